import hashlib
import random
import zlib

import pytest

from drainwatch.llm.common import settle
from drainwatch.llm.prefix_trie import as_paths, share_openings, trie, turn_lists

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        of = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(of, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {}
    for path, ids in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(path))
        out[min(ids), len(path)] = (min(members[path[:-1]]) if path else None, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (None, 1, "user", "lost")]
    for conv in [*range(-20, 230), 1000, 1007]:
        n = rng.choice([1, 1, 2, 3, 6, 9])
        rows += [(conv, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé😀", "", None])) for t in range(n)]
    # Copies of one conversation, a third of all.
    for conv in range(2000, 2120):
        rows += [(conv, t, "user", "same") for t in range(7)]
    return rows + rows[5:9]


@pytest.mark.parametrize("shards", [1, 4, 60])
def test_against_brute_force(spark, shards):
    rows = corpus(shards)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        paths = settle(as_paths(share_openings(turn_lists(spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)))), "paths")
        got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in trie(paths).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute(rebuilt(rows))


def test_plain_tries(spark):
    build = lambda rows: trie(settle(as_paths(turn_lists(spark.createDataFrame(rows, SCHEMA))), "paths")).collect()
    assert build([]) == []
    assert build([(None, 0, "user", "x", "")]) == []
    # One very long conversation with a very long text, and one that is its beginning.
    long_one = [(1, t, "user", "long " * 50_000 if t == 0 else f"t{t}", "") for t in range(400)]
    got = {(r["conv_id"], r["depth"]): r for r in build(long_one + [(2, 0, "user", "long " * 50_000, "")])}
    assert len(got) == 401
    assert got[1, 1]["n_convs"] == 2 and got[1, 1]["n_leaves"] == 1 and got[1, 0]["saved_tokens"] == 250_000
    assert got[1, 1]["ends_sha256"] == hashlib.sha256(b"2").hexdigest()
