import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from drainwatch.llm.turn_repair import damage, plan, repair, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def brute(codes):
    """The least (cost, edits) over all paths of at most three inserts in a row."""

    @lru_cache(None)
    def go(i, said, inserts):
        done = re.fullmatch("(s?(ua)+)?", said) and i == len(codes)
        found = [(0, "")] if done else []
        ways = []
        if inserts < 3:
            ways += [("I", 2, i, said + r, inserts + 1) for r in "ua"]
        if i < len(codes):
            c = codes[i]
            ways.append(("D", 3, i + 1, said, 0))
            if c != "d":
                ways.append(("K", int(c.isupper()), i + 1, said + c.lower(), 0))
                ways += [("R", 2 + c.isupper(), i + 1, said + r, 0) for r in "ua"]
        for edit, cost, j, now, k in ways:
            if re.fullmatch("(s?(ua)*u?)?", now):
                # Only the last letter matters from here.
                rest = go(j, now[-1:] if now[-1:] != "a" else "ua", k)
                if rest:
                    found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    return go(0, "", 0)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_search_against_all_paths(block):
    for n in range(5):
        for codes in itertools.product("suaxdSUA", repeat=n):
            assert repair("".join(codes), block) == brute("".join(codes))


def test_long_conversations():
    rng = random.Random(2)
    codes = "".join(rng.choices("uauauauasxdSUAX", k=3000))
    assert repair(codes, 64) == repair(codes)
    cost, audit = repair(codes)
    assert len(audit.replace("I", "")) == 3000
    roles = "".join({"user": "u", "assistant": "a"}.get(role) or codes[row].lower() for row, role in plan(codes, audit))
    assert re.fullmatch("(s?(ua)+)?", roles)
    spent = {"I": 2, "R": 2, "D": 3, "K": 0}
    kept = [e for e in audit if e != "I"]
    assert cost == sum(spent[e] for e in audit) + sum(c.isupper() and e != "D" for c, e in zip(codes, kept, strict=True))


def expected(conv, rows):
    """Damage and repair of one conversation in plain Python."""
    fill = lambda v: " " if v is None else v
    out = []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, fill(r[1]), fill(r[2]))):
        role, text = fill(role), fill(text)
        kind = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20
        role, text = ("user" if kind == 4 else role), ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    counts, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", set()
    for _, role, text in out:
        ink = text.strip(" \t\n\v\f\r")
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        codes += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    cost, audit = brute(codes)
    text = "\n".join(f"{role or out[row][1]}:{'' if row is None else out[row][2]}" for row, role in plan(codes, audit))
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def test_damaged_rows_against_plain_python(spark):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "", "User", None], ["Yes.", "No", " \n", "", None, "What? ", "…", "a.b"]
    convs = {conv: [(rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(roles[:2] * 4 + roles), rng.choice(texts)) for _ in range(rng.randint(1, 9))] for conv in [*range(-3, 150), None]}
    rows = [(c, *r, "extra") for c, all_ in convs.items() for r in all_]
    whole = repair_conversations(damage(spark.createDataFrame(rows, SCHEMA)))
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    got = {r[0]: tuple(r[1:]) for r in whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(shown, 256)).collect()}
    assert set(got) == set(convs)
    for c, all_ in convs.items():
        assert got[c] == expected(c, all_)


def test_edges(spark):
    assert repair_conversations(damage(spark.createDataFrame([], SCHEMA))).count() == 0
    # Undamaged rows, a very long text, and a column of a name that the operator makes.
    rows = [(1, 0, "user", "word " * 200_000, "x"), (1, 1, "assistant", "Done.", "x")]
    r = repair_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r["truncated"], r["cost"], r["audit"], len(r["messages"][0]["text"])) == (1, 1, "KK", 1_000_000)
