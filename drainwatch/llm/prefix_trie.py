"""The trie of all conversations by a splitter skeleton.

A node is a distinct sequence of first turns (role and text).  A conversation becomes a path: a 128-bit digest for each turn, one after the other, so that the byte order of paths is the order of the
trie.  Splitters from a sample cut that order, (path, conv_id), into shards, and the trie of the splitter paths is broadcast: the skeleton.  Only a node on a splitter's path can have members in two
shards, because all paths between two that begin alike begin so too.  Every other node lies whole in one shard, where a scan of the sorted paths with a stack finishes it.  Of the skeleton nodes each shard
gives partial aggregates, which are added up by a reduction; the few skeleton nodes are then linked.

Copies of one conversation that fill several shards make their whole path part of the skeleton, so no shard has to hold them all.  The splitters are cut to the first turn that tells them from
the sample before (at most ``DEPTH`` turns), so the skeleton holds at most shards x DEPTH nodes.  The conversations that end at a skeleton node go as chunks of text, in order, through one stream per node;
nothing is held but the state of the hash.  Shards are sorted with spilling; a scan holds the open path and the finished children of its nodes, at most the nodes of one shard.

Turns come by turn number (null first), then digest; null roles and texts are empty; repeated rows are turns of their own.  Rows without a conv_id belong to no conversation and are left out.  An empty
table has no nodes.  Texts are digested where they are read, so very long ones are never shuffled.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import crc32_sql, settle, table

# Bytes of a turn's digest.
TURN = 16
# Turns of a splitter, at most, and sampled paths for each shard.
DEPTH = 256
SAMPLED = 8
# Conversations of a shard, and the most shards (splitters are broadcast: at most SHARDS x DEPTH x TURN bytes).
ROWS = 100_000
SHARDS = 4096
# Ids in one chunk, rows in one batch of a scan's output.
CHUNK = 50_000
OUT_ROWS = 5_000
NODE = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SCAN = NODE + ", node_key string, parent_key string, chars long, shard int, chunk int, ends string"
DONE, PARTIAL, ENDS = range(3)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def key_of(prefix: bytes) -> str:
    return hashlib.md5(prefix).hexdigest()


def splitters(paths: DataFrame, shards: int, rows: int) -> list[tuple[bytes, int]]:
    """At most shards - 1 lower ends of shards.  The sample is bounded: SAMPLED rows a shard are expected, of DEPTH turns each at most."""
    if shards < 2:
        return []
    share = min(1.0, SAMPLED * shards / rows)
    chosen = paths.filter(F.pmod(F.xxhash64("conv_id", F.lit(12)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sorted((bytes(p), i) for p, i in chosen.select(F.substring("path", 1, TURN * DEPTH), "conv_id").collect())
    out = []
    for n in sorted({k * len(sample) // shards for k in range(1, shards)} - {0}):
        (before, _), (path, conv) = sample[n - 1], sample[n]
        if before == path:
            out.append((path, conv))
        else:
            out.append((path[: len(commonprefix([before, path])) // TURN * TURN + TURN], -(1 << 63)))
    return sorted(set(out))


class Node:
    __slots__ = ("depth", "key", "chars", "n", "least", "children", "leaves", "saved", "sha", "ids", "pending")

    def __init__(self, depth: int, key: str | None, chars: int):
        self.depth, self.key, self.chars = depth, key, chars
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        # A finished node hashes its own ends; a skeleton node (key) hands them on.
        self.sha = None
        self.ids: list[str] = []
        self.pending: list[tuple] = []


class Scan:
    """One shard, in order.  ``around``: the splitter paths at its two ends."""

    def __init__(self, shard: int, around: list[bytes]):
        self.shard, self.around, self.chunk = shard, around, 0
        self.path, self.stack, self.out = b"", [], []

    def add(self, path: bytes, chars: list[int], conv: int) -> None:
        if not self.stack:
            self.stack = [Node(0, key_of(b""), 0)]
        same = len(commonprefix([self.path, path])) // TURN
        while len(self.stack) - 1 > same:
            self.close()
        fixed = max([len(commonprefix([a, path])) // TURN for a in self.around], default=0)
        for d in range(len(self.stack), len(path) // TURN + 1):
            self.stack.append(Node(d, key_of(path[: d * TURN]) if d <= fixed else None, int(chars[d - 1])))
        self.path = path
        top = self.stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        top.ids.append(str(conv))
        if len(top.ids) >= CHUNK:
            self.flush(top)

    def flush(self, node: Node) -> None:
        if not node.ids:
            return
        text, node.ids = ",".join(node.ids), []
        if node.key is not None:
            self.out.append((ENDS, None, node.depth, None, None, None, None, None, None, node.key, None, None, self.shard, self.chunk, text))
            self.chunk += 1
        elif node.sha is None:
            node.sha = hashlib.sha256(text.encode())
        else:
            node.sha.update(("," + text).encode())

    def close(self) -> None:
        node = self.stack.pop()
        self.flush(node)
        up = self.stack[-1] if self.stack else None
        if node.key is not None:
            self.out.append((PARTIAL, node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, None, node.key, up and up.key, node.chars, self.shard, None, None))
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.chars
            self.out.extend((DONE, *row[:2], node.least, *row[2:], None, None, None, self.shard, None, None) for row in node.pending)
            row = (node.least, node.depth, node.n, node.children, node.leaves, node.saved, node.sha.hexdigest() if node.sha else NO_ENDS)
            if up.key is None:
                up.pending.append(row)
            else:
                self.out.append((DONE, *row[:2], None, *row[2:], None, up.key, None, self.shard, None, None))
            up.children += 1
        if up:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.leaves += node.leaves
            up.saved += node.saved

    def finish(self) -> None:
        while self.stack:
            self.close()


def _frame(rows: list[tuple], schema: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=object) for k, name in enumerate(schema)})


def scan_shards(ends: list[tuple[bytes, int]]):
    names = [c.split()[0] for c in SCAN.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Scan | None = None
        for batch in batches:
            for shard, path, chars, conv in zip(batch["shard"], batch["path"], batch["chars"], batch["conv_id"], strict=True):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.finish()
                        yield _frame(now.out, names)
                    now = Scan(int(shard), [ends[k][0] for k in (shard - 1, shard) if 0 <= k < len(ends)])
                now.add(bytes(path), chars, int(conv))
                if len(now.out) >= OUT_ROWS:
                    yield _frame(now.out, names)
                    now.out = []
        if now is not None:
            now.finish()
            yield _frame(now.out, names)

    return scan


def link_skeleton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums below each skeleton node, from the deepest up.  One task: at most SHARDS x DEPTH nodes."""
    nodes = {r["node_key"]: r for batch in batches for r in batch.to_dict("records")}
    for r in nodes.values():
        r["kids"] = int(r["n_children"])
    for r in nodes.values():
        if r["parent_key"] in nodes:
            nodes[r["parent_key"]]["kids"] += 1
    # The partial sums hold all finished nodes below; what skeleton nodes add themselves goes up from node to node.
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        r["more_leaves"] = r.get("more_leaves", 0) + (r["kids"] == 0)
        r["more_saved"] = r.get("more_saved", 0) + (int(r["n_convs"]) - 1) * int(r["chars"])
        up = nodes.get(r["parent_key"])
        if up:
            for name in ("more_leaves", "more_saved"):
                up[name] = up.get(name, 0) + r[name]
    rows = [(r["node_key"], r["conv_id"], r["depth"], nodes[r["parent_key"]]["conv_id"] if r["parent_key"] in nodes else None, r["n_convs"], r["kids"], int(r["n_leaves"]) + r["more_leaves"], int(r["saved_tokens"]) + r["more_saved"]) for r in nodes.values()]
    yield _frame(rows, LINKED)


LINKED = ["node_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks sorted by node and place become one hash per node."""
    key, sha = None, None
    for batch in batches:
        for k, text in zip(batch["node_key"], batch["ends"], strict=True):
            if k == key:
                sha.update(("," + text).encode())
                continue
            if key is not None:
                yield pd.DataFrame({"node_key": [key], "ends_sha256": [sha.hexdigest()]})
            key, sha = k, hashlib.sha256(text.encode())
    if key is not None:
        yield pd.DataFrame({"node_key": [key], "ends_sha256": [sha.hexdigest()]})


def trie(paths: DataFrame) -> DataFrame:
    """``paths``: output of ``as_paths``, written.  One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    rows = paths.count()
    shards = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS + 1))
    ends = splitters(paths, shards, max(rows, 1))
    sent = spark.sparkContext.broadcast(ends)

    def shard_of(path: pd.Series, conv: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(sent.value, (bytes(p), c)) for p, c in zip(path, conv, strict=True)], dtype="int32")

    dealt = paths.withColumn("shard", F.pandas_udf(shard_of, "int")("path", "conv_id")).repartitionById(len(ends) + 1, F.col("shard"))
    scanned = settle(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInPandas(lambda b: scan_shards(sent.value)(b), SCAN), "trie-scan")

    total = lambda c: F.sum(c).alias(c)
    parts = scanned.filter(F.col("kind") == PARTIAL).groupBy("node_key", "parent_key", "depth", "chars").agg(F.min("conv_id").alias("conv_id"), *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    linked_type = "node_key string, " + ", ".join(f"{c} long" for c in LINKED[1:])
    linked = parts.repartition(1).mapInPandas(link_skeleton, linked_type)
    chunks = scanned.filter(F.col("kind") == ENDS).select("node_key", "shard", "chunk", "ends").repartition("node_key").sortWithinPartitions("node_key", "shard", "chunk")
    hashes = chunks.mapInPandas(hash_ends, "node_key string, ends_sha256 string")
    skeleton = settle(linked.join(hashes, "node_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "trie-skeleton")

    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # Bounded like the skeleton: at most SHARDS x DEPTH short rows.
    above = F.broadcast(skeleton.select(F.col("node_key").alias("_key"), F.col("conv_id").alias("_above")))
    done = scanned.filter(F.col("kind") == DONE).join(above, F.col("parent_key") == F.col("_key"), "left")
    return done.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above")).select(*result).union(skeleton.select(*result))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the digest and the code points of each turn, in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", digest.alias("digest"), F.length(text).alias("chars")).alias("_turn"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("turns"))


def as_paths(lists: DataFrame) -> DataFrame:
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def share_openings(lists: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % block; h is a hash of c below ``most``.

    A conversation of which others take the opening is looked up by at most 2 * block - 1 of them, with at most most - 1 of its turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = lists.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_of"), F.slice("turns", 1, most - 1).alias("_head"))
    joined = lists.withColumn("_h", h).join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("_of"), "left")
    head = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), F.col("_h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("_h")))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(settle(as_paths(share_openings(turn_lists(table(spark, sf_dir, "conversations")))), "trie-paths"))


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars, turn
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS n FROM turns),
convs AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM numbered) q),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.n, t.digest, t.chars FROM convs c JOIN numbered t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.n <= c.h
  UNION ALL SELECT c.conv_id, 1, t.n, t.digest, t.chars FROM convs c JOIN numbered t ON t.conv_id = c.conv_id AND t.n > c.h),
lists AS (SELECT conv_id, list(digest ORDER BY part, n) AS path, list(chars ORDER BY part, n) AS sizes FROM rebuilt GROUP BY conv_id),
whole AS (SELECT c.conv_id, coalesce(array_to_string(path, ''), '') AS path, sizes, coalesce(len(path), 0) AS depth FROM convs c LEFT JOIN lists USING (conv_id)),
members AS (SELECT conv_id, depth, sizes, d, substr(path, 1, 32 * d) AS path FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM whole) q),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = d), '')) AS ends,
    coalesce(max(CASE WHEN d > 0 THEN sizes[d] END), 0) AS chars, CASE WHEN d > 0 THEN substr(path, 1, 32 * (d - 1)) END AS above FROM members GROUP BY d, path),
kids AS (SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes LEFT JOIN kids ON kids.above = nodes.path),
below AS (SELECT substr(path, 1, 32 * k) AS path, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own) q GROUP BY substr(path, 1, 32 * k))
SELECT o.conv_id, o.d::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, o.n_children::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN below b ON b.path = o.path LEFT JOIN nodes p ON p.path = o.above
"""
