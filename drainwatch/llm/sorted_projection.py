"""Embedding near-duplicates by sorted projection passes.

A pass draws random hyperplanes, writes the sides a vector lies on as one number (the concatenated hashes) and sorts the vectors of each label by it.
Vectors of small angle share long beginnings of that number and come to stand near each other; each is compared with its neighbours of the sorted order, and the
pairs of enough cosine are united across passes.  Vectors are hashed as they lie about their label's mean, as vectors of a common direction would crowd on a few numbers.
Passes come in rounds.  The passes of a round follow from the labels' sizes and means, such that a pair right at the limit meets with probability ``recall`` where a label's vectors
are spread evenly about their mean; where they are not, further rounds of other planes follow until one unites nothing new.  The sorted order is cut by ranges, not by labels, so one label may hold most of the rows; ties are spread by a hash.

A window shows some links of a dense group, enough to find its members.  All links inside each found component are then counted exactly, block against block, so
neither copies nor dense groups lose links to the window's bound, and no pair of them is ever written out.

Vectors with a null label, null, of length or norm 0, or with null or non-finite components link with nothing; vectors of different length are never compared.  A null vec_id
links with nothing and is kept.  Equal vectors are one vector with a count; rows that repeat a vec_id count as vectors of their own and belong to one component.
An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.llm.common import fresh, settle, table
from drainwatch.llm.components import components, linked

BITS = 48
# Cosine about the mean for which a round's passes are reckoned, at least.
LEAST_ABOUT = 0.7
# Sums of labels that a task holds, at most.
HELD = 4096


@dataclass(frozen=True)
class Passes:
    least: float = 0.93
    window: int = 128  # a vector is compared with 128 to 255 vectors before it
    recall: float = 0.999
    block: int = 256  # rows of one block when a component's links are counted
    seed: int = 9


def passes_for(largest: int, how: Passes, common: float = 0.0) -> int:
    """So many passes that two vectors of cosine ``least`` share a window at least once with probability ``recall``.

    common: the mean cosine of the label's vectors.  About their mean the two are less alike; below ``LEAST_ABOUT`` rounds make up for it.
    """
    bits = max(0.0, math.log2(max(1, largest) / how.window))
    about = max((how.least - common) / (1 - common), min(LEAST_ABOUT, how.least)) if common < how.least else min(LEAST_ABOUT, how.least)
    once = (1 - math.acos(about) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - how.recall) / math.log(1 - min(once, 0.99))))


def hashes(vectors: list, centres: list, passes: int, seed: int, first: int) -> list[list[int]]:
    """One number per vector and pass (from the pass ``first`` on); vectors may differ in length."""
    out: list = [None] * len(vectors)
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    for dim, rows in by.items():
        x = units([vectors[i] for i in rows]) - np.array([np.asarray(centres[i], np.float64) for i in rows])
        codes = []
        for p in range(first, first + passes):
            planes = np.random.default_rng([seed, dim, p]).standard_normal((dim, BITS))
            codes.append((x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)))
        for i, c in zip(rows, np.array(codes).T.tolist(), strict=True):
            out[i] = c
    return out


def units(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)  # else squares of very small or large components leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def partial_sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(_key, _dim, n, sums) of the unit vectors of each label, one row per task and label."""
    held: dict[tuple, list] = {}

    def rows() -> pd.DataFrame:
        out = pd.DataFrame([(*k, n, x.tolist()) for k, (n, x) in held.items()], columns=["_key", "_dim", "n", "sums"])
        held.clear()
        return out

    for part in parts:
        for (key, dim), own in part.groupby(["_key", "_dim"], sort=False):
            n, x = held.get((key, dim), (0, 0.0))
            held[key, dim] = (n + len(own), x + units(own["_vector"].tolist()).sum(0))
        if len(held) > HELD:
            yield rows()
    if held:
        yield rows()


def label_centres(classes: DataFrame) -> DataFrame:
    """(_key, _dim, n, centre, common) of each label: the mean of its unit vectors, and their mean cosine."""
    sums = classes.select("_key", "_dim", "_vector").mapInPandas(partial_sums, "_key long, _dim int, n long, sums array<double>")
    # Rows are per task and label; their components add up before the shuffle.
    each = sums.select("_key", "_dim", "n", F.posexplode("sums").alias("_at", "x")).groupBy("_key", "_dim", "_at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = (F.col("x") / F.col("n")).cast("float")
    placed = each.groupBy("_key", "_dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_at", mean.alias("x")))).alias("_all"), F.sum(mean * mean).alias("common"))
    return placed.select("_key", "_dim", "n", F.transform("_all", lambda a: a["x"]).alias("centre"), "common")


def neighbour_links(parts: Iterator[pd.DataFrame], how: Passes) -> Iterator[pd.DataFrame]:
    """Walk a sorted part, each block of ``window`` rows against itself and the block before it."""
    before, waiting = None, None

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        both = block if before is None else pd.concat([before, block])
        out = []
        for _, own in both.groupby(["_pass", "_label", "_dim"], sort=False):
            if len(own) > 1:
                x, ids = units(own["_vector"].tolist()), own["id"].to_numpy(np.int64)
                out += linked(ids, x @ x.T >= how.least)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    for part in parts:
        waiting = part if waiting is None else pd.concat([waiting, part])
        while len(waiting) >= how.window:
            block, waiting = waiting.iloc[: how.window], waiting.iloc[how.window :]
            yield compare(block)
            before = block
    if waiting is not None and len(waiting):
        yield compare(waiting)


def counted_links(rows: pd.DataFrame, how: Passes) -> pd.DataFrame:
    """One pair of blocks of a component: for each class, the vectors of the other block that it links with."""
    out = []
    for _, same in rows.groupby("_dim", sort=False):
        first, second = same[same["_left"]], same[~same["_left"]]
        alone = len(second) == 0 and bool((same["_i"] == same["_j"]).all())
        if alone:
            second = first
        if not len(first) or not len(second):
            continue
        near = units(first["_vector"].tolist()) @ units(second["_vector"].tolist()).T >= how.least
        if alone:
            np.fill_diagonal(near, False)
        out.append(pd.DataFrame({"_class": first["_class"], "n": near @ second["_times"].to_numpy(np.int64)}))
        if not alone:
            out.append(pd.DataFrame({"_class": second["_class"], "n": near.T @ first["_times"].to_numpy(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"_class": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})


def near_vectors(rows: DataFrame, how: Passes = Passes()) -> DataFrame:
    """rows: vec_id, embedding, label and more.  Adds n_links, component_id and kept."""
    rows = fresh(rows, "n_links", "component_id", "kept", "_label", "_vector")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    merged = usable.groupBy(F.col("label").alias("_label"), F.col("embedding").alias("_vector")).agg(F.min("vec_id").cast("long").alias("id"), F.count(F.lit(1)).alias("_times"))
    classes = settle(merged.withColumns({"_dim": F.size("_vector"), "_class": F.xxhash64("_label", "_vector", "id"), "_key": F.xxhash64("_label")}), "vectors")

    centres = settle(label_centres(classes), "label-centres")
    reckoned = F.udf(lambda n, common: passes_for(n, how, common), "int")
    # Labels of a window or less need one pass or two, whatever their mean.
    most = centres.filter(F.col("n") > how.window).agg(F.max(reckoned("n", "common"))).first()[0]
    passes = max(passes_for(1, how), most or 0)
    parts = max(1, math.ceil(classes.count() * passes / 20_000))
    about = classes.join(centres.select("_key", "_dim", "centre"), ["_key", "_dim"])
    order = ["_pass", "_label", "_dim", "_code", "_tie"]

    def pairs(first: int) -> DataFrame:
        @F.pandas_udf("array<long>")
        def codes(vectors: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series(hashes(vectors.tolist(), own.tolist(), passes, how.seed, first))

        placed = about.select("id", "_label", "_dim", "_vector", F.posexplode(codes("_vector", "centre")).alias("_pass", "_code")).withColumn("_tie", F.xxhash64("id", "_pass"))
        ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return ordered.mapInPandas(lambda it: neighbour_links(it, how), "a long, b long")

    # Rows of one id are one node, whatever vectors they hold.
    groups, first, united = settle(components(pairs(0)), "vector-components"), 0, 0
    while (now := groups.filter("id <> component_id").count()) > united:
        united, first = now, first + passes
        groups = settle(components(pairs(first).union(groups.select("id", "component_id"))), "vector-components")

    # All links inside the components: classes are dealt to blocks by hash, and every two blocks of a component meet once.
    inside = classes.join(groups, "id")
    blocks = inside.groupBy("component_id").agg(F.ceil(F.count(F.lit(1)) / how.block).cast("int").alias("_blocks"))
    dealt = inside.join(blocks, "component_id").withColumn("_own", F.pmod(F.xxhash64("_class"), F.col("_blocks")).cast("int"))
    meet = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "component_id", F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"), (F.col("_own") <= F.col("_with")).alias("_left"), "_class", "_dim", "_times", "_vector"
    )
    counts = meet.groupBy("component_id", "_i", "_j").applyInPandas(lambda own: counted_links(own, how), "_class long, n long").groupBy("_class").agg(F.sum("n").alias("n"))

    known = classes.join(groups, "id", "left").join(counts, "_class", "left")
    known = known.select("_label", "_vector", (F.col("_times") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = rows.join(known, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_vector")) & F.col("vec_id").isNotNull(), "left").drop("_label", "_vector")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", F.col("vec_id").cast("long"))})
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON e.vec_id = c.id LEFT JOIN degree d ON d.a = e.vec_id
"""
