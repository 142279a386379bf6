"""Connected components of links between documents, by alternating large and small stars.

Every round replaces the links of a node by links to the least node it knows; the links end as one star per component.  Least nodes
are found by aggregates that combine before the shuffle, so a node with very many links is no burden to one task.  Rounds are written
to the shared folder; nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drainwatch.llm.common import settle


def linked(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """The components of a small neighbour matrix as (id, least id)."""
    low = ids.copy()
    near = near | np.eye(len(ids), dtype=bool)
    while True:
        new = np.where(near, low[None, :], np.iinfo(np.int64).max).min(1)
        if (new == low).all():
            return [(int(a), int(b)) for a, b in zip(ids, low, strict=True) if b < a]
        low = new


def _round(links: DataFrame) -> DataFrame:
    """links: (u, v) with v < u."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("m", "w").alias("m"))
    large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.union(least.filter("m < w").select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
    down = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    small = large.join(down, F.col("u") == F.col("w")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(down.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), whole numbers, any order, repeats allowed.  Returns (id, component_id) of every node that has a link to another."""
    now = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    state = None
    while True:
        # Stars are reached when a round changes nothing.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == state or mark[0] == 0:
            break
        state, now = mark, settle(_round(now), "links")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
