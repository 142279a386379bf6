"""Deduplication of typed events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.operators.select import newest_per_key
from drainwatch.plans.normalize import CONTROL_TYPES

NOT_CONTENT = ("origin", "received_at_ms", "arrival", "type", "inexact")
INSTRUCTION = ("signature", "ix_index", "inner_ix_index")


def content_hash(columns: list[str]) -> Column:
    """One hash of the whole content, in a fixed column order; origin and receive time left out."""
    kept = [c for c in columns if c not in NOT_CONTENT]
    return F.sha1(F.to_json(F.struct(*kept)))


def _joined(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def dedup_key(ev: DataFrame, kind: str) -> DataFrame:
    """Add ``key``.  A single swap instruction is reported once per side, so the mint belongs to it."""
    if kind in ("swap", "transfer", "token_create", "pool_create"):
        key = _joined(*INSTRUCTION, "mint")
    elif kind == "liquidity":
        key = _joined(*INSTRUCTION, "base_mint")
    elif kind == "graduation":
        key = _joined("mint", "slot")
    elif kind in CONTROL_TYPES:
        key = F.lit(None).cast("string")
    else:
        key = content_hash(ev.columns)
    return ev.withColumn("key", key)


def dedup_exact(ev: DataFrame, order: list[str], key: str = "key") -> DataFrame:
    """First arrival wins per (type, key); rows without a key are all kept.

    ``row_number() = 1`` is applied before the shuffle too, so a key repeated a billion times
    sends one row per task.
    """
    keyed = newest_per_key(ev.filter(F.col(key).isNotNull()), ["type", key], [F.asc(c) for c in order], 1)
    return keyed.unionByName(ev.filter(F.col(key).isNull()))


def ingest_counters(ev: DataFrame, key: str = "key") -> DataFrame:
    """Per type: received, duplicates, delivered."""
    per_key = ev.groupBy("type", key).agg(F.count(F.lit(1)).alias("_n"))
    extra = F.when(F.col(key).isNotNull(), F.col("_n") - 1).otherwise(0)
    return per_key.groupBy("type").agg(
        F.sum("_n").alias("received"), F.sum(extra).alias("duplicates"), F.sum(F.col("_n") - extra).alias("delivered")
    )


def key_collision_report(ev: DataFrame, candidates: dict[str, list[str]], content: Column) -> DataFrame:
    """For each candidate key, how many different contents it would have merged."""
    parts = []
    for name, columns in candidates.items():
        pairs = ev.select(_joined(*columns).alias("_k"), content.alias("_h")).groupBy("_k", "_h").count()
        merged = pairs.groupBy("_k").agg((F.count(F.lit(1)) - 1).alias("_x"))
        parts.append(merged.agg(F.sum("_x").alias("collisions")).select(F.lit(name).alias("candidate"), "collisions"))
    return reduce(DataFrame.unionByName, parts)
