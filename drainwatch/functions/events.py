"""Small predicates and columns over typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.params import TRACKED_TYPES

POSITION = ("block_time_s", "slot", "tx_index", "ix_index", "inner_ix_index")


def tracked_filter(ev: DataFrame) -> DataFrame:
    """Only the event types that feed state."""
    return ev.filter(F.col("type").isin(*TRACKED_TYPES))


def derive_origin(catchup: Column, backfill: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(catchup), "catchup").when(yes(backfill), "backfill").otherwise("realtime")


def tx_position() -> Column:
    """Where on the chain an event happened; compares part by part."""
    return F.struct(*POSITION)


def time_position() -> Column:
    """Events without a transaction sort before every transaction of their second."""
    low = F.lit(-2).cast("bigint")
    return F.struct("block_time_s", *[low.alias(p) for p in POSITION[1:]])
