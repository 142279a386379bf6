"""Lifetimes of keys between silences, as one fold.

A lifetime ends with a silence longer than the long limit, or longer than the short one while nothing in it has been marked yet.  Within a bucket no longer than the short limit no lifetime can end, so a
bucket acts on the state like a single event that lasts: a summary (first and last second, events, marked) per (key, bucket), which combines before the shuffle, says all.  Lifetimes are then a fold of
the summaries in order: the input is read once, and a key has as many summaries as there are buckets in which it was active, however many events it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def activity(rows: DataFrame, key: str, at: str, marks: Column, width: int) -> DataFrame:
    """One row per (key, bucket): start_s, end_s, events, marked.  A bucket holds the seconds over (bucket - 1) * width up to bucket * width."""
    bucket = F.ceil(F.col(at) / width).cast("bigint")
    return rows.groupBy(key, bucket.alias("bucket")).agg(
        F.min(at).alias("start_s"), F.max(at).alias("end_s"), F.count(F.lit(1)).alias("events"), F.max(F.coalesce(marks, F.lit(False))).alias("marked")
    )


def lifetimes(active: DataFrame, key: str, short_s: int, long_s: int) -> DataFrame:
    """``active``: output of ``activity`` with a width of at most ``short_s``.  (key, session, start_s, end_s, events, marked), sessions numbered from 0."""
    along = Window.partitionBy(key).orderBy("bucket")
    gap = F.col("start_s") - F.lag("end_s").over(along)
    steps = active.repartition(key).withColumn("_gap", gap)
    over = lambda limit: F.coalesce(F.col("_gap") > limit, F.lit(False))
    steps = steps.withColumn("_segment", F.sum(over(long_s).cast("int")).over(along))
    # Between long silences only unmarked time can break, and a mark lasts until the next long silence.
    inside = Window.partitionBy(key, "_segment").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_was", F.coalesce(F.max("marked").over(inside), F.lit(False)))
    breaks = over(long_s) | (over(short_s) & ~F.col("_was"))
    numbered = steps.withColumn("session", F.sum(breaks.cast("bigint")).over(along))
    return numbered.groupBy(key, "session").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("events").alias("events"), F.max("marked").alias("marked")
    )
