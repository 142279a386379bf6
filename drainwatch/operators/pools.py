"""Running totals over the pools of a token, in one step.

A token's value is the sum of each pool's latest reading.  The order is cut into buckets (an hour of chain time), and a summary per (token, bucket, pool), its latest reading, combines before the
shuffle.  From the summaries alone follow what each pool held before a bucket and what all pools held together.  Both join the bucket's rows as rows in front of them, so that two windows
over (token, bucket) finish the work on rows that are shuffled once.  The input is read twice, once for the summaries and once for the rows, whatever the size of a token.

The summaries of one token, a row for each hour and pool in which it traded, pass through one task; its readings do not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drainwatch.operators.running import BUCKET, FRONT, HOUR, bucket_of

TOTAL = "decimal(38,6)"


@dataclass(frozen=True)
class Held:
    """One total: ``col`` is what a reading adds to it (null: the reading changes nothing), ``peak`` the column of which the largest so far is kept under ``peak_name``."""

    name: str
    col: str
    peak: str | None = None
    peak_name: str | None = None


def pool_totals(rows: DataFrame, key: str, pool: str, order: str, held: list[Held], width: int = HOUR, summed: DataFrame | None = None) -> DataFrame:
    """Add, after every row, the total and the peak of each ``held``.  A reading replaces its pool's contribution.  ``order`` must identify a row within its key.

    ``summed``: what the summaries are made of, where that is cheaper to read than ``rows`` (it may hold further keys).  The contributions of a row are all null or all set: a reading without a value changes none.  The result is partitioned by (key, BUCKET) and keeps BUCKET.
    """
    rows = rows.withColumn(BUCKET, bucket_of(rows, order, width))
    now = F.struct(*[F.col(h.col).cast(TOTAL).alias(h.name) for h in held])
    priced = F.col(held[0].col).isNotNull()
    peaks = [h for h in held if h.peak]
    source = rows if summed is None else summed.withColumn(BUCKET, bucket_of(summed, order, width))
    ends = source.groupBy(key, BUCKET, pool).agg(F.max_by(now, F.when(priced, F.col(order))).alias("_end"), *[F.max(h.peak).alias(f"_peak_{h.name}") for h in peaks])

    # One row per key, bucket and pool from here to the fronts.
    by_pool = Window.partitionBy(key, pool).orderBy(BUCKET)
    before = ends.repartition(key).withColumn("_prev", F.last("_end", ignorenulls=True).over(by_pool.rowsBetween(Window.unboundedPreceding, -1)))
    part = lambda column, h: F.coalesce(F.col(f"{column}.{h.name}"), F.lit(0).cast(TOTAL))
    grown = before.select("*", *[F.when(F.col("_end").isNotNull(), part("_end", h) - part("_prev", h)).cast(TOTAL).alias(f"_grown_{h.name}") for h in held])
    along = Window.partitionBy(key).orderBy(BUCKET)
    earlier = along.rangeBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(key, BUCKET).orderBy(pool)) == 1
    fronts = grown.select(
        key, BUCKET, pool, F.col("_prev").alias("_now"), first.alias("_first"), F.lit(0).alias(FRONT),
        *[F.sum(f"_grown_{h.name}").over(earlier).cast(TOTAL).alias(f"_base_{h.name}") for h in held],
        *[F.max(f"_peak_{h.name}").over(earlier).alias(f"_peak_{h.name}") for h in peaks],
    ).select(
        key, BUCKET, pool, "_now", FRONT, *[F.when(F.col("_first"), F.col(f"_base_{h.name}")).alias(f"_base_{h.name}") for h in held], *[f"_peak_{h.name}" for h in peaks]
    )

    own = rows.select("*", F.when(priced, now).alias("_now"), F.lit(1).alias(FRONT), *[F.col(h.peak).alias(f"_peak_{h.name}") for h in peaks])
    both = own.unionByName(fronts, allowMissingColumns=True).repartition(key, BUCKET)
    of_pool = Window.partitionBy(key, BUCKET, pool).orderBy(FRONT, order).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_was", F.last("_now", ignorenulls=True).over(of_pool))
    change = lambda h: F.when(F.col(FRONT) == 0, F.col(f"_base_{h.name}")).when(F.col("_now").isNotNull(), part("_now", h) - part("_was", h)).cast(TOTAL)
    changed = seen.select("*", *[change(h).alias(f"_change_{h.name}") for h in held])
    so_far = Window.partitionBy(key, BUCKET).orderBy(FRONT, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = changed.select(
        "*", *[F.coalesce(F.sum(f"_change_{h.name}").over(so_far), F.lit(0).cast(TOTAL)).cast(TOTAL).alias(h.name) for h in held],
        *[F.max(f"_peak_{h.name}").over(so_far).alias(h.peak_name) for h in peaks],
    )
    return totals.filter(F.col(FRONT) == 1).select(*rows.columns, *[h.name for h in held], *[h.peak_name for h in peaks])
