"""Row selection by order: first crossing, newest n per key, report top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_crossing(df: DataFrame, keys: list[str], order: list[str], predicate: Column | None = None) -> DataFrame:
    """The first row per key that satisfies the predicate.

    ``min_by`` over the whole row combines on the map side, so a hot key costs one row per task.
    """
    rows = df if predicate is None else df.filter(predicate)
    rest = [c for c in df.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in ``order``.

    Spark turns ``row_number() <= n`` into a limit per key on both sides of the shuffle, so no
    more than n rows per key and task travel (for n up to the session's group-limit threshold).
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n).drop("_rn")


def tally(df: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    """Counts per key, largest first."""
    column = F.col(key) if isinstance(key, str) else key
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)
