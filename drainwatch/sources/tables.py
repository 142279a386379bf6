"""Tables kept between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_features(ft: DataFrame, path: str) -> None:
    """The feature table of one capture, read by every report."""
    ft.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_routed(routed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parsed frames by type, so that each type's normalization opens its own folder only.

    Parsing text is the dear part of the work: done once, whatever reads the types later.
    """
    good = routed.filter("reason is null")
    good.select(*[c for c in good.columns if c not in ("value", "type")], "type").write.mode(mode).partitionBy("type").parquet(path)


def read_routed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
