"""What the training-data operators share: tables, words, and session settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.session import prepare, settle, shared_dir  # noqa: F401

# A word is a run of characters other than the six ASCII white-space characters (also in Java's and DuckDB's dialects).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
# Rows of one Arrow batch: a batch of very long texts must fit a Python worker.
BATCH_ROWS = 500
# Words of the bitmap that ``marked`` broadcasts, at most.
MARKS = 1 << 20


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to make (case-insensitive, as Spark resolves them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def marked(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Drop most rows whose id is not wanted: a bitmap of hashed ids, at most MARKS words of 64 bits, is broadcast.  An exact join must follow.

    The bitmap's size is bounded whatever the number of ids; where they are so many that it is full, nothing is dropped.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), F.col(c)), F.lit(MARKS))
    bit = lambda c: F.pmod(F.xxhash64(F.lit(8), F.col(c)), F.lit(64)).cast("int")
    bits = ids.select(place(id_column).alias("_place"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(id_column)).alias("_bit"))
    words = bits.groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    set_there = F.call_function("getbit", F.col("_bits"), bit(column)) == 1
    return rows.join(F.broadcast(words), (place(column) == F.col("_place")) & set_there, "left_semi")


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the CRC-32 of an ASCII text, which DuckDB lacks: each byte is taken in, then shifted out bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295::BIGINT)"
