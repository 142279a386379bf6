"""Structured Streaming forms of the stateless and built-in stateful operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.params import DEFAULTS, Params
from drainwatch.plans.normalize import frames_to_routed, rejections, validated
from drainwatch.session import work_path
from drainwatch.sources.tables import write_routed

# Late rows are counted but still applied, so state must outlive a day's delay.
LATE_BOUND = "24 hours"


def event_clock(ev: DataFrame, params: Params = DEFAULTS, delay: str = LATE_BOUND) -> DataFrame:
    """Add ``at``, the event time no further ahead than the receive time allows, as the watermark.

    Without a receive time (a replay) the block time is taken as it is.
    """
    at = F.col("block_time_s")
    if "received_s" in ev.columns:
        at = F.least(at, F.col("received_s") + params.max_future_skew_s)
        ev = ev.withColumn("late", F.col("received_s") - F.col("block_time_s") > params.late_after_s)
    return ev.withColumn("at", F.timestamp_seconds(at)).withWatermark("at", delay)


def dedup_stream(ev: DataFrame, keys: tuple[str, ...] = ("type", "key")) -> DataFrame:
    """First delivery wins among rows within the watermark; memory is bounded by time per key.

    ``ev`` carries a watermark (event_clock).
    """
    return ev.dropDuplicatesWithinWatermark(list(keys))


def minute_buckets(rd: DataFrame, seconds: int = DEFAULTS.reading_bucket_s) -> DataFrame:
    """Newest reading per (token, pool, tumbling bucket), emitted when the bucket closes."""
    bucket = F.window("at", f"{seconds} seconds").alias("w")
    priced = F.when(F.col("usd").isNotNull(), F.col("pos"))
    newest = rd.groupBy("mint", "pool", bucket).agg(F.max_by("usd", priced).alias("usd"), F.max(priced).alias("pos"))
    return newest.select("mint", "pool", F.unix_timestamp("w.start").alias("start_s"), "usd", "pos")


def rate_stream(ev: DataFrame, seconds: int = 1) -> DataFrame:
    bucket = F.window("at", f"{seconds} seconds").alias("w")
    return ev.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("start_s"), "n")


def bucket_parts(directory: str, seconds: int) -> Callable[[DataFrame, int], None]:
    """Buckets that lose no row: each batch files what it adds to any bucket, closed or not, as a part of its own; ``merged_rate`` and ``merged_readings`` put the parts together on read.

    A part is one row per bucket (and pool) that the batch touches.  A row behind the watermark corrects its bucket the moment its batch is filed, and a batch that runs again replaces its parts.
    """
    def run(batch: DataFrame, number: int) -> None:
        start = (F.floor(F.col("block_time_s") / seconds) * seconds).alias("start_s")
        priced = F.when(F.col("usd").isNotNull(), F.col("pos"))
        parts = batch.groupBy("mint", "pool", start).agg(F.count(F.lit(1)).alias("n"), F.max_by("usd", priced).alias("usd"), F.max(priced).alias("pos"))
        parts.write.mode("overwrite").parquet(f"{directory}/batch={number}")

    return run


def merged_rate(parts: DataFrame) -> DataFrame:
    return parts.groupBy("start_s").agg(F.sum("n").alias("n"))


def merged_readings(parts: DataFrame) -> DataFrame:
    """Newest reading per (token, pool, bucket) over all batches."""
    return parts.filter("pos is not null").groupBy("mint", "pool", "start_s").agg(F.max_by("usd", "pos").alias("usd"), F.max("pos").alias("pos"))


def compact_parts(parts: DataFrame, path: str, before_s: int) -> None:
    """Parts of buckets that are long closed, as one part; the rest is left to the batches."""
    old = parts.filter(F.col("start_s") < before_s)
    newest = F.max_by(F.struct("usd", "pos"), "pos").alias("_r")
    merged = old.groupBy("mint", "pool", "start_s").agg(F.sum("n").alias("n"), newest)
    merged.select("mint", "pool", "start_s", "n", F.col("_r.usd").alias("usd"), F.col("_r.pos").alias("pos")).write.mode("overwrite").parquet(path)


def normalize_batches(good_dir: str, bad_dir: str) -> Callable[[DataFrame, int], None]:
    """One micro-batch: valid frames filed by type, rejected ones to quarantine.

    A batch is parsed and checked once, and every frame goes to exactly one of the two.  Each batch has
    a folder of its own, so a batch that is run again replaces what it wrote.
    """
    def run(batch: DataFrame, number: int) -> None:
        checked = validated(frames_to_routed(batch)).persist()
        try:
            write_routed(checked.drop("issues"), f"{good_dir}/batch={number}", mode="overwrite")
            rejections(checked).select("value", "kind", "entry").write.mode("overwrite").parquet(f"{bad_dir}/batch={number}")
        finally:
            checked.unpersist()

    return run


def stream_normalize(frames: DataFrame, good_dir: str, bad_dir: str, checkpoint: str):
    return frames.writeStream.foreachBatch(normalize_batches(good_dir, bad_dir)).option("checkpointLocation", checkpoint)


def once(records: DataFrame, key: str = "id") -> DataFrame:
    """Each record once, however often it is delivered: the keys are state of the stream (records are few beside events)."""
    return records.dropDuplicates([key])


def records_sink(directory: str) -> Callable[[DataFrame, int], None]:
    """A folder per batch, so a batch that is run again after a restart replaces what it wrote; nothing written earlier is read."""
    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{directory}/batch={number}")

    return run


def landed(rows: DataFrame, stretch: Column, stretches: int, key: str, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table as a stream: its stretches land one after the other, and each is one micro-batch.

    A stretch lands in as many files as tasks run at a time, and a micro-batch takes that many.  Where few rows leave some unwritten, empty files make up the number: a batch that began in one
    stretch and ended in the next would move the watermark past rows still to come.
    """
    spark: SparkSession = rows.sparkSession
    files = spark.sparkContext.defaultParallelism
    kept = columns or rows.columns
    schema = rows.select(*kept).schema
    for k in range(stretches):
        rows.filter(stretch == k).repartition(files, key).select(*kept).write.parquet(f"{path}/{k}")
        missing = files - len(spark.read.schema(schema).parquet(f"{path}/{k}").inputFiles())
        for _ in range(missing):
            spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)


def run_to_end(writer) -> None:
    """Process everything there is now, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into files of the shared folder; the result as a table."""
    spark: SparkSession = stream.sparkSession
    path = work_path(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-progress")
    run_to_end(writer)
    return spark.read.schema(stream.schema).parquet(path)
