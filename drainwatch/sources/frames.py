"""Raw frames from files, as a batch and as a stream, and their archive.

Frame tables: value (one JSON text), path, line (place in the file; sorts as written).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drainwatch.functions.redact import redact_secrets
from drainwatch.operators.running import Running, running
from drainwatch.params import BLOCK_TIME, FIREHOSE_TYPES, FRAME_TYPE, STARTS_TRACKING, WRAPPED_SOL

FRAME_FILES = "*.jsonl*"
LINES_PER_BUCKET = 100_000
STAMP = r"^(\w+)-(\d{8}T\d{6})Z-\d+\.jsonl"


def _lines(reader, path: str) -> DataFrame:
    # Lines end at \n only: other Unicode line ends are legal inside JSON text.
    frames = reader.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return frames.filter(F.trim("value") != "")


def _text(reader, path: str) -> DataFrame:
    return _lines(reader, path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("n"),
        ).alias("line"),
    )


def scan_frames(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of ``.jsonl`` and ``.jsonl.gz`` files and directories of them; missing paths are skipped."""
    found = []
    for path in paths:
        try:
            found.append(_text(spark.read, path))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not found:
        return spark.createDataFrame([], "value string, path string, line struct<path:string,block:bigint,n:bigint>")
    return reduce(DataFrame.unionByName, found)


def scan_capture(spark: SparkSession, directory: str, prefix: str) -> DataFrame:
    """Both tiers of a capture: files whose stamp begins with the prefix."""
    tiers = [
        scan_frames(spark, [f"{directory}/{tier}-{prefix}*.jsonl*"]).withColumn("tier", F.lit(tier)) for tier in ("lifecycle", "firehose")
    ]
    return reduce(DataFrame.unionByName, tiers)


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """name, path, size of the frame files: the contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", FRAME_FILES).load(directory)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size"))


def scan_since(files: DataFrame, hours: int, now_s: int) -> DataFrame:
    """Lifecycle files that can hold the last hours.

    A file's stamp is its start, so the newest one that started before the cutoff counts too.
    """
    stamp = F.regexp_extract("name", STAMP, 2)
    rows = files.filter(F.col("name").rlike(r"^lifecycle-\d{8}T\d{6}Z-\d+\.jsonl$")).withColumn(
        "start_s", F.unix_timestamp(F.to_timestamp(stamp, "yyyyMMdd'T'HHmmss"))
    )
    before = rows.filter(F.col("start_s") < now_s - hours * 3600).agg(F.max(F.struct("start_s", "name")).alias("b")).first().b
    if before is None:
        return rows
    return rows.filter(F.struct("start_s", "name") >= F.struct(F.lit(before.start_s).cast("bigint").alias("start_s"), F.lit(before.name).alias("name")))


def stream_frames(spark: SparkSession, directory: str, files_per_trigger: int | None = None) -> DataFrame:
    """The live feed: the same frames, as files land."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _lines(reader.schema("value string"), directory).select("value", F.col("_metadata.file_path").alias("path"))


def tier_of(text: str = "value") -> Column:
    """Swaps and transfers are the firehose; everything else, malformed frames too, is lifecycle."""
    return F.when(F.regexp_extract(text, FRAME_TYPE, 1).isin(*FIREHOSE_TYPES), "firehose").otherwise("lifecycle")


def archive_rows(frames: DataFrame, received: str, literal_key: str | None = None) -> DataFrame:
    day = F.date_format(F.timestamp_seconds(received), "yyyyMMdd")
    return frames.select(redact_secrets(F.col("value"), literal_key).alias("value"), tier_of().alias("tier"), day.alias("day"))


def archive_raw(frames: DataFrame, directory: str, received: str, literal_key: str | None = None, rows_per_file: int = 1_000_000) -> None:
    """Every frame, redacted, by tier and UTC day."""
    rows = archive_rows(frames, received, literal_key)
    rows.write.mode("append").partitionBy("tier", "day").option("maxRecordsPerFile", rows_per_file).text(directory)


def archive_stream(frames: DataFrame, directory: str, checkpoint: str, received: str, literal_key: str | None = None):
    rows = archive_rows(frames, received, literal_key)
    return (
        rows.writeStream.format("text").partitionBy("tier", "day").option("path", directory).option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def retention_plan(
    files: DataFrame, group: str, order: str, size: str, cap: int, reserve: int = 0
) -> DataFrame:
    """Add ``drop``: the oldest files go until what is kept and one reserve fit the cap."""
    sums = running(files, [group], [order], [Running("_before", "sum", size, before=True)])
    totals = files.groupBy(group).agg(F.sum(size).alias("_total"))
    joined = sums.join(totals, group)
    return joined.select(*files.columns, (F.col("_total") - F.coalesce("_before", F.lit(0)) > cap - reserve).alias("drop"))


def block_time(text: str = "value") -> Column:
    return F.nullif(F.regexp_extract(text, BLOCK_TIME, 1), F.lit("")).cast("bigint")


def _stretch(frames: DataFrame, line: str) -> Column:
    """A stretch of lines: a block of a file, or so many line numbers."""
    kind = frames.schema[line].dataType
    return F.struct(f"{line}.path", f"{line}.block") if isinstance(kind, StructType) else F.floor(F.col(line) / LINES_PER_BUCKET)


def merge_tiers(frames: DataFrame, line: str = "line") -> DataFrame:
    """Add ``key_s``: the line's block time, or the last one seen earlier in its tier.

    Sorting by (key_s, tier, line) interleaves the tiers as they happened.
    """
    timed = frames.withColumn("_bt", block_time())
    filled = running(timed, ["tier"], [line], [Running("key_s", "last", "_bt")], bucket=_stretch(timed, line))
    return filled.withColumn("key_s", F.coalesce("key_s", F.lit(0).cast("bigint"))).drop("_bt")


def lifecycle_mints(frames: DataFrame) -> DataFrame:
    """Every mint that can be followed: only launches, curve snapshots and graduations start it."""
    mint = F.regexp_extract("value", r'"mint":"(\w+)"', 1).alias("mint")
    rows = frames.filter(F.col("value").rlike(STARTS_TRACKING)).select(mint)
    return rows.filter((F.col("mint") != "") & (F.col("mint") != WRAPPED_SOL)).distinct()


def extract_subset(frames: DataFrame, mints: DataFrame, end_s: int, literal_key: str | None = None, forbidden: str = r"(?i)sk_") -> DataFrame:
    """All frames that mention a chosen mint up to one common end, redacted.

    Fails the job if anything that looks like a key is left.  ``frames`` carries key_s (merge_tiers).
    """
    from drainwatch.plans.joins import mint_prefilter

    chosen = mint_prefilter(frames.filter(F.col("key_s") <= end_s), mints)
    clean = chosen.withColumn("value", redact_secrets(F.col("value"), literal_key))
    guard = F.when(
        F.col("value").rlike(forbidden), F.raise_error(F.concat(F.lit("a line still carries something like a key: "), F.substring("value", 1, 40)))
    ).otherwise(F.col("value"))
    return clean.withColumn("value", guard.cast("string"))
