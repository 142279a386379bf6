"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A repeated JSON key keeps its last value instead of failing the frame.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# The settings that may be changed on a session somebody else started.
RUNTIME_SETTINGS = {k: v for k, v in SETTINGS.items() if k.startswith("spark.sql.")}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "drainwatch") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    builder = builder.config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("DRAINWATCH_DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.ui.enabled", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator relies on to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (a laptop, the
    tests) is a folder of our own made, and only a local master may use a local one.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.environ.get("DRAINWATCH_WORK_DIR") or tempfile.mkdtemp(prefix="drainwatch-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """The rows by the columns, over as many tasks as the session shuffles to.

    Adaptive execution joins partitions by their compressed bytes.  Rows of few different values compress to a
    hundredth of what a sort or a window holds of them, and would end in one or two tasks; a given number is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write an intermediate table to the shared folder once, and go on from the files.

    For results that several steps read: they are computed once, survive lost executors, and
    have a known size, which lets the optimizer choose its joins.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
