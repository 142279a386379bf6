"""The detector's own log: alerts and drains as JSON lines by UTC day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.functions.events import POSITION

POS = f"struct<{','.join(f'{p}:bigint' for p in POSITION)}>"
TRIGGER = f"struct<type:string,pool:string,dex:string,pos:{POS}>"
EVIDENCE = "struct<quote_mint:string,quote_units:decimal(29,9),fingerprint:boolean,prior_rugs:array<struct<no:bigint,mint:string,t_at:bigint,mechanism:string>>,n_prior:bigint>"
CONFIDENCE = "struct<precision:double,confirmed:int,fired:int,typical_lead_s:int>"
WARNED = "array<struct<alert_at:bigint,level:string,id:string,lead_s:bigint>>"
# Everything an alert or a drain says; amounts as text, so that no digit is lost on the way.
RECORD = f"""kind string, id string, level string, rule string, mint string, creator string, t_at bigint, detected_at_ms bigint, origin string, mechanism string, actor string, pool string, dex string,
peak_usd string, last_usd string, n_prior bigint, url string, trigger {TRIGGER}, evidence {EVIDENCE}, confidence {CONFIDENCE}, alerts {WARNED}"""


def as_records(alerts: DataFrame, rugs: DataFrame, url: str = "https://solscan.io/token/", detected_ms: Column | None = None) -> DataFrame:
    """Full alerts and drains (``detect``'s) as rows of the registry, with a link to look the token up and the time they were written."""
    rows = alerts.withColumn("kind", F.lit("alert")).unionByName(rugs.withColumn("kind", F.lit("rug")), allowMissingColumns=True)
    at = F.unix_millis(F.current_timestamp()) if detected_ms is None else detected_ms
    more = {"url": F.concat(F.lit(url), "mint"), "detected_at_ms": at.cast("bigint")}
    more |= {c: F.col(c).cast("string") for c in ("peak_usd", "last_usd")}
    return rows.withColumns(more)


def write_registry(records: DataFrame, directory: str, written_s: str = "t_at") -> None:
    """Append records to one folder per day."""
    day = F.date_format(F.timestamp_seconds(written_s), "yyyyMMdd")
    body = F.to_json(F.struct(*records.columns))
    records.select(body.alias("value"), day.alias("day")).write.mode("append").partitionBy("day").text(directory)


def load_registry(spark: SparkSession, directory: str, days: int, now_s: int) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of the days that matter; older folders are not opened."""
    oldest = F.date_format(F.timestamp_seconds(F.lit(now_s - days * 86400)), "yyyyMMdd")
    lines = spark.read.option("lineSep", "\n").schema("value string, day string").text(directory).filter(F.col("day") >= oldest)
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.select("value", "day", F.from_json("value", RECORD).alias("r"))
    good = F.coalesce(F.col("r.kind").isin("alert", "rug"), F.lit(False))
    return parsed.filter(good).select("r.*"), parsed.filter(~good).select("value", "day")


def full_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, drains) of a registry in the shape ``detect`` gives them, for a detector that goes on from there."""
    alerts = records.filter("kind = 'alert'").select("kind", "id", "level", "rule", "mint", "creator", "t_at", "trigger", "evidence", "confidence")
    money = [F.col("peak_usd").cast("decimal(28,6)").alias("peak_usd"), F.col("last_usd").cast("decimal(38,6)").alias("last_usd")]
    rugs = records.filter("kind = 'rug'").select("kind", "id", "mint", "creator", "t_at", "mechanism", "actor", "trigger", *money, "alerts")
    return alerts, rugs


def bad_line_counts(bad: DataFrame) -> DataFrame:
    """Lines of each day that are no record."""
    return bad.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
