"""Report tables over the detector's records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drainwatch.operators.quantiles import index_quantiles
from drainwatch.operators.select import newest_per_key
from drainwatch.params import DEFAULTS, HOUR, Params
from drainwatch.plans import rules

SHOWN_SEQUENCES, SHOWN_PENDING = 12, 3


def recent_sequences(rg: DataFrame, al: DataFrame, n: int = SHOWN_SEQUENCES) -> DataFrame:
    return rules.sequences(rg, al).orderBy(F.desc("rug_at"), "mint").limit(n)


def pending_alerts(al: DataFrame, rg: DataFrame, clock_s: Column, params: Params = DEFAULTS, n: int = SHOWN_PENDING) -> DataFrame:
    """The newest open and unconfirmed alerts, how many there are, their age and the rule's usual lead."""
    pending = rules.open_and_unconfirmed(al, rg, clock_s, params)
    totals = pending.groupBy("status").agg(F.count(F.lit(1)).alias("total"))
    shown = newest_per_key(pending.select("id", "level", "t_at", "status"), ["status"], [F.desc("t_at"), F.asc("id")], n)
    dim = rules.confidence_dim(al.sparkSession).select("level", "typical_lead_s")
    age = F.greatest(F.lit(0).cast("bigint"), clock_s - F.col("t_at"))
    return shown.join(totals, "status").join(F.broadcast(dim), "level").select(
        "id", "status", age.cast("bigint").alias("age_s"), "typical_lead_s", "total"
    )


def rule_scoreboard(al: DataFrame, rg: DataFrame, clock_s: Column, params: Params = DEFAULTS) -> DataFrame:
    live = rules.alert_level_stats(al, rg, clock_s, params)
    zero = {c: 0 for c in ("fired", "confirmed", "unconfirmed", "open")}
    return rules.confidence_dim(al.sparkSession).join(live, "level", "left").na.fill(zero)


def blind_spots(rg: DataFrame, al: DataFrame) -> DataFrame:
    flagged = rg.join(al.select("mint", F.lit(True).alias("_w")).distinct(), "mint", "left")
    # One pass: the metric rows each drain counts for.
    names = F.when(F.col("_w"), F.array(F.lit("rugs"), F.lit("warned"))).otherwise(
        F.array(F.lit("rugs"), F.concat(F.lit("unwarned "), F.col("mechanism")))
    )
    counted = flagged.select(F.explode(names).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("value"))
    base = metric_names(rg, ["rugs", "warned"])
    return base.join(counted, "metric", "full").select("metric", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))


def metric_names(df: DataFrame, names: list[str]) -> DataFrame:
    """The metrics that must appear even when nothing counts for them."""
    return df.sparkSession.createDataFrame([(n,) for n in names], "metric string")


def records_feed_rows(al: DataFrame, rg: DataFrame) -> DataFrame:
    one = al.select(F.lit("alert").alias("kind"), F.col("id").alias("key"), "t_at")
    return one.unionByName(rg.select(F.lit("rug").alias("kind"), F.col("mint").alias("key"), "t_at"))


def feed(records: DataFrame, n: int | None = None) -> DataFrame:
    """First alert per id and first drain per token: all of them, or the newest ``n`` of each."""
    first = records.groupBy("kind", "key").agg(F.min("t_at").alias("t_at"))
    if n is None:
        return first.filter(F.col("kind").isin("alert", "rug"))
    parts = [first.filter(F.col("kind") == k).orderBy(F.desc("t_at"), "key").limit(n) for k in ("alert", "rug")]
    return reduce(DataFrame.unionByName, parts)


def prior_rug_list(rg: DataFrame, cap: int) -> DataFrame:
    """Per creator the newest ``cap`` drains, newest first."""
    kept = newest_per_key(rg.filter(F.col("creator").isNotNull()), ["creator"], [F.desc("pos")], cap)
    entry = F.struct("pos", "mint")
    return kept.groupBy("creator").agg(
        F.reverse(F.array_sort(F.collect_list(entry)))["mint"].alias("mints"), F.count(F.lit(1)).alias("n")
    )


def validation_metrics(al: DataFrame, rg: DataFrame, end_s: Column) -> DataFrame:
    """Metric rows to hold against an analysis: per rule, the union of both, and the drains."""
    rows = rules.with_confirmation(al, rg)
    hit = F.col("rug_at").isNotNull()
    late = ~hit & (end_s - F.col("t_at") < HOUR)
    per_level = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("fired"), F.count_if(hit).alias("confirmed"), F.count_if(late).alias("late")
    )
    long = per_level.unpivot(["level"], ["fired", "confirmed", "late"], "what", "value").select(
        F.concat_ws(" ", "level", "what").alias("metric"), "value"
    )
    tokens = rows.groupBy("mint").agg(F.max(hit.cast("int")).alias("hit"), F.count(F.lit(1)).alias("n"))
    ids = rows.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("extra"))
    zero = F.lit(0).cast("bigint")
    union = tokens.agg(F.count(F.lit(1)).alias("union fired"), F.coalesce(F.sum("hit"), zero).alias("union confirmed"))
    extra = ids.agg(F.coalesce(F.sum("extra"), zero).alias("duplicate alerts"))
    total = rg.agg(F.count(F.lit(1)).alias("rugs"))
    singles = [t.unpivot([], t.columns, "metric", "value") for t in (union, extra, total)]
    by = rules.rugs_by_mechanism(rg).select(F.concat(F.lit("rugs "), F.col("mechanism")).alias("metric"), F.col("n").alias("value"))
    return reduce(DataFrame.unionByName, [long, *singles, by])


LEADS = {"p5": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9}


def lead_metrics(al: DataFrame, rg: DataFrame) -> DataFrame:
    """Metric rows on warning times by rule: quantiles, least, how many under one and two minutes; and, where alerts carry it, how many show the fingerprint."""
    rows = rules.with_confirmation(al, rg).withColumn("lead_s", F.col("rug_at") - F.col("t_at"))
    leads = rows.filter("lead_s is not null")
    q = index_quantiles(leads, ["level"], "lead_s", LEADS).drop("n")
    least = leads.groupBy("level").agg(F.min("lead_s").alias("min"), *[F.count_if(F.col("lead_s") < s).alias(f"under {s}") for s in (60, 120)])
    both = q.join(least, "level")
    names = [c for c in both.columns if c != "level"]
    out = both.unpivot(["level"], names, "what", "value").select(F.concat_ws(" ", "level", F.lit("lead"), "what").alias("metric"), F.col("value").cast("bigint").alias("value"))
    if "fingerprint" in al.columns:
        marked = al.groupBy("level").agg(F.count_if(F.coalesce("fingerprint", F.lit(False))).alias("value"))
        out = out.unionByName(marked.filter("level = 'red'").select(F.lit("red fingerprint").alias("metric"), "value"))
    return out


def metrics_vs_expected(actual: DataFrame, expected: DataFrame) -> DataFrame:
    a = actual.select("metric", F.col("value").alias("actual"))
    e = expected.select("metric", F.col("value").alias("expected"))
    return a.join(e, "metric", "full").withColumn("differs", ~F.col("actual").eqNullSafe(F.col("expected")))


def system_metrics(counters: DataFrame, stats: DataFrame, worklist: DataFrame) -> DataFrame:
    """Frames, state and worklist counts as one (metric, value) table."""
    frames = counters.agg(F.sum("received").alias("value")).select(F.lit("frames").alias("metric"), "value")
    waiting = worklist.agg(F.sum("n").alias("value")).select(F.lit("worklist").alias("metric"), "value")
    return frames.unionByName(stats).unionByName(waiting)


def event_rate(ev: DataFrame, seconds: int = 1, at: str = "block_time_s") -> DataFrame:
    """Events per tumbling interval and per second within it."""
    start = (F.floor(F.col(at) / seconds) * seconds).cast("bigint")
    counted = ev.groupBy(start.alias("start_s")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("per_second", F.col("n") / seconds)


def health_check(ev: DataFrame, now_s: Column, stale_s: int = DEFAULTS.stale_after_s, at: str = "block_time_s") -> DataFrame:
    last = ev.agg(F.max(at).alias("last_s"), F.count(F.lit(1)).alias("frames"))
    return last.withColumn("stale", (now_s - F.col("last_s")) > stale_s)
