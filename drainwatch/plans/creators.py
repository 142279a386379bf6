"""Creator memory: launches, bursts, retention, and reports on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.operators.lifetimes import activity, lifetimes
from drainwatch.operators.running import Running, running
from drainwatch.operators.select import newest_per_key
from drainwatch.params import DEFAULTS, STAGE_RANK, Params
from drainwatch.plans.tokens import collapsed
from drainwatch.session import dealt, settle


def creator_launches(ev: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per (creator, mint): earliest creation time, the stream outranking snapshots."""
    seen = ev.filter(F.col("type") == "token_create").select(
        F.col("actor").alias("creator"), "mint", F.col("block_time_s").alias("created_s"), F.lit("stream").alias("source")
    )
    rows = seen if history is None else seen.unionByName(
        history.select("creator", "mint", "created_s", F.lit("rest").alias("source"))
    )
    # 'stream' > 'rest' as text, which is the rank wanted.
    return rows.groupBy("creator", "mint").agg(F.min("created_s").alias("created_s"), F.max("source").alias("source"))


def cap_launches(la: DataFrame, n: int) -> DataFrame:
    """The newest launches per creator; unknown times go first, ties drop the smaller mint."""
    return newest_per_key(la, ["creator"], [F.desc_nulls_last("created_s"), F.desc("mint")], n)


def launches_in_window(la: DataFrame, now_s: Column, window_s: int = DEFAULTS.burst_window_s) -> DataFrame:
    inside = F.col("created_s").isNotNull() & (now_s - F.col("created_s") < window_s)
    return la.groupBy("creator").agg(F.count_if(inside).alias("n"))


def rolling_launches(la: DataFrame, window_s: int = DEFAULTS.burst_window_s) -> DataFrame:
    """Launches of the creator in the trailing window, at each second with a launch.

    A launch counts from its second until ``window_s`` later, so the trailing count is a running
    sum of arrivals and departures.  That stays parallel for a creator with millions of launches,
    which a range window over the creator would not.
    """
    return _rolled(_launch_seconds(la), window_s)


def _launch_seconds(la: DataFrame) -> DataFrame:
    return la.filter(F.col("created_s").isNotNull()).groupBy("creator", "created_s").agg(F.count(F.lit(1)).alias("_n"))


def _rolled(at: DataFrame, window_s: int) -> DataFrame:
    step = lambda t, kind, n: F.struct(t.alias("t"), F.lit(kind).alias("_kind"), n.alias("_n"))
    steps = F.array(step(F.col("created_s"), 1, F.col("_n")), step(F.col("created_s") + window_s, 0, -F.col("_n")))
    counted = running(at.select("creator", F.inline(steps)), ["creator"], ["t", "_kind"], [Running("n", "sum", "_n")])
    return counted.filter("_kind = 1").select("creator", F.col("t").alias("created_s"), "n")


def serial_creators(la: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Creators who ever had more launches within the window than the limit; sticky."""
    la = dealt(la.select("creator", "created_s"), "creator")
    busy = la.groupBy("creator").agg(F.count(F.lit(1)).alias("_all")).filter(F.col("_all") > params.burst_max_launches)
    # The running count reads them twice: found once.
    at = settle(_launch_seconds(la.join(busy, "creator", "left_semi")), "launch-seconds")
    rolled = _rolled(at, params.burst_window_s)
    most = rolled.groupBy("creator").agg(F.max("n").alias("most"))
    return most.filter(F.col("most") > params.burst_max_launches)


def creator_dim(la: DataFrame, ev: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    acts = ev.filter(F.col("type").isin("token_create", "graduation"))
    seen = acts.groupBy(F.col("actor").alias("creator")).agg(
        F.min("block_time_s").alias("first_seen_s"), F.max("block_time_s").alias("last_seen_s")
    )
    launches = la.groupBy("creator").agg(F.count(F.lit(1)).alias("launches"))
    serial = serial_creators(la, params).select("creator", F.lit(True).alias("serial"))
    joined = reduce(lambda a, b: a.join(b, "creator", "left"), [launches, serial], seen)
    return joined.na.fill({"launches": 0}).withColumn("serial", F.coalesce("serial", F.lit(False)))


def creator_retention(creators: DataFrame, now_s: Column, params: Params = DEFAULTS) -> DataFrame:
    keep = F.when(F.col("serial"), params.retention_serial_s).otherwise(params.retention_default_s)
    return creators.filter(now_s - F.col("last_seen_s") <= keep)


def cap_creators(creators: DataFrame, n: int) -> DataFrame:
    return creators.orderBy(F.desc("serial"), F.desc("last_seen_s"), "creator").limit(n)


def launch_bucket(n: str = "launches") -> Column:
    c = F.col(n)
    return (
        F.when(c <= 1, "1").when(c <= 3, "2-3").when(c <= 10, "4-10").when(c <= 30, "11-30").when(c <= 100, "31-100").otherwise(">100")
    )


def launch_histogram(la: DataFrame) -> DataFrame:
    per = la.groupBy("creator").agg(F.count(F.lit(1)).alias("launches"))
    return per.groupBy(launch_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("creators"))


def top_serial(la: DataFrame, serial: DataFrame, outcomes: DataFrame, n: int = 12, params: Params = DEFAULTS) -> DataFrame:
    """Serial creators by launches, with how many of their tokens graduated and were drained."""
    flags = outcomes.select(
        "mint", (F.col("stage") == "graduated").alias("_grad"), collapsed(params=params).alias("_gone")
    )
    mine = la.join(serial.select("creator"), "creator", "left_semi").join(flags, "mint", "left")
    per = mine.groupBy("creator").agg(
        F.count(F.lit(1)).alias("launches"), F.count_if("_grad").alias("graduated"), F.count_if("_gone").alias("collapsed")
    )
    return per.orderBy(F.desc("launches"), "creator").limit(n)


def collapse_by_serial(outcomes: DataFrame, serial: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    flagged = outcomes.join(serial.select("creator", F.lit(True).alias("_s")), "creator", "left")
    gone, grad, by = collapsed(params=params), F.col("stage") == "graduated", F.col("_s").isNotNull()
    return flagged.agg(
        F.count_if(gone).alias("collapsed"), F.count_if(gone & by).alias("collapsed_serial"),
        F.count_if(grad).alias("graduated"), F.count_if(grad & by).alias("graduated_serial"),
    )


def cap_tracked(tok: DataFrame, n: int) -> DataFrame:
    """Over capacity, tokens still on the curve go first, then the least recently active."""
    early = F.when(F.col("stage_rank") >= STAGE_RANK["graduated"], 2).otherwise(F.col("stage_rank"))
    return tok.orderBy(early.desc(), F.desc("last_activity_s"), "mint").limit(n)


def state_stats(tok: DataFrame, creators: DataFrame, la: DataFrame, rd: DataFrame, now_s: Column, params: Params = DEFAULTS) -> DataFrame:
    """One (metric, value) table of what the state holds."""
    def metrics(df: DataFrame, **aggs: Column) -> DataFrame:
        one = df.agg(*[a.cast("bigint").alias(k) for k, a in aggs.items()])
        return one.unpivot([], list(aggs), "metric", "value")

    recent = launches_in_window(la, now_s, params.burst_window_s)
    over = creators.filter("serial").join(recent, "creator")
    parts = [
        metrics(tok, tokens=F.count(F.lit(1)), **{s: F.count_if(F.col("stage") == s) for s in STAGE_RANK}),
        metrics(creators, creators=F.count(F.lit(1)), serial=F.count_if("serial")),
        metrics(over, over_threshold_now=F.count_if(F.col("n") > params.burst_max_launches)),
        metrics(la, launches=F.count(F.lit(1))),
        metrics(rd, readings=F.count("usd"), unpriced=F.count_if(F.col("usd").isNull())),
    ]
    return reduce(DataFrame.unionByName, parts)


def watermark_and_late(
    ev: DataFrame, arrival: list[str], params: Params = DEFAULTS
) -> DataFrame:
    """Event-time clock before each arrival and whether the row came late.

    A block time ahead of the receive time is capped, so one bogus row cannot move the clock.
    There is one clock for the whole feed: ``running`` splits the order over all tasks.
    """
    capped = ev.withColumn("_at", F.least("block_time_s", F.col("received_s") + params.max_future_skew_s))
    seen = running(capped, [], arrival, [Running("watermark_s", "max", "_at", before=True)]).drop("_at")
    late = F.coalesce(F.col("watermark_s") - F.col("block_time_s") > params.late_after_s, F.lit(False))
    return seen.withColumn("late", late)


def idle_expiry(ev: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Lifetimes of tracked tokens: (mint, session, start, end, events).

    A silence longer than the graduated limit always ends a lifetime; one longer than the curve
    limit ends it unless the token graduated earlier in the same lifetime.
    """
    active = token_activity(ev, min(params.idle_curve_s, params.idle_graduated_s))
    return token_lifetimes(active, params)


def token_activity(ev: DataFrame, width: int) -> DataFrame:
    return activity(ev, "mint", "block_time_s", F.col("type") == "graduation", width)


def token_lifetimes(active: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return lifetimes(active, "mint", params.idle_curve_s, params.idle_graduated_s).withColumnRenamed("marked", "graduated")
