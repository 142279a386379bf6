"""Joins of events with tokens, prices and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.operators.running import Running, running
from drainwatch.params import DEFAULTS, MINT_KEYS, STAGE_RANK, WRAPPED_SOL
from drainwatch.plans.tokens import stage_name

# Both sides of a pair as a row may carry them.
PAIR_PARTS = ("reserve", "decimals", "amount", "usd")


def resolve_pair(ev: DataFrame, tok: DataFrame) -> DataFrame:
    """Which side of the pair is a token we follow (base first), and the other side as the quote.

    ``tok`` has one row per mint.  The wrapped native coin is on one side of nearly every pair
    and never a launched token, so it does not travel to the lookup; rows without a candidate get a
    key of their own instead of meeting on null.
    """
    known = tok.select(F.col("mint").alias("_m")).filter(F.col("_m") != WRAPPED_SOL)

    def look_up(rows: DataFrame, side: str, flag: str, needed: Column) -> DataFrame:
        ask = F.when(needed & (F.col(side) != WRAPPED_SOL), F.col(side)).otherwise(
            F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string"))
        )
        hit = known.withColumn(flag, F.lit(True))
        return rows.withColumn("_ask", ask).join(hit, F.col("_ask") == F.col("_m"), "left").drop("_m", "_ask")

    rows = look_up(ev, "base_mint", "_base", F.lit(True))
    rows = look_up(rows, "quote_mint", "_quote", F.col("_base").isNull())
    is_base = F.coalesce(F.col("_base"), F.lit(False))
    other = lambda part: F.when(is_base, F.col(f"quote_{part}")).otherwise(F.col(f"base_{part}"))
    parts = [p for p in PAIR_PARTS if f"quote_{p}" in ev.columns]
    keep = [c for c in ev.columns if c not in ("mint",)]
    return rows.select(
        *[F.col(c).alias(c) if c != "quote_mint" else F.col(c).alias("pair_quote_mint") for c in keep if c not in {f"quote_{p}" for p in parts}],
        F.when(is_base, F.col("base_mint")).when(F.col("_quote"), F.col("quote_mint")).alias("mint"),
        is_base.alias("is_base"),
        F.when(is_base, F.col("quote_mint")).otherwise(F.col("base_mint")).alias("quote_mint"),
        *[other(p).alias(f"quote_{p}") for p in parts],
    )


def price_asof(ev: DataFrame, px: DataFrame) -> DataFrame:
    """The newest price learned for the event's quote mint at or before the event's position.

    ``px``: quote_mint, pos, usd_per_unit.  Nearly all events share one quote mint, which is what
    ``running`` is for.  At one position the price counts before the event that follows it, and
    of several prices learned at the same position the first (by ``seq``, if given) is kept.
    """
    kept = F.min_by("usd_per_unit", "seq") if "seq" in px.columns else F.min("usd_per_unit")
    first = px.groupBy("quote_mint", "pos").agg(kept.alias("_px"))
    rows = ev.withColumn("_kind", F.lit(1)).withColumn("_uid", F.xxhash64(*[c for c in ev.columns if c != "pos"]))
    marks = first.withColumn("_kind", F.lit(0)).withColumn("_uid", F.lit(0).cast("bigint"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    priced = running(both, ["quote_mint"], ["pos", "_kind", "_uid"], [Running("usd_per_unit", "last", "_px")])
    return priced.filter("_kind = 1").select(*ev.columns, "usd_per_unit")


def late_token_join(pair_ev: DataFrame, first_seen: DataFrame, ttl_s: int = DEFAULTS.pending_ttl_s) -> DataFrame:
    """Pair events of followed tokens; one that came before its token counts if not more than ``ttl_s`` early.

    ``first_seen``: mint, first_seen_s (one row per token).
    """
    seen = first_seen.select("mint", F.col("first_seen_s").alias("_first"))
    kept = pair_ev.join(seen, "mint").filter(F.col("block_time_s") >= F.col("_first") - ttl_s)
    return kept.withColumn("held", F.col("block_time_s") < F.col("_first")).drop("_first")


def swaps_of_known(swaps: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Swaps before their token is known are dropped, never held."""
    seen = first_seen.select("mint", F.col("first_pos").alias("_first"))
    return swaps.join(seen, "mint").filter(F.col("pos") >= F.col("_first")).drop("_first")


def mint_prefilter(frames: DataFrame, mints: DataFrame, text: str = "value") -> DataFrame:
    """Raw lines that mention a followed mint, decided before any JSON is parsed.

    Nearly every line names one mint besides the native coin: those meet the list by one semi-join.
    A line that names more (three at most) is asked once per mint and kept once.
    """
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(MINT_KEYS), 1))
    lines = frames.withColumn("_ids", F.filter(ids, lambda m: m != WRAPPED_SOL))
    followed = mints.select(F.col("mint").alias("_mint")).distinct()
    one = lines.filter(F.size("_ids") == 1).withColumn("_mint", F.col("_ids")[0])
    # The few others: their lists of mints are looked up, not their lines.
    more = lines.filter(F.size("_ids") > 1).withColumn("_list", F.array_join("_ids", ","))
    asked = more.select("_list", F.explode("_ids").alias("_mint")).distinct()
    named = asked.join(followed, "_mint", "left_semi").select("_list").distinct()
    kept = more.join(named, "_list", "left_semi")
    return one.join(followed, "_mint", "left_semi").select(*frames.columns).unionByName(kept.select(*frames.columns))


def merge_creator_history(la: DataFrame, hist_tokens: DataFrame) -> DataFrame:
    """Launches seen in the stream, full-outer with launches listed by snapshots.

    ``la``: creator, mint, created_s, source.  ``hist_tokens``: creator, mint, created_s,
    graduated, graduated_s, holders, ath_mcap_usd, liquidity_usd, fetched_s.
    The earliest creation wins, the stream outranks a snapshot as the source.  A snapshot knows of a stage only
    that the token graduated, so it never lowers the one the stream saw (``stage_rank``, where ``la`` has it).
    """
    seen_rank = F.col("stage_rank") if "stage_rank" in la.columns else F.lit(None).cast("int")
    mine = la.select("creator", "mint", F.col("created_s").alias("_seen_s"), F.col("source").alias("_source"), seen_rank.alias("_rank"))
    joined = mine.join(hist_tokens, ["creator", "mint"], "full")
    at = F.when(F.col("graduated"), F.coalesce("graduated_s", "fetched_s"))
    rank = F.greatest("_rank", F.when(F.col("graduated"), STAGE_RANK["graduated"]))
    return joined.select(
        "creator", "mint",
        F.least("_seen_s", "created_s").alias("created_s"),
        F.when(F.col("_source") == "stream", "stream").otherwise("rest").alias("source"),
        F.when(rank.isNotNull(), stage_name(rank)).alias("stage"),
        at.alias("graduated_at_s"), "holders", "ath_mcap_usd",
        F.col("liquidity_usd").alias("rest_usd"), F.col("fetched_s").alias("at_s"),
    )


def reconcile_with_snapshot(sample: DataFrame, snapshot: DataFrame, end_s: Column, floor=DEFAULTS.max_floor_usd) -> DataFrame:
    """Our verdicts on each sampled token against the snapshot's liquidity: by the whole value (``verdict``) and by the tradable one (``verdict_tradable``).

    ``sample``: stratum, mint, peak_usd, collapsed, graduated, curve_units, tradable_last_usd, last_pool_s, and for the second verdict tradable_collapsed, tradable_peak_usd.
    ``snapshot``: mint, liquidity_usd.
    """
    s = sample.join(snapshot.select("mint", "liquidity_usd"), "mint", "left")
    theirs = F.col("liquidity_usd") <= floor
    low = (
        F.when(F.col("graduated") & (F.col("curve_units") > 0.05) & (F.col("tradable_last_usd") <= floor), "low-curve")
        .when(end_s - F.col("last_pool_s") < 1800, "low-active")
        .otherwise("low-quiet")
    )

    def judged(ours: Column, peak: Column) -> Column:
        times = F.col("liquidity_usd") / F.when(peak > 0, peak)
        high = F.when(times.between(1.4, 2.6), "high-double").otherwise("high")
        same = F.when(ours, "same-collapsed").otherwise("same-alive")
        return F.when(F.col("liquidity_usd").isNull(), "unlisted").when(ours == theirs, same).when(ours, high).otherwise(low)

    out = s.withColumn("verdict", judged(F.col("collapsed"), F.col("peak_usd")))
    if "tradable_collapsed" in sample.columns:
        out = out.withColumn("verdict_tradable", judged(F.coalesce("tradable_collapsed", F.lit(False)), F.coalesce("tradable_peak_usd", "peak_usd")))
    return out
