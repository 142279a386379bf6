"""Creator-history snapshots merged into what is tracked: tokens, launches, creators.

A snapshot answers for one creator: what it launched before the feed was heard, and how those tokens fare.  It never lowers a stage, never makes a token look active, and never takes a creator's name away.
All three tables are joins by key and aggregates; of several snapshots of a creator or token the newest counts for figures, the earliest for times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.params import DEFAULTS, STAGE_RANK, Params
from drainwatch.plans.creators import creator_launches, launches_in_window
from drainwatch.plans.tokens import stage_name


def listed_tokens(hist_tokens: DataFrame) -> DataFrame:
    """One row per (creator, mint): earliest creation and graduation, the newest snapshot's figures."""
    newest = F.struct("fetched_s", "holders")
    graduated_s = F.when(F.col("graduated"), F.coalesce("graduated_s", "fetched_s"))
    return hist_tokens.groupBy("creator", "mint").agg(
        F.min("created_s").alias("created_s"), F.max("graduated").alias("graduated"), F.min(graduated_s).alias("graduated_s"),
        *[F.max_by(c, newest).alias(c) for c in ("holders", "ath_mcap_usd", "liquidity_usd")], F.max("fetched_s").alias("fetched_s"),
    )


def merge_tokens(tok: DataFrame, hist_tokens: DataFrame) -> DataFrame:
    """The tracked tokens with what snapshots know of them: creator, creation, graduation, holders, highest value and liquidity.  Tokens that are not tracked stay out."""
    newest = F.struct("fetched_s", "creator")
    known = listed_tokens(hist_tokens).groupBy("mint").agg(
        F.max_by("creator", newest).alias("_creator"), F.min("created_s").alias("_created"), F.max("graduated").alias("_graduated"), F.min("graduated_s").alias("_graduated_s"),
        *[F.max_by(c, newest).alias(c) for c in ("holders", "ath_mcap_usd")], F.max_by("liquidity_usd", newest).alias("rest_usd"), F.max("fetched_s").alias("rest_at_s"),
    )
    joined = tok.drop("holders", "ath_mcap_usd", "rest_usd", "rest_at_s").join(known, "mint", "left")
    rank = F.greatest("stage_rank", F.when(F.col("_graduated"), STAGE_RANK["graduated"]))
    out = joined.withColumns({
        "creator": F.coalesce("creator", "_creator"), "created_at_s": F.least("created_at_s", "_created"), "stage_rank": rank,
        "graduated_at_s": F.least("graduated_at_s", "_graduated_s"), "stage": stage_name(rank),
    })
    return out.drop("_creator", "_created", "_graduated", "_graduated_s")


def merge_launches(la: DataFrame, tok: DataFrame, hist_tokens: DataFrame) -> DataFrame:
    """Launches of the stream and of snapshots; of tokens that are not tracked, what became of them as the snapshot says."""
    listed = listed_tokens(hist_tokens)
    both = la.select("creator", "mint", "created_s", "source").unionByName(listed.select("creator", "mint", "created_s", F.lit("rest").alias("source")))
    # 'stream' > 'rest' as text, which is the rank wanted.
    launches = both.groupBy("creator", "mint").agg(F.min("created_s").alias("created_s"), F.max("source").alias("source"))
    fate = listed.join(tok.select("mint"), "mint", "left_anti").select(
        "creator", "mint", F.when(F.col("graduated"), "graduated").alias("stage"), F.col("liquidity_usd").alias("rest_usd"), "holders", "ath_mcap_usd", F.col("fetched_s").alias("at_s")
    )
    return launches.join(fate, ["creator", "mint"], "left")


def merge_creators(creators: DataFrame, hist: DataFrame, launches: DataFrame, now_s: Column, params: Params = DEFAULTS) -> DataFrame:
    """Creators with a snapshot's totals, wider first and last times, and the serial flag looked at again over the merged launches.  It is never taken back."""
    newest = F.struct("fetched_s", "tokens_launched")
    totals = hist.groupBy("creator").agg(
        F.max_by("tokens_launched", newest).alias("tokens_launched"), F.max_by("migrated", newest).alias("migrated"), F.max("fetched_s").alias("fetched_s"),
        F.min("first_launch_s").alias("_first"), F.max("last_launch_s").alias("_last"),
    )
    per = launches.groupBy("creator").agg(F.count(F.lit(1)).alias("launches"), F.min("created_s").alias("_low"), F.max("created_s").alias("_high"))
    recent = launches_in_window(launches, now_s, params.burst_window_s).withColumnRenamed("n", "_recent")
    base = creators.select("creator", "first_seen_s", "last_seen_s", F.col("serial").alias("_serial"))
    out = base.join(totals, "creator", "full").join(per, "creator", "left").join(recent, "creator", "left")
    serial = F.coalesce("_serial", F.lit(False)) | (F.coalesce("_recent", F.lit(0)) > params.burst_max_launches)
    return out.select(
        "creator", F.least("first_seen_s", "_first", "_low").alias("first_seen_s"), F.greatest("last_seen_s", "_last", "_high").alias("last_seen_s"),
        F.coalesce("launches", F.lit(0).cast("bigint")).alias("launches"), serial.alias("serial"), "tokens_launched", "migrated", "fetched_s",
    )


def apply_creator_history(
    ev: DataFrame, tok: DataFrame, creators: DataFrame, hist: DataFrame, hist_tokens: DataFrame, now_s: Column, params: Params = DEFAULTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, launches, creators) after the snapshots."""
    launches = merge_launches(creator_launches(ev), tok, hist_tokens)
    return merge_tokens(tok, hist_tokens), launches, merge_creators(creators, hist, launches, now_s, params)
