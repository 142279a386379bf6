"""Token and pool state as aggregates.

Inputs
    ev  events: type, kind, mint, pool, dex, actor, block_time_s, pos and, on identity rows,
        launchpad, name, symbol, quote_mint
    rd  readings: mint, source (pool | curve | rest), pool, dex, at_s, pos, usd, holders

``pos`` is a struct of on-chain position parts and compares part by part.  Every fold here is a
min, a max or an argmax, so arrival order and repeated rows change nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.operators.select import newest_per_key
from drainwatch.params import CURVE_DEXES, DEFAULTS, STAGE_RANK

IDENTITY_TYPES = ("token_create", "meme", "graduation")


def stage_rank(type_col: str = "type") -> Column:
    """The stage an event proves, as its rank."""
    t = F.col(type_col)
    return (
        F.when(t == "graduation", STAGE_RANK["graduated"])
        .when(t == "meme", STAGE_RANK["curve"])
        .otherwise(STAGE_RANK["created"])
    )


def stage_name(rank: Column) -> Column:
    out = F.lit("created")
    for name in ("curve", "graduated"):
        out = F.when(rank >= STAGE_RANK[name], name).otherwise(out)
    return out


def tradable_venue(dex: str = "dex") -> Column:
    """False only for a launchpad's own curve venue."""
    return F.coalesce(~F.col(dex).isin(*CURVE_DEXES), F.lit(True))


def _first_known(column: str, born: Column, other: Column) -> Column:
    """The creation event's value, else the earliest any other identity event gave."""
    known = F.col(column).isNotNull()
    return F.coalesce(
        F.min_by(column, F.when(born, F.col("pos"))),
        F.min_by(column, F.when(other & known, F.col("pos"))),
    ).alias(column)


def _creators(born: Column, other: Column) -> list[Column]:
    named = F.when(other & F.col("creator").isNotNull(), F.col("pos"))
    launch = F.when(born, F.col("pos"))
    return [F.min_by("creator", launch).alias("born_by"), F.min(launch).alias("born_pos"), F.min_by("creator", named).alias("known_by"), F.min(named).alias("known_pos")]


def creator_then(columns: list[str]) -> Column:
    """The creator as known at ``pos``, where the token table says from when (``online``); else the token's.  An event before its token counts from the token's first."""
    if "born_pos" not in columns:
        return F.col("creator")
    at = F.when(F.col("pos") < F.col("first_pos"), F.col("first_pos")).otherwise(F.col("pos"))
    return F.when(at >= F.col("born_pos"), F.col("born_by")).when(at >= F.col("known_pos"), F.col("known_by"))


# What ``creator_then`` reads of a token.
CREATOR = ("creator", "born_by", "born_pos", "known_by", "known_pos", "first_pos")


def creator_columns(tok: DataFrame) -> list[str]:
    return [c for c in CREATOR if c in tok.columns]


def token_dim(ev: DataFrame, history: DataFrame | None = None, online: bool = False) -> DataFrame:
    """One row per token: identity, times, stage.

    ``online`` adds who is known as the creator from when: born_by and born_pos (the first launch), known_by and known_pos (the first other event that names one).

    Identity columns come from the few identity rows only; the firehose rows contribute two
    longs (first and last activity), which hash-aggregate on the map side.
    """
    born, other = F.col("type") == "token_create", F.col("type") != "token_create"
    ident = ev.filter(F.col("type").isin(*IDENTITY_TYPES)).withColumnRenamed("actor", "creator")
    optional = [c for c in ("launchpad", "name", "symbol", "quote_mint") if c in ev.columns]
    grad = F.when(F.col("type") == "graduation", F.col("pos"))
    dim = ident.groupBy("mint").agg(
        *[_first_known(c, born, other) for c in ["creator", *optional]],
        F.min(F.when(born, F.col("block_time_s"))).alias("created_at_s"),
        F.max(stage_rank()).alias("stage_rank"),
        F.min(F.when(F.col("type") == "graduation", F.col("block_time_s"))).alias("graduated_at_s"),
        F.min_by("pool", grad).alias("graduation_pool"),
        F.min(grad).alias("graduated_pos"),
        F.min("pos").alias("first_pos"),
        *(_creators(born, other) if online else []),
    )
    activity = ev.groupBy("mint").agg(
        F.min("block_time_s").alias("first_seen_s"), F.max("block_time_s").alias("last_activity_s")
    )
    tok = dim.join(activity, "mint")
    if history is not None:
        known = history.select("mint", F.col("creator").alias("_creator"), F.col("created_s").alias("_created"))
        tok = (
            tok.join(known, "mint", "left")
            .withColumn("creator", F.coalesce("creator", "_creator"))
            .withColumn("created_at_s", F.least("created_at_s", "_created"))
            .drop("_creator", "_created")
        )
    return tok.withColumn("stage", stage_name(F.col("stage_rank")))


def curve_progress(meme: DataFrame) -> DataFrame:
    """Progress of the newest curve snapshot; on equal time the larger percentage."""
    newest = F.struct("block_time_s", "progress_pct")
    return meme.groupBy("mint").agg(F.max_by("progress_pct", newest).alias("progress_pct"))


def downsample_readings(rd: DataFrame, bucket_s: int = DEFAULTS.reading_bucket_s) -> DataFrame:
    """One reading per (token, source, pool, bucket): the newest by the total reading order."""
    order = F.struct("pos", "source", F.coalesce("pool", F.lit("")), "usd", F.coalesce("holders", F.lit(-1)))
    keys = ["mint", "source", "pool"]
    rest = [c for c in rd.columns if c not in keys]
    bucket = F.floor(F.col("at_s") / bucket_s).alias("bucket")
    kept = rd.groupBy(*keys, bucket).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return kept.select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*rd.columns)


def keep_newest_readings(rd: DataFrame, n: int) -> DataFrame:
    order = [F.desc("pos"), F.desc("source"), F.desc(F.coalesce("pool", F.lit(""))), F.desc("usd")]
    return newest_per_key(rd, ["mint"], order, n)


def peak_liquidity(rd: DataFrame) -> DataFrame:
    """Largest reading ever offered and the earliest time it was reached (before downsampling)."""
    return rd.groupBy("mint").agg(
        F.max("usd").alias("peak_usd"), F.min_by("at_s", F.struct(-F.col("usd"), F.col("at_s"))).alias("peak_at_s")
    )


def pool_dim(ev: DataFrame, rd: DataFrame) -> DataFrame:
    """One row per (token, pool).

    The venue of the newest reading wins over whoever announced the pool, since migrations
    announce a pool under the launchpad's name.
    """
    announced = ev.filter(F.col("pool").isNotNull()).groupBy("mint", "pool").agg(
        F.min_by("dex", F.when(F.col("dex").isNotNull(), F.col("pos"))).alias("announced_dex"),
        F.max("block_time_s").alias("last_seen_s"),
    )
    latest = (
        rd.filter((F.col("source") == "pool") & F.col("usd").isNotNull())
        .groupBy("mint", "pool")
        .agg(F.max_by(F.struct("usd", "dex", "at_s"), F.struct("pos", "usd")).alias("r"))
    )
    return announced.join(latest, ["mint", "pool"], "left").select(
        "mint",
        "pool",
        F.coalesce(F.col("r.dex"), F.when(F.col("r").isNull(), F.col("announced_dex"))).alias("dex"),
        F.col("r.usd").alias("latest_usd"),
        F.col("r.at_s").alias("latest_at_s"),
        "last_seen_s",
    )


def top_pools(pools: DataFrame, n: int) -> DataFrame:
    return newest_per_key(pools, ["mint"], [F.desc("last_seen_s"), F.desc("pool")], n)


def tradable_liquidity(pools: DataFrame, tok: DataFrame) -> DataFrame:
    """What can be sold into: the sum over non-curve pools of a graduated token."""
    graduated = tok.filter(F.col("stage") == "graduated").select("mint")
    priced = pools.filter(F.col("latest_usd").isNotNull() & tradable_venue())
    return priced.groupBy("mint").agg(F.sum("latest_usd").alias("tradable_usd")).join(graduated, "mint", "left_semi")


def tradable_peak(rd: DataFrame) -> DataFrame:
    """Largest single reading in a non-curve pool, before graduation too."""
    pool = rd.filter((F.col("source") == "pool") & tradable_venue())
    return pool.groupBy("mint").agg(F.max("usd").alias("tradable_peak_usd"))


def _newest_of_source(rd: DataFrame, source: str, name: str) -> DataFrame:
    rows = rd.filter(F.col("source") == source)
    return rows.groupBy("mint").agg(F.max_by("usd", F.struct("pos", "usd")).alias(name))


def latest_rest_reading(rd: DataFrame) -> DataFrame:
    return _newest_of_source(rd, "rest", "rest_usd")


def current_liquidity(pools: DataFrame, rd: DataFrame, tok: DataFrame) -> DataFrame:
    """Tradable liquidity if graduated and known, else all pools, else the last curve reading."""
    every = pools.filter(F.col("latest_usd").isNotNull()).groupBy("mint").agg(F.sum("latest_usd").alias("all_usd"))
    parts = [tradable_liquidity(pools, tok), every, _newest_of_source(rd, "curve", "curve_usd")]
    joined = reduce(lambda a, b: a.join(b, "mint", "left"), parts, tok.select("mint"))
    return joined.select("mint", F.coalesce("tradable_usd", "all_usd", "curve_usd").alias("current_usd"))


def token_outcome(tok: DataFrame, pools: DataFrame, rd: DataFrame) -> DataFrame:
    """What became of each token: the row folded into its creator's record."""
    parts = [
        peak_liquidity(rd).select("mint", "peak_usd"),
        tradable_peak(rd),
        current_liquidity(pools, rd, tok),
        latest_rest_reading(rd),
    ]
    joined = reduce(lambda a, b: a.join(b, "mint", "left"), parts, tok)
    graduated = F.col("stage") == "graduated"
    null = lambda name, kind: F.col(name) if name in tok.columns else F.lit(None).cast(kind).alias(name)
    return joined.select(
        "mint",
        "creator",
        "stage",
        F.coalesce(F.when(graduated, F.col("tradable_peak_usd")), F.col("peak_usd")).alias("peak_usd"),
        F.col("current_usd").alias("last_usd"),
        "rest_usd",
        null("holders", "bigint"),
        null("ath_mcap_usd", "decimal(38,18)"),
        F.col("last_activity_s").alias("at_s"),
    )


def merge_outcomes(folded: DataFrame, tracked: DataFrame) -> DataFrame:
    """Folded launch outcomes under tracked ones: null never overwrites, stages only move forward."""
    both = folded.withColumn("_rank", F.lit(0)).unionByName(tracked.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    ranks = F.create_map(*[x for k, v in STAGE_RANK.items() for x in (F.lit(k), F.lit(v))])
    fields = [c for c in both.columns if c not in ("mint", "stage", "at_s", "_rank")]
    order = F.struct("_rank", "at_s")
    merged = both.groupBy("mint").agg(
        F.max(ranks[F.col("stage")]).alias("_stage"),
        F.max("at_s").alias("at_s"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields],
    )
    return merged.withColumn("stage", stage_name(F.col("_stage"))).select(
        "mint", "stage", *fields, "at_s"
    )


def collapsed(peak: str = "peak_usd", last: str = "last_usd", params=DEFAULTS) -> Column:
    """Once worth something, now worth nothing."""
    return F.coalesce((F.col(peak) >= params.min_peak_usd) & (F.col(last) <= params.max_floor_usd), F.lit(False))
