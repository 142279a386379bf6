"""Token and pool state over the adapter."""

from pyspark.sql import functions as F

from drainwatch.catalog.adapter import EV, PARAMS, RD, TOK, readings, sql, token_events
from drainwatch.catalog.registry import query
from drainwatch.plans import tokens

_DOUBLE = lambda c: F.col(c).cast("double").alias(c)


def _all(spark, sf_dir):
    ev = token_events(spark, sf_dir)
    return ev, readings(ev), tokens.token_dim(ev)


@query("T1_token_dim", sql(TOK, "SELECT mint, creator, created_at_s, stage, graduated_at_s, graduation_pool, first_seen_s, last_activity_s FROM tok"))
def t1(spark, sf_dir):
    return tokens.token_dim(token_events(spark, sf_dir)).select(
        "mint", "creator", "created_at_s", "stage", "graduated_at_s", "graduation_pool", "first_seen_s", "last_activity_s"
    )


@query("T2_created_at", sql(EV, "SELECT mint, min(bt) AS created_at_s FROM ev WHERE typ = 'token_create' GROUP BY mint"))
def t2(spark, sf_dir):
    tok = tokens.token_dim(token_events(spark, sf_dir))
    return tok.filter("created_at_s is not null").select("mint", "created_at_s")


@query("T3_stage", sql(TOK, "SELECT stage, count(*) AS n FROM tok GROUP BY stage"))
def t3(spark, sf_dir):
    return tokens.token_dim(token_events(spark, sf_dir)).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("T4_graduated_at", sql(TOK, "SELECT mint, graduated_at_s, graduation_pool FROM tok WHERE graduated_at_s IS NOT NULL"))
def t4(spark, sf_dir):
    tok = tokens.token_dim(token_events(spark, sf_dir))
    return tok.filter("graduated_at_s is not null").select("mint", "graduated_at_s", "graduation_pool")


_BUCKETED = """, bucketed AS (SELECT *, row_number() OVER (PARTITION BY mint, pool, bt // 3600 ORDER BY bt DESC, slot DESC) AS rn FROM rd)"""


@query("T9_downsample_readings", sql(RD + _BUCKETED, "SELECT mint, pool, bt AS at_s, slot, CAST(usd AS DOUBLE) AS usd FROM bucketed WHERE rn = 1"))
def t9(spark, sf_dir):
    _, rd, _ = _all(spark, sf_dir)
    return tokens.downsample_readings(rd, 3600).select("mint", "pool", "at_s", F.col("pos.slot").alias("slot"), _DOUBLE("usd"))


@query(
    "T10_keep_newest_readings",
    sql(RD, """SELECT mint, pool, bt AS at_s, slot, CAST(usd AS DOUBLE) AS usd FROM rd
QUALIFY row_number() OVER (PARTITION BY mint ORDER BY bt DESC, slot DESC) <= 20"""),
)
def t10(spark, sf_dir):
    _, rd, _ = _all(spark, sf_dir)
    return tokens.keep_newest_readings(rd, 20).select("mint", "pool", "at_s", F.col("pos.slot").alias("slot"), _DOUBLE("usd"))


@query("T11_peak_liquidity", sql(RD, "SELECT mint, CAST(max(usd) AS DOUBLE) AS peak_usd, arg_min(bt, (-usd, bt)) AS peak_at_s FROM rd GROUP BY mint"))
def t11(spark, sf_dir):
    _, rd, _ = _all(spark, sf_dir)
    return tokens.peak_liquidity(rd).select("mint", _DOUBLE("peak_usd"), "peak_at_s")


_POOLS = """, pools AS (
  SELECT e.mint, e.pool, max(e.bt) AS last_seen_s, any_value(e.dex) AS dex,
    arg_max(e.usd, (e.bt, e.slot)) FILTER (WHERE e.typ IN ('add', 'remove', 'swap')) AS latest_usd
  FROM ev e GROUP BY e.mint, e.pool)"""


@query("T12_pool_dim", sql(RD + _POOLS, "SELECT mint, pool, dex, last_seen_s, CAST(latest_usd AS DOUBLE) AS latest_usd FROM pools"))
def t12(spark, sf_dir):
    ev, rd, _ = _all(spark, sf_dir)
    return tokens.pool_dim(ev, rd).select("mint", "pool", "dex", "last_seen_s", _DOUBLE("latest_usd"))


@query(
    "T13_top_pools",
    sql(RD + _POOLS, """SELECT mint, pool, last_seen_s FROM pools
QUALIFY row_number() OVER (PARTITION BY mint ORDER BY last_seen_s DESC, pool DESC) <= 2"""),
)
def t13(spark, sf_dir):
    ev, rd, _ = _all(spark, sf_dir)
    return tokens.top_pools(tokens.pool_dim(ev, rd), 2).select("mint", "pool", "last_seen_s")


_TRADABLE = _POOLS + """, tradable AS (
  SELECT p.mint, sum(latest_usd) AS tradable_usd FROM pools p JOIN tok t ON t.mint = p.mint AND t.stage = 'graduated'
  WHERE latest_usd IS NOT NULL AND dex <> 'pumpfun' GROUP BY p.mint),
cur AS (
  SELECT t.mint, coalesce(any_value(d.tradable_usd), sum(p.latest_usd)) AS current_usd
  FROM tok t LEFT JOIN tradable d ON d.mint = t.mint LEFT JOIN pools p ON p.mint = t.mint GROUP BY t.mint)"""


@query("T14_tradable_liquidity", sql(RD + _TRADABLE, "SELECT mint, CAST(tradable_usd AS DOUBLE) AS tradable_usd FROM tradable"))
def t14(spark, sf_dir):
    ev, rd, tok = _all(spark, sf_dir)
    return tokens.tradable_liquidity(tokens.pool_dim(ev, rd), tok).select("mint", _DOUBLE("tradable_usd"))


@query("T15_tradable_peak", sql(RD, "SELECT mint, CAST(max(usd) AS DOUBLE) AS tradable_peak_usd FROM rd WHERE dex <> 'pumpfun' GROUP BY mint"))
def t15(spark, sf_dir):
    _, rd, _ = _all(spark, sf_dir)
    return tokens.tradable_peak(rd).select("mint", _DOUBLE("tradable_peak_usd"))


@query("T16_current_liquidity", sql(RD + _TRADABLE, "SELECT mint, CAST(current_usd AS DOUBLE) AS current_usd FROM cur"))
def t16(spark, sf_dir):
    ev, rd, tok = _all(spark, sf_dir)
    return tokens.current_liquidity(tokens.pool_dim(ev, rd), rd, tok).select("mint", _DOUBLE("current_usd"))


OUTCOME = _TRADABLE + """, outcome AS (
  SELECT t.mint, t.creator, t.stage,
    CASE WHEN t.stage = 'graduated' THEN coalesce(max(r.held), max(r.usd)) ELSE max(r.usd) END AS peak_usd,
    any_value(c.current_usd) AS last_usd, t.last_activity_s AS at_s
  FROM tok t LEFT JOIN rd r ON r.mint = t.mint LEFT JOIN cur c ON c.mint = t.mint GROUP BY t.mint, t.creator, t.stage, t.last_activity_s)"""


def outcomes(spark, sf_dir):
    ev, rd, tok = _all(spark, sf_dir)
    return tokens.token_outcome(tok, tokens.pool_dim(ev, rd), rd)


@query("T18_token_outcome", sql(RD + OUTCOME, "SELECT mint, creator, stage, CAST(peak_usd AS DOUBLE) AS peak_usd, CAST(last_usd AS DOUBLE) AS last_usd, at_s FROM outcome"))
def t18(spark, sf_dir):
    return outcomes(spark, sf_dir).select("mint", "creator", "stage", _DOUBLE("peak_usd"), _DOUBLE("last_usd"), "at_s")


_MERGED = OUTCOME + """, cutoff AS (SELECT min(bt) + (max(bt) - min(bt)) // 2 AS half FROM ev),
early AS (SELECT mint, max(usd) AS peak_usd, arg_max(usd, (bt, slot)) AS last_usd, max(bt) AS at_s FROM rd, cutoff WHERE bt <= half GROUP BY mint),
late AS (SELECT o.* FROM outcome o, cutoff WHERE o.at_s > half AND o.mint IN (SELECT mint FROM rd, cutoff WHERE bt > half AND dex <> 'pumpfun'))"""


@query(
    "T19_merge_outcomes",
    sql(RD + _MERGED, """SELECT coalesce(e.mint, l.mint) AS mint, coalesce(l.stage, 'created') AS stage,
  CAST(coalesce(l.peak_usd, e.peak_usd) AS DOUBLE) AS peak_usd, CAST(coalesce(l.last_usd, e.last_usd) AS DOUBLE) AS last_usd,
  greatest(coalesce(e.at_s, l.at_s), coalesce(l.at_s, e.at_s)) AS at_s
FROM early e FULL JOIN late l ON e.mint = l.mint"""),
)
def t19(spark, sf_dir):
    """Outcomes folded half way (a plain last reading) under the outcomes of tokens still active later."""
    ev, rd, tok = _all(spark, sf_dir)
    span = ev.agg(F.min("block_time_s").alias("lo"), F.max("block_time_s").alias("hi")).first()
    half = span.lo + (span.hi - span.lo) // 2
    folded = rd.filter(F.col("at_s") <= half).groupBy("mint").agg(
        F.lit("created").alias("stage"), F.max("usd").alias("peak_usd"),
        F.max_by("usd", "pos").alias("last_usd"), F.max("at_s").alias("at_s"),
    )
    active = rd.filter((F.col("at_s") > half) & (F.col("dex") != "pumpfun")).select("mint")
    tracked = tokens.token_outcome(tok, tokens.pool_dim(ev, rd), rd).filter(F.col("at_s") > half).join(active, "mint", "left_semi")
    merged = tokens.merge_outcomes(folded, tracked.select("mint", "stage", "peak_usd", "last_usd", "at_s"))
    return merged.select("mint", "stage", _DOUBLE("peak_usd"), _DOUBLE("last_usd"), "at_s")


@query("R11_collapsed", sql(RD + OUTCOME, "SELECT mint, coalesce(peak_usd >= 100 AND last_usd <= 10, false) AS collapsed FROM outcome"))
def r11(spark, sf_dir):
    return outcomes(spark, sf_dir).select("mint", tokens.collapsed(params=PARAMS).alias("collapsed"))


@query("N24_tracked_filter", sql(EV, "SELECT typ IN ('add', 'remove') AS pair_event, count(*) AS n FROM ev GROUP BY 1"))
def n24(spark, sf_dir):
    from drainwatch.functions.events import tracked_filter

    rows = tracked_filter(token_events(spark, sf_dir))
    return rows.groupBy((F.col("type") == "liquidity").alias("pair_event")).agg(F.count(F.lit(1)).alias("n"))
