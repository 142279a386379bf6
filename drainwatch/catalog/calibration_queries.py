"""Features and the calibration report over the adapter, and the statistics over other tables."""

from pyspark.sql import functions as F

from drainwatch.catalog.adapter import EV, PARAMS, RD, Story, readings, sql, table, token_events
from drainwatch.catalog.creator_queries import ASKED, LA, PATIENT, Work
from drainwatch.catalog.registry import query
from drainwatch.catalog.rule_queries import CLOCK, SLOT, clock
from drainwatch.catalog.state_queries import OUTCOME, outcomes
from drainwatch.operators.quantiles import auc, index_quantiles
from drainwatch.operators.select import tally
from drainwatch.plans import calibration as cal
from drainwatch.plans import creators, features
from drainwatch.session import settle, work_path
from drainwatch.sources import tables

_DOUBLE = lambda c: F.col(c).cast("double").alias(c)
BAND = PARAMS.with_(fingerprint_min=60, fingerprint_max=110)
# The adapter's pools seldom end near zero: an ending under 60 counts as collapsed in the report.
# The adapter's swaps come hours apart: twelve days after graduation count as early.
EARLY_S = 12 * 86400
ENDED = PARAMS.with_(max_floor_usd=60)


def legs_of(ev):
    """Readings resolved to their token: one swap in six is the quote leg, one token in ten pairs with another coin."""
    number = F.substring("mint", 2, 20).cast("bigint")
    slot = F.col("pos.slot")
    return readings(ev).select(
        "mint", "pool", "dex", "event", "kind", "actor", "at_s", "pos", "usd", "source", "holders",
        ((F.col("event") == "liquidity") | (slot % 6 != 0)).alias("is_base"),
        (number % 10 != 0).alias("native"), (slot % 2 == 0).alias("sell"),
        F.col("usd").alias("moved"), F.col("usd").alias("reserve"), (slot * 1000).alias("base_reserve"),
        (1 + F.floor(F.col("at_s") / 86400) % 3).cast("int").alias("price"),
    )


class Capture:
    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.ev = token_events(spark, sf_dir)
        self.named = self.ev.withColumn("name", F.concat(F.lit(" Coin "), F.upper("actor")))
        self.legs = legs_of(self.ev)

    def base(self):
        return features.token_features(self.named)

    def full(self):
        ft = self.base()
        done = ft.join(features.all_pool_collapse(self.legs, ft, PARAMS), "mint", "left")
        return done.join(features.tradable_series(self.legs, ft, PARAMS), "mint", "left")

    def facts(self, min_swaps=10):
        """One narrow row per token, read by every table of the report: written once."""
        ft = settle(self.full(), "features")
        liq = features.liquidity_rows(self.legs)
        sw = features.graduated_swaps(self.legs, ft)
        facts = settle(cal.token_facts(ft, outcomes(self.spark, self.sf_dir), liq, sw, ENDED, min_swaps, EARLY_S), "facts")
        return facts, liq, sw


FT = RD + OUTCOME + """,
legs AS (SELECT *, typ <> 'swap' OR slot % 6 <> 0 AS is_base, CAST(substr(mint, 2) AS BIGINT) % 10 <> 0 AS native, slot % 2 = 0 AS sell,
  1 + (bt // 86400) % 3 AS price, CASE WHEN typ = 'swap' THEN 'swap' ELSE 'liquidity ' || typ END AS cause FROM rd),
ft0 AS (SELECT mint,
  coalesce(arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'token_create'), arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'graduation')) AS creator,
  min(bt) FILTER (WHERE typ = 'token_create') AS created_s, arg_min(dex, (bt, slot)) FILTER (WHERE typ = 'token_create') AS launchpad,
  lower(trim(' Coin ' || upper(arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'token_create')))) AS name,
  min(bt) FILTER (WHERE typ = 'graduation') AS grad_at_s, arg_min(dex, (bt, slot)) FILTER (WHERE typ = 'graduation') AS grad_dex,
  arg_min(slot, (bt, slot)) FILTER (WHERE typ = 'graduation') AS gslot
  FROM ev WHERE typ IN ('token_create', 'graduation') GROUP BY mint),
legg AS (SELECT l.*, coalesce((l.bt, l.slot) > (f.grad_at_s, f.gslot), false) AS grad FROM legs l JOIN ft0 f ON f.mint = l.mint),
fst AS (SELECT *, CASE WHEN native THEN held END AS uheld FROM legg WHERE is_base),
fdi AS (SELECT *, coalesce(uheld, 0) - coalesce(lag(coalesce(uheld, 0)) OVER p, 0) AS udiff, coalesce(held, 0) - coalesce(lag(coalesce(held, 0)) OVER p, 0) AS hdiff,
  usd - coalesce(lag(usd) OVER p, 0) AS adiff FROM fst WINDOW p AS (PARTITION BY mint, pool ORDER BY bt, slot)),
fsu AS (SELECT *, sum(udiff) OVER m AS utotal, CASE WHEN count(held) OVER m > 0 THEN sum(hdiff) OVER m END AS htotal, sum(adiff) OVER m AS atotal, max(usd) OVER m AS apeak
  FROM fdi WINDOW m AS (PARTITION BY mint ORDER BY bt, slot ROWS UNBOUNDED PRECEDING)),
ser AS (SELECT *, max(now_usd) OVER (PARTITION BY mint ORDER BY bt, slot) AS pk FROM (SELECT *, utotal * price AS now_usd FROM fsu WHERE grad)),
tser AS (SELECT mint, max(now_usd) AS tradable_peak, arg_max(now_usd, (bt, slot)) AS tradable_last,
  min(bt) FILTER (WHERE pk >= 100 AND now_usd <= 10) AS tradable_collapse_at_s, arg_min(cause, (bt, slot)) FILTER (WHERE pk >= 100 AND now_usd <= 10) AS tradable_collapse_by,
  arg_min(actor, (bt, slot)) FILTER (WHERE pk >= 100 AND now_usd <= 10) AS tradable_collapse_actor FROM ser GROUP BY mint),
col AS (SELECT mint, min(bt) AS collapse_at_s, arg_min(cause, (bt, slot)) AS collapse_by, arg_min(actor, (bt, slot)) AS collapse_actor FROM fsu
  WHERE apeak >= 100 AND coalesce(CASE WHEN grad THEN htotal END, atotal) <= 10 GROUP BY mint),
ft AS (SELECT f.*, c.collapse_at_s, c.collapse_by, c.collapse_actor, t.tradable_peak, t.tradable_last, t.tradable_collapse_at_s, t.tradable_collapse_by, t.tradable_collapse_actor
  FROM ft0 f LEFT JOIN col c ON c.mint = f.mint LEFT JOIN tser t ON t.mint = f.mint)"""

_SWAPS = "SELECT mint, bt, sell, actor, CASE WHEN native THEN usd ELSE -1 END AS reserve FROM legg WHERE typ = 'swap' AND is_base AND grad"
FACTS = FT + f""",
liq AS (SELECT mint, bt, slot, typ AS kind, actor AS provider, pool, dex, CASE WHEN native THEN usd END AS moved FROM legs WHERE typ <> 'swap'),
sw AS ({_SWAPS}),
fadd AS (SELECT l.mint, l.bt AS add_at_s, l.moved AS add_units, l.dex AS add_dex FROM liq l JOIN ft f ON f.mint = l.mint
  WHERE kind = 'add' AND provider = f.creator AND (f.collapse_at_s IS NULL OR l.bt <= f.collapse_at_s) QUALIFY row_number() OVER (PARTITION BY l.mint ORDER BY l.bt, l.slot) = 1),
shr AS (SELECT s.mint, count(*) AS n_all, count(*) FILTER (WHERE sell) AS s_all, count(*) FILTER (WHERE bf) AS n_before, count(*) FILTER (WHERE bf AND sell) AS s_before,
  count(*) FILTER (WHERE bf AND s.bt < grad_at_s + {EARLY_S}) AS n_early, count(*) FILTER (WHERE bf AND sell AND s.bt < grad_at_s + {EARLY_S}) AS s_early, count(DISTINCT actor) AS traders
  FROM (SELECT s.*, f.grad_at_s, f.collapse_at_s IS NULL OR s.bt < f.collapse_at_s AS bf FROM sw s JOIN ft f ON f.mint = s.mint) s GROUP BY s.mint),
net AS (SELECT l.mint, coalesce(sum(CASE WHEN kind = 'remove' THEN moved ELSE -moved END), 0) AS net_units FROM liq l JOIN ft f ON f.mint = l.mint AND f.creator = l.provider GROUP BY l.mint),
sel AS (SELECT mint, sum(n) AS sells, max(n) AS top_sells FROM (SELECT s.mint, s.actor, count(*) AS n FROM sw s JOIN ft f ON f.mint = s.mint
  WHERE sell AND (f.collapse_at_s IS NULL OR s.bt <= f.collapse_at_s) GROUP BY ALL) GROUP BY mint),
rem AS (SELECT l.mint, max(CASE WHEN l.provider = f.creator THEN 1 ELSE 0 END) AS creator_removed FROM liq l JOIN ft f ON f.mint = l.mint
  WHERE kind = 'remove' AND (f.collapse_at_s IS NULL OR l.bt <= f.collapse_at_s) GROUP BY l.mint),
facts AS (SELECT f.*, o.stage, o.peak_usd, o.last_usd, a.add_at_s, a.add_units, a.add_dex, n.net_units, s.sells, s.top_sells, coalesce(h.traders, 0) AS traders, r.creator_removed,
  CASE WHEN n_all >= 10 THEN s_all / CAST(n_all AS DOUBLE) END AS share_all, CASE WHEN n_before >= 10 THEN s_before / CAST(n_before AS DOUBLE) END AS share_before,
  CASE WHEN n_early >= 10 THEN s_early / CAST(n_early AS DOUBLE) END AS share_early,
  coalesce(o.peak_usd >= 100 AND o.last_usd <= 60, false) AS collapsed, o.stage = 'graduated' AS graduated, a.add_at_s IS NOT NULL AS signal
  FROM ft f LEFT JOIN outcome o ON o.mint = f.mint LEFT JOIN fadd a ON a.mint = f.mint LEFT JOIN shr h ON h.mint = f.mint
  LEFT JOIN net n ON n.mint = f.mint LEFT JOIN sel s ON s.mint = f.mint LEFT JOIN rem r ON r.mint = f.mint)"""


def rank_sql(source, group, value, ps, rule="least(n - 1, CAST(floor({p} * n) AS BIGINT))"):
    """SQL of the index quantiles: rank within the group, then pick."""
    g = ", ".join(group)
    by = f"PARTITION BY {g} " if g else ""
    picks = ", ".join(f"max(CASE WHEN i = {rule.format(p=p)} THEN {value} END) AS {name}" for name, p in ps.items())
    head = f"{g}, " if g else ""
    return f"""SELECT {head}max(n) AS n, {picks} FROM (SELECT *, row_number() OVER ({by}ORDER BY {value}) - 1 AS i, count(*) OVER ({by.strip()}) AS n
FROM ({source}) WHERE {value} IS NOT NULL) {'GROUP BY ' + g if g else ''}"""


# ---- features

_F1 = sql(FT, "SELECT mint, creator, created_s, launchpad, name, grad_at_s, grad_dex FROM ft0")


@query("F1_token_features", _F1)
def f1(spark, sf_dir):
    return Capture(spark, sf_dir).base().drop("graduated_pos")


@query("S9_write_read_features", _F1)
def s9(spark, sf_dir):
    path = work_path(spark, "features")
    tables.write_features(Capture(spark, sf_dir).base().drop("graduated_pos"), path)
    return tables.read_features(spark, path)


@query("F2_liquidity_rows", sql(FT, "SELECT mint, bt AS at_s, typ AS kind, actor AS provider, pool, dex, CAST(CASE WHEN native THEN usd END AS DOUBLE) AS moved FROM legs WHERE typ <> 'swap'"))
def f2(spark, sf_dir):
    return features.liquidity_rows(Capture(spark, sf_dir).legs).select("mint", "at_s", "kind", "provider", "pool", "dex", _DOUBLE("moved"))


@query("F3_graduated_swaps", sql(FT, f"SELECT mint, bt AS at_s, sell, actor AS trader, CAST(reserve AS DOUBLE) AS reserve FROM ({_SWAPS})"))
def f3(spark, sf_dir):
    c = Capture(spark, sf_dir)
    return features.graduated_swaps(c.legs, c.base()).select("mint", "at_s", "sell", "trader", _DOUBLE("reserve"))


@query("F4_curve_swap_counts", sql(FT, """SELECT mint, count(*) FILTER (WHERE is_base AND NOT grad) AS curve_swaps, count(*) FILTER (WHERE is_base AND NOT grad AND sell) AS curve_sells,
  count(*) FILTER (WHERE NOT is_base) AS quote_leg_swaps FROM legg WHERE typ = 'swap' GROUP BY mint"""))
def f4(spark, sf_dir):
    c = Capture(spark, sf_dir)
    return features.curve_swap_counts(c.legs, c.base())


@query("F5_pool_last", sql(FT, """SELECT mint, pool, arg_max(dex, (bt, slot)) AS dex, max(bt) AS at_s, CAST(CASE WHEN bool_and(native) THEN arg_max(usd, (bt, slot)) END AS DOUBLE) AS units,
  arg_max(slot, (bt, slot)) * 1000 AS base_reserve, CAST(arg_max(price, (bt, slot)) AS BIGINT) AS price FROM legs WHERE is_base GROUP BY mint, pool"""))
def f5(spark, sf_dir):
    return features.pool_last(Capture(spark, sf_dir).legs).select("mint", "pool", "dex", "at_s", _DOUBLE("units"), "base_reserve", F.col("price").cast("bigint").alias("price"))


@query("F6_tradable_series", sql(FT, "SELECT mint, CAST(tradable_peak AS DOUBLE) AS tradable_peak, CAST(tradable_last AS DOUBLE) AS tradable_last, tradable_collapse_at_s, tradable_collapse_by, tradable_collapse_actor FROM tser"))
def f6(spark, sf_dir):
    c = Capture(spark, sf_dir)
    out = features.tradable_series(c.legs, c.base(), PARAMS)
    return out.withColumns({k: F.col(k).cast("double") for k in ("tradable_peak", "tradable_last")})


@query("F7_all_pool_collapse", sql(FT, "SELECT * FROM col"))
def f7(spark, sf_dir):
    c = Capture(spark, sf_dir)
    return features.all_pool_collapse(c.legs, c.base(), PARAMS)


@query("F8_capture_span", sql(EV, "SELECT min(bt) AS start_s, max(bt) AS end_s, (max(bt) - min(bt)) / 3600.0::DOUBLE AS hours FROM ev"))
def f8(spark, sf_dir):
    return features.capture_span(token_events(spark, sf_dir))


@query("F9_trader_dictionary", sql(EV, """SELECT actor AS trader, row_number() OVER (ORDER BY min((bt, slot)), actor) - 1 AS id FROM ev WHERE typ = 'swap' GROUP BY actor"""))
def f9(spark, sf_dir):
    return features.trader_dictionary(token_events(spark, sf_dir).filter("type = 'swap'"))


@query("F10_periodic_samples", sql(EV + """, g AS (SELECT *, bt - lag(bt) OVER (PARTITION BY mint ORDER BY bt, slot) AS gap FROM ev),
s1 AS (SELECT *, sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY bt, slot) AS seg FROM g),
s2 AS (SELECT *, max(CASE WHEN typ = 'graduation' THEN 1 ELSE 0 END) OVER (PARTITION BY mint, seg ORDER BY bt, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s1),
s3 AS (SELECT *, sum(CASE WHEN gap > 86400 OR (gap > 10800 AND coalesce(was, 0) = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY bt, slot) AS session FROM s2),
life AS (SELECT mint, session, min(bt) AS a, max(bt) + CASE WHEN bool_or(typ = 'graduation') THEN 86400 ELSE 10800 END AS b FROM s3 GROUP BY ALL),
samples AS (SELECT unnest(generate_series(CAST(ceil(min(bt) / 21600) AS BIGINT), CAST(ceil(max(bt) / 21600) AS BIGINT))) * 21600 AS at_s FROM ev)""",
    """SELECT s.at_s, (SELECT count(*) FROM life l WHERE l.a <= s.at_s AND s.at_s <= l.b) AS tokens, (SELECT count(*) FROM ev e WHERE e.bt <= s.at_s) AS events FROM samples s"""))
def f10(spark, sf_dir):
    return features.periodic_samples(token_events(spark, sf_dir), 21600, PARAMS.with_(idle_curve_s=10800, idle_graduated_s=86400))


# ---- report

@query("P1_metric_contingency", sql(FACTS, """SELECT collapsed AS old, coalesce(tradable_peak >= 100 AND tradable_last <= 10, false) AS tradable, tradable_peak IS NULL AS no_reading, count(*) AS n
FROM facts WHERE graduated GROUP BY ALL"""))
def p1(spark, sf_dir):
    return cal.metric_contingency(Capture(spark, sf_dir).facts()[0], PARAMS)


@query("P2_collapse_groups", sql(FACTS, """SELECT CASE WHEN signal THEN 'A creator add' WHEN NOT graduated THEN 'B curve ' || coalesce(launchpad, '?')
  WHEN created_s IS NULL THEN 'C graduated, creation not seen' ELSE 'C graduated ' || coalesce(launchpad, '?') || ', no creator add' END AS "group", count(*) AS n FROM facts WHERE collapsed GROUP BY 1"""))
def p2(spark, sf_dir):
    return cal.collapse_groups(Capture(spark, sf_dir).facts()[0])


@query("P3_first_creator_add", sql(FACTS, "SELECT mint, add_at_s, CAST(add_units AS DOUBLE) AS add_units, add_dex FROM fadd"))
def p3(spark, sf_dir):
    facts, _, _ = Capture(spark, sf_dir).facts()
    return facts.filter("signal").select("mint", "add_at_s", _DOUBLE("add_units"), "add_dex")


@query("P4_drain_mechanism", sql(FACTS, """SELECT CASE WHEN collapse_by = 'swap' THEN CASE WHEN collapse_actor = creator THEN 'sold, last by the creator' ELSE 'sold' END
    || CASE WHEN coalesce(top_sells >= sells * 0.5 AND sells > 0, false) THEN '; one wallet half or more' ELSE '; many sellers' END
  WHEN collapse_by = 'liquidity remove' THEN CASE WHEN creator_removed = 1 THEN 'removed by the creator' ELSE 'removed by a third wallet' END
  WHEN collapse_by IS NULL THEN 'not seen' ELSE collapse_by END AS mechanism, count(*) AS n FROM facts WHERE collapsed AND graduated AND NOT signal GROUP BY 1"""))
def p4(spark, sf_dir):
    return cal.drain_mechanism(Capture(spark, sf_dir).facts()[0])


@query("P5_third_party_removers", sql(FACTS, """, t AS (SELECT provider, count(*) AS n FROM liq l JOIN facts f ON f.mint = l.mint WHERE kind = 'remove' AND collapsed AND graduated AND NOT signal
  AND provider IS DISTINCT FROM creator AND (collapse_at_s IS NULL OR l.bt <= collapse_at_s) GROUP BY provider)
SELECT provider, n, (SELECT count(*) FROM t) AS distinct_wallets FROM t ORDER BY n DESC, provider LIMIT 8""").replace("\n, t AS", ", t AS"))
def p5(spark, sf_dir):
    facts, liq, _ = Capture(spark, sf_dir).facts()
    return cal.third_party_removers(liq, facts)


@query("P6_precision_of_signal", sql(FACTS, """SELECT count(*) AS matches, count(*) FILTER (WHERE collapsed) AS collapsed, count(DISTINCT creator) AS creators,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE collapsed) / CAST(count(*) AS DOUBLE) END AS precision FROM facts WHERE signal"""))
def p6(spark, sf_dir):
    return cal.precision_of_signal(Capture(spark, sf_dir).facts()[0])


@query("P7_recall_by_denominator", sql(FACTS, """SELECT denominator, count(signal) AS total, count(*) FILTER (WHERE signal) AS found,
  CASE WHEN count(signal) > 0 THEN count(*) FILTER (WHERE signal) / CAST(count(signal) AS DOUBLE) END AS recall FROM (VALUES ('all'), ('graduated'), ('by remove'), ('by creator remove'), ('by sells')) d(denominator) LEFT JOIN (
  SELECT signal, 'all' AS denominator FROM facts WHERE collapsed UNION ALL SELECT signal, 'graduated' FROM facts WHERE collapsed AND graduated
  UNION ALL SELECT signal, 'by remove' FROM facts WHERE collapsed AND graduated AND collapse_by = 'liquidity remove'
  UNION ALL SELECT signal, 'by creator remove' FROM facts WHERE collapsed AND graduated AND collapse_by = 'liquidity remove' AND collapse_actor = creator
  UNION ALL SELECT signal, 'by sells' FROM facts WHERE collapsed AND graduated AND collapse_by = 'swap') b USING (denominator) GROUP BY denominator"""))
def p7(spark, sf_dir):
    return cal.recall_by_denominator(Capture(spark, sf_dir).facts()[0])


_LEADS = "SELECT collapse_at_s - add_at_s AS lead_s FROM facts WHERE signal AND collapsed AND collapse_at_s IS NOT NULL"


@query("P8_lead_distribution", sql(FACTS, f"""SELECT q.*, r.* FROM ({rank_sql(_LEADS, [], 'lead_s', cal.DIST)}) q,
(SELECT min(lead_s) AS min, max(lead_s) AS max, count(*) FILTER (WHERE lead_s < 1) AS under_1, count(*) FILTER (WHERE lead_s < 30) AS under_30, count(*) FILTER (WHERE lead_s < 60) AS under_60,
  count(*) FILTER (WHERE lead_s < 120) AS under_120 FROM ({_LEADS})) r"""))
def p8(spark, sf_dir):
    facts, _, _ = Capture(spark, sf_dir).facts()
    return cal.distribution(cal.lead_rows(facts), "lead_s", below=(1, 30, 60, 120))


@query("P9_net_extraction", sql(FACTS, """SELECT count(*) AS n, CAST(sum(coalesce(net_units, 0)) AS DOUBLE) AS total_units, count(*) FILTER (WHERE coalesce(net_units, 0) < 0) AS losers
FROM facts WHERE signal AND collapsed"""))
def p9(spark, sf_dir):
    return cal.net_extraction(Capture(spark, sf_dir).facts()[0])


@query("P10_hits_per_hour", sql(FACTS, "SELECT add_at_s // 3600 % 24 AS utc_hour, count(*) AS n FROM facts WHERE signal AND collapsed GROUP BY 1"))
def p10(spark, sf_dir):
    return cal.hits_per_hour(Capture(spark, sf_dir).facts()[0])


@query("P11_amount_bins", sql(FACTS, """SELECT CASE WHEN add_units < 80 THEN '<80' WHEN add_units < 84.9 THEN '80-84.9' WHEN add_units <= 85.1 THEN '84.9-85.1' WHEN add_units <= 90 THEN '85.1-90' ELSE '>90' END AS bin,
  collapsed, count(*) AS n FROM facts WHERE signal AND add_units IS NOT NULL GROUP BY ALL"""))
def p11(spark, sf_dir):
    return cal.amount_bins(Capture(spark, sf_dir).facts()[0])


@query("P12_standalone_band_rule", sql(FACTS, """SELECT role, dex, count(*) AS tokens, count(*) FILTER (WHERE collapsed) AS collapsed, count(*) FILTER (WHERE collapsed) / CAST(count(*) AS DOUBLE) AS precision FROM (
  SELECT l.dex, f.collapsed, CASE WHEN l.provider = f.creator THEN 'creator' ELSE 'other' END AS role FROM liq l JOIN facts f ON f.mint = l.mint
  WHERE l.kind = 'add' AND l.moved BETWEEN 60 AND 110 AND f.stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.mint ORDER BY l.bt, l.slot) = 1) GROUP BY role, dex"""))
def p12(spark, sf_dir):
    facts, liq, _ = Capture(spark, sf_dir).facts()
    return cal.standalone_band_rule(liq, facts, BAND)


@query("P12_band_providers", sql(FACTS, """SELECT provider, count(*) AS n FROM (SELECT l.provider, f.creator FROM liq l JOIN facts f ON f.mint = l.mint
  WHERE l.kind = 'add' AND l.moved BETWEEN 60 AND 110 AND f.stage IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.mint ORDER BY l.bt, l.slot) = 1)
WHERE provider IS DISTINCT FROM creator GROUP BY provider ORDER BY n DESC, provider LIMIT 5"""))
def p12_providers(spark, sf_dir):
    facts, liq, _ = Capture(spark, sf_dir).facts()
    return cal.band_providers(liq, facts, BAND)


@query("P13_sell_share", sql(FACTS, "SELECT mint, share_all, share_before, share_early FROM facts"))
def p13(spark, sf_dir):
    return Capture(spark, sf_dir).facts()[0].select("mint", *cal.VARIANTS)


_LONG = """, long AS (SELECT mint, collapsed, v AS variant, p AS population, CASE v WHEN 'share_all' THEN share_all WHEN 'share_before' THEN share_before ELSE share_early END AS share
  FROM facts, (VALUES ('share_all'), ('share_before'), ('share_early')) a(v), (VALUES ('all'), ('with signal'), ('without signal')) b(p)
  WHERE graduated AND (p = 'all' OR (p = 'with signal') = signal)),
won AS (SELECT a.variant, a.population, sum(CASE WHEN a.share > b.share THEN 1.0 WHEN a.share = b.share THEN 0.5 ELSE 0 END) / count(*) AS auc
  FROM long a JOIN long b ON a.variant = b.variant AND a.population = b.population AND a.collapsed AND NOT b.collapsed AND a.share IS NOT NULL AND b.share IS NOT NULL GROUP BY ALL)"""


@query("P14_group_comparison", sql(FACTS + _LONG, f"""SELECT q.*, CAST(w.auc AS DOUBLE) AS auc FROM ({rank_sql('SELECT * FROM long', ['variant', 'population', 'collapsed'], 'share', {'p25': 0.25, 'p50': 0.5, 'p75': 0.75})}) q
LEFT JOIN won w ON w.variant = q.variant AND w.population = q.population"""))
def p14(spark, sf_dir):
    return cal.group_comparison(Capture(spark, sf_dir).facts()[0])


@query("P15_threshold_sweep", sql(FACTS, """SELECT CAST(c AS DOUBLE) AS cut, count(f.mint) AS flagged, count(*) FILTER (WHERE f.collapsed) AS collapsed,
  CASE WHEN count(f.mint) > 0 THEN count(*) FILTER (WHERE f.collapsed) / CAST(count(f.mint) AS DOUBLE) END AS precision
FROM (VALUES (0.3), (0.4), (0.5), (0.6)) x(c) LEFT JOIN facts f ON f.graduated AND NOT f.signal AND f.share_early <= CAST(c AS DOUBLE) GROUP BY c"""))
def p15(spark, sf_dir):
    return cal.threshold_sweep(Capture(spark, sf_dir).facts()[0], (0.3, 0.4, 0.5, 0.6))


@query("P16_distinct_traders", sql(FACTS, f"""SELECT q.*, (SELECT CAST(sum(CASE WHEN a.traders > b.traders THEN 1.0 WHEN a.traders = b.traders THEN 0.5 ELSE 0 END) / count(*) AS DOUBLE)
  FROM facts a JOIN facts b ON a.graduated AND b.graduated AND a.collapsed AND NOT b.collapsed) AS auc
FROM ({rank_sql('SELECT * FROM facts WHERE graduated', ['collapsed'], 'traders', {'p50': 0.5})}) q"""))
def p16(spark, sf_dir):
    return cal.distinct_traders(Capture(spark, sf_dir).facts()[0])


@query("P17_serial_by_graduated_share", sql(FACTS + ", " + LA, """SELECT CASE WHEN share = 0 THEN '0' WHEN share <= 0.1 THEN '(0,0.1]' WHEN share <= 0.5 THEN '(0.1,0.5]' ELSE '(0.5,1]' END AS graduated_share,
  count(*) AS creators, CAST(sum(n) AS BIGINT) AS launches, CAST(sum(gone) AS BIGINT) AS collapses FROM (
  SELECT f.creator, count(*) AS n, count(*) FILTER (WHERE collapsed) AS gone, count(*) FILTER (WHERE graduated) / CAST(count(*) AS DOUBLE) AS share FROM facts f
  WHERE f.creator IN (SELECT creator FROM la GROUP BY creator HAVING count(*) > 10) AND f.stage IS NOT NULL GROUP BY f.creator) GROUP BY 1"""))
def p17(spark, sf_dir):
    c = Capture(spark, sf_dir)
    return cal.serial_by_graduated_share(c.facts()[0], creators.creator_launches(c.ev))


_G2C = "SELECT collapse_at_s - grad_at_s AS seconds FROM facts WHERE collapsed AND graduated AND NOT signal AND collapse_at_s IS NOT NULL AND grad_at_s IS NOT NULL"


@query("P18_graduation_to_collapse", sql(FACTS, f"SELECT q.*, r.* FROM ({rank_sql(_G2C, [], 'seconds', cal.DIST)}) q, (SELECT min(seconds) AS min, max(seconds) AS max FROM ({_G2C})) r"))
def p18(spark, sf_dir):
    return cal.graduation_to_collapse(Capture(spark, sf_dir).facts()[0])


_WAITS = "SELECT class, now - enqueued_s AS wait_s FROM elig"


@query("P19_class_percentiles", sql(EV + ", " + ASKED, f"""SELECT q.*, u.under_10, u.under_60 FROM ({rank_sql(_WAITS, ['class'], 'wait_s', {'p10': 0.1, 'p50': 0.5, 'p90': 0.9}, 'CAST(floor({p} * (n - 1)) AS BIGINT)')}) q
JOIN (SELECT class, count(*) FILTER (WHERE wait_s < 10) AS under_10, count(*) FILTER (WHERE wait_s < 60) AS under_60 FROM ({_WAITS}) GROUP BY class) u ON u.class = q.class"""))
def p19(spark, sf_dir):
    w = Work(spark, sf_dir)
    return cal.class_percentiles(w.eligible().withColumn("wait_s", w.now - F.col("enqueued_s")), "class", "wait_s")


@query("P20_stratified_sample", """WITH m AS (SELECT *, md5(CAST(o_orderkey AS VARCHAR) || '|' || '7') AS mix FROM orders),
alone AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY mix) = 1)
SELECT o_orderkey, o_custkey, o_orderpriority FROM alone QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY mix) <= 30""")
def p20(spark, sf_dir):
    """Orders stand for tokens, their customers for creators."""
    rows = cal.stratified_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_custkey", 30, 7)
    return rows.select("o_orderkey", "o_custkey", "o_orderpriority")


@query("P22_name_reuse", """WITH t AS (SELECT lower(trim(text)) AS name, source FROM documents),
per AS (SELECT name, min(source) <> max(source) AS shared, count(*) AS c FROM t GROUP BY name)
SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(coalesce(sum(c) FILTER (WHERE shared), 0) AS BIGINT) AS reused FROM per""")
def p22(spark, sf_dir):
    """Documents stand for tokens: the text is the name, the source its owner."""
    return cal.name_reuse(table(spark, sf_dir, "documents"), "text", "source")


@query("P22_repeated_final_liquidity", sql(FACTS, """SELECT collapsed, CAST(sum(c) AS BIGINT) AS tokens, CAST(coalesce(sum(c) FILTER (WHERE c > 1), 0) AS BIGINT) AS repeated
FROM (SELECT collapsed, round(last_usd, 2) AS v, count(*) AS c FROM facts WHERE last_usd IS NOT NULL GROUP BY ALL) GROUP BY collapsed"""))
def p22b(spark, sf_dir):
    return cal.repeated_final_liquidity(Capture(spark, sf_dir).facts()[0])


# ---- statistics over the driver's other tables

@query("Q1_index_quantiles", rank_sql("SELECT lang, n_chars FROM documents", ["lang"], "n_chars", cal.DIST))
def q1(spark, sf_dir):
    return index_quantiles(table(spark, sf_dir, "documents"), ["lang"], "n_chars", cal.DIST)


@query("Q1_index_quantiles_prices", rank_sql("SELECT l_returnflag, l_extendedprice FROM lineitem", ["l_returnflag"], "l_extendedprice", cal.DIST))
def q1b(spark, sf_dir):
    return index_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", cal.DIST)


@query("Q2_auc", """WITH s AS (SELECT d.n_chars AS v, l.quality = 1 AS pos FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT v, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM s GROUP BY v),
r AS (SELECT *, sum(n) OVER (ORDER BY v) - n AS below FROM c)
SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, CAST(sum(p * (2 * below + n)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE) * 2) AS auc FROM r""")
def q2(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", "n_chars").join(labels, "doc_id")
    return auc(scored, "n_chars", F.col("quality") == 1)


@query("Q3_tally", "SELECT source AS key, count(*) AS n FROM documents GROUP BY source")
def q3(spark, sf_dir):
    return tally(table(spark, sf_dir, "documents"), "source")
