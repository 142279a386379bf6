"""Alerts, confirmations, their statistics and the report tables over the adapter."""

from pyspark.sql import functions as F

from drainwatch.catalog.adapter import EV, PARAMS, PRIOR, RD, RECORDS, RUGS, TOK, Story, sql
from drainwatch.catalog.registry import query
from drainwatch.operators.select import first_crossing
from drainwatch.plans import reports, rules

# A nested field selected by path keeps its last name.
SLOT = "pos.slot"
_DOUBLE = lambda c: F.col(c).cast("double").alias(c)


def clock(ev):
    """The newest event time: one number."""
    return F.lit(ev.agg(F.max("block_time_s")).first()[0])


CLOCK = ", clock AS (SELECT max(bt) AS now FROM ev)"


@query("J1_resolve_pair", sql(TOK, """SELECT e.slot, t.mint, t.creator = e.actor AS by_creator FROM ev e JOIN tok t ON t.mint = e.mint WHERE e.typ IN ('add', 'remove')"""))
def j1(spark, sf_dir):
    """Pairs are built with the token on either side; resolving must give the token back."""
    from drainwatch.plans import joins

    s = Story(spark, sf_dir)
    flipped = F.col("slot") % 2 == 0
    native = F.lit(joins.WRAPPED_SOL)
    pairs = s.ev.filter(F.col("type") == "liquidity").select(
        "slot", "actor",
        F.when(flipped, native).otherwise(F.col("mint")).alias("base_mint"),
        F.when(flipped, F.col("mint")).otherwise(native).alias("quote_mint"),
    )
    found = joins.resolve_pair(pairs, s.tok).filter("mint is not null")
    return found.join(s.tok.select("mint", "creator"), "mint").select("slot", "mint", (F.col("creator") == F.col("actor")).alias("by_creator"))


@query("W1_running_tradable", sql(RD, "SELECT mint, slot, CAST(total AS DOUBLE) AS total_usd FROM state"))
def w1(spark, sf_dir):
    return rules.running_tradable(Story(spark, sf_dir).rd).select("mint", SLOT, _DOUBLE("total_usd"))


@query("W2_running_peak", sql(RD, "SELECT mint, slot, CAST(peak AS DOUBLE) AS peak_usd FROM state"))
def w2(spark, sf_dir):
    return rules.running_peak(Story(spark, sf_dir).rd).select("mint", SLOT, _DOUBLE("peak_usd"))


@query("W3_first_crossing", sql(RD, """SELECT mint, bt AS at_s, slot, CAST(usd AS DOUBLE) AS usd FROM rd WHERE usd >= 100
QUALIFY row_number() OVER (PARTITION BY mint ORDER BY bt, slot) = 1"""))
def w3(spark, sf_dir):
    rd = Story(spark, sf_dir).rd
    return first_crossing(rd, ["mint"], ["pos"], F.col("usd") >= 100).select("mint", "at_s", SLOT, _DOUBLE("usd"))


@query("W5_stage_at_event", sql(EV, """SELECT slot, CAST(max(CASE WHEN typ = 'graduation' THEN 2 ELSE 0 END)
  OVER (PARTITION BY mint ORDER BY bt, slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stage_rank FROM ev"""))
def w5(spark, sf_dir):
    return rules.stage_at_event(Story(spark, sf_dir).ev).select("slot", F.col("stage_rank").cast("bigint").alias("stage_rank"))


@query("R1_red_alerts", sql(RUGS, "SELECT id, mint, creator, t_at, slot, pool, dex FROM red"))
def r1(spark, sf_dir):
    s = Story(spark, sf_dir)
    return s.red(s.rugs_plain()).select("id", "mint", "creator", "t_at", SLOT, "pool", "dex")


@query("R2_fingerprint", sql(EV, "SELECT dex, count(*) AS n, count(*) FILTER (WHERE usd BETWEEN 84.9 AND 85.1) AS hits FROM ev WHERE typ = 'add' GROUP BY dex"))
def r2(spark, sf_dir):
    ev = Story(spark, sf_dir).ev.filter(F.col("kind") == "add").withColumn("quote_mint", F.lit(rules.WRAPPED_SOL))
    return ev.groupBy("dex").agg(F.count(F.lit(1)).alias("n"), F.count_if(rules.fingerprint("usd", "quote_mint")).alias("hits"))


@query("R3_amber_alerts", sql(RECORDS, "SELECT id, mint, creator, t_at, slot, n_prior FROM amber"))
def r3(spark, sf_dir):
    al, _ = Story(spark, sf_dir).records()
    return al.filter("level = 'amber'").select("id", "mint", "creator", "t_at", SLOT, "n_prior")


@query("R4_rug_confirmations", sql(RUGS, """SELECT mint, creator, t_at, slot, actor, pool, dex,
  CAST(peak AS DOUBLE) AS peak_usd, CAST(total AS DOUBLE) AS last_usd FROM rug0"""))
def r4(spark, sf_dir):
    rg = Story(spark, sf_dir).rugs_plain()
    return rg.select("mint", "creator", "t_at", SLOT, "actor", "pool", "dex", _DOUBLE("peak_usd"), _DOUBLE("last_usd"))


@query("R5_mechanism", sql(RUGS, "SELECT mint, t_at, mechanism FROM rg"))
def r5(spark, sf_dir):
    return Story(spark, sf_dir).rugs().select("mint", "t_at", "mechanism")


_STATUS = CLOCK + """, st AS (
  SELECT a.*, r.t_at AS rug_at, r.mechanism, CASE WHEN r.mint IS NOT NULL THEN 'confirmed' WHEN c.now - a.t_at <= 864000 THEN 'open' ELSE 'unconfirmed' END AS status
  FROM al a LEFT JOIN rg r ON r.mint = a.mint, clock c)"""
# Ten days in the adapter, whose events spread over a month.
SLOW = PARAMS.with_(resolve_s=864000)


@query("R6_alert_level_stats", sql(RECORDS + _STATUS + """, ranked AS (SELECT level, rug_at - t_at AS lead, row_number() OVER (PARTITION BY level ORDER BY rug_at - t_at) - 1 AS i,
  count(*) OVER (PARTITION BY level) AS n FROM st WHERE rug_at IS NOT NULL)""", """SELECT s.level, count(*) AS fired, count(*) FILTER (WHERE status = 'confirmed') AS confirmed,
  count(*) FILTER (WHERE status = 'unconfirmed') AS unconfirmed, count(*) FILTER (WHERE status = 'open') AS open,
  (SELECT max(lead) FROM ranked r WHERE r.level = s.level AND i = n // 2) AS median_lead_s,
  CASE WHEN count(*) FILTER (WHERE status <> 'open') > 0 THEN count(*) FILTER (WHERE status = 'confirmed') / CAST(count(*) FILTER (WHERE status <> 'open') AS DOUBLE) END AS precision
FROM st s GROUP BY s.level"""))
def r6(spark, sf_dir):
    s = Story(spark, sf_dir)
    al, rg = s.records()
    return rules.alert_level_stats(al, rg, clock(s.ev), SLOW)


@query("R7_rugs_by_mechanism", sql(RUGS, "SELECT mechanism, count(*) AS n, count(DISTINCT creator) AS creators FROM rg GROUP BY mechanism"))
def r7(spark, sf_dir):
    return rules.rugs_by_mechanism(Story(spark, sf_dir).rugs())


@query("R8_confidence_dim", sql(RUGS, """SELECT id, 422 / 431.0::DOUBLE AS measured_precision, 485 AS typical_lead_s FROM red""").replace("485 AS", "CAST(485 AS BIGINT) AS"))
def r8(spark, sf_dir):
    """Each alert with its own rule's measured precision."""
    s = Story(spark, sf_dir)
    red = s.red(s.rugs_plain())
    return red.join(F.broadcast(rules.confidence_dim(spark)), "level").select("id", "measured_precision", "typical_lead_s")


@query("R9_resume_from_registry", sql(RECORDS + ", half AS (SELECT min(t_at) + (max(t_at) - min(t_at)) // 2 AS t FROM al)",
       "SELECT id, t_at FROM al, half WHERE t_at > half.t"))
def r9(spark, sf_dir):
    """A restart that finds the first half of the alerts on file raises only the others."""
    al, _ = Story(spark, sf_dir).records()
    lo, hi = al.agg(F.min("t_at"), F.max("t_at")).first()
    if lo is None:
        return al.select("id", "t_at")
    history = al.filter(F.col("t_at") <= lo + (hi - lo) // 2)
    return rules.resume_from_registry(al, history).select("id", "t_at")


@query("R10_describe_records", sql(RECORDS, """SELECT '[ALERT ' || upper(level) || '] ' || strftime(make_timestamp(t_at * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || mint || ' by ' || creator AS line FROM al
UNION ALL SELECT '[RUG] ' || strftime(make_timestamp(t_at * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' || mint || ': ' || mechanism || ' by ' || actor
  || ' ($' || CAST(peak AS DECIMAL(20,2)) || ' to $' || CAST(total AS DECIMAL(20,2)) || ')' FROM rg"""))
def r10(spark, sf_dir):
    al, rg = Story(spark, sf_dir).records()
    return rules.describe_records(al).select("line").union(rules.describe_rugs(rg).select("line"))


@query("J6_confirm_alerts", sql(RECORDS, "SELECT a.id, a.level, r.mint, r.mechanism, a.t_at AS alert_at, r.t_at AS rug_at, r.t_at - a.t_at AS lead_s FROM al a JOIN rg r ON r.mint = a.mint"))
def j6(spark, sf_dir):
    al, rg = Story(spark, sf_dir).records()
    return rules.confirm_alerts(rg, al)


@query("J7_prior_rugs", sql(PRIOR, "SELECT mint, creator, t_at, slot, n_prior, array_to_string(list_slice(string_split(all_mints, ','), 1, 5), ',') AS shown FROM prior"))
def j7(spark, sf_dir):
    s = Story(spark, sf_dir)
    _, rg = s.records()
    out = rules.prior_rugs(s.graduations(), rg, s.params)
    return out.select("mint", "creator", "t_at", SLOT, "n_prior", F.array_join("prior_rugs.mint", ",").alias("shown"))


@query("W11_prior_rug_list", sql(RUGS, """SELECT creator, string_agg(mint, ',' ORDER BY t_at DESC, slot DESC) AS newest, count(*) AS n FROM (
  SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY creator ORDER BY t_at DESC, slot DESC) <= 3) GROUP BY creator"""))
def w11(spark, sf_dir):
    return reports.prior_rug_list(Story(spark, sf_dir).rugs(), cap=3).select("creator", F.array_join("mints", ",").alias("newest"), "n")


@query("J8_unwarned_rugs", sql(RECORDS, "SELECT mechanism, count(*) AS n FROM rg WHERE mint NOT IN (SELECT mint FROM al) GROUP BY mechanism"))
def j8(spark, sf_dir):
    al, rg = Story(spark, sf_dir).records()
    return rules.unwarned_rugs(rg, al)


@query("J9_open_and_unconfirmed", sql(RECORDS + _STATUS, "SELECT id, t_at, status FROM st WHERE status <> 'confirmed'"))
def j9(spark, sf_dir):
    s = Story(spark, sf_dir)
    al, rg = s.records()
    return rules.open_and_unconfirmed(al, rg, clock(s.ev), SLOW).select("id", "t_at", "status")


_SEQ = """, seq AS (SELECT r.mint, r.mechanism, r.t_at AS rug_at, string_agg(a.id, ',' ORDER BY a.t_at, a.level) AS alerts, r.t_at - min(a.t_at) AS lead_s
  FROM rg r JOIN al a ON a.mint = r.mint GROUP BY r.mint, r.mechanism, r.t_at)"""


@query("J10_sequences", sql(RECORDS + _SEQ, "SELECT * FROM seq"))
def j10(spark, sf_dir):
    al, rg = Story(spark, sf_dir).records()
    return rules.sequences(rg, al).withColumn("alerts", F.array_join("alerts.id", ","))


@query("D1_recent_sequences", sql(RECORDS + _SEQ, "SELECT * FROM seq ORDER BY rug_at DESC, mint LIMIT 12"))
def d1(spark, sf_dir):
    al, rg = Story(spark, sf_dir).records()
    return reports.recent_sequences(rg, al).withColumn("alerts", F.array_join("alerts.id", ","))


@query("D2_open_alerts", sql(RECORDS + _STATUS, """SELECT * FROM (SELECT id, status, now - t_at AS age_s, CAST(CASE level WHEN 'red' THEN 485 ELSE 129 END AS BIGINT) AS typical_lead_s,
  count(*) OVER (PARTITION BY status) AS total FROM st, clock WHERE status <> 'confirmed'
  QUALIFY row_number() OVER (PARTITION BY status ORDER BY t_at DESC, id) <= 3)"""))
def d2(spark, sf_dir):
    s = Story(spark, sf_dir)
    al, rg = s.records()
    return reports.pending_alerts(al, rg, clock(s.ev), SLOW)


@query("D3_rule_scoreboard", sql(RECORDS + _STATUS, """SELECT l.level, l.rule, l.mp AS measured_precision, count(s.id) AS fired, count(*) FILTER (WHERE s.status = 'confirmed') AS confirmed
FROM (VALUES ('red', 'creator-adds-liquidity', 422 / 431.0::DOUBLE), ('amber', 'repeat-rugger', 359 / 435.0::DOUBLE)) l(level, rule, mp)
LEFT JOIN st s ON s.level = l.level GROUP BY ALL"""))
def d3(spark, sf_dir):
    s = Story(spark, sf_dir)
    al, rg = s.records()
    board = reports.rule_scoreboard(al, rg, clock(s.ev), SLOW)
    return board.select("level", "rule", "measured_precision", "fired", "confirmed")


@query("D4_blind_spots", sql(RECORDS, """SELECT 'rugs' AS metric, count(*) AS value FROM rg
UNION ALL SELECT 'warned', count(*) FROM rg WHERE mint IN (SELECT mint FROM al)
UNION ALL SELECT 'unwarned ' || mechanism, count(*) FROM rg WHERE mint NOT IN (SELECT mint FROM al) GROUP BY mechanism"""))
def d4(spark, sf_dir):
    al, rg = Story(spark, sf_dir).records()
    return reports.blind_spots(rg, al)


@query("D6_feed", sql(RECORDS, """SELECT 'alert' AS kind, id AS key, t_at FROM al UNION ALL SELECT 'rug', mint, t_at FROM rg"""))
def d6(spark, sf_dir):
    """Delivered twice, shown once."""
    al, rg = Story(spark, sf_dir).records()
    one = reports.records_feed_rows(al, rg)
    return reports.feed(one.unionByName(one)).select("kind", "key", "t_at")


@query("P21_validation_metrics", sql(RECORDS + CLOCK + """, x AS (SELECT a.*, r.t_at AS rug_at FROM al a LEFT JOIN rg r ON r.mint = a.mint)""", """SELECT level || ' fired' AS metric, count(*) AS value FROM x GROUP BY level
UNION ALL SELECT level || ' confirmed', count(rug_at) FROM x GROUP BY level
UNION ALL SELECT level || ' late', count(*) FILTER (WHERE rug_at IS NULL AND now - t_at < 3600) FROM x, clock GROUP BY level
UNION ALL SELECT 'union fired', count(DISTINCT mint) FROM x
UNION ALL SELECT 'union confirmed', count(DISTINCT CASE WHEN rug_at IS NOT NULL THEN mint END) FROM x
UNION ALL SELECT 'duplicate alerts', count(*) - count(DISTINCT id) FROM x
UNION ALL SELECT 'rugs', count(*) FROM rg
UNION ALL SELECT 'rugs ' || mechanism, count(*) FROM rg GROUP BY mechanism"""))
def p21(spark, sf_dir):
    s = Story(spark, sf_dir)
    al, rg = s.records()
    return reports.validation_metrics(al, rg, clock(s.ev))


@query("P21_leads", sql(RECORDS + """, x AS (SELECT a.level, r.t_at - a.t_at AS lead FROM al a JOIN rg r ON r.mint = a.mint),
k AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY lead) - 1 AS i, count(*) OVER (PARTITION BY level) AS n FROM x)""", " UNION ALL ".join(
    [f"SELECT level || ' lead {name}' AS metric, CAST(max(lead) AS BIGINT) AS value FROM k WHERE i = least(n - 1, CAST(floor({p} * n) AS BIGINT)) GROUP BY level" for name, p in reports.LEADS.items()]
    + ["SELECT level || ' lead min', min(lead) FROM x GROUP BY level"] + [f"SELECT level || ' lead under {s}', count(*) FILTER (WHERE lead < {s}) FROM x GROUP BY level" for s in (60, 120)])))
def p21_leads(spark, sf_dir):
    return reports.lead_metrics(*Story(spark, sf_dir).records())


@query("J12_metrics_vs_expected", sql(RUGS + """, got AS (SELECT mechanism AS metric, count(*) AS actual FROM rg GROUP BY mechanism),
want AS (SELECT mechanism AS metric, count(*) AS expected FROM rg WHERE t_at % 2 = 0 GROUP BY mechanism)""", """SELECT coalesce(g.metric, w.metric) AS metric, actual, expected, actual IS DISTINCT FROM expected AS differs FROM got g FULL JOIN want w ON g.metric = w.metric""").replace("\n, got", ", got"))
def j12(spark, sf_dir):
    rg = Story(spark, sf_dir).rugs()
    metric = F.col("mechanism").alias("metric")
    actual = rg.groupBy(metric).agg(F.count(F.lit(1)).alias("value"))
    expected = rg.filter(F.col("t_at") % 2 == 0).groupBy(metric).agg(F.count(F.lit(1)).alias("value"))
    return reports.metrics_vs_expected(actual, expected)
