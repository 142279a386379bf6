"""Creators, windows over event time, and the look-up worklist."""

from pyspark.sql import functions as F

from drainwatch.catalog.adapter import EV, PARAMS, RD, TOK, Story, readings, sql, token_events
from drainwatch.catalog.registry import query
from drainwatch.catalog.rule_queries import CLOCK, clock
from drainwatch.catalog.state_queries import OUTCOME, outcomes
from drainwatch.plans import creators, reports, tokens, worklist

LA = """la AS (SELECT actor AS creator, mint, min(bt) AS created_s, 'stream' AS source FROM ev WHERE typ = 'token_create' GROUP BY actor, mint)"""
SERIAL = LA + """, rolled AS (SELECT creator, created_s, count(*) OVER (PARTITION BY creator ORDER BY created_s RANGE BETWEEN 604799 PRECEDING AND CURRENT ROW) AS n FROM la),
serial AS (SELECT creator, max(n) AS most FROM rolled GROUP BY creator HAVING max(n) > 5)"""
DIM = SERIAL + """, cdim AS (SELECT e.actor AS creator, min(bt) AS first_seen_s, max(bt) AS last_seen_s,
  coalesce(any_value(l.n), 0) AS launches, any_value(s.creator) IS NOT NULL AS serial
  FROM ev e LEFT JOIN (SELECT creator, count(*) AS n FROM la GROUP BY creator) l ON l.creator = e.actor LEFT JOIN serial s ON s.creator = e.actor
  WHERE typ IN ('token_create', 'graduation') GROUP BY e.actor)"""


def _ev_la(spark, sf_dir):
    ev = token_events(spark, sf_dir)
    return ev, creators.creator_launches(ev)


@query("C1_creator_launches", sql(EV + ", " + LA, "SELECT * FROM la"))
def c1(spark, sf_dir):
    return _ev_la(spark, sf_dir)[1]


@query("C2_cap_launches", sql(EV + ", " + LA, "SELECT creator, mint, created_s FROM la QUALIFY row_number() OVER (PARTITION BY creator ORDER BY created_s DESC, mint DESC) <= 3"))
def c2(spark, sf_dir):
    return creators.cap_launches(_ev_la(spark, sf_dir)[1], 3).select("creator", "mint", "created_s")


@query("C3_launches_in_window", sql(EV + ", " + LA + CLOCK, "SELECT creator, count(*) FILTER (WHERE now - created_s < 604800) AS n FROM la, clock GROUP BY creator"))
def c3(spark, sf_dir):
    ev, la = _ev_la(spark, sf_dir)
    return creators.launches_in_window(la, clock(ev), PARAMS.burst_window_s)


@query("C4_serial_creators", sql(EV + ", " + SERIAL, "SELECT creator, most FROM serial"))
def c4(spark, sf_dir):
    return creators.serial_creators(_ev_la(spark, sf_dir)[1], PARAMS)


@query("W4_rolling_launches", sql(EV + ", " + SERIAL, "SELECT DISTINCT creator, created_s, n FROM rolled"))
def w4(spark, sf_dir):
    return creators.rolling_launches(_ev_la(spark, sf_dir)[1], PARAMS.burst_window_s)


@query("C5_creator_dim", sql(EV + ", " + DIM, "SELECT * FROM cdim"))
def c5(spark, sf_dir):
    ev, la = _ev_la(spark, sf_dir)
    return creators.creator_dim(la, ev, PARAMS)


@query("C6_launch_histogram", sql(EV + ", " + LA, """SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 10 THEN '4-10' WHEN n <= 30 THEN '11-30'
  WHEN n <= 100 THEN '31-100' ELSE '>100' END AS bucket, count(*) AS creators FROM (SELECT creator, count(*) AS n FROM la GROUP BY creator) GROUP BY 1"""))
def c6(spark, sf_dir):
    return creators.launch_histogram(_ev_la(spark, sf_dir)[1])


_FATE = RD + OUTCOME + ", " + SERIAL


@query("C7_top_serial", sql(_FATE, """SELECT l.creator, count(*) AS launches, count(*) FILTER (WHERE o.stage = 'graduated') AS graduated,
  count(*) FILTER (WHERE o.peak_usd >= 100 AND o.last_usd <= 10) AS collapsed
FROM la l JOIN serial s ON s.creator = l.creator LEFT JOIN outcome o ON o.mint = l.mint GROUP BY l.creator ORDER BY launches DESC, l.creator LIMIT 12"""))
def c7(spark, sf_dir):
    la = _ev_la(spark, sf_dir)[1]
    return creators.top_serial(la, creators.serial_creators(la, PARAMS), outcomes(spark, sf_dir), 12, PARAMS)


@query("C8_collapse_by_serial", sql(_FATE, """SELECT count(*) FILTER (WHERE gone) AS collapsed, count(*) FILTER (WHERE gone AND s) AS collapsed_serial,
  count(*) FILTER (WHERE stage = 'graduated') AS graduated, count(*) FILTER (WHERE stage = 'graduated' AND s) AS graduated_serial
FROM (SELECT o.stage, coalesce(o.peak_usd >= 100 AND o.last_usd <= 10, false) AS gone, o.creator IN (SELECT creator FROM serial) AS s FROM outcome o)"""))
def c8(spark, sf_dir):
    la = _ev_la(spark, sf_dir)[1]
    return creators.collapse_by_serial(outcomes(spark, sf_dir), creators.serial_creators(la, PARAMS), PARAMS)


_STATS = """SELECT 'tokens' AS metric, count(*) AS value FROM tok UNION ALL SELECT 'created', count(*) FILTER (WHERE stage = 'created') FROM tok
UNION ALL SELECT 'curve', count(*) FILTER (WHERE stage = 'curve') FROM tok UNION ALL SELECT 'graduated', count(*) FILTER (WHERE stage = 'graduated') FROM tok
UNION ALL SELECT 'creators', count(*) FROM cdim UNION ALL SELECT 'serial', count(*) FILTER (WHERE serial) FROM cdim
UNION ALL SELECT 'over_threshold_now', count(*) FROM cdim c WHERE serial AND (SELECT count(*) FROM la, clock WHERE la.creator = c.creator AND now - created_s < 604800) > 5
UNION ALL SELECT 'launches', count(*) FROM la UNION ALL SELECT 'readings', count(*) FROM rd UNION ALL SELECT 'unpriced', count(*) FROM rd WHERE usd IS NULL"""


def stats(spark, sf_dir):
    s = Story(spark, sf_dir, PARAMS)
    la = creators.creator_launches(s.ev)
    return creators.state_stats(s.tok, creators.creator_dim(la, s.ev, PARAMS), la, s.rd, clock(s.ev), PARAMS)


@query("C9_state_stats", sql(RD + ", " + DIM + CLOCK, _STATS))
def c9(spark, sf_dir):
    return stats(spark, sf_dir)


@query("W6_watermark_and_late", sql(EV + """, arr AS (SELECT *, bt + (slot % 5) * 600 AS received_s FROM ev),
wm AS (SELECT *, max(least(bt, received_s + 60)) OVER (ORDER BY received_s, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS watermark_s FROM arr)""",
    "SELECT slot, watermark_s, coalesce(watermark_s - bt > 60, false) AS late FROM wm"))
def w6(spark, sf_dir):
    """Rows arrive up to forty minutes after their block time."""
    ev = token_events(spark, sf_dir).withColumn("received_s", F.col("block_time_s") + (F.col("slot") % 5) * 600)
    return creators.watermark_and_late(ev, ["received_s", "slot"], PARAMS).select("slot", "watermark_s", "late")


@query("W7_idle_expiry", sql(EV + """, g AS (SELECT *, bt - lag(bt) OVER (PARTITION BY mint ORDER BY bt, slot) AS gap FROM ev),
s1 AS (SELECT *, sum(CASE WHEN gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY bt, slot) AS seg FROM g),
s2 AS (SELECT *, max(CASE WHEN typ = 'graduation' THEN 1 ELSE 0 END) OVER (PARTITION BY mint, seg ORDER BY bt, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s1),
s3 AS (SELECT *, sum(CASE WHEN gap > 86400 OR (gap > 10800 AND coalesce(was, 0) = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY bt, slot) AS session FROM s2)""",
    "SELECT mint, CAST(session AS BIGINT) AS session, min(bt) AS start_s, max(bt) AS end_s, count(*) AS events FROM s3 GROUP BY ALL"))
def w7(spark, sf_dir):
    return creators.idle_expiry(token_events(spark, sf_dir), PARAMS.with_(idle_curve_s=10800, idle_graduated_s=86400)).drop("graduated")


@query("W8_cap_tracked", sql(TOK, "SELECT mint, stage, last_activity_s FROM tok ORDER BY stage = 'graduated' DESC, last_activity_s DESC, mint LIMIT 40"))
def w8(spark, sf_dir):
    tok = tokens.token_dim(token_events(spark, sf_dir))
    return creators.cap_tracked(tok, 40).select("mint", "stage", "last_activity_s")


@query("W9_creator_retention", sql(EV + ", " + DIM + CLOCK, "SELECT creator, last_seen_s, serial FROM cdim, clock WHERE now - last_seen_s <= CASE WHEN serial THEN 604800 ELSE 86400 END"))
def w9(spark, sf_dir):
    ev, la = _ev_la(spark, sf_dir)
    kept = creators.creator_retention(creators.creator_dim(la, ev, PARAMS), clock(ev), PARAMS)
    return kept.select("creator", "last_seen_s", "serial")


@query("W10_event_rate", sql(EV, "SELECT bt // 3600 * 3600 AS start_s, count(*) AS n, count(*) / 3600.0::DOUBLE AS per_second FROM ev GROUP BY 1"))
def w10(spark, sf_dir):
    return reports.event_rate(token_events(spark, sf_dir), 3600)


@query("D7_health_check", sql(EV, """SELECT late, max(bt) AS last_s, count(*) AS frames, min(now) + 3600 - max(bt) > 30 AS stale
  FROM (SELECT bt, slot % 2 = 0 AS late, max(bt) OVER () - 3600 AS now FROM ev) WHERE NOT late OR bt < now GROUP BY late"""))
def d7(spark, sf_dir):
    """Two feeds: one is fed to the end, the other went quiet an hour before."""
    ev = token_events(spark, sf_dir)
    now, late = clock(ev), F.col("slot") % 2 == 0
    parts = [(ev.filter(~late), False), (ev.filter(late & (F.col("block_time_s") < now - 3600)), True)]
    rows = [reports.health_check(e, now).withColumn("late", F.lit(which)) for e, which in parts]
    return rows[0].unionByName(rows[1])


# Who was asked before, and when: every creator whose number is not a multiple of three, at first sight.
ASKED = DIM + CLOCK + """, cre AS (SELECT creator, serial, CASE WHEN CAST(substr(creator, 2) AS BIGINT) % 3 <> 0 THEN first_seen_s END AS last_asked_s FROM cdim),
req AS (SELECT e.actor AS creator, e.mint, CASE WHEN typ = 'graduation' THEN 'graduation' WHEN c.serial THEN 'suspect' WHEN c.last_asked_s IS NULL THEN 'new-creator' ELSE 'known-creator' END AS class,
  e.bt AS enqueued_s, coalesce(b.born, e.bt) AS born_s, c.last_asked_s FROM ev e JOIN cre c ON c.creator = e.actor LEFT JOIN (SELECT mint, min(bt) AS born FROM ev WHERE typ = 'token_create' GROUP BY mint) b ON b.mint = e.mint WHERE typ IN ('token_create', 'graduation')),
elig AS (SELECT r.*, now, CASE WHEN last_asked_s IS NOT NULL AND enqueued_s - last_asked_s < CASE class WHEN 'suspect' THEN 600 WHEN 'graduation' THEN 60 WHEN 'known-creator' THEN 21600 ELSE 0 END THEN 'recent'
  WHEN now - enqueued_s > 432000 THEN 'stale' WHEN born_s + 10 > now THEN 'young' ELSE 'ready' END AS status FROM req r, clock),
one AS (SELECT creator, arg_min(class, (rk, enqueued_s, mint)) AS class, min(enqueued_s) AS enqueued_s, arg_min(mint, (rk, enqueued_s, mint)) AS mint
  FROM (SELECT *, CASE class WHEN 'suspect' THEN 0 WHEN 'graduation' THEN 1 WHEN 'new-creator' THEN 2 ELSE 3 END AS rk FROM elig WHERE status = 'ready') GROUP BY creator)"""
# Five days of waiting allowed, as the adapter's events spread over a month.
PATIENT = PARAMS.with_(max_wait_s=432000)


class Work:
    def __init__(self, spark, sf_dir):
        self.ev, self.la = _ev_la(spark, sf_dir)
        dim = creators.creator_dim(self.la, self.ev, PARAMS)
        asked = F.when(F.substring("creator", 2, 20).cast("bigint") % 3 != 0, F.col("first_seen_s"))
        self.creators = dim.select("creator", "serial", asked.alias("last_asked_s"))
        self.now = clock(self.ev)

    def requests(self):
        return worklist.classify_requests(self.ev, self.creators)

    def eligible(self):
        return worklist.eligibility(self.requests(), self.now, PATIENT)


@query("E1_classify_requests", sql(EV + ", " + ASKED, "SELECT creator, mint, class, enqueued_s, born_s FROM req"))
def e1(spark, sf_dir):
    return Work(spark, sf_dir).requests().select("creator", "mint", "class", "enqueued_s", "born_s")


@query("E2_suspect_repoll", sql(EV + ", " + ASKED, """SELECT l.creator, arg_max(l.mint, (l.created_s, l.mint)) AS mint, max(l.created_s) AS born_s FROM la l JOIN cre c ON c.creator = l.creator, clock
WHERE c.serial AND (c.last_asked_s IS NULL OR now - c.last_asked_s >= 600) GROUP BY l.creator"""))
def e2(spark, sf_dir):
    w = Work(spark, sf_dir)
    return worklist.suspect_repoll(w.creators, w.la, w.now, PATIENT).select("creator", "mint", "born_s")


@query("E3_eligibility", sql(EV + ", " + ASKED, "SELECT creator, mint, class, enqueued_s, status FROM elig"))
def e3(spark, sf_dir):
    return Work(spark, sf_dir).eligible().select("creator", "mint", "class", "enqueued_s", "status")


@query("E4_one_per_creator", sql(EV + ", " + ASKED, "SELECT * FROM one"))
def e4(spark, sf_dir):
    return worklist.one_per_creator(Work(spark, sf_dir).eligible().filter("status = 'ready'"))


@query("E5_rank_worklist", sql(EV + ", " + ASKED, """SELECT creator, class, enqueued_s, mint FROM one
ORDER BY CASE class WHEN 'suspect' THEN 0 WHEN 'graduation' THEN 1 WHEN 'new-creator' THEN 2 ELSE 3 END, enqueued_s, creator LIMIT 25"""))
def e5(spark, sf_dir):
    ready = Work(spark, sf_dir).eligible().filter("status = 'ready'")
    return worklist.rank_worklist(worklist.one_per_creator(ready), 25)


@query("E6_worklist_stats", sql(EV + ", " + ASKED, """SELECT class, count(*) AS n, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'stale') AS discarded,
  CAST(round(avg(now - enqueued_s) FILTER (WHERE status = 'ready')) AS BIGINT) AS mean_wait_s FROM elig GROUP BY class"""))
def e6(spark, sf_dir):
    w = Work(spark, sf_dir)
    return worklist.worklist_stats(w.eligible(), w.now)


@query("E6_dispatch_stats", sql(EV + ", " + ASKED + """, ranked AS (SELECT *, row_number() OVER (ORDER BY CASE class WHEN 'suspect' THEN 0 WHEN 'graduation' THEN 1 WHEN 'new-creator' THEN 2 ELSE 3 END, enqueued_s, creator) <= 25 AS taken FROM one)""",
    "SELECT class, count(*) FILTER (WHERE taken) AS dispatched, count(*) FILTER (WHERE NOT taken) AS pending, CAST(round(avg(now - enqueued_s) FILTER (WHERE taken)) AS BIGINT) AS mean_wait_s FROM ranked, clock GROUP BY class"))
def e6_dispatch(spark, sf_dir):
    w = Work(spark, sf_dir)
    return worklist.dispatch_stats(worklist.dispatch(w.eligible(), w.now, 25))


@query("D5_system_metrics", sql(RD + ", " + ASKED, "SELECT 'frames' AS metric, count(*) AS value FROM ev UNION ALL SELECT 'worklist', count(*) FROM elig UNION ALL " + _STATS))
def d5(spark, sf_dir):
    ev = token_events(spark, sf_dir)
    w = Work(spark, sf_dir)
    counters = ev.groupBy("type").agg(F.count(F.lit(1)).alias("received"))
    return reports.system_metrics(counters, stats(spark, sf_dir), worklist.worklist_stats(w.eligible(), w.now))
