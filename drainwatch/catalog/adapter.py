"""The driver's ``events`` table seen as token events, once for Spark and once for SQL.

signup -> token_create, view -> graduation, purchase -> add, error -> remove, click -> swap; the
number in ``props`` names the token; three pools per token, pool 0 being the launchpad's curve.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.params import Params
from drainwatch.plans import rules, tokens
from drainwatch.session import prepare, settle

# Thresholds scaled to the values in the driver's events (0 to about 700).
PARAMS = Params(min_peak_usd=Decimal(100), max_floor_usd=Decimal(10), burst_window_s=7 * 86400, burst_max_launches=5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_token_events(table(spark, sf_dir, "events"))


def as_token_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    mint = F.concat(F.lit("T"), F.regexp_extract("props", r"(\d+)", 1))
    lane = F.col("event_id") % 3
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select(
        F.when(kind == "signup", "token_create").when(kind == "view", "graduation").when(kind == "click", "swap").otherwise("liquidity").alias("type"),
        F.when(kind == "purchase", "add").when(kind == "error", "remove").alias("kind"),
        mint.alias("mint"),
        F.concat(mint, F.lit("-p"), lane.cast("string")).alias("pool"),
        F.when(lane == 0, "pumpfun").otherwise("pumpswap").alias("dex"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("actor"),
        at.alias("block_time_s"),
        F.col("event_id").alias("slot"),
        F.struct(at.alias("block_time_s"), F.col("event_id").alias("slot")).alias("pos"),
        F.col("value").cast("decimal(18,2)").alias("usd"),
    )


def readings(ev: DataFrame) -> DataFrame:
    """Pool readings: every liquidity and swap event values its pool."""
    rows = ev.filter(F.col("type").isin("liquidity", "swap"))
    return rows.select(
        "mint", F.lit("pool").alias("source"), "pool", "dex", F.col("block_time_s").alias("at_s"), "pos", "usd",
        F.lit(None).cast("bigint").alias("holders"), F.col("type").alias("event"), "kind", "actor",
    )


class Story:
    """The detector's records over the adapter, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = PARAMS):
        self.params = params
        self.ev = token_events(spark, sf_dir)
        self.rd = readings(self.ev)
        self.tok = tokens.token_dim(self.ev)
        self.grads = self.ev.filter(F.col("type") == "graduation").drop("kind", "usd")

    def rugs_plain(self) -> DataFrame:
        return rules.rug_confirmations(self.rd, self.tok, self.params)

    def red(self, rg: DataFrame) -> DataFrame:
        return rules.red_alerts(self.ev.filter(F.col("type") == "liquidity"), self.tok, rg, self.params)

    def rugs(self) -> DataFrame:
        rg = self.rugs_plain()
        return rules.mechanism(rg, self.red(rg))

    def graduations(self) -> DataFrame:
        """Graduation events with the token's creator (the event's own where none is known)."""
        known = self.tok.select("mint", F.col("creator").alias("_c"))
        return self.grads.join(known, "mint", "left").withColumn("creator", F.coalesce("_c", "actor")).drop("_c")

    def records(self) -> tuple[DataFrame, DataFrame]:
        """(alerts, rugs).

        Drains and red alerts are few, and both rules and every report read them: written once.
        """
        found = settle(self.rugs_plain(), "drains")
        red = settle(self.red(found), "red")
        rg = rules.mechanism(found, red)
        amber = rules.amber_alerts(self.graduations(), rg, self.params)
        return rules.alerts_union(red, amber), rg


# ---- the same view in SQL -------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id AS slot, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS bt, 'C' || user_id AS actor,
    CASE event_type WHEN 'signup' THEN 'token_create' WHEN 'view' THEN 'graduation' WHEN 'purchase' THEN 'add'
      WHEN 'error' THEN 'remove' ELSE 'swap' END AS typ,
    'T' || regexp_extract(props, '(\\d+)', 1) AS mint,
    'T' || regexp_extract(props, '(\\d+)', 1) || '-p' || (event_id % 3) AS pool,
    CASE WHEN event_id % 3 = 0 THEN 'pumpfun' ELSE 'pumpswap' END AS dex,
    CAST(value AS DECIMAL(18,2)) AS usd
  FROM events)"""

TOK = EV + """,
tok AS (
  SELECT e.mint,
    coalesce(arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'token_create'), arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'graduation')) AS creator,
    min(bt) FILTER (WHERE typ = 'token_create') AS created_at_s,
    CASE WHEN bool_or(typ = 'graduation') THEN 'graduated' ELSE 'created' END AS stage,
    min(bt) FILTER (WHERE typ = 'graduation') AS graduated_at_s,
    min(slot) FILTER (WHERE typ = 'graduation') AS graduated_slot,
    arg_min(pool, (bt, slot)) FILTER (WHERE typ = 'graduation') AS graduation_pool,
    min(bt) AS first_seen_s, max(bt) AS last_activity_s
  FROM ev e GROUP BY e.mint HAVING bool_or(typ IN ('token_create', 'graduation')))"""

RD = TOK + """,
rd AS (SELECT *, CASE WHEN dex = 'pumpswap' THEN usd END AS held FROM ev WHERE typ IN ('add', 'remove', 'swap')),
step AS (SELECT *, coalesce(held, 0) - coalesce(lag(coalesce(held, 0)) OVER (PARTITION BY mint, pool ORDER BY bt, slot), 0) AS diff FROM rd),
state AS (SELECT *,
    CASE WHEN count(held) OVER w > 0 THEN sum(diff) OVER w END AS total,
    max(held) OVER w AS peak
  FROM step WINDOW w AS (PARTITION BY mint ORDER BY bt, slot ROWS UNBOUNDED PRECEDING))"""

RUGS = RD + """,
rug0 AS (
  SELECT s.mint, t.creator, s.bt AS t_at, s.slot, s.typ, s.actor, s.pool, s.dex, s.peak, s.total
  FROM state s JOIN tok t ON s.mint = t.mint JOIN ev g ON g.slot = t.graduated_slot
  WHERE (s.bt, s.slot) > (g.bt, g.slot) AND s.peak >= 100 AND s.total <= 10
  QUALIFY row_number() OVER (PARTITION BY s.mint ORDER BY s.bt, s.slot) = 1),
red AS (
  SELECT 'red:' || e.mint AS id, 'red' AS level, e.mint, t.creator, e.bt AS t_at, e.slot, e.pool, e.dex
  FROM ev e JOIN tok t ON e.mint = t.mint AND e.actor = t.creator LEFT JOIN rug0 r ON r.mint = e.mint
  WHERE e.typ = 'add' AND (r.mint IS NULL OR (e.bt, e.slot) < (r.t_at, r.slot))
  QUALIFY row_number() OVER (PARTITION BY e.mint ORDER BY e.bt, e.slot) = 1),
rg AS (
  SELECT r.*, CASE WHEN r.typ <> 'swap' AND r.actor = r.creator THEN CASE WHEN d.mint IS NOT NULL THEN 'creator-pull' ELSE 'migration-pull' END
    WHEN r.typ <> 'swap' THEN 'third-party-remove' WHEN r.actor = r.creator THEN 'dev-dump' ELSE 'sell-off' END AS mechanism
  FROM rug0 r LEFT JOIN red d ON d.mint = r.mint)"""

PRIOR = RUGS + """,
grads AS (
  SELECT e.mint, coalesce(t.creator, e.actor) AS creator, e.bt AS t_at, e.slot, e.pool, e.dex
  FROM ev e LEFT JOIN tok t ON t.mint = e.mint WHERE e.typ = 'graduation'),
remembered AS (
  SELECT g.mint, g.creator, g.t_at, g.slot, r.mint AS rmint, r.t_at AS rat, r.slot AS rslot, r.mechanism AS rmech,
    row_number() OVER (PARTITION BY g.slot ORDER BY r.t_at DESC, r.slot DESC) AS back
  FROM grads g JOIN rg r ON r.creator = g.creator AND (r.t_at, r.slot) < (g.t_at, g.slot)),
prior AS (
  SELECT mint, creator, t_at, slot, count(*) AS n_prior, string_agg(rmint, ',' ORDER BY back) AS all_mints
  FROM remembered WHERE rmint <> mint AND rat < t_at GROUP BY ALL)"""

RECORDS = PRIOR + """,
amber AS (
  SELECT 'amber:' || p.mint AS id, 'amber' AS level, p.mint, p.creator, p.t_at, p.slot, p.n_prior
  FROM prior p LEFT JOIN rg r ON r.mint = p.mint WHERE r.mint IS NULL OR (p.t_at, p.slot) < (r.t_at, r.slot)
  QUALIFY row_number() OVER (PARTITION BY p.mint ORDER BY p.t_at, p.slot) = 1),
al AS (SELECT id, level, mint, creator, t_at, slot FROM red UNION ALL SELECT id, level, mint, creator, t_at, slot FROM amber)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
