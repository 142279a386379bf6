"""From raw frames to alerts and drains, as one job.

Every step is an operator of this package; what is here is only how they join: the provider of a liquidity event is its actor,
raw amounts become units of the quote asset, and a record says what set it off, on what evidence and how sure its rule has been.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.functions.events import POSITION
from drainwatch.params import CONFIDENCE, DEFAULTS, RULE_NAME, Params
from drainwatch.plans import normalize as nz
from drainwatch.plans import prices, rules
from drainwatch.plans.dedup import dedup_exact, dedup_key
from drainwatch.plans.joins import late_token_join
from drainwatch.plans.tokens import creator_columns, creator_then
from drainwatch.session import settle, work_path
from drainwatch.sources.tables import read_routed, write_routed

KINDS = ("token_create", "pool_create", "meme", "graduation", "liquidity", "swap")


def typed_events(frames: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """The valid frames of each type that feeds state, once per key.  Frames are parsed and filed once, to the shared folder."""
    path = work_path(frames.sparkSession, "filed")
    write_routed(nz.frames_to_routed(frames, text), path)
    filed = read_routed(frames.sparkSession, path)
    return {k: dedup_exact(dedup_key(nz.normalize(filed, k), k), ["block_time_s", "slot"] if k != "meme" else ["block_time_s"]).drop("key") for k in KINDS}


def pair_moves(pairs: DataFrame) -> DataFrame:
    """Liquidity of followed tokens as the rules read it: who, and how much of the quote asset."""
    units = prices.to_units(F.col("quote_amount"), F.col("quote_decimals"))
    return pairs.filter("mint is not null").select("mint", F.col("provider").alias("actor"), "kind", "pool", "dex", "pos", "block_time_s", "quote_mint", units.alias("quote_units"))


def graduations(grad: DataFrame, tok: DataFrame) -> DataFrame:
    low = F.lit(-1).cast("bigint")
    pos = F.struct("block_time_s", "slot", *[low.alias(p) for p in POSITION[2:]])
    known = tok.select("mint", *creator_columns(tok))
    rows = grad.withColumnRenamed("creator", "_own").withColumn("pos", pos).join(known, "mint", "left")
    return rows.select("mint", F.coalesce(creator_then(known.columns), "_own").alias("creator"), "pos", "block_time_s", "pool", "dex")


def confidence(level: Column) -> Column:
    """The measured precision of the rule behind an alert, with the counts it comes from."""
    known = [F.when(level == k, F.struct(F.lit(c / f).alias("precision"), F.lit(c).alias("confirmed"), F.lit(f).alias("fired"), F.lit(lead).alias("typical_lead_s"))) for k, (c, f, lead) in CONFIDENCE.items()]
    return F.coalesce(*known)


def alert_records(al: DataFrame) -> DataFrame:
    """Alerts with their rule, what set them off, the evidence and the rule's confidence."""
    rule = F.coalesce(*[F.when(F.col("level") == k, F.lit(name)) for k, name in RULE_NAME.items()])
    trigger = F.struct(F.when(F.col("level") == "red", "liquidity").otherwise("graduation").alias("type"), "pool", "dex", "pos")
    evidence = F.struct("quote_mint", "quote_units", "fingerprint", "prior_rugs", "n_prior")
    return al.select(F.lit("alert").alias("kind"), "id", "level", rule.alias("rule"), "mint", "creator", "t_at", trigger.alias("trigger"), evidence.alias("evidence"), confidence(F.col("level")).alias("confidence"))


def rug_records(rg: DataFrame, al: DataFrame) -> DataFrame:
    """Drains with how they happened and the alerts that came before them, each with its lead."""
    hits = rules.confirm_alerts(rg, al).select("mint", F.struct("alert_at", "level", "id", "lead_s").alias("_a"))
    # One alert per level and token.
    listed = hits.groupBy("mint").agg(F.array_sort(F.collect_list("_a")).alias("alerts"))
    trigger = F.struct(F.col("event").alias("type"), "pool", "dex", "pos")
    rows = rg.join(listed, "mint", "left")
    return rows.select(F.lit("rug").alias("kind"), F.concat(F.lit("rug:"), "mint").alias("id"), "mint", "creator", "t_at", "mechanism", "actor", trigger.alias("trigger"), "peak_usd", "last_usd", "alerts")


def detect(frames: DataFrame, params: Params = DEFAULTS, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(alerts, drains) of a feed of raw frames."""
    norm = typed_events(frames, text)
    tok = settle(prices.token_table(norm), "tokens")
    known = tok.select("mint", "first_seen_s")
    pairs = settle(late_token_join(prices.pair_rows(norm["liquidity"], tok).filter("mint is not null"), known, params.pending_ttl_s).drop("held"), "pairs")
    swaps = settle(prices.swap_rows(norm["swap"], tok), "swaps")
    rd = settle(prices.pool_readings(pairs, swaps, prices.learn_quote_prices(norm["liquidity"], pairs, swaps)), "readings")
    drained = settle(rules.rug_confirmations(rd, tok, params), "drained")
    red = settle(rules.red_alerts(pair_moves(pairs), tok, drained, params), "red")
    rg = settle(rules.mechanism(drained, red), "rugs")
    amber = rules.amber_alerts(graduations(norm["graduation"], tok), rg, params)
    al = settle(rules.alerts_union(red, amber), "alerts")
    return alert_records(al), rug_records(rg, al)


def describe_drains(rg: DataFrame) -> DataFrame:
    """One line per drain: what, when, how, from what to what, and the alerts that came before it."""
    when = F.date_format(F.timestamp_seconds("t_at"), "yyyy-MM-dd HH:mm:ss")
    money = lambda c: F.concat(F.lit("$"), F.col(c).cast("decimal(28,2)").cast("string"))
    warned = F.when(F.size("alerts") > 0, F.concat_ws(", ", F.transform("alerts", lambda a: F.concat(a["level"], F.lit(" "), a["lead_s"].cast("string"), F.lit(" s before"))))).otherwise("no alert")
    how = F.concat("mechanism", F.lit(" by "), "actor")
    return rg.withColumn("line", F.concat_ws(" | ", F.concat(F.lit("RUG "), when), F.concat(F.lit("token "), "mint"), how, F.concat(money("peak_usd"), F.lit(" to "), money("last_usd")), warned))


def describe(al: DataFrame) -> DataFrame:
    """One line per alert: what, when, why, how sure and how long before."""
    when = F.date_format(F.timestamp_seconds("t_at"), "yyyy-MM-dd HH:mm:ss")
    why = F.when(F.col("level") == "red", F.concat(F.lit("added "), F.col("evidence.quote_units").cast("decimal(20,4)").cast("string"), F.lit(" of the quote asset"))).otherwise(
        F.concat(F.lit("drained "), F.col("evidence.n_prior").cast("string"), F.lit(" before"))
    )
    sure = F.format_string("%.1f %% of %d, usually %d s ahead", F.col("confidence.precision") * 100, F.col("confidence.fired"), F.col("confidence.typical_lead_s"))
    return al.withColumn("line", F.concat_ws(" | ", F.concat(F.upper("level"), F.lit(" "), when), F.concat(F.lit("token "), "mint"), F.concat(F.lit("by "), "creator"), why, sure))
