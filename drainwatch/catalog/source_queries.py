"""Files, archives, registry and snapshots, all written by Spark from the driver's tables."""

from pyspark.sql import functions as F

from drainwatch.catalog.adapter import EV, PARAMS, RECORDS, Story, sql, table, token_events
from drainwatch.catalog.registry import query
from drainwatch.plans import history, joins, prices, rules, tokens
from drainwatch.plans.creators import creator_launches
from drainwatch.session import settle, work_path
from drainwatch.sources import frames as fr
from drainwatch.sources import registry, snapshots

# One short frame per event; swaps are the firehose tier.
_TYPE = "CASE typ WHEN 'add' THEN 'liquidity' WHEN 'remove' THEN 'liquidity' ELSE typ END"
_LINE = f"""'{{"type":"' || {_TYPE} || '","mint":"' || mint || '","url":"https://h/?api_key=sk_' || slot || '&z=1"' || CASE WHEN slot % 4 = 0 THEN '' ELSE ',"block_time":' || bt END || '}}'"""
LINES = EV + f", lines AS (SELECT *, {_LINE} AS value, CASE WHEN typ = 'swap' THEN 'firehose' ELSE 'lifecycle' END AS tier FROM ev)"


def lines(spark, sf_dir):
    ev = token_events(spark, sf_dir)
    bt = F.when(F.col("slot") % 4 == 0, "").otherwise(F.concat(F.lit(',"block_time":'), F.col("block_time_s")))
    value = F.concat(F.lit('{"type":"'), "type", F.lit('","mint":"'), "mint", F.lit('","url":"https://h/?api_key=sk_'), F.col("slot"), F.lit('&z=1"'), bt, F.lit("}"))
    return ev.select("slot", "block_time_s", "mint", value.alias("value")).withColumn("tier", fr.tier_of())


def written(spark, sf_dir):
    """The frames as two tiers of files, as a capture leaves them."""
    root = work_path(spark, "capture")
    rows = lines(spark, sf_dir)
    for tier in ("lifecycle", "firehose"):
        part = rows.filter(F.col("tier") == tier).orderBy("slot").select("value")
        part.write.option("compression", "gzip" if tier == "firehose" else "none").text(f"{root}/{tier}-20240101T000000Z-0001.jsonl")
    return root


@query("S1_scan_frames", sql(LINES, "SELECT value FROM lines"))
def s1(spark, sf_dir):
    return fr.scan_frames(spark, [written(spark, sf_dir), "/nowhere/at/all"]).select("value")


@query("S2_scan_capture", sql(LINES, "SELECT value, tier FROM lines"))
def s2(spark, sf_dir):
    return fr.scan_capture(spark, written(spark, sf_dir), "202401").select("value", "tier")


_STAMPED = EV + """, files AS (SELECT min(bt) // 3600 * 3600 AS start_s, 'lifecycle-' || strftime(make_timestamp(min(bt) // 3600 * 3600 * 1000000), '%Y%m%dT%H%M%S') || 'Z-1.jsonl' AS name FROM ev GROUP BY bt // 3600),
cut AS (SELECT max(start_s) - 86400 + 5 AS c FROM files)"""


@query("S3_scan_since", sql(_STAMPED, "SELECT name, start_s FROM files, cut WHERE start_s >= (SELECT max(start_s) FROM files, cut WHERE start_s < c)"))
def s3(spark, sf_dir):
    """A file list with one file per hour of events."""
    ev = token_events(spark, sf_dir)
    start = (F.floor(F.col("block_time_s") / 3600) * 3600).alias("start_s")
    stamp = F.date_format(F.timestamp_seconds("start_s"), "yyyyMMdd'T'HHmmss")
    files = ev.select(start).distinct().select(F.concat(F.lit("lifecycle-"), stamp, F.lit("Z-1.jsonl")).alias("name"))
    newest = ev.agg(F.max(F.floor(F.col("block_time_s") / 3600) * 3600)).first()[0]
    return fr.scan_since(files, 24, newest + 5).select("name", "start_s")


_CLEAN = "regexp_replace(value, 'api_key=[^\"&#\\s]*', 'api_key=REDACTED', 'g')"


@query("S5_archive_raw", sql(LINES, f"SELECT {_CLEAN} AS value, tier, CAST(strftime(make_timestamp(bt * 1000000), '%Y%m%d') AS BIGINT) AS day FROM lines"))
def s5(spark, sf_dir):
    path = work_path(spark, "archive")
    fr.archive_raw(lines(spark, sf_dir), path, "block_time_s")
    return spark.read.text(path).select("value", "tier", F.col("day").cast("bigint").alias("day"))


@query("S6_retention_plan", """SELECT doc_id, total - coalesce(before, 0) > 150000 - 20000 AS drop FROM (
  SELECT doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(n_chars) OVER (PARTITION BY lang) AS total FROM documents)""")
def s6(spark, sf_dir):
    """Documents stand for files: the language is the tier, the id the age."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return fr.retention_plan(docs, "lang", "doc_id", "n_chars", 150_000, 20_000).select("doc_id", "drop")


def _records(spark, sf_dir):
    s = Story(spark, sf_dir)
    al, rg = s.records()
    a = al.select(F.lit("alert").alias("kind"), "id", "level", "mint", "creator", "t_at")
    return s, a.unionByName(rg.select(F.lit("rug").alias("kind"), "mint", "creator", "t_at", "mechanism"), allowMissingColumns=True)


_REG = RECORDS + """, recs AS (SELECT 'alert' AS kind, id, mint, creator, t_at, CAST(NULL AS VARCHAR) AS mechanism FROM al UNION ALL SELECT 'rug', NULL, mint, creator, t_at, mechanism FROM rg),
fin AS (SELECT max(bt) AS now FROM ev)"""


@query("S7_write_registry", sql(_REG, "SELECT kind, count(*) AS n, count(DISTINCT t_at // 86400) AS days FROM recs GROUP BY kind"))
def s7(spark, sf_dir):
    path = work_path(spark, "registry")
    _, recs = _records(spark, sf_dir)
    registry.write_registry(recs, path)
    rows = spark.read.text(path).withColumn("kind", F.get_json_object("value", "$.kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("days"))


@query("S8_load_registry", sql(_REG, "SELECT kind, id, mint, creator, t_at, mechanism FROM recs, fin WHERE t_at // 86400 >= (now - 20 * 86400) // 86400"))
def s8(spark, sf_dir):
    """Some damaged lines lie among the records: they are set aside, the rest loads."""
    path = work_path(spark, "registry")
    s, recs = _records(spark, sf_dir)
    registry.write_registry(recs, path)
    bad = recs.filter("kind = 'rug'").select(F.lit('{"kind":"other"}').alias("value"), F.date_format(F.timestamp_seconds("t_at"), "yyyyMMdd").alias("day"))
    bad.write.mode("append").partitionBy("day").text(path)
    now = s.ev.agg(F.max("block_time_s")).first()[0]
    good, _ = registry.load_registry(spark, path, 20, now)
    return good.select("kind", "id", "mint", "creator", "t_at", "mechanism")


# ---- snapshots: a customer is a creator, its orders are its tokens

BLOCK = 4096


def history_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    token = F.struct(
        F.concat(F.lit("M"), "o_orderkey").alias("mint"), F.concat(F.lit("Name "), "o_orderkey").alias("name"), F.col("o_orderstatus").alias("symbol"),
        F.lit("pumpfun").alias("dex"), made.alias("created_time"), (F.col("o_orderstatus") == "F").alias("graduated"),
        F.when(F.col("o_orderstatus") == "F", made + 100).otherwise(0).alias("graduated_time"), F.lit("1.5").alias("ath_usd"), price.alias("ath_mcap_usd"),
        F.lit("0.1").alias("price_usd"), price.alias("liquidity_usd"), (F.col("o_orderkey") % 100).alias("holders"), F.lit("0").alias("total_fees_usd"),
        F.lit("0").alias("volume_1h_usd"), F.lit(0).alias("bundlers_count"), F.lit(False).alias("is_current"),
    )
    # One snapshot lists a customer's orders of one block of order numbers: never more than the block holds.
    per = o.groupBy("o_custkey", F.floor(F.col("o_orderkey") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(token)).alias("tokens"), F.min(made).alias("first_launch"), F.max(made).alias("last_launch"), F.count(F.lit(1)).alias("n"),
        F.min("o_orderkey").alias("first_key"), F.min_by(made, "o_orderkey").alias("created_time"),
    )
    launched = F.when(F.col("o_custkey") % 11 == 0, F.lit(None)).otherwise(F.col("n"))
    body = F.to_json(F.struct(
        F.concat(F.lit("M"), "first_key").alias("mint"), F.concat(F.lit("K"), "o_custkey").alias("creator"), F.lit("pumpfun").alias("launchpad"), "created_time",
        launched.alias("tokens_launched"), F.lit(0).alias("migrated"), "first_launch", "last_launch", F.col("n").alias("scanned"), F.lit(False).alias("truncated"), "tokens",
    ))
    return per.select(body.alias("value"), F.lit(2_000_000_000).cast("bigint").alias("fetched_s"))


# Every eleventh customer's snapshot lacks a field and is rejected.
HIST = """o AS (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS made, 'M' || o_orderkey AS mint, 'K' || o_custkey AS creator FROM orders WHERE o_custkey % 11 <> 0)"""


@query("S10_load_creator_history", sql(HIST, """SELECT creator, 'M' || min(o_orderkey) AS mint, count(*) AS tokens_launched, min(made) AS first_launch_s, max(made) AS last_launch_s,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS graduated FROM o GROUP BY creator, o_orderkey // 4096"""))
def s10(spark, sf_dir):
    hist, _ = snapshots.load_creator_history(history_lines(spark, sf_dir))
    grads = F.size(F.filter("tokens", lambda t: t["graduated_s"].isNotNull())).cast("bigint")
    return hist.select("creator", "mint", "tokens_launched", "first_launch_s", "last_launch_s", grads.alias("graduated"))


@query("S10_history_tokens", sql(HIST, """SELECT creator, mint, made AS created_s, o_orderstatus = 'F' AS graduated, CASE WHEN o_orderstatus = 'F' THEN made + 100 END AS graduated_s,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS liquidity_usd, o_orderkey % 100 AS holders FROM o"""))
def s10b(spark, sf_dir):
    hist, _ = snapshots.load_creator_history(history_lines(spark, sf_dir))
    t = snapshots.history_tokens(hist)
    return t.select("creator", "mint", "created_s", "graduated", "graduated_s", F.col("liquidity_usd").cast("double").alias("liquidity_usd"), "holders")


@query("S11_load_token_security", """SELECT 'P' || p_partkey AS mint, p_partkey % 2 = 0 AS token2022, CAST(p_size AS DOUBLE) / 10 AS total_tax_pct, p_partkey % 3 = 0 AS has_authority
FROM part WHERE p_partkey % 7 <> 0""")
def s11(spark, sf_dir):
    """Parts stand for tokens; every seventh snapshot carries a number where a text belongs."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tax = (F.col("p_size").cast("decimal(10,1)") / 10).cast("decimal(10,1)").cast("string")
    body = F.to_json(F.struct(
        F.concat(F.lit("P"), k).alias("mint"), F.when(k % 3 == 0, "A").alias("mint_authority"), F.lit(None).cast("string").alias("freeze_authority"), (k % 2 == 0).alias("token2022"),
        F.lit(None).cast("boolean").alias("metadata_mutable"), F.array(F.lit("x")).alias("extensions"), F.lit(None).cast("string").alias("transfer_fee_pct"), F.lit(False).alias("non_transferable"),
        tax.alias("total_tax_pct"), F.struct(F.lit("0").alias("transfer_fee_pct"), F.lit("0").alias("swap_fee_pct"), F.lit("0").alias("tip_pct")).alias("tax_breakdown"),
        F.lit("K1").alias("creator"), F.lit("1.5").alias("creator_pct"), F.lit("20").alias("top10_pct"),
    ), {"ignoreNullFields": "false"})
    damaged = F.when(k % 7 == 0, F.regexp_replace(body, '"creator_pct":"1.5"', '"creator_pct":1.5')).otherwise(body)
    good, _ = snapshots.load_token_security(p.select(damaged.alias("value"), F.lit(2_000_000_000).alias("fetched_s")))
    return good.select("mint", "token2022", F.col("total_tax_pct").cast("double").alias("total_tax_pct"), F.col("mint_authority").isNotNull().alias("has_authority"))


@query("S12_identity_dim", sql(HIST, """SELECT mint, creator, made AS created_s, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY creator, o_orderkey // 4096) THEN 'pumpfun' END AS launchpad,
  'Name ' || o_orderkey AS name, o_orderstatus AS symbol FROM o"""))
def s12(spark, sf_dir):
    hist, _ = snapshots.load_creator_history(history_lines(spark, sf_dir))
    return snapshots.identity_dim(hist)


@query("J5_merge_creator_history", sql(HIST + """, seen AS (SELECT 'K' || o_custkey AS creator, 'M' || o_orderkey AS mint, CAST(epoch(o_orderdate) AS BIGINT) - 50 + o_orderkey % 100 AS s FROM orders WHERE o_orderkey % 3 = 0)""", """SELECT coalesce(o.creator, s.creator) AS creator, coalesce(o.mint, s.mint) AS mint, least(coalesce(o.made, s.s), coalesce(s.s, o.made)) AS created_s,
  CASE WHEN s.mint IS NOT NULL THEN 'stream' ELSE 'rest' END AS source, CASE WHEN o.o_orderstatus = 'F' THEN 'graduated' WHEN s.mint IS NOT NULL AND CAST(substr(s.mint, 2) AS BIGINT) % 2 = 1 THEN 'curve' END AS stage,
  CASE WHEN o.o_orderstatus = 'F' THEN o.made + 100 END AS graduated_at_s FROM o FULL JOIN seen s ON s.creator = o.creator AND s.mint = o.mint"""))
def j5(spark, sf_dir):
    """A third of the orders were seen launching too, some earlier and some later than the snapshot says."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0")
    made = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    la = o.select(F.concat(F.lit("K"), "o_custkey").alias("creator"), F.concat(F.lit("M"), "o_orderkey").alias("mint"),
                  (made - 50 + F.col("o_orderkey") % 100).alias("created_s"), F.lit("stream").alias("source"), F.when(F.col("o_orderkey") % 2 == 1, 1).alias("stage_rank"))
    hist, _ = snapshots.load_creator_history(history_lines(spark, sf_dir))
    out = joins.merge_creator_history(la, snapshots.history_tokens(hist))
    return out.select("creator", "mint", "created_s", "source", "stage", "graduated_at_s")


@query("C1_creator_launches_with_history", sql(EV + """, la AS (SELECT actor AS creator, mint, min(bt) AS c, 'stream' AS source FROM ev WHERE typ = 'token_create' GROUP BY ALL),
h AS (SELECT 'K' || o_custkey AS creator, 'M' || o_orderkey AS mint, CAST(epoch(o_orderdate) AS BIGINT) AS c, 'rest' AS source FROM orders WHERE o_custkey % 11 <> 0)""", """SELECT creator, mint, c AS created_s, source FROM la UNION ALL SELECT * FROM h"""))
def c1h(spark, sf_dir):
    hist, _ = snapshots.load_creator_history(history_lines(spark, sf_dir))
    return creator_launches(token_events(spark, sf_dir), snapshots.history_tokens(hist))


@query("T17_latest_rest_reading", sql(HIST, "SELECT mint, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS rest_usd FROM o"))
def t17(spark, sf_dir):
    hist, _ = snapshots.load_creator_history(history_lines(spark, sf_dir))
    rd = prices.rest_readings(snapshots.history_tokens(hist))
    older = rd.withColumn("usd", F.col("usd") + 1).withColumn("pos", F.struct((F.col("at_s") - 60).alias("block_time_s"), *[F.col(f"pos.{p}").alias(p) for p in ("slot", "tx_index", "ix_index", "inner_ix_index")]))
    return tokens.latest_rest_reading(rd.unionByName(older)).select("mint", F.col("rest_usd").cast("double").alias("rest_usd"))


def _judged(gone, peak):
    return f"""CASE WHEN liq IS NULL THEN 'unlisted' WHEN {gone} AND liq <= 5 THEN 'same-collapsed' WHEN NOT {gone} AND liq > 5 THEN 'same-alive'
  WHEN {gone} AND liq / {peak} BETWEEN 1.4 AND 2.6 THEN 'high-double' WHEN {gone} THEN 'high'
  WHEN o_orderkey % 5 = 0 THEN 'low-curve' WHEN o_orderkey % 7 = 0 THEN 'low-active' ELSE 'low-quiet' END"""


@query("J11_reconcile_with_snapshot", f"""WITH s AS (SELECT o_orderpriority AS stratum, o_totalprice / 2 AS peak, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice ELSE o_totalprice / 2 END AS tpeak, o_orderkey % 2 = 0 AS gone, o_orderkey % 3 = 1 AS tgone,
  CASE WHEN o_custkey % 11 <> 0 THEN CAST(CAST(o_totalprice * (o_orderkey % 3) AS DECIMAL(18,2)) AS DOUBLE) END AS liq, o_orderkey FROM orders)
SELECT stratum, {_judged("gone", "peak")} AS verdict, {_judged("tgone", "tpeak")} AS verdict_tradable, count(*) AS n FROM s GROUP BY ALL""")
def j11(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    sample = o.select(
        F.col("o_orderpriority").alias("stratum"), k.alias("mint"), (F.col("o_totalprice") / 2).alias("peak_usd"), (k % 2 == 0).alias("collapsed"), F.lit(True).alias("graduated"),
        F.when(k % 5 == 0, 1.0).otherwise(0.0).alias("curve_units"), F.lit(0.0).alias("tradable_last_usd"), F.when(k % 7 == 0, 9000).otherwise(0).alias("last_pool_s"),
        (k % 3 == 1).alias("tradable_collapsed"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("tradable_peak_usd"),
    )
    listed = o.filter("o_custkey % 11 <> 0").select(k.alias("mint"), (F.col("o_totalprice") * (k % 3)).cast("decimal(18,2)").cast("double").alias("liquidity_usd"))
    out = joins.reconcile_with_snapshot(sample, listed, F.lit(10000))
    return out.groupBy("stratum", "verdict", "verdict_tradable").agg(F.count(F.lit(1)).alias("n"))


# Orders as launches: a third were heard in the stream (some by no known creator), every second of those on the curve.
_HEARD = HIST + """, heard AS (SELECT 'M' || o_orderkey AS mint, CASE WHEN o_orderkey % 2 = 1 THEN 'K' || o_custkey END AS creator, CAST(epoch(o_orderdate) AS BIGINT) - 50 + o_orderkey % 100 AS s, o_orderkey % 2 AS rank FROM orders WHERE o_orderkey % 3 = 0),
clock AS (SELECT max(CAST(epoch(o_orderdate) AS BIGINT)) AS now FROM orders)"""


class Merged:
    def __init__(self, spark, sf_dir):
        o = table(spark, sf_dir, "orders")
        key, made = F.col("o_orderkey"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        heard = o.filter(key % 3 == 0).select(
            F.lit("token_create").alias("type"), F.concat(F.lit("M"), key).alias("mint"), F.when(key % 2 == 1, F.concat(F.lit("K"), "o_custkey")).alias("actor"), (made - 50 + key % 100).alias("block_time_s"), (key % 2).cast("int").alias("rank"),
        )
        tok = heard.select("mint", F.col("actor").alias("creator"), F.col("block_time_s").alias("created_at_s"), F.col("rank").alias("stage_rank"), F.lit(None).cast("bigint").alias("graduated_at_s"), F.lit("").alias("stage"))
        named = heard.filter("actor is not null")
        dim = named.groupBy(F.col("actor").alias("creator")).agg(F.min("block_time_s").alias("first_seen_s"), F.max("block_time_s").alias("last_seen_s"), F.lit(False).alias("serial"))
        hist, _ = snapshots.load_creator_history(history_lines(spark, sf_dir))
        hist = settle(hist, "history")
        now = F.lit(o.agg(F.max(made)).first()[0])
        self.tokens, self.launches, self.creators = history.apply_creator_history(named, tok, dim, hist, snapshots.history_tokens(hist), now, PARAMS.with_(burst_window_s=86400 * 365, burst_max_launches=3))


@query("J5_tokens_after_history", sql(_HEARD, """SELECT h.mint, coalesce(h.creator, o.creator) AS creator, least(h.s, coalesce(o.made, h.s)) AS created_at_s,
  CASE WHEN o.o_orderstatus = 'F' THEN 'graduated' WHEN h.rank = 1 THEN 'curve' ELSE 'created' END AS stage, CASE WHEN o.o_orderstatus = 'F' THEN o.made + 100 END AS graduated_at_s,
  o.o_orderkey % 100 AS holders, CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS ath_mcap_usd FROM heard h LEFT JOIN o ON o.mint = h.mint"""))
def j5_tokens(spark, sf_dir):
    t = Merged(spark, sf_dir).tokens
    return t.select("mint", "creator", "created_at_s", "stage", "graduated_at_s", "holders", F.col("ath_mcap_usd").cast("double").alias("ath_mcap_usd"))


@query("J5_launches_after_history", sql(_HEARD, """SELECT coalesce(o.creator, n.creator) AS creator, coalesce(o.mint, n.mint) AS mint, least(coalesce(o.made, n.s), coalesce(n.s, o.made)) AS created_s, CASE WHEN n.mint IS NOT NULL THEN 'stream' ELSE 'rest' END AS source,
  CASE WHEN o.o_orderkey % 3 <> 0 AND o.o_orderstatus = 'F' THEN 'graduated' END AS stage, CASE WHEN o.o_orderkey % 3 <> 0 THEN o.o_orderkey % 100 END AS holders
FROM o FULL JOIN (SELECT * FROM heard WHERE creator IS NOT NULL) n ON n.creator = o.creator AND n.mint = o.mint"""))
def j5_launches(spark, sf_dir):
    return Merged(spark, sf_dir).launches.select("creator", "mint", "created_s", "source", "stage", "holders")


@query("C5_creators_after_history", sql(_HEARD + """, la AS (SELECT coalesce(o.creator, n.creator) AS creator, coalesce(o.mint, n.mint) AS mint, least(coalesce(o.made, n.s), coalesce(n.s, o.made)) AS at
  FROM o FULL JOIN (SELECT * FROM heard WHERE creator IS NOT NULL) n ON n.creator = o.creator AND n.mint = o.mint),
h AS (SELECT creator, min(made) AS a, max(made) AS b FROM o GROUP BY creator), d AS (SELECT creator, min(s) AS a, max(s) AS b FROM heard WHERE creator IS NOT NULL GROUP BY creator),
t AS (SELECT creator, max(n) AS tokens_launched FROM (SELECT creator, o_orderkey // 4096, count(*) AS n FROM o GROUP BY ALL) GROUP BY creator)""", """SELECT l.creator, least(coalesce(any_value(h.a), any_value(d.a)), coalesce(any_value(d.a), any_value(h.a)), min(l.at)) AS first_seen_s,
  greatest(coalesce(any_value(h.b), any_value(d.b)), coalesce(any_value(d.b), any_value(h.b)), max(l.at)) AS last_seen_s, count(*) AS launches, count(*) FILTER (WHERE now - l.at < 86400 * 365) > 3 AS serial, any_value(t.tokens_launched) AS tokens_launched
FROM la l LEFT JOIN h ON h.creator = l.creator LEFT JOIN d ON d.creator = l.creator LEFT JOIN t ON t.creator = l.creator, clock GROUP BY l.creator"""))
def c5_after(spark, sf_dir):
    return Merged(spark, sf_dir).creators.select("creator", "first_seen_s", "last_seen_s", "launches", "serial", "tokens_launched")


# ---- raw text joins

@query("J2_mint_prefilter", sql(LINES + ", m AS (SELECT DISTINCT mint FROM ev WHERE typ = 'token_create' AND slot % 50 = 0)", """SELECT value FROM lines WHERE tier = 'firehose' AND mint IN (SELECT mint FROM m)"""))
def j2(spark, sf_dir):
    rows = lines(spark, sf_dir)
    mints = token_events(spark, sf_dir).filter("type = 'token_create' and slot % 50 = 0").select("mint")
    return joins.mint_prefilter(rows.filter("tier = 'firehose'").select("value"), mints)


@query("J2_lifecycle_mints", sql(EV, "SELECT DISTINCT mint FROM ev WHERE typ IN ('token_create', 'graduation')"))
def j2b(spark, sf_dir):
    return fr.lifecycle_mints(lines(spark, sf_dir))


_CARRIED = LINES + """, carried AS (SELECT *, coalesce(last_value(CASE WHEN slot % 4 <> 0 THEN bt END IGNORE NULLS) OVER (PARTITION BY tier ORDER BY slot ROWS UNBOUNDED PRECEDING), 0) AS key_s FROM lines)"""


@query("J13_merge_tiers", sql(_CARRIED, "SELECT slot, tier, key_s FROM carried"))
def j13(spark, sf_dir):
    return fr.merge_tiers(lines(spark, sf_dir), "slot").select("slot", "tier", "key_s")


@query("S13_extract_subset", sql(_CARRIED + ", m AS (SELECT DISTINCT mint FROM ev WHERE typ = 'token_create' AND slot % 50 = 0), fin AS (SELECT min(bt) + 864000 AS e FROM ev)", f"""SELECT slot, {_CLEAN} AS value FROM carried, fin WHERE mint IN (SELECT mint FROM m) AND key_s <= e"""))
def s13(spark, sf_dir):
    """Every frame of the chosen tokens in the first ten days, cleaned of keys."""
    rows = fr.merge_tiers(lines(spark, sf_dir), "slot")
    ev = token_events(spark, sf_dir)
    mints = ev.filter("type = 'token_create' and slot % 50 = 0").select("mint")
    end = ev.agg(F.min("block_time_s")).first()[0] + 864000
    return fr.extract_subset(rows, mints, end).select("slot", "value")


@query("R12_alert_latency", sql(RECORDS, "SELECT id, t_at % 5 AS latency_s FROM al"))
def r12(spark, sf_dir):
    al, _ = Story(spark, sf_dir).records()
    seen = al.withColumn("detected_at_ms", (F.col("t_at") + F.col("t_at") % 5) * 1000 + 200)
    return seen.select("id", rules.alert_latency().alias("latency_s"))
