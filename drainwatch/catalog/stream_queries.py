"""Streams run to their end over the driver's events, held against the same SQL as the batch forms."""

from pyspark.sql import functions as F

from drainwatch.catalog.adapter import EV, PARAMS, RUGS, Story, as_token_events, readings, sql, table, token_events
from drainwatch.catalog.feed_adapter import FEED, raw_frames
from drainwatch.catalog.feed_queries import JITTER_S, frame_stream
from drainwatch.catalog.registry import query
from drainwatch.plans import normalize as nz
from drainwatch.plans import rules, tokens
from drainwatch.session import shared_dir, work_path
from drainwatch.sources import frames as fr
from drainwatch.streaming import feed, lifecycle, slices


# Micro-batches of the registered streams.
STRETCHES = 5


def event_stream(spark, sf_dir, delay="1 hour", received=False):
    """The events table as a stream: stretches of time land one after the other, and each is a micro-batch that finds the state of those before it."""
    batch = table(spark, sf_dir, "events")
    shared_dir(spark)
    path = work_path(spark, "events")
    low, high = batch.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    at = F.floor((F.unix_timestamp("ts") - low) * STRETCHES / (high - low + 1))
    ev = as_token_events(feed.landed(batch, at, STRETCHES, "event_id", path))
    if received:
        ev = ev.withColumn("received_s", F.col("block_time_s") + (F.col("slot") % 5) * 30 - 120)
    return feed.event_clock(ev, PARAMS, delay)


@query("S4_stream_frames", sql(FEED, "SELECT id FROM base"))
def s4(spark, sf_dir):
    """The raw feed as lines of text, read as a stream."""
    path = work_path(spark, "live")
    raw_frames(spark, sf_dir).select(F.to_json(F.struct("id", "value")).alias("value")).write.text(path)
    lines = feed.drain(fr.stream_frames(spark, path).select("value"), "s4")
    return lines.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"))


@query("X1_stream_normalize", sql(FEED, """SELECT type AS kind, 'good' AS part, count(*) AS n FROM feed WHERE reason IS NULL GROUP BY type
UNION ALL SELECT CASE WHEN reason = 'unknown_type' THEN reason || ' rug' WHEN reason = 'invalid_shape' THEN reason || ' ' || type ELSE reason END, 'bad', count(*) FROM feed WHERE reason IS NOT NULL GROUP BY 1"""))
def x1(spark, sf_dir):
    """Both outputs of the stream: valid frames filed by type, and the quarantine."""
    src, good, bad = (work_path(spark, n) for n in ("raw", "good", "bad"))
    raw_frames(spark, sf_dir).select("value").write.text(src)
    stream = fr.stream_frames(spark, src).select("value")
    feed.run_to_end(feed.stream_normalize(stream, good, bad, f"{good}-progress"))
    parts = [(good, "type", "good"), (bad, "kind", "bad")]
    counts = [spark.read.parquet(p).groupBy(F.col(c).cast("string").alias("kind"), F.lit(n).alias("part")).agg(F.count(F.lit(1)).alias("n")) for p, c, n in parts]
    return counts[0].unionByName(counts[1])


@query("X2_event_clock", sql(EV, "SELECT slot, least(bt, bt + (slot % 5) * 30 - 120 + 60) AS at_s FROM ev"))
def x2(spark, sf_dir):
    ev = event_stream(spark, sf_dir, received=True)
    return feed.drain(ev.select("slot", F.unix_timestamp("at").alias("at_s")), "x2")


@query("X3_late_still_applied", sql(EV, "SELECT (slot % 5) * 30 - 120 > 60 AS late, count(*) AS n FROM ev GROUP BY 1"))
def x3(spark, sf_dir):
    """Late rows carry a flag and stay in the stream."""
    ev = event_stream(spark, sf_dir, delay=feed.LATE_BOUND, received=True)
    return feed.drain(ev.select("slot", "late"), "x3").groupBy("late").agg(F.count(F.lit(1)).alias("n"))


# Repeats of the streamed feed come within twice its jitter.
HORIZON = f"{2 * JITTER_S} seconds"


def keyed_stream(spark, sf_dir):
    """Valid frames of the streamed feed (every fifth delivered twice, out of order) with their type, key and event time."""
    routed = nz.validated(nz.frames_to_routed(frame_stream(spark, sf_dir))).filter(F.col("reason").isNull() & F.col("type").isin(*slices.KINDS))
    at = F.try_variant_get("v", "$.block_time", "bigint")
    return routed.select("type", "v", slices.frame_key(F.col("type")).alias("key"), at.alias("block_time_s"))


_FOLLOWED = "SELECT * FROM feed WHERE reason IS NULL AND type IN ('token_create', 'meme', 'graduation', 'liquidity', 'swap')"


@query("U3_dedup_stream", sql(FEED + f", good AS ({_FOLLOWED})", "SELECT type, count(*) AS n, CAST(sum(bt % 1000) AS BIGINT) AS at_sum FROM good GROUP BY type"))
def u3(spark, sf_dir):
    """First delivery of each frame of the feed by its own key."""
    ev = feed.event_clock(keyed_stream(spark, sf_dir), PARAMS, HORIZON)
    out = feed.drain(feed.dedup_stream(ev).select("type", "block_time_s"), "u3")
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("block_time_s") % 1000).alias("at_sum"))


@query("X4_streaming_dedup", sql(FEED + f", good AS ({_FOLLOWED})", """SELECT type, CASE WHEN type = 'graduation' THEN 'T' || k || '|' || id ELSE 'sig' || id || '|' || (id % 5) || '|' || (id % 3 - 1) || '|T' || k END AS key FROM good WHERE type <> 'meme'"""))
def x4(spark, sf_dir):
    """The keys that reach what follows, each once."""
    ev = feed.event_clock(keyed_stream(spark, sf_dir).filter("type <> 'meme'"), PARAMS, HORIZON)
    return feed.drain(feed.dedup_stream(ev).select("type", "key"), "x4")


def late_parts(spark, sf_dir):
    """The events table as parts of hourly buckets, its batches mixed: most rows are days behind the newest of the batches before."""
    path, out = work_path(spark, "mixed"), work_path(spark, "parts")
    batch = table(spark, sf_dir, "events")
    for k in range(3):
        batch.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    ev = as_token_events(stream.parquet(path))
    ev = ev.withColumn("usd", F.when(F.col("type").isin("liquidity", "swap"), F.col("usd")))
    feed.run_to_end(ev.writeStream.foreachBatch(feed.bucket_parts(out, 3600)).option("checkpointLocation", f"{out}-progress"))
    return spark.read.parquet(out)


@query("X13_rate_with_late_rows", sql(EV, "SELECT bt // 3600 * 3600 AS start_s, count(*) AS n FROM ev GROUP BY 1"))
def x13_late(spark, sf_dir):
    """Every row counts, however late it comes."""
    return feed.merged_rate(late_parts(spark, sf_dir))


@query("X12_buckets_with_late_rows", sql(EV, """SELECT mint, pool, bt // 3600 * 3600 AS start_s, CAST(arg_max(usd, (bt, slot)) AS DOUBLE) AS usd FROM ev
WHERE typ IN ('add', 'remove', 'swap') GROUP BY mint, pool, bt // 3600"""))
def x12_late(spark, sf_dir):
    rows = feed.merged_readings(late_parts(spark, sf_dir))
    return rows.select("mint", "pool", "start_s", F.col("usd").cast("double").alias("usd"))


_CLOSED = "(SELECT max(bt) FROM ev) - 3600"


@query("X12_minute_buckets", sql(EV, f"""SELECT mint, pool, bt // 600 * 600 AS start_s, CAST(arg_max(usd, (bt, slot)) AS DOUBLE) AS usd FROM ev
WHERE typ IN ('add', 'remove', 'swap') GROUP BY mint, pool, bt // 600 HAVING bt // 600 * 600 + 600 <= {_CLOSED}"""))
def x12(spark, sf_dir):
    """Ten-minute buckets: those the watermark has closed."""
    rd = event_stream(spark, sf_dir)
    out = feed.minute_buckets(rd.withColumn("usd", F.when(F.col("type").isin("liquidity", "swap"), F.col("usd"))), 600)
    return feed.drain(out.filter("usd is not null").select("mint", "pool", "start_s", F.col("usd").cast("double").alias("usd")), "x12")


@query("X13_rate_metric", sql(EV, f"SELECT bt // 3600 * 3600 AS start_s, count(*) AS n FROM ev GROUP BY 1 HAVING bt // 3600 * 3600 + 3600 <= {_CLOSED}"))
def x13(spark, sf_dir):
    return feed.drain(feed.rate_stream(event_stream(spark, sf_dir), 3600), "x13")


# What the stream knows at each event: the creator of the first launch seen so far, else of the first graduation.
ONLINE = RUGS + """, firsts AS (SELECT mint, arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'token_create') AS ca, min((bt, slot)) FILTER (WHERE typ = 'token_create') AS cp,
  arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'graduation') AS ga, min((bt, slot)) FILTER (WHERE typ = 'graduation') AS gp FROM ev GROUP BY mint),
known AS (SELECT e.*, CASE WHEN f.cp <= (e.bt, e.slot) THEN f.ca WHEN f.gp <= (e.bt, e.slot) THEN f.ga END AS creator FROM ev e JOIN firsts f ON f.mint = e.mint),
ored AS (SELECT k.mint, k.creator, k.bt AS t_at, k.slot FROM known k LEFT JOIN rug0 r ON r.mint = k.mint WHERE k.typ = 'add' AND k.actor = k.creator AND (r.mint IS NULL OR (k.bt, k.slot) < (r.t_at, r.slot))
  QUALIFY row_number() OVER (PARTITION BY k.mint ORDER BY k.bt, k.slot) = 1),
org AS (SELECT k.mint, k.creator, k.bt AS t_at, k.slot, CASE WHEN k.typ <> 'swap' AND k.actor = k.creator THEN CASE WHEN o.mint IS NOT NULL THEN 'creator-pull' ELSE 'migration-pull' END
  WHEN k.typ <> 'swap' THEN 'third-party-remove' WHEN k.actor = k.creator THEN 'dev-dump' ELSE 'sell-off' END AS mechanism FROM rug0 r JOIN known k ON k.slot = r.slot LEFT JOIN ored o ON o.mint = r.mint)"""


def records(spark, sf_dir, **options):
    return lifecycle.token_records(event_stream(spark, sf_dir), PARAMS, **options)


@query("X5_stateful_token_lifecycle", sql(ONLINE, """SELECT 'red:' || mint AS id, creator, t_at, slot, CAST(NULL AS VARCHAR) AS mechanism FROM ored
UNION ALL SELECT 'rug:' || mint, creator, t_at, slot, mechanism FROM org"""))
def x5(spark, sf_dir):
    out = feed.drain(records(spark, sf_dir), "x5")
    return out.filter(F.col("kind").isin("alert", "rug")).select("id", "creator", "t_at", "slot", "mechanism")


@query("X6_stateful_creator_memory", sql(ONLINE + """, og AS (SELECT k.mint, k.creator, k.bt AS t_at, k.slot FROM known k LEFT JOIN org r ON r.mint = k.mint WHERE k.typ = 'graduation' AND (r.mint IS NULL OR (k.bt, k.slot) < (r.t_at, r.slot))),
back AS (SELECT g.*, r.mint AS rmint, r.t_at AS rat, row_number() OVER (PARTITION BY g.slot ORDER BY r.t_at DESC, r.slot DESC) AS b FROM og g JOIN org r ON r.creator = g.creator AND (r.t_at, r.slot) < (g.t_at, g.slot)),
pr AS (SELECT mint, creator, t_at, slot, count(*) AS n_prior FROM back WHERE rmint <> mint AND rat < t_at GROUP BY ALL)""", """SELECT 'amber:' || mint AS id, creator, t_at, slot, n_prior FROM pr QUALIFY row_number() OVER (PARTITION BY mint, creator ORDER BY t_at, slot) = 1"""))
def x6(spark, sf_dir):
    out = feed.drain(lifecycle.amber_records(records(spark, sf_dir), PARAMS), "x6")
    return out.select("id", "creator", "t_at", "slot", "n_prior")


_IDLE = PARAMS.with_(idle_curve_s=3600, idle_graduated_s=3600)


@query("X7_ttl_fold", sql(RUGS + """, pl AS (SELECT mint, pool, dex, arg_max(usd, (bt, slot)) AS u FROM rd GROUP BY ALL),
fo AS (SELECT e.mint, max(e.bt) AS t_at, CASE WHEN bool_or(e.typ = 'graduation') THEN 'graduated' ELSE 'created' END AS stage FROM ev e GROUP BY e.mint HAVING max(e.bt) + 3601 <= (SELECT max(bt) - 3600 FROM ev))""", """SELECT f.mint, f.t_at, f.stage, (SELECT CAST(CASE WHEN f.stage = 'graduated' THEN coalesce(max(held), max(usd)) ELSE max(usd) END AS DOUBLE) FROM rd WHERE rd.mint = f.mint) AS peak_usd,
  (SELECT CAST(coalesce(CASE WHEN f.stage = 'graduated' THEN sum(u) FILTER (WHERE dex <> 'pumpfun') END, sum(u)) AS DOUBLE) FROM pl WHERE pl.mint = f.mint) AS last_usd FROM fo f"""))
def x7(spark, sf_dir):
    """Tokens silent for an hour when the stream's clock passes them are folded into one outcome row."""
    out = feed.drain(lifecycle.token_records(event_stream(spark, sf_dir), _IDLE, fold_idle=True), "x7")
    rows = out.filter("kind = 'outcome'")
    return rows.select("mint", "t_at", "stage", F.col("peak_usd").cast("double").alias("peak_usd"), F.col("last_usd").cast("double").alias("last_usd"))


@query("X8_early_pairs_held", sql(EV + """, f AS (SELECT mint, min((bt, slot)) AS p, min(bt) AS t FROM ev WHERE typ IN ('token_create', 'graduation') GROUP BY mint)""", """SELECT e.mint, e.slot, (e.bt, e.slot) < p AS held FROM ev e JOIN f ON f.mint = e.mint WHERE typ IN ('add', 'remove') AND ((e.bt, e.slot) > p OR e.bt >= f.t - 7200)"""))
def x8(spark, sf_dir):
    return feed.drain(lifecycle.release_early_pairs(event_stream(spark, sf_dir), 7200), "x8").select("mint", "slot", "held")


@query("X9_alert_resolution", sql(ONLINE, """SELECT 'unconfirmed:' || o.mint AS id, o.t_at FROM ored o LEFT JOIN org r ON r.mint = o.mint WHERE (r.mint IS NULL OR r.t_at > o.t_at + 3600) AND o.t_at + 3601 <= (SELECT max(bt) - 3600 FROM ev)"""))
def x9(spark, sf_dir):
    out = feed.drain(records(spark, sf_dir, resolve=True), "x9")
    return out.filter("kind = 'unconfirmed'").select("id", "t_at")


@query("X14_records_sink", sql(ONLINE, "SELECT 'red:' || mint AS id, t_at FROM ored UNION ALL SELECT 'rug:' || mint, t_at FROM org"))
def x14(spark, sf_dir):
    path = work_path(spark, "records")
    rows = records(spark, sf_dir).filter(F.col("kind").isin("alert", "rug")).select("id", "t_at")
    feed.run_to_end(feed.once(rows).writeStream.foreachBatch(feed.records_sink(path)).option("checkpointLocation", f"{path}-progress"))
    return spark.read.parquet(path).select("id", "t_at")


_HALF = ", h AS (SELECT min(bt) + (max(bt) - min(bt)) // 2 AS half FROM ev)"
_WARM = ONLINE + _HALF + """, tok1 AS (SELECT mint, coalesce(arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'token_create'), arg_min(actor, (bt, slot)) FILTER (WHERE typ = 'graduation')) AS creator
  FROM ev, h WHERE bt <= half GROUP BY mint),
red1 AS (SELECT DISTINCT e.mint FROM ev e JOIN tok1 t ON t.mint = e.mint AND t.creator = e.actor LEFT JOIN rug0 r ON r.mint = e.mint, h WHERE e.typ = 'add' AND e.bt <= half AND (r.mint IS NULL OR (e.bt, e.slot) < (r.t_at, r.slot))),
red2 AS (SELECT k.mint, k.bt AS t_at, k.slot FROM known k LEFT JOIN rug0 r ON r.mint = k.mint, h WHERE k.typ = 'add' AND k.actor = k.creator AND k.bt > half AND k.mint NOT IN (SELECT mint FROM red1)
  AND (r.mint IS NULL OR (k.bt, k.slot) < (r.t_at, r.slot)) QUALIFY row_number() OVER (PARTITION BY k.mint ORDER BY k.bt, k.slot) = 1)"""


@query("X10_warm_start", sql(_WARM, """SELECT 'red:' || mint AS id, t_at, CAST(NULL AS VARCHAR) AS mechanism FROM red2
UNION ALL SELECT 'rug:' || o.mint, o.t_at, CASE WHEN o.mechanism IN ('creator-pull', 'migration-pull') THEN CASE WHEN o.mint IN (SELECT mint FROM red1 UNION ALL SELECT mint FROM red2) THEN 'creator-pull' ELSE 'migration-pull' END
  ELSE o.mechanism END FROM org o, h WHERE o.t_at > half"""))
def x10(spark, sf_dir):
    """The batch state of the first half of the time starts the stream of the second half, which repeats nothing."""
    ev = token_events(spark, sf_dir)
    lo, hi = ev.agg(F.min("block_time_s"), F.max("block_time_s")).first()
    half = lo + (hi - lo) // 2
    old = ev.filter(F.col("block_time_s") <= half)
    rd, tok = readings(old), tokens.token_dim(old)
    rg = rules.rug_confirmations(rd, tok, PARAMS)
    red = rules.red_alerts(old.filter("type = 'liquidity'"), tok, rg, PARAMS)
    initial = lifecycle.initial_tokens(old, rd, tok, red, rg)
    stream = event_stream(spark, sf_dir).filter(F.col("block_time_s") > half)
    out = feed.drain(lifecycle.token_records(stream, PARAMS, initial=initial), "x10")
    return out.filter(F.col("kind").isin("alert", "rug")).select("id", "t_at", "mechanism")


@query("X11_idempotent_apply", sql(RUGS, """SELECT r.mint, r.t_at, r.slot, CAST(r.peak AS DOUBLE) AS peak_usd, r.mechanism FROM (SELECT r.*, g.mechanism FROM rug0 r JOIN rg g ON g.mint = r.mint) r"""))
def x11(spark, sf_dir):
    """Every event delivered twice and out of order: the same drains."""
    s = Story(spark, sf_dir)
    s.ev = s.ev.unionByName(s.ev.repartition(7, "slot")).repartition(5, "actor")
    s.rd, s.tok = readings(s.ev), tokens.token_dim(s.ev)
    rg = s.rugs()
    return rg.select("mint", "t_at", F.col("pos.slot").alias("slot"), F.col("peak_usd").cast("double").alias("peak_usd"), "mechanism")
