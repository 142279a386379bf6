"""Parsing, validation, deduplication and pricing of raw frames derived from the events table."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drainwatch.catalog.adapter import EV, PARAMS, sql, table, token_events
from drainwatch.catalog.feed_adapter import FEED, HAS_SLOT, RAW, SOL, raw_frames, routed_frames
from drainwatch.catalog.registry import query
from drainwatch.functions import validate as v
from drainwatch.functions.redact import redact_secrets, redact_url
from drainwatch.plans import dedup, detect, joins, prices, tokens
from drainwatch.plans import normalize as nz
from drainwatch.session import settle, work_path
from drainwatch.sources import registry
from drainwatch.sources.tables import read_routed, write_routed
from drainwatch.streaming import feed, slices


def routed(spark, sf_dir):
    return nz.frames_to_routed(raw_frames(spark, sf_dir))


def typed(spark, sf_dir, kind, carry=("id",)):
    return nz.normalize(routed_frames(spark, sf_dir), kind, list(carry))


# How each kind of field is shown for comparison, on both sides.
_SQL = {
    v.DECIMAL.expected: "CAST({e} AS DOUBLE)", v.INT.expected: "CAST({e} AS BIGINT)", v.SECONDS.expected: "CAST({e} AS BIGINT)",
    v.RAW.expected: "CAST(CAST({e} AS DECIMAL(38,0)) AS VARCHAR)", v.MILLIS.expected: "CAST({e} AS BIGINT)",
}


def shown(df: DataFrame) -> DataFrame:
    cast = {"decimal(38,18)": "double", "decimal(38,0)": "string"}
    return df.select(*[F.col(c).cast(cast[t]).alias(c) if t in cast else F.col(c) for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))])


def expected(kind, overrides=None, skip=()):
    """SQL of what normalizing one type must give back."""
    overrides = overrides or {}
    cols = ["id", "origin"]
    for name, path, k in nz.SCHEMAS[kind]:
        if name in skip:
            continue
        e = overrides.get(name, RAW[kind].get(path, "NULL"))
        cols.append(f"{_SQL.get(k.expected, '{e}').format(e=e)} AS {name}")
    cols += [f"{e} AS {n}" for n, e in overrides.items() if n not in {f[0] for f in nz.SCHEMAS[kind]}]
    return sql(FEED, f"SELECT {', '.join(cols)} FROM feed WHERE reason IS NULL AND type = '{kind}'")


@query("N1_parse_frames", sql(FEED, f"""SELECT id, reason IS DISTINCT FROM 'invalid_json' AS parsed,
  CASE WHEN type IN ('liquidity', 'swap', 'meme') AND reason IS DISTINCT FROM 'invalid_json' AND reason IS DISTINCT FROM 'not_an_object'
    THEN CAST(9007199254740993 + id * 1000 AS VARCHAR) END AS exact_amount FROM feed"""))
def n1(spark, sf_dir):
    parsed = nz.parse_frames(raw_frames(spark, sf_dir))
    amount = F.try_variant_get("v", "$.base_reserve", "decimal(38,0)").cast("string")
    return parsed.select("id", F.col("v").isNotNull().alias("parsed"), amount.alias("exact_amount"))


@query("N2_route_by_type", sql(FEED, """SELECT coalesce(CASE WHEN reason <> 'invalid_shape' THEN reason END, 'ok') AS reason,
  CASE WHEN reason IN ('invalid_json', 'not_an_object') THEN '?' WHEN reason = 'unknown_type' THEN 'rug' ELSE type END AS type, count(*) AS n FROM feed GROUP BY ALL"""))
def n2(spark, sf_dir):
    r = routed(spark, sf_dir)
    return r.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason"), F.coalesce("type", F.lit("?")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def _register(name, kind, overrides=None, skip=(), extra=None):
    @query(name, expected(kind, overrides, skip))
    def run(spark, sf_dir):
        rows = typed(spark, sf_dir, kind)
        for column, e in (extra() if extra else {}).items():
            rows = rows.withColumn(column, e)
        return shown(rows).drop("type", *[s for s in skip if s in rows.columns])

    return run


def _windows_text():
    one = lambda w: F.concat(w["window_s"], F.lit(":"), w["trades"], F.lit(":"), w["volume_usd"].cast("double"))
    return F.array_join(F.transform("windows", one), ",")


_WINDOWS_SQL = "'300:' || k || ':1.25,3600:' || (k + 5) || ':' || CAST(CAST(val AS DOUBLE) AS VARCHAR)"

_register("N3_normalize_token_create", "token_create", {"uri": "nullif(CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://x/' || id END, '')"})
_register("N4_normalize_pool_create", "pool_create")
_register("N5_normalize_graduation", "graduation")
_register("N6_normalize_liquidity", "liquidity")
_register("N7_normalize_swap", "swap", {"price": "0.001"})
_register("N8_normalize_transfer", "transfer")
_register("N9_normalize_candle", "candle")
_register("N10_normalize_stats", "stats", {"shown_windows": _WINDOWS_SQL}, ("windows",), lambda: {"shown_windows": _windows_text()})
_register("N11_normalize_meme", "meme", {
    "shown_windows": _WINDOWS_SQL, "meta_name": "CASE WHEN id % 2 = 0 THEN 'Coin ' || k END", "meta_symbol": "CAST(NULL AS VARCHAR)",
    "meta_supply": "CASE WHEN id % 2 = 0 THEN CAST(9007199254740993 + id * 1000 AS VARCHAR) END", "meta_link": "CASE WHEN id % 2 = 0 THEN 'https://x/' || k END",
}, ("windows", "metadata"), lambda: {
    "shown_windows": _windows_text(), "meta_name": F.col("metadata.name"), "meta_symbol": F.col("metadata.symbol"),
    "meta_supply": F.col("metadata.supply").cast("string"), "meta_link": F.col("metadata.socials")["x"],
})
_register("N12_normalize_surge", "surge")
_register("N12_normalize_radar", "radar")
_register("N13_normalize_metadata", "metadata", {
    "symbol": "CAST(NULL AS VARCHAR)", "uri": "CAST(NULL AS VARCHAR)", "description": "CAST(NULL AS VARCHAR)", "image_url": "'https://h.example/i/' || k || '?z=1'",
    "resolved_at_ms": "CASE WHEN id % 5 <> 0 THEN bt * 1000 END", "n_links": "CAST(0 AS BIGINT)",
}, ("socials",), lambda: {"n_links": F.size("socials").cast("bigint")})


@query("N14_normalize_control", sql(FEED, """SELECT id, origin, CASE type WHEN 'connected' THEN 'nyc' END AS region, CASE type WHEN 'connected' THEN 'swap,meme' END AS types,
  CASE type WHEN 'backfill_end' THEN k END AS events FROM feed WHERE reason IS NULL AND type IN ('connected', 'backfill_end')"""))
def n14(spark, sf_dir):
    r = routed_frames(spark, sf_dir)
    hello = nz.normalize(r, "connected", ["id"]).withColumn("types", F.array_join("subscribed_types", ",")).drop("subscribed_types")
    return hello.unionByName(nz.normalize(r, "backfill_end", ["id"]), allowMissingColumns=True).select("id", "origin", "region", "types", "events")


@query("N15_quarantine_snapshots", sql(FEED, "SELECT id, type, origin, false AS verified, k AS items FROM feed WHERE reason IS NULL AND type IN ('launches', 'graduating', 'graduated', 'trending')"))
def n15(spark, sf_dir):
    rows = nz.quarantine_snapshots(routed_frames(spark, sf_dir), ["id"])
    return rows.select("id", "type", "origin", "verified", F.try_variant_get("payload", "$.items", "bigint").alias("items"))


@query("N16_derive_origin", sql(FEED, "SELECT origin, count(*) AS n FROM feed WHERE reason IS NULL AND type = 'swap' GROUP BY origin"))
def n16(spark, sf_dir):
    return typed(spark, sf_dir, "swap").groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("N17_tx_ref", sql(FEED, """SELECT id, 'sig' || id AS signature, CAST(bt AS VARCHAR) || '/' || id || '/' || u || '/' || (id % 5) || '/' || (id % 3 - 1) AS pos, bt * 1000 + 250 AS indexed_at_ms
FROM feed WHERE reason IS NULL AND type = 'transfer'"""))
def n17(spark, sf_dir):
    from drainwatch.functions.events import POSITION

    return typed(spark, sf_dir, "transfer").select("id", "signature", F.concat_ws("/", *POSITION).alias("pos"), "indexed_at_ms")


@query("N18_explode_windows", sql(FEED, """SELECT id, CAST(w AS BIGINT) AS window_s, CASE w WHEN 300 THEN k ELSE k + 5 END AS trades, CASE w WHEN 300 THEN 1.25::DOUBLE ELSE CAST(val AS DOUBLE) END AS volume_usd
FROM feed, (VALUES (300), (3600)) x(w) WHERE reason IS NULL AND type = 'stats'"""))
def n18(spark, sf_dir):
    rows = typed(spark, sf_dir, "stats").select("id", F.explode("windows").alias("w"))
    return rows.select("id", "w.window_s", "w.trades", F.col("w.volume_usd").cast("double").alias("volume_usd"))


@query("N19_validate_fields", sql(FEED, f"""SELECT count(*) FILTER (WHERE type IN ({', '.join(repr(t) for t in HAS_SLOT)}) AND id % 29 <> 0) AS good_slot,
  count(*) FILTER (WHERE type IN ('swap', 'stats', 'meme') AND NOT (id % 43 = 4 AND id % 29 <> 0)) AS good_price,
  count(*) FILTER (WHERE type IN ('swap', 'stats', 'meme', 'token_create', 'pool_create', 'liquidity', 'transfer', 'graduation') AND NOT (id % 47 = 5 AND id % 43 <> 4 AND id % 29 <> 0)) AS good_time
FROM feed WHERE reason IS NULL OR reason = 'invalid_shape'"""))
def n19(spark, sf_dir):
    rows = routed(spark, sf_dir).filter("reason is null")
    field = lambda name: v.get(F.col("v"), name)
    return rows.agg(
        F.count_if(v.validate_int(field("slot"))).alias("good_slot"), F.count_if(v.validate_decimal(field("price_usd"))).alias("good_price"),
        F.count_if(v.validate_seconds(field("block_time"))).alias("good_time"),
    )


@query("N20_collect_issues", sql(FEED, """SELECT id, type, CASE WHEN id % 29 = 0 THEN 'slot: expected a whole number' WHEN id % 43 = 4 THEN 'price_usd: expected a decimal text'
  ELSE 'block_time: expected unix seconds' END AS issues FROM feed WHERE reason = 'invalid_shape'"""))
def n20(spark, sf_dir):
    bad = nz.validated(routed(spark, sf_dir)).filter("reason = 'invalid_shape'")
    return bad.select("id", "type", F.array_join(F.slice("issues", 1, 3), "; ").alias("issues"))


@query("N21_redact_url", r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '[?&]ref=') THEN url
  ELSE regexp_replace(regexp_replace(url, '([?&])ref=[^&#]*&?', '\1', 'g'), '[?&]+(#|$)', '\1', 'g') END AS url FROM pages""")
def n21(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", redact_url(F.col("url"), "ref").alias("url"))


@query("N22_redact_secrets", r"""SELECT page_id, md5(regexp_replace(replace(html, 'track', 'REDACTED'), 'href=[^"&#\s]*', 'href=REDACTED', 'g')) AS digest FROM pages""")
def n22(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(redact_secrets(F.col("html"), "track", "href")).alias("digest"))


_KIND = """CASE WHEN reason = 'unknown_type' THEN reason || ' rug' WHEN reason = 'invalid_shape' THEN reason || ' ' || type ELSE reason END"""


@query("N23_quarantine_counts", sql(FEED, f"SELECT {_KIND} AS kind, count(*) AS n FROM feed WHERE reason IS NOT NULL GROUP BY 1"))
def n23(spark, sf_dir):
    return nz.quarantine(raw_frames(spark, sf_dir), "id")[0]


@query("N23_quarantine_recent", sql(FEED, f"SELECT id, {_KIND} AS kind FROM feed WHERE reason IS NOT NULL ORDER BY id DESC LIMIT 10"))
def n23b(spark, sf_dir):
    return nz.quarantine(raw_frames(spark, sf_dir), "id")[1].select("id", "kind")


# ---- deduplication: every third frame is delivered again later, flagged as backfill

_KEYED = ("swap", "transfer", "token_create", "pool_create", "liquidity", "graduation")


def delivered_twice(spark, sf_dir):
    once = raw_frames(spark, sf_dir)
    again = once.filter("id % 3 = 0").withColumn("value", F.regexp_replace("value", r"\}$", ',"backfill":true}'))
    return once.withColumn("arrival", F.col("id")).unionByName(again.withColumn("arrival", F.col("id") + 1_000_000_000))


def keyed(spark, sf_dir, kinds=_KEYED):
    # Seven types are read from the frames: parsed once, filed by type.
    path = work_path(spark, "twice")
    write_routed(nz.frames_to_routed(delivered_twice(spark, sf_dir)), path)
    r = read_routed(spark, path)
    parts = [dedup.dedup_key(nz.normalize(r, k, ["id", "arrival"]), k).select("id", "arrival", "type", "origin", "key") for k in kinds]
    return reduce(DataFrame.unionByName, parts)


_TX_KEY = "'sig' || id || '|' || (id % 5) || '|' || (id % 3 - 1) || '|T' || k"
_KEY_SQL = f"CASE WHEN type = 'graduation' THEN 'T' || k || '|' || id ELSE {_TX_KEY} END"
_KINDS_SQL = ", ".join(repr(k) for k in _KEYED)


@query("U1_dedup_key", sql(FEED, f"SELECT id, type, CASE WHEN type NOT IN ('connected', 'backfill_end') THEN {_KEY_SQL} END AS key FROM feed WHERE reason IS NULL AND type IN ({_KINDS_SQL}, 'connected', 'backfill_end')"))
def u1(spark, sf_dir):
    return keyed(spark, sf_dir, (*_KEYED, "connected", "backfill_end")).filter("arrival = id").select("id", "type", "key")


@query("U2_dedup_exact", sql(FEED, f"""SELECT id, type, origin FROM feed WHERE reason IS NULL AND type IN ({_KINDS_SQL}, 'backfill_end')
UNION ALL SELECT id, type, CASE WHEN id % 8 = 0 THEN 'catchup' ELSE 'backfill' END FROM feed WHERE reason IS NULL AND type = 'backfill_end' AND id % 3 = 0"""))
def u2(spark, sf_dir):
    """Control frames carry no key: their second delivery stays."""
    rows = keyed(spark, sf_dir, (*_KEYED, "backfill_end"))
    return dedup.dedup_exact(rows, ["arrival"]).select("id", "type", "origin")


@query("U4_ingest_counters", sql(FEED, f"""SELECT type, count(*) + count(*) FILTER (WHERE id % 3 = 0) AS received, count(*) FILTER (WHERE id % 3 = 0) AS duplicates, count(*) AS delivered
FROM feed WHERE reason IS NULL AND type IN ({_KINDS_SQL}) GROUP BY type"""))
def u4(spark, sf_dir):
    return dedup.ingest_counters(keyed(spark, sf_dir))


@query("U5_key_collision_report", sql(EV, """SELECT candidate, CAST(sum(c - 1) AS BIGINT) AS collisions FROM (
  SELECT 'mint' AS candidate, count(DISTINCT (usd, typ)) AS c FROM ev GROUP BY mint UNION ALL SELECT 'mint+actor', count(DISTINCT (usd, typ)) FROM ev GROUP BY mint, actor
  UNION ALL SELECT 'mint+actor+slot', count(DISTINCT (usd, typ)) FROM ev GROUP BY mint, actor, slot) GROUP BY candidate"""))
def u5(spark, sf_dir):
    ev = token_events(spark, sf_dir)
    content = F.sha1(F.to_json(F.struct("usd", "type", "kind")))
    return dedup.key_collision_report(ev, {"mint": ["mint"], "mint+actor": ["mint", "actor"], "mint+actor+slot": ["mint", "actor", "slot"]}, content)


_IDENT = FEED + f""",
ident AS (SELECT 'T' || k AS mint, bt, CASE WHEN type = 'meme' THEN -2 ELSE id END AS spot, type = 'token_create' AS born,
  CASE type WHEN 'token_create' THEN 'Coin "' || k || '"' WHEN 'meme' THEN CASE WHEN id % 2 = 0 THEN 'Coin ' || k END END AS name, CASE WHEN type = 'token_create' THEN 'S' || k END AS symbol,
  CASE WHEN type = 'token_create' THEN {SOL} END AS quote_mint, CASE WHEN type <> 'meme' OR id % 3 = 0 OR id % 2 = 0 THEN 'C' || u END AS creator FROM feed WHERE reason IS NULL AND type IN ('token_create', 'meme', 'graduation'))"""


def _known_first(column):
    return f"coalesce(arg_min({column}, (bt, spot)) FILTER (WHERE born), arg_min({column}, (bt, spot)) FILTER (WHERE NOT born AND {column} IS NOT NULL)) AS {column}"


@query("T1_token_identity", sql(_IDENT, f"SELECT mint, 'pumpfun' AS launchpad, {', '.join(map(_known_first, ('creator', 'name', 'symbol', 'quote_mint')))}, min(bt) FILTER (WHERE born) AS created_at_s FROM ident GROUP BY mint"))
def t1_identity(spark, sf_dir):
    """Names, symbols, launchpads and quote assets from the frames of three types."""
    norm = {k: nz.normalize(routed_frames(spark, sf_dir), k) for k in ("token_create", "meme", "graduation")}
    return prices.token_table(norm).select("mint", "launchpad", "creator", "name", "symbol", "quote_mint", "created_at_s")


# ---- prices and readings

class Feed:
    def __init__(self, spark, sf_dir):
        r = routed_frames(spark, sf_dir)
        self.norm = {k: nz.normalize(r, k) for k in ("token_create", "meme", "graduation", "liquidity", "swap")}
        self.tok = settle(prices.token_table(self.norm), "tokens")
        # Resolved rows feed both the prices and the readings.
        self.pairs = settle(prices.pair_rows(self.norm["liquidity"], self.tok), "pairs")
        self.swaps = settle(prices.swap_rows(self.norm["swap"], self.tok), "swaps")
        self.px = prices.learn_quote_prices(self.norm["liquidity"], self.pairs, self.swaps)


PX = FEED + f""",
good AS (SELECT *, 'T' || k AS mint FROM feed WHERE reason IS NULL),
first AS (SELECT mint, min((bt, CASE type WHEN 'meme' THEN -2 ELSE id END)) AS pos FROM good WHERE type IN ('token_create', 'meme', 'graduation') GROUP BY mint),
moves AS (SELECT g.*, CAST(val AS DECIMAL(18,2)) AS units FROM good g JOIN first f ON f.mint = g.mint WHERE g.type = 'liquidity' OR (g.type = 'swap' AND (g.bt, g.id) >= f.pos)),
px AS (SELECT bt, id, CAST(100 + k % 3 AS DECIMAL(18,2)) AS price FROM good WHERE type = 'liquidity' UNION ALL SELECT bt, id, CAST(100 + k % 3 AS DECIMAL(18,2)) FROM moves WHERE type = 'swap'),
memes AS (SELECT g.*, (SELECT arg_max(price, (p.bt, p.id)) FROM px p WHERE p.bt < g.bt) AS price FROM good g WHERE type = 'meme')"""


@query("T5_curve_progress", sql(PX, "SELECT mint, CAST(arg_max(val, (bt, val)) AS DOUBLE) AS progress_pct FROM memes GROUP BY mint"))
def t5(spark, sf_dir):
    return tokens.curve_progress(typed(spark, sf_dir, "meme")).select("mint", F.col("progress_pct").cast("double").alias("progress_pct"))


@query("T6_curve_readings", sql(PX, "SELECT mint, bt AS at_s, CAST(val * price AS DOUBLE) AS usd FROM memes"))
def t6(spark, sf_dir):
    f = Feed(spark, sf_dir)
    return prices.curve_readings(f.norm["meme"], f.tok, f.px).select("mint", "at_s", F.col("usd").cast("double").alias("usd"))


@query("T7_pool_readings", sql(PX, "SELECT mint, id AS slot, type AS event, CAST(units * (100 + k % 3) AS DOUBLE) AS usd FROM moves"))
def t7(spark, sf_dir):
    f = Feed(spark, sf_dir)
    rd = prices.pool_readings(f.pairs, f.swaps, f.px)
    return rd.select("mint", F.col("pos.slot").alias("slot"), "event", F.col("usd").cast("double").alias("usd"))


@query("T8_learn_quote_prices", sql(PX, f"SELECT {SOL} AS quote_mint, id AS slot, CAST(price AS DOUBLE) AS usd_per_unit FROM px"))
def t8(spark, sf_dir):
    px = Feed(spark, sf_dir).px
    return px.select("quote_mint", F.col("pos.slot").alias("slot"), F.col("usd_per_unit").cast("double").alias("usd_per_unit"))


@query("J3_price_asof", sql(EV, """SELECT e.slot, CAST(p.usd AS DOUBLE) AS usd_per_unit FROM ev e ASOF LEFT JOIN (SELECT slot, mint, usd FROM ev WHERE typ = 'add') p ON p.mint = e.mint AND p.slot <= e.slot WHERE e.typ = 'swap'"""))
def j3(spark, sf_dir):
    """Adds teach a price per token, swaps look it up."""
    ev = token_events(spark, sf_dir).withColumn("quote_mint", F.col("mint"))
    px = ev.filter("kind = 'add'").select("quote_mint", "pos", F.col("usd").alias("usd_per_unit"))
    asked = ev.filter("type = 'swap'").select("slot", "quote_mint", "pos")
    return joins.price_asof(asked, px).select("slot", F.col("usd_per_unit").cast("double").alias("usd_per_unit"))


@query("J4_late_token_join", sql(EV + """, seen AS (SELECT mint, min(bt) AS f FROM ev WHERE typ IN ('token_create', 'graduation') AND bt >= (SELECT min(bt) + 864000 FROM ev) GROUP BY mint)""", """SELECT e.slot, e.mint, e.bt < f AS held FROM ev e JOIN seen s ON s.mint = e.mint WHERE typ IN ('add', 'remove') AND e.bt >= f - 21600"""))
def j4(spark, sf_dir):
    """Tokens known only from the tenth day on: pair events up to six hours earlier are held for them."""
    ev = token_events(spark, sf_dir)
    start = ev.agg(F.min("block_time_s")).first()[0] + 864000
    seen = ev.filter(F.col("type").isin("token_create", "graduation") & (F.col("block_time_s") >= start)).groupBy("mint").agg(F.min("block_time_s").alias("first_seen_s"))
    return joins.late_token_join(ev.filter("type = 'liquidity'"), seen, 21600).select("slot", "mint", "held")


@query("J4_swaps_of_known", sql(EV + """, seen AS (SELECT mint, min((bt, slot)) AS f FROM ev WHERE typ IN ('token_create', 'graduation') GROUP BY mint)""", """SELECT e.slot, e.mint FROM ev e JOIN seen s ON s.mint = e.mint WHERE typ = 'swap' AND (e.bt, e.slot) >= f"""))
def j4b(spark, sf_dir):
    ev = token_events(spark, sf_dir)
    return joins.swaps_of_known(ev.filter("type = 'swap'"), tokens.token_dim(ev)).select("slot", "mint")


# What the detector knows at each event, over the feed: one pool per token, each reading at the price of its own event.
ONLINE_FEED = FEED + f""",
raw AS (SELECT id AS slot, bt, CASE type WHEN 'liquidity' THEN CASE WHEN id % 3 = 0 THEN 'remove' ELSE 'add' END ELSE type END AS typ, 'T' || k AS mint, val * (100 + k % 3) AS usd,
  CASE WHEN type <> 'meme' OR id % 3 = 0 OR id % 2 = 0 THEN 'C' || u END AS actor, CASE WHEN type = 'meme' THEN -2 ELSE id END AS spot
  FROM feed WHERE reason IS NULL AND type IN ('token_create', 'meme', 'graduation', 'liquidity', 'swap')),
tk AS (SELECT mint, arg_min(actor, (bt, spot)) FILTER (WHERE typ = 'token_create') AS ba, min((bt, spot)) FILTER (WHERE typ = 'token_create') AS bp,
  arg_min(actor, (bt, spot)) FILTER (WHERE typ <> 'token_create' AND actor IS NOT NULL) AS ka, min((bt, spot)) FILTER (WHERE typ <> 'token_create' AND actor IS NOT NULL) AS kp,
  min(bt) AS seen, min((bt, spot)) AS fp, min((bt, spot)) FILTER (WHERE typ = 'graduation') AS gp FROM raw WHERE typ IN ('token_create', 'meme', 'graduation') GROUP BY mint),
ev AS (SELECT r.*, t.gp, CASE WHEN (CASE WHEN (r.bt, r.spot) < t.fp THEN t.fp ELSE (r.bt, r.spot) END) >= t.bp THEN t.ba
    WHEN (CASE WHEN (r.bt, r.spot) < t.fp THEN t.fp ELSE (r.bt, r.spot) END) >= t.kp THEN t.ka END AS creator
  FROM raw r JOIN tk t ON t.mint = r.mint WHERE typ IN ('token_create', 'meme', 'graduation') OR (typ IN ('add', 'remove') AND r.bt >= t.seen - 600) OR (typ = 'swap' AND (r.bt, r.spot) >= t.fp)),
st AS (SELECT *, max(usd) OVER (PARTITION BY mint ORDER BY bt, slot ROWS UNBOUNDED PRECEDING) AS peak FROM ev WHERE typ IN ('add', 'remove', 'swap')),
rug0 AS (SELECT mint, creator, bt AS t_at, slot, typ, actor FROM st WHERE (bt, slot) > gp AND peak >= 10000 AND usd <= 1000 QUALIFY row_number() OVER (PARTITION BY mint ORDER BY bt, slot) = 1),
red AS (SELECT 'red:' || e.mint AS id, 'red' AS level, e.mint, e.creator, e.bt AS t_at, e.slot FROM ev e LEFT JOIN rug0 r ON r.mint = e.mint
  WHERE e.typ = 'add' AND e.actor = e.creator AND (r.mint IS NULL OR (e.bt, e.slot) < (r.t_at, r.slot)) QUALIFY row_number() OVER (PARTITION BY e.mint ORDER BY e.bt, e.slot) = 1),
rg AS (SELECT r.*, CASE WHEN r.typ <> 'swap' AND r.actor = r.creator THEN CASE WHEN d.mint IS NOT NULL THEN 'creator-pull' ELSE 'migration-pull' END
  WHEN r.typ <> 'swap' THEN 'third-party-remove' WHEN r.actor = r.creator THEN 'dev-dump' ELSE 'sell-off' END AS mechanism FROM rug0 r LEFT JOIN red d ON d.mint = r.mint),
grads AS (SELECT mint, coalesce(creator, actor) AS creator, bt AS t_at, slot FROM ev WHERE typ = 'graduation'),
prior AS (SELECT g.mint, g.creator, g.t_at, g.slot, count(*) AS n_prior FROM grads g JOIN rg r ON r.creator = g.creator AND r.mint <> g.mint AND r.t_at < g.t_at GROUP BY ALL),
amber AS (SELECT 'amber:' || p.mint AS id, 'amber' AS level, p.mint, p.creator, p.t_at, p.slot FROM prior p LEFT JOIN rg r ON r.mint = p.mint WHERE r.mint IS NULL OR (p.t_at, p.slot) < (r.t_at, r.slot)
  QUALIFY row_number() OVER (PARTITION BY p.mint ORDER BY p.t_at, p.slot) = 1),
al AS (SELECT * FROM red UNION ALL SELECT * FROM amber)"""
RECORDS_SQL = sql(ONLINE_FEED, """SELECT 'alert' AS kind, id, mint, creator, t_at, CAST(NULL AS VARCHAR) AS mechanism FROM al
UNION ALL SELECT 'rug', 'rug:' || mint, mint, creator, t_at, mechanism FROM rg""")
# Reserves of the feed are 0 to about 700 units at 100 dollars.
WORTH = PARAMS.with_(min_peak_usd=10000, max_floor_usd=1000)


def shown_records(alerts, drains):
    one = alerts.select("kind", "id", "mint", "creator", "t_at", F.lit(None).cast("string").alias("mechanism"))
    return one.unionByName(drains.select("kind", "id", "mint", "creator", "t_at", "mechanism"))


@query("E2E_batch_records", RECORDS_SQL)
def e2e(spark, sf_dir):
    """The whole way in one job, over the raw feed: alerts and drains."""
    return shown_records(*detect.detect(raw_frames(spark, sf_dir).select("value"), WORTH))


# How far frames stray from the order of time, and how long the clock waits for them.
JITTER_S = 7200
_RUNS: dict[tuple[str, str], slices.Slices] = {}


def frame_stream(spark, sf_dir, batches=2):
    """The raw feed as a stream of a few micro-batches: out of order by up to two hours, every fifth frame delivered twice, the second time in any later place of that time."""
    path = work_path(spark, "frames")
    times = token_events(spark, sf_dir).select(F.col("slot").alias("id"), "block_time_s")
    low, high = times.agg(F.min("block_time_s"), F.max("block_time_s")).first()
    frames = raw_frames(spark, sf_dir).join(times, "id")
    deliveries = F.explode(F.when(F.col("id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    sent = frames.select("value", "block_time_s", deliveries.alias("again"), "id")
    at = F.col("block_time_s") + F.pmod(F.xxhash64("id", "again"), F.lit(JITTER_S))
    stretch = F.least(F.lit(batches - 1), F.floor((at - low) * batches / (high - low + 1)))
    return feed.landed(sent.select("value", "id", stretch.alias("_stretch")), F.col("_stretch"), batches, "id", path, ["value"])


def run_slices(spark, sf_dir):
    """The detector over the streamed feed, to its end, once per session and data set: several queries read what it wrote."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        state, out = work_path(spark, "slices"), work_path(spark, "records")
        run = slices.Slices(spark, state, out, WORTH, delay_s=JITTER_S, seen_s=2 * JITTER_S, keep_facts=True)
        run.close(slices.run_feed(frame_stream(spark, sf_dir), run, f"{state}-progress"))
        _RUNS[key] = run
    return _RUNS[key]


@query("E2E_stream_records", RECORDS_SQL)
def e2e_stream(spark, sf_dir):
    """The same records from a stream of slices."""
    out = run_slices(spark, sf_dir).out_dir
    return shown_records(slices.table_of(spark, out, "alerts"), slices.table_of(spark, out, "rugs"))


@query("T7_stream_pool_readings", sql(ONLINE_FEED, "SELECT mint, slot, CASE WHEN typ = 'swap' THEN typ ELSE 'liquidity' END AS event, CAST(usd AS DOUBLE) AS usd FROM ev WHERE typ IN ('add', 'remove', 'swap')"))
def t7_stream(spark, sf_dir):
    """Readings at the price of the moment, as the stream learned it."""
    rd = slices.table_of(spark, run_slices(spark, sf_dir).out_dir, "readings")
    return rd.select("mint", F.col("pos.slot").alias("slot"), "event", F.col("usd").cast("double").alias("usd"))


@query("U4_stream_counters", sql(FEED + """, sent AS (SELECT *, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS n, type IN ('token_create', 'meme', 'graduation', 'liquidity', 'swap') AS followed FROM feed)""",
       """SELECT metric, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'received' AS metric, n FROM sent
UNION ALL SELECT reason, n FROM sent WHERE reason IS NOT NULL
UNION ALL SELECT 'not followed', n FROM sent WHERE reason IS NULL AND NOT followed
UNION ALL SELECT 'admitted', 1 FROM sent WHERE reason IS NULL AND followed
UNION ALL SELECT 'duplicate', n - 1 FROM sent WHERE reason IS NULL AND followed) GROUP BY metric"""))
def u4_stream(spark, sf_dir):
    """What became of every frame of the stream, by reason."""
    told = slices.table_of(spark, run_slices(spark, sf_dir).out_dir, "counters")
    return told.groupBy("metric").agg(F.sum("n").alias("n")).filter("n > 0")


@query("R10_full_records", sql(ONLINE_FEED, """SELECT CASE level WHEN 'red' THEN 'RED' ELSE 'AMBER' END || ' ' || strftime(make_timestamp(t_at * 1000000), '%Y-%m-%d %H:%M:%S') || ' | token ' || mint || ' | by ' || creator AS line FROM al
UNION ALL SELECT 'RUG ' || strftime(make_timestamp(t_at * 1000000), '%Y-%m-%d %H:%M:%S') || ' | token ' || mint || ' | ' || mechanism || ' by ' || actor FROM rg"""))
def r10_full(spark, sf_dir):
    """Full records through the registry and back, described: the beginning of each line."""
    out, path = run_slices(spark, sf_dir).out_dir, work_path(spark, "registry")
    registry.write_registry(registry.as_records(slices.table_of(spark, out, "alerts"), slices.table_of(spark, out, "rugs")), path)
    newest = spark.read.text(path).agg(F.max(F.get_json_object("value", "$.t_at").cast("bigint"))).first()[0] or 0
    good, _ = registry.load_registry(spark, path, 3650, newest)
    alerts, rugs = registry.full_records(good)
    beginning = lambda df: df.select(F.call_function("substring_index", "line", F.lit(" | "), F.lit(3)).alias("line"))
    return beginning(detect.describe(alerts)).union(beginning(detect.describe_drains(rugs)))
