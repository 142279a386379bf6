"""Raw JSON frames of all eighteen types, derived by Spark from the driver's ``events``.

Field values are written once, in SQL both engines read (columns: id, bt, u, k, val), so a check can
compute from the table itself what parsing the frames must give back.  A few frames are damaged
by rule: text after the end, wrapped in a list, renamed type, changed JSON kind, changed unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drainwatch.catalog.adapter import table
from drainwatch.params import WRAPPED_SOL
from drainwatch.plans.normalize import STREAM_TYPES, frames_to_routed
from drainwatch.session import work_path
from drainwatch.sources.tables import read_routed, write_routed

SOL = f"'{WRAPPED_SOL}'"
MINT = "'T' || k"
BIG = "CAST(9007199254740993 + id * 1000 AS DECIMAL(38,0))"
DEC = "CAST(val AS STRING)"

_ORIGIN = {"backfill": "CASE WHEN id % 4 = 0 THEN true END", "catchup": "CASE WHEN id % 8 = 0 THEN true END"}
_TX = {
    "signature": "'sig' || id", "slot": "id", "block_time": "bt", "tx_index": "u", "ix_index": "id % 5", "inner_ix_index": "id % 3 - 1",
    "indexed_at": "bt * 1000 + 250",
}
_WINDOWS = """map('3600', named_struct('volume_usd', CAST(val AS STRING), 'trades', k + 5, 'buys', k, 'sells', 5L, 'price_change_pct', '0.5'),
  '300', named_struct('volume_usd', '1.25', 'trades', k, 'buys', k, 'sells', 0L, 'price_change_pct', '-0.5'))"""
_SPIKE = {
    "mint": MINT, "trigger_time": "bt", "mcap_at_trigger": DEC, "price_at_trigger": "'0.5'", "volume_window_usd": DEC, "baseline_usd": "'2.5'",
    "multiple": "'1.5'", "trades": "k", "traders_est": "u", "window_secs": "300 + id % 2",
}
RAW: dict[str, dict[str, str]] = {
    "token_create": {**_TX, "kind": "'token'", "dex": "'pumpfun'", "mint": MINT, "pool": "'T' || k || '-c'", "base_mint": MINT, "quote_mint": SOL,
                     "name": "'Coin \"' || k || '\"'", "symbol": "'S' || k", "uri": "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://x/' || id END", "creator": "'C' || u"},
    "pool_create": {**_TX, "kind": "'pool'", "dex": "'pumpswap'", "mint": MINT, "pool": "'T' || k || '-a'",
                    "base_mint": f"CASE WHEN id % 2 = 0 THEN {SOL} ELSE {MINT} END", "quote_mint": f"CASE WHEN id % 2 = 0 THEN {MINT} ELSE {SOL} END", "creator": "'C' || u"},
    "graduation": {"mint": MINT, "launchpad": "'pumpfun'", "creator": "'C' || u", "created_time": "bt + 763000", "pool": "'T' || k || '-a'",
                   "dex": "'pumpswap'", "slot": "id", "block_time": "bt"},
    "liquidity": {**_TX, "dex": "'pumpswap'", "pool": "'T' || k || '-a'", "kind": "CASE WHEN id % 3 = 0 THEN 'remove' ELSE 'add' END", "provider": "'C' || u",
                  "base_mint": MINT, "quote_mint": SOL, "base_amount": BIG, "quote_amount": "(u % 50 + 1) * 1000000000", "base_decimals": "6", "quote_decimals": "9",
                  "base_reserve": BIG, "quote_reserve": "CAST(val * 1000000000 AS BIGINT)", "base_usd": "'0'", "quote_usd": "CAST((u % 50 + 1) * (100 + k % 3) AS STRING)"},
    "swap": {**_TX, "dex": "'pumpswap'", "pool": "'T' || k || '-a'", "mint": MINT, "quote_mint": SOL, "trader": "'C' || u", "side": "CASE WHEN id % 2 = 0 THEN 'buy' ELSE 'sell' END",
             "base_amount": BIG, "quote_amount": "(u % 20 + 1) * 1000000000", "base_decimals": "6", "quote_decimals": "9", "base_reserve": BIG,
             "quote_reserve": "CAST(val * 1000000000 AS BIGINT)", "fee_amount": "k", "fee_mint": SOL, "fee_pct": "'0.1'", "fee_paid_out": "k",
             "price_impact_pct": "'0.25'", "price": "'1e-3'", "price_usd": DEC, "volume_usd": "CAST((u % 20 + 1) * (100 + k % 3) AS STRING)",
             "mcap_usd": "CASE WHEN id % 3 <> 0 THEN CAST(val AS STRING) END", "candle_ok": "id % 2 = 0", "virtual_base_reserve": "0", "virtual_quote_reserve": "0"},
    "transfer": {**_TX, "kind": "CASE id % 3 WHEN 0 THEN 'transfer' WHEN 1 THEN 'mint' ELSE 'burn' END", "mint": MINT,
                 "src_owner": "CASE WHEN id % 3 <> 1 THEN 'C' || u END", "dst_owner": "CASE WHEN id % 3 <> 2 THEN 'D' || u END", "amount": BIG, "decimals": "CASE WHEN id % 5 <> 0 THEN 6 END"},
    "candle": {"mint": MINT, "pool": "'T' || k || '-a'", "interval": "'1m'", "time": "bt", "open": DEC, "high": DEC, "low": "'0.01'", "close": DEC, "volume": "'12.5'",
               "trades": "k", "closed": "id % 2 = 1"},
    "stats": {"mint": MINT, "price_usd": DEC, "block_time": "bt", "windows": _WINDOWS},
    "meme": {"mint": MINT, "launchpad": "'pumpfun'",
             "metadata": "CASE WHEN id % 2 = 0 THEN named_struct('name', 'Coin ' || k, 'symbol', '', 'creator', 'C' || u, 'socials', map('x', 'https://x/' || k), 'decimals', 6L, 'supply', CAST(9007199254740993 + id * 1000 AS DECIMAL(38,0))) END",
             "creator": "CASE WHEN id % 3 = 0 THEN 'C' || u END", "created_time": "CASE WHEN id % 5 <> 0 THEN bt - 60 END", "graduated": "id % 7 = 0", "progress_pct": DEC,
             "price_usd": DEC, "base_reserve": BIG, "quote_reserve": "CAST(val * 1000000000 AS BIGINT)", "block_time": "bt", "windows": _WINDOWS},
    "surge": _SPIKE,
    "radar": _SPIKE,
    "metadata": {"mint": MINT, "name": "'Coin ' || k", "symbol": "''", "decimals": "6", "image_url": "'https://h.example/i/' || k || '?api_key=abc' || u || '&z=1'", "logo_uri": "CAST(NULL AS STRING)",
                 "resolved_at": "CASE WHEN id % 5 = 0 THEN 9223372036854775807 ELSE bt * 1000 END"},
    "connected": {"region": "'nyc'", "filter": "named_struct('types', array('swap', 'meme'), 'mints', 0)"},
    "backfill_end": {"events": "k"},
    "launches": {"items": "k"}, "graduating": {"items": "k"}, "graduated": {"items": "k"}, "trending": {"items": "k"},
}
HAS_SLOT = ("token_create", "pool_create", "liquidity", "swap", "transfer", "graduation")
HAS_BLOCK_TIME = (*HAS_SLOT, "stats", "meme")
HAS_PRICE = ("swap", "stats", "meme")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "unix_timestamp(CAST(ts AS timestamp)) AS bt", "user_id AS u",
        r"CAST(regexp_extract(props, '(\\d+)', 1) AS bigint) AS k", "CAST(value AS decimal(18,2)) AS val",
    )


_WRITTEN: dict[tuple[str, str], str] = {}


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value, id: the raw feed as a table, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = work_path(spark, "feed")
        build_frames(spark, sf_dir).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def routed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good frames, parsed and filed by type, written once per session and data set."""
    key = (spark.sparkContext.applicationId, sf_dir + "#routed")
    if key not in _WRITTEN:
        path = work_path(spark, "routed")
        write_routed(frames_to_routed(raw_frames(spark, sf_dir)), path)
        _WRITTEN[key] = path
    return read_routed(spark, _WRITTEN[key])


def build_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event; the type follows from the event number."""
    # The driver's table is one small file; a feed lands as many, and its frames are built as many at a time.
    rows = base(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "id")
    text = F.lit(None).cast("string")
    for i, kind in enumerate(STREAM_TYPES):
        fields = {"type": f"'{kind}'", **RAW[kind], **_ORIGIN}
        # Missing values are left out of the frame, as the feed does; metadata is the one that may be null.
        body = F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()]))
        if kind == "meme":
            open_end = body.substr(F.lit(1), F.length(body) - 1)
            body = F.when(F.col("id") % 2 == 1, F.concat(open_end, F.lit(',"metadata":null}'))).otherwise(body)
        text = F.when(F.col("id") % len(STREAM_TYPES) == i, body).otherwise(text)
    rows = rows.withColumn("value", text)
    # The first rule that applies damages the frame.
    damaged = (
        F.when(F.expr("id % 31 = 1"), F.expr("substring(value, 1, length(value) - 5)"))
        .when(F.expr("id % 37 = 2"), F.concat(F.lit("["), F.col("value"), F.lit("]")))
        .when(F.expr("id % 41 = 3"), F.regexp_replace("value", r'"type":"\w+"', '"type":"rug"'))
        .when(F.expr("id % 29 = 0"), F.regexp_replace("value", r'"slot":(\d+)', '"slot":"$1"'))
        .when(F.expr("id % 43 = 4"), F.regexp_replace("value", r'"price_usd":"([^"]+)"', '"price_usd":$1'))
        .when(F.expr("id % 47 = 5"), F.regexp_replace("value", r'"block_time":(\d+)', '"block_time":$1000'))
        .otherwise(F.col("value"))
    )
    return rows.select("id", damaged.alias("value"))


def _among(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


FEED = f"""base AS (SELECT event_id AS id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS bt, user_id AS u, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k,
  CAST(value AS DECIMAL(18,2)) AS val, list_extract([{_among(STREAM_TYPES)}], event_id % {len(STREAM_TYPES)} + 1) AS type FROM events),
feed AS (SELECT *, CASE WHEN id % 31 = 1 THEN 'invalid_json' WHEN id % 37 = 2 THEN 'not_an_object' WHEN id % 41 = 3 THEN 'unknown_type'
  WHEN id % 29 = 0 THEN CASE WHEN type IN ({_among(HAS_SLOT)}) THEN 'invalid_shape' END
  WHEN id % 43 = 4 THEN CASE WHEN type IN ({_among(HAS_PRICE)}) THEN 'invalid_shape' END
  WHEN id % 47 = 5 THEN CASE WHEN type IN ({_among(HAS_BLOCK_TIME)}) THEN 'invalid_shape' END END AS reason,
  CASE WHEN id % 8 = 0 THEN 'catchup' WHEN id % 4 = 0 THEN 'backfill' ELSE 'realtime' END AS origin FROM base)"""
