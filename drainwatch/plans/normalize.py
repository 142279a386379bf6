"""Raw JSON frames to typed events, one declared schema per type.

Each schema is a list of (output column, JSON path, kind).  Unknown fields are dropped; a missing
or changed field rejects the frame with the paths that failed.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.functions import validate as v
from drainwatch.functions.events import derive_origin
from drainwatch.functions.exact import fits
from drainwatch.functions.redact import redact_secrets, redact_url
from drainwatch.operators.select import tally

# ---- fixed values: the feed's field names per event type -------------------------------------

ORIGIN = [("_backfill", "backfill", v.optional(v.BOOL)), ("_catchup", "catchup", v.optional(v.BOOL))]
TX = [
    ("signature", "signature", v.TEXT),
    ("slot", "slot", v.INT),
    ("block_time_s", "block_time", v.SECONDS),
    ("tx_index", "tx_index", v.INT),
    ("ix_index", "ix_index", v.INT),
    ("inner_ix_index", "inner_ix_index", v.INT),
    ("indexed_at_ms", "indexed_at", v.MILLIS),
]


def _same(kind: v.Kind, *names: str) -> list:
    return [(n, n, kind) for n in names]


def _window_fields(w: Column) -> dict[str, tuple[Column, v.Kind]]:
    kinds = {"volume_usd": v.DECIMAL, "trades": v.INT, "buys": v.INT, "sells": v.INT, "price_change_pct": v.DECIMAL}
    return {k: (v.get(w, k), kind) for k, kind in kinds.items()}


def _windows_valid(raw: Column) -> Column:
    entries = F.map_entries(F.try_variant_get(raw, "$", "map<string,variant>"))

    def good(e: Column) -> Column:
        out = e["key"].rlike(r"^\d+$")
        for field, kind in _window_fields(e["value"]).values():
            out = out & kind.valid(field)
        return out

    return F.coalesce(F.forall(entries, good), F.lit(False))


def explode_windows(raw: Column) -> Column:
    """Trade windows keyed by seconds as an array of structs in order of seconds."""
    entries = F.map_entries(F.try_variant_get(raw, "$", "map<string,variant>"))
    return F.array_sort(
        F.transform(
            entries,
            lambda e: F.struct(
                e["key"].try_cast("bigint").alias("window_s"),
                *[kind.read(field).alias(k) for k, (field, kind) in _window_fields(e["value"]).items()],
            ),
        )
    )


WINDOWS = v.Kind("trade windows", _windows_valid, explode_windows)

_MEME_META = [
    *_same(v.BLANKABLE, "name", "symbol", "uri", "creator", "logo_uri", "description"),
    ("socials", "socials", v.optional(v.TEXT_MAP)),
    ("decimals", "decimals", v.nullish(v.INT)),
    ("supply", "supply", v.nullish(v.RAW)),
]


def _meta_valid(raw: Column) -> Column:
    good = F.coalesce(v.kind_of(raw).startswith("OBJECT<"), F.lit(False))
    for _, path, kind in _MEME_META:
        good = good & kind.valid(v.get(raw, path))
    return v.is_null(raw) | good


def _no_links() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _meta_read(raw: Column) -> Column:
    fields = [
        (F.coalesce(kind.read(v.get(raw, p)), _no_links()) if n == "socials" else kind.read(v.get(raw, p))).alias(n)
        for n, p, kind in _MEME_META
    ]
    return F.when(~v.is_null(raw), F.struct(*fields))


META = v.Kind("metadata or null", _meta_valid, _meta_read)

_SPIKE = [
    ("mint", "mint", v.TEXT), ("trigger_time_s", "trigger_time", v.SECONDS),
    *_same(v.DECIMAL, "mcap_at_trigger", "price_at_trigger", "volume_window_usd", "baseline_usd", "multiple"),
    *_same(v.INT, "trades", "traders_est"), ("window_s", "window_secs", v.INT),
]

SCHEMAS: dict[str, list] = {
    "token_create": [*TX, ("kind", "kind", v.enum("token")), *_same(v.TEXT, "dex", "mint", "pool", "base_mint", "quote_mint", "name", "symbol"),
                     ("uri", "uri", v.BLANKABLE), ("creator", "creator", v.TEXT)],
    "pool_create": [*TX, ("kind", "kind", v.enum("pool")), *_same(v.TEXT, "dex", "mint", "pool", "base_mint", "quote_mint", "creator")],
    "graduation": [*_same(v.TEXT, "mint", "launchpad", "creator"), ("reported_created_time_s", "created_time", v.SECONDS),
                   *_same(v.TEXT, "pool", "dex"), ("slot", "slot", v.INT), ("block_time_s", "block_time", v.SECONDS)],
    "liquidity": [*TX, *_same(v.TEXT, "dex", "pool"), ("kind", "kind", v.enum("add", "remove")), *_same(v.TEXT, "provider", "base_mint", "quote_mint"),
                  *_same(v.RAW, "base_amount", "quote_amount"), *_same(v.INT, "base_decimals", "quote_decimals"),
                  *_same(v.RAW, "base_reserve", "quote_reserve"), *_same(v.DECIMAL, "base_usd", "quote_usd")],
    "swap": [*TX, *_same(v.TEXT, "dex", "pool", "mint", "quote_mint", "trader"), ("side", "side", v.enum("buy", "sell")),
             *_same(v.RAW, "base_amount", "quote_amount"), *_same(v.INT, "base_decimals", "quote_decimals"),
             *_same(v.RAW, "base_reserve", "quote_reserve", "fee_amount"), ("fee_mint", "fee_mint", v.TEXT), ("fee_pct", "fee_pct", v.DECIMAL),
             ("fee_paid_out", "fee_paid_out", v.RAW), *_same(v.DECIMAL, "price_impact_pct", "price", "price_usd", "volume_usd"),
             ("mcap_usd", "mcap_usd", v.optional(v.DECIMAL)), ("candle_ok", "candle_ok", v.BOOL), *_same(v.RAW, "virtual_base_reserve", "virtual_quote_reserve")],
    "transfer": [*TX, ("kind", "kind", v.enum("transfer", "mint", "burn")), ("mint", "mint", v.TEXT),
                 *_same(v.optional(v.TEXT), "src_owner", "dst_owner"), ("amount", "amount", v.RAW), ("decimals", "decimals", v.optional(v.INT))],
    "candle": [*_same(v.TEXT, "mint", "pool", "interval"), ("open_time_s", "time", v.SECONDS), *_same(v.DECIMAL, "open", "high", "low", "close", "volume"),
               ("trades", "trades", v.INT), ("closed", "closed", v.BOOL)],
    "stats": [("mint", "mint", v.TEXT), ("price_usd", "price_usd", v.DECIMAL), ("block_time_s", "block_time", v.SECONDS), ("windows", "windows", WINDOWS)],
    "meme": [*_same(v.TEXT, "mint", "launchpad"), ("metadata", "metadata", META), ("creator", "creator", v.optional(v.TEXT)),
             ("reported_created_time_s", "created_time", v.optional(v.SECONDS)), ("graduated", "graduated", v.BOOL),
             *_same(v.DECIMAL, "progress_pct", "price_usd"), *_same(v.RAW, "base_reserve", "quote_reserve"),
             ("block_time_s", "block_time", v.SECONDS), ("windows", "windows", WINDOWS)],
    "surge": _SPIKE,
    "radar": _SPIKE,
    "metadata": [("mint", "mint", v.TEXT), *_same(v.BLANKABLE, "name", "symbol"), ("decimals", "decimals", v.INT),
                 *_same(v.BLANKABLE, "uri", "image_url", "logo_uri", "description"), ("socials", "socials", v.optional(v.TEXT_MAP)),
                 ("resolved_at_ms", "resolved_at", v.MILLIS_OR_NONE)],
    "connected": [("region", "region", v.TEXT), ("subscribed_types", "filter.types", v.TEXTS)],
    "backfill_end": [("events", "events", v.INT)],
    "launches": [], "graduating": [], "graduated": [], "trending": [],
}
STREAM_TYPES = tuple(SCHEMAS)
SNAPSHOT_TYPES = ("launches", "graduating", "graduated", "trending")
CONTROL_TYPES = ("connected", "backfill_end")
TX_TYPES = ("token_create", "pool_create", "liquidity", "swap", "transfer")
SPIKE_TYPES = ("surge", "radar")

# ---- frames to typed rows ---------------------------------------------------------------------


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer copies a column's expression into every filter and projection that uses it,
    which for a parsed frame means parsing again for every field.  A generator is not copied.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_frames(frames: DataFrame, text: str = "value") -> DataFrame:
    """Add ``v``, the parsed frame, losing no digit.  Anything that is not one JSON value gives null.

    Parsing inside a list, in front of a zero, makes text after the first value an error, as it must be:
    a value that closes the list itself loses the zero.
    """
    listed = once(frames, _listed=F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(",0]"))))
    alone = (F.try_variant_get("_listed", "$[1]", "int") == 0) & F.try_variant_get("_listed", "$[2]", "variant").isNull()
    return once(listed, v=F.when(alone, F.try_variant_get("_listed", "$[0]", "variant"))).drop("_listed")


def route_by_type(parsed: DataFrame) -> DataFrame:
    """Add ``type`` and ``reason`` (null while the frame may still be good)."""
    raw = v.get(F.col("v"), "type")
    named = once(parsed, type=F.when(v.is_text(raw), v.get(F.col("v"), "type", "string")))
    reason = (
        F.when(F.col("v").isNull(), "invalid_json")
        .when(~v.kind_of(F.col("v")).startswith("OBJECT<"), "not_an_object")
        .when(~F.coalesce(F.col("type").isin(*STREAM_TYPES), F.lit(False)), "unknown_type")
    )
    return once(named, reason=reason)


def _fields(kind: str) -> list:
    return [*ORIGIN, *SCHEMAS[kind]]


def _built_once(build):
    """Expressions over a frame are the same for every table: building the field rules of all types takes seconds, so each is built once per JVM."""
    known = {}

    def once_built(kind: str):
        key = (id(SparkContext._gateway), kind)
        if key not in known:
            known[key] = build(kind)
        return known[key]

    return once_built


@_built_once
def frame_issues(kind: str) -> Column:
    return v.collect_issues([(f"{path}: expected {k.expected}", k.valid(v.get(F.col("v"), path))) for _, path, k in _fields(kind)])


def validated(routed: DataFrame) -> DataFrame:
    """Every frame with the issues of its own type's schema; ``invalid_shape`` where there are any."""
    issues = F.lit(None).cast("array<string>")
    for kind in STREAM_TYPES:
        issues = F.when(F.col("type") == kind, frame_issues(kind)).otherwise(issues)
    out = once(routed, issues=F.when(F.col("reason").isNull(), issues))
    return out.withColumn("reason", F.when(F.size("issues") > 0, "invalid_shape").otherwise(F.col("reason")))


def frames_to_routed(frames: DataFrame, text: str = "value") -> DataFrame:
    return route_by_type(parse_frames(frames, text))


@_built_once
def _typed(kind: str) -> list[Column]:
    cols = [k.read(v.get(F.col("v"), path)).alias(name) for name, path, k in SCHEMAS[kind]]
    if kind == "metadata":
        swap = {"image_url": lambda c: redact_url(c), "socials": lambda c: F.coalesce(c, _no_links())}
        cols = [swap[name](k.read(v.get(F.col("v"), path))).alias(name) if name in swap else k.read(v.get(F.col("v"), path)).alias(name)
                for name, path, k in SCHEMAS[kind]]
    origin = derive_origin(v.get(F.col("v"), "catchup", "boolean"), v.get(F.col("v"), "backfill", "boolean"))
    return [origin.alias("origin"), *cols, _inexact(kind)]


def _inexact(kind: str) -> Column:
    """name=text of every number that its column cannot hold to the last digit, so that none is lost (``functions.exact.told`` reads them)."""
    lost = lambda name, raw: F.when(v.is_text(raw) & ~fits(v.text_of(raw)), F.concat(name, F.lit("="), v.text_of(raw)))
    found = F.array(*[lost(F.lit(name), v.get(F.col("v"), path)) for name, path, k in SCHEMAS[kind] if k.expected == v.DECIMAL.expected]).cast("array<string>")
    for name, path in [(name, path) for name, path, k in SCHEMAS[kind] if k.expected == WINDOWS.expected]:
        decimals = lambda e: [(f, raw) for f, (raw, fk) in _window_fields(e["value"]).items() if fk is v.DECIMAL]
        of_window = lambda e: F.array(*[lost(F.concat(F.lit(f"{name}."), e["key"], F.lit(f".{f}")), raw) for f, raw in decimals(e)])  # noqa: B023, E731
        each = F.transform(F.map_entries(v.get(F.col("v"), path, "map<string,variant>")), of_window)
        found = F.concat(found, F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    return F.filter(found, lambda x: x.isNotNull()).alias("inexact")


def normalize(routed: DataFrame, kind: str, carry: list[str] | None = None, checked: bool = False) -> DataFrame:
    """The good frames of one type as typed rows: type, origin, the schema's columns.  ``checked``: the frames went through ``validated`` already."""
    rows = routed.filter(F.col("reason").isNull() & (F.col("type") == kind))
    good = rows if checked else rows.filter(F.size(frame_issues(kind)) == 0)
    return good.select(*(carry or []), "type", *_typed(kind))


def quarantine_snapshots(routed: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The four unverified types: only type and origin are trusted, the payload stays as it came."""
    rows = routed.filter(F.col("reason").isNull() & F.col("type").isin(*SNAPSHOT_TYPES))
    good = rows.filter(F.size(frame_issues(SNAPSHOT_TYPES[0])) == 0)
    origin = derive_origin(v.get(F.col("v"), "catchup", "boolean"), v.get(F.col("v"), "backfill", "boolean"))
    return good.select(*(carry or []), "type", origin.alias("origin"), F.lit(False).alias("verified"), F.col("v").alias("payload"))


def rejected(frames: DataFrame, text: str = "value") -> DataFrame:
    """Bad frames with their kind, issues and a redacted 200-character sample."""
    return rejections(validated(frames_to_routed(frames, text)), text)


def rejections(checked: DataFrame, text: str = "value") -> DataFrame:
    """The bad ones among validated frames."""
    bad = checked.filter(F.col("reason").isNotNull())
    kind = F.concat_ws(" ", "reason", F.when(F.col("reason").isin("unknown_type", "invalid_shape"), F.col("type")))
    entry = F.concat(kind, F.lit(": "), F.array_join(F.slice(F.coalesce("issues", F.array().cast("array<string>")), 1, 3), "; "),
                     F.lit(" | "), F.substring(text, 1, 200))
    return bad.withColumn("kind", kind).withColumn("entry", redact_secrets(entry))


def quarantine(frames: DataFrame, order: str, recent: int = 10, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(counts per kind, the newest rejections)."""
    bad = rejected(frames, text)
    return tally(bad, "kind", "kind"), bad.orderBy(F.desc(order)).limit(recent).select(order, "kind", "entry")
