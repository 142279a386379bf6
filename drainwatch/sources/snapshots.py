"""Creator-history and token-security snapshots kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.functions import validate as v
from drainwatch.plans.normalize import once, parse_frames

_NULLABLE_DECIMAL = v.Kind("a decimal text or null", lambda r: v.is_null(r) | v.validate_decimal(r), v.to_decimal)
_NULLABLE_TEXT = v.Kind("a text or null", lambda r: v.is_null(r) | v.is_text(r), v.TEXT.read)
_NULLABLE_BOOL = v.Kind("true, false or null", lambda r: v.is_null(r) | v.validate_bool(r), v.BOOL.read)

# The snapshots' field names.
HISTORY = [
    ("mint", "mint", v.TEXT), ("creator", "creator", v.TEXT), ("launchpad", "launchpad", v.TEXT), ("created_s", "created_time", v.SECONDS),
    ("tokens_launched", "tokens_launched", v.INT), ("migrated", "migrated", v.INT), ("first_launch_s", "first_launch", v.SECONDS),
    ("last_launch_s", "last_launch", v.SECONDS), ("scanned", "scanned", v.INT), ("truncated", "truncated", v.BOOL),
]
TOKEN = [
    ("mint", "mint", v.TEXT), ("name", "name", v.TEXT), ("symbol", "symbol", v.TEXT), ("dex", "dex", v.TEXT), ("created_s", "created_time", v.SECONDS),
    ("graduated", "graduated", v.BOOL), ("graduated_s", "graduated_time", v.SECONDS_OR_ZERO), ("ath_usd", "ath_usd", _NULLABLE_DECIMAL),
    ("ath_mcap_usd", "ath_mcap_usd", _NULLABLE_DECIMAL), ("price_usd", "price_usd", v.DECIMAL), ("liquidity_usd", "liquidity_usd", v.DECIMAL),
    ("holders", "holders", v.INT), ("total_fees_usd", "total_fees_usd", v.DECIMAL), ("volume_1h_usd", "volume_1h_usd", v.DECIMAL),
    ("bundlers_count", "bundlers_count", v.INT), ("is_current", "is_current", v.BOOL),
]
SECURITY = [
    ("mint", "mint", v.TEXT), ("mint_authority", "mint_authority", _NULLABLE_TEXT), ("freeze_authority", "freeze_authority", _NULLABLE_TEXT),
    ("token2022", "token2022", v.BOOL), ("metadata_mutable", "metadata_mutable", _NULLABLE_BOOL), ("extensions", "extensions", v.TEXTS),
    ("transfer_fee_pct", "transfer_fee_pct", _NULLABLE_DECIMAL), ("non_transferable", "non_transferable", v.BOOL), ("total_tax_pct", "total_tax_pct", v.DECIMAL),
    ("tax_transfer_fee_pct", "tax_breakdown.transfer_fee_pct", v.DECIMAL), ("tax_swap_fee_pct", "tax_breakdown.swap_fee_pct", v.DECIMAL),
    ("tax_tip_pct", "tax_breakdown.tip_pct", v.DECIMAL), ("creator", "creator", v.TEXT), ("creator_pct", "creator_pct", v.DECIMAL), ("top10_pct", "top10_pct", v.DECIMAL),
]


def _checks(fields: list, of: Column) -> list[tuple[str, Column]]:
    return [(f"{path}: expected {k.expected}", k.valid(v.get(of, path))) for _, path, k in fields]


def _read(fields: list, of: Column) -> list[Column]:
    return [k.read(v.get(of, path)).alias(name) for name, path, k in fields]


def load_token_security(lines: DataFrame, fetched_s: str = "fetched_s") -> tuple[DataFrame, DataFrame]:
    """(snapshots, rejected lines with their issues)."""
    rows = once(parse_frames(lines), issues=v.collect_issues(_checks(SECURITY, F.col("v"))))
    return rows.filter(F.size("issues") == 0).select(*_read(SECURITY, F.col("v")), fetched_s), rows.filter(F.size("issues") > 0).select("value", "issues")


def load_creator_history(lines: DataFrame, fetched_s: str = "fetched_s") -> tuple[DataFrame, DataFrame]:
    """(one row per snapshot with its ``tokens`` array, rejected lines with their issues)."""
    tokens = F.try_variant_get("v", "$.tokens", "array<variant>")

    def token_ok(t: Column) -> Column:
        out = F.lit(True)
        for _, ok in _checks(TOKEN, t):
            out = out & ok
        return out

    listed = F.coalesce(F.forall(tokens, token_ok), F.lit(False))
    checks = [*_checks(HISTORY, F.col("v")), ("tokens: expected a list of tokens", listed)]
    rows = once(parse_frames(lines), issues=v.collect_issues(checks))
    good = rows.filter(F.size("issues") == 0).select(
        *_read(HISTORY, F.col("v")), F.transform(tokens, lambda t: F.struct(*_read(TOKEN, t))).alias("tokens"), fetched_s
    )
    return good, rows.filter(F.size("issues") > 0).select("value", "issues")


def history_tokens(hist: DataFrame) -> DataFrame:
    """One row per listed token, the shape the state merges."""
    t = hist.select("creator", F.col("fetched_s"), F.explode("tokens").alias("t"))
    return t.select("creator", "fetched_s", "t.*")


def identity_dim(hist: DataFrame) -> DataFrame:
    """mint -> identity.  A queried token's own row (with its launchpad) wins over a mere mention."""
    listed = hist.select("creator", F.lit(None).cast("string").alias("launchpad"), "fetched_s", F.explode("tokens").alias("t"))
    mention = listed.select("t.mint", "creator", F.col("t.created_s").alias("created_s"), "launchpad", F.col("t.name").alias("name"),
                            F.col("t.symbol").alias("symbol"), "fetched_s", F.lit(1).alias("_rank"))
    # A snapshot may not list the token it was asked for.
    self_row = F.get(F.filter("tokens", lambda t: t["mint"] == F.col("mint")), F.lit(0))
    own = hist.select("mint", "creator", "created_s", "launchpad", self_row["name"].alias("name"), self_row["symbol"].alias("symbol"),
                      "fetched_s", F.lit(0).alias("_rank"))
    both = own.unionByName(mention)
    fields = ["creator", "created_s", "launchpad", "name", "symbol"]
    return both.groupBy("mint").agg(F.min_by(F.struct(*fields), F.struct("_rank", "fetched_s")).alias("r")).select("mint", "r.*")
