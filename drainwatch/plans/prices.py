"""USD prices of quote assets learned from the feed, and the readings they value.

Decimals are narrowed before they meet: a product or quotient of two wide decimals would silently
lose its fraction.  Whoever makes a token chooses its decimals, so nothing here may fail: what does
not fit the exact types is computed in doubles, and what fits no type at all is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.functions.events import POSITION, time_position, tx_position
from drainwatch.params import WRAPPED_SOL
from drainwatch.plans.joins import price_asof, resolve_pair, swaps_of_known
from drainwatch.plans.tokens import token_dim

UNITS, PRICE, USD = "decimal(29,9)", "decimal(30,18)", "decimal(28,6)"
NATIVE_DECIMALS = 9


def to_units(raw: Column, decimals: Column) -> Column:
    """Exact units of an asset of up to nine decimals (the kept fraction), null for others."""
    scale = F.when(decimals.between(0, NATIVE_DECIMALS), F.pow(F.lit(10.0), decimals)).try_cast("decimal(19,0)")
    return F.try_divide(raw.try_cast("decimal(20,0)"), scale).try_cast(UNITS)


def rough_units(raw: Column, decimals: Column) -> Column:
    """Units as a double, for any number of decimals a byte can hold."""
    return F.try_divide(raw.try_cast("double"), F.when(decimals.between(0, 255), F.pow(F.lit(10.0), decimals)))


def usd_per_unit(usd: Column, raw: Column, decimals: Column) -> Column:
    """Null for no amount or no value: the feed sends "0" where it knows no price."""
    units = to_units(raw, decimals)
    exact = F.when(units > 0, F.try_divide(usd.try_cast("decimal(20,10)"), units).try_cast(PRICE))
    rough = F.try_divide(usd.try_cast("double"), rough_units(raw, decimals)).try_cast(PRICE)
    price = F.coalesce(exact, rough)
    return F.when((raw > 0) & (usd > 0) & (price > 0), price)


def value_usd(raw: Column, decimals: Column, price: Column) -> Column:
    exact = F.try_multiply(to_units(raw, decimals), price.try_cast(PRICE)).try_cast(USD)
    return F.coalesce(exact, F.try_multiply(rough_units(raw, decimals), price.try_cast("double")).try_cast(USD))


def price_outcomes(rows: DataFrame, usd: str, raw: str, decimals: str) -> DataFrame:
    """How many amounts got an exact price, a rounded one, none because the feed knows none, or none because no type holds it."""
    worth = (F.col(raw) > 0) & (F.col(usd) > 0)
    exact = F.try_divide(F.col(usd).try_cast("decimal(20,10)"), to_units(F.col(raw), F.col(decimals))).try_cast(PRICE)
    outcome = (
        F.when(~F.coalesce(worth, F.lit(False)), "unknown")
        .when((to_units(F.col(raw), F.col(decimals)) > 0) & (exact > 0), "exact")
        .when(usd_per_unit(F.col(usd), F.col(raw), F.col(decimals)).isNotNull(), "rounded")
        .otherwise("does not fit")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def identity_events(norm: dict[str, DataFrame]) -> DataFrame:
    """Launches, curve snapshots and graduations in the shape token_dim reads."""
    create = norm["token_create"].select(
        "type", "mint", "pool", "dex", F.col("creator").alias("actor"), "block_time_s", tx_position().alias("pos"), F.col("dex").alias("launchpad"),
        "name", "symbol", F.when(F.col("mint") == F.col("base_mint"), F.col("quote_mint")).otherwise(F.col("base_mint")).alias("quote_mint"),
    )
    meme = norm["meme"].select(
        "type", "mint", F.coalesce("creator", "metadata.creator").alias("actor"), "block_time_s", time_position().alias("pos"), "launchpad",
        F.col("metadata.name").alias("name"), F.col("metadata.symbol").alias("symbol"),
    )
    grad = norm["graduation"]
    low = F.lit(-1).cast("bigint")
    grad_pos = F.struct("block_time_s", "slot", *[low.alias(p) for p in POSITION[2:]])
    grads = grad.select("type", "mint", "pool", "dex", F.col("creator").alias("actor"), "block_time_s", grad_pos.alias("pos"), "launchpad")
    return create.unionByName(meme, allowMissingColumns=True).unionByName(grads, allowMissingColumns=True)


def token_table(norm: dict[str, DataFrame]) -> DataFrame:
    return token_dim(identity_events(norm), online=True)


def pair_rows(liquidity: DataFrame, tok: DataFrame) -> DataFrame:
    """Liquidity events resolved to the token they are about (null mint: none we follow)."""
    ev = liquidity.withColumn("pos", tx_position()).withColumn("event", F.lit("liquidity"))
    return resolve_pair(ev, tok)


def swap_rows(swap: DataFrame, tok: DataFrame) -> DataFrame:
    """Swaps resolved likewise; both legs are worth the swap's volume."""
    ev = (
        swap.withColumn("pos", tx_position()).withColumn("event", F.lit("swap")).withColumnRenamed("mint", "base_mint")
        .withColumn("base_usd", F.col("volume_usd")).withColumn("quote_usd", F.col("volume_usd"))
    )
    return swaps_of_known(resolve_pair(ev, tok).filter("mint is not null"), tok)


def _observation(mint: str, usd: str, raw: str, decimals: str) -> list[Column]:
    return [F.col(mint).alias("quote_mint"), "pos", usd_per_unit(F.col(usd), F.col(raw), F.col(decimals)).alias("usd_per_unit")]


def learn_quote_prices(liquidity: DataFrame, pairs: DataFrame, swaps: DataFrame) -> DataFrame:
    """quote_mint, pos, usd_per_unit.

    Every liquidity event teaches its quote side, and its base side where our token is the quote;
    a swap of a followed token teaches the side it was paid in.
    """
    quote_side = liquidity.withColumn("pos", tx_position()).select(*_observation("quote_mint", "quote_usd", "quote_amount", "quote_decimals"))
    turned = pairs.filter(F.col("mint").isNotNull() & ~F.col("is_base"))
    base_side = turned.select(*_observation("quote_mint", "quote_usd", "quote_amount", "quote_decimals"))
    paid = swaps.select(*_observation("quote_mint", "quote_usd", "quote_amount", "quote_decimals"))
    seen = [quote_side.withColumn("seq", F.lit(0)), base_side.withColumn("seq", F.lit(1)), paid.withColumn("seq", F.lit(2))]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).filter("usd_per_unit is not null")


def pool_readings(pairs: DataFrame, swaps: DataFrame, px: DataFrame) -> DataFrame:
    """The quote-side reserve after each liquidity or swap event, in USD at the price of the moment."""
    cols = ["mint", "quote_mint", "quote_reserve", "quote_decimals", "pool", "dex", "pos", "event", "block_time_s", "signature"]
    lp = pairs.filter("mint is not null").select(*cols, "kind", F.col("provider").alias("actor"))
    sw = swaps.select(*cols, F.lit(None).cast("string").alias("kind"), F.col("trader").alias("actor"))
    priced = price_asof(lp.unionByName(sw), px)
    usd = value_usd(F.col("quote_reserve"), F.col("quote_decimals"), F.col("usd_per_unit"))
    return priced.select(
        "mint", F.lit("pool").alias("source"), "pool", "dex", F.col("block_time_s").alias("at_s"), "pos", usd.alias("usd"),
        F.lit(None).cast("bigint").alias("holders"), "event", "kind", "actor",
    )


def curve_readings(meme: DataFrame, tok: DataFrame, px: DataFrame) -> DataFrame:
    """USD held by the bonding curve at each snapshot (in the token's quote asset, usually the native coin).

    A snapshot without a price stays, with no value.
    """
    rows = meme.withColumn("pos", time_position()).join(tok.select("mint", "quote_mint"), "mint")
    rows = rows.select("mint", F.coalesce("quote_mint", F.lit(WRAPPED_SOL)).alias("quote_mint"), "quote_reserve", "progress_pct", "pos", "block_time_s")
    priced = price_asof(rows, px)
    usd = value_usd(F.col("quote_reserve"), F.lit(NATIVE_DECIMALS), F.col("usd_per_unit"))
    return priced.select(
        "mint", F.lit("curve").alias("source"), F.lit(None).cast("string").alias("pool"), F.lit(None).cast("string").alias("dex"),
        F.col("block_time_s").alias("at_s"), "pos", usd.alias("usd"), F.lit(None).cast("bigint").alias("holders"),
    )


def rest_readings(hist_tokens: DataFrame) -> DataFrame:
    """Snapshot liquidity as readings; being asked about is no activity of the token."""
    rows = hist_tokens.withColumn("block_time_s", F.col("fetched_s")).withColumn("pos", time_position())
    return rows.select(
        "mint", F.lit("rest").alias("source"), F.lit(None).cast("string").alias("pool"), F.lit(None).cast("string").alias("dex"),
        F.col("fetched_s").alias("at_s"), "pos", F.col("liquidity_usd").cast(USD).alias("usd"), "holders",
    )
