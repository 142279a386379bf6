"""Per-token features of a capture.  Lists become child tables instead of arrays in a row.

Inputs
    ev    events with type, kind, mint, actor, pool, dex, block_time_s, pos (and name on launches)
    legs  liquidity and swap rows resolved to their token: mint, is_base, native (quote is the
          wrapped coin), event, kind, sell, actor, pool, dex, at_s, pos, moved, reserve, usd, price
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drainwatch.operators.running import Running, running
from drainwatch.operators.select import first_crossing
from drainwatch.params import DEFAULTS, Params
from drainwatch.plans.creators import token_activity, token_lifetimes
from drainwatch.plans.rules import first_after, state_by_bucket, tradable_state
from drainwatch.session import settle


def token_features(ev: DataFrame) -> DataFrame:
    born, grad = F.col("type") == "token_create", F.col("type") == "graduation"
    at_birth, at_grad = F.when(born, F.col("pos")), F.when(grad, F.col("pos"))
    name = F.lower(F.trim("name")) if "name" in ev.columns else F.lit(None).cast("string")
    rows = ev.filter(born | grad).withColumn("_name", name)
    return rows.groupBy("mint").agg(
        F.coalesce(F.min_by("actor", at_birth), F.min_by("actor", at_grad)).alias("creator"),
        F.min(F.when(born, F.col("block_time_s"))).alias("created_s"),
        F.min_by("dex", at_birth).alias("launchpad"),
        F.min_by("_name", at_birth).alias("name"),
        F.min(F.when(grad, F.col("block_time_s"))).alias("grad_at_s"),
        F.min_by("dex", at_grad).alias("grad_dex"),
        F.min(at_grad).alias("graduated_pos"),
    )


def liquidity_rows(legs: DataFrame) -> DataFrame:
    """Adds and removes, with amounts only where the other side is the native coin."""
    native = lambda c: F.when(F.col("native"), F.col(c)).alias(c)
    rows = legs.filter(F.col("event") == "liquidity")
    return rows.select("mint", "at_s", "pos", "kind", F.col("actor").alias("provider"), "pool", "dex", native("moved"), native("reserve"))


def _with_graduation(legs: DataFrame, ft: DataFrame) -> DataFrame:
    """Stages only move forward, so "graduated at this event" is one comparison, not a window."""
    at = ft.select("mint", "graduated_pos")
    return legs.join(at, "mint").withColumn("graduated", F.coalesce(F.col("pos") > F.col("graduated_pos"), F.lit(False)))


def graduated_swaps(legs: DataFrame, ft: DataFrame) -> DataFrame:
    """Token-side swaps while graduated: time, sell flag, trader, native reserve (-1 if another coin)."""
    rows = _with_graduation(legs.filter((F.col("event") == "swap") & F.col("is_base")), ft).filter("graduated")
    reserve = F.when(F.col("native"), F.col("reserve")).otherwise(F.lit(-1))
    return rows.select("mint", "at_s", "pos", "sell", F.col("actor").alias("trader"), reserve.alias("reserve"))


def curve_swap_counts(legs: DataFrame, ft: DataFrame) -> DataFrame:
    rows = _with_graduation(legs.filter(F.col("event") == "swap"), ft)
    early = F.col("is_base") & ~F.col("graduated")
    return rows.groupBy("mint").agg(
        F.count_if(early).alias("curve_swaps"), F.count_if(early & F.col("sell")).alias("curve_sells"),
        F.count_if(~F.col("is_base")).alias("quote_leg_swaps"),
    )


def pool_last(legs: DataFrame) -> DataFrame:
    """Latest state of each pool by position: venue, time, native units, and where the legs carry them the base reserve and the price."""
    reserve = F.when(F.col("native"), F.col("reserve"))
    more = [c for c in ("base_reserve", "price") if c in legs.columns]
    rows = legs.filter(F.col("is_base") | (F.col("event") == "liquidity")).withColumn("_units", reserve)
    last = rows.groupBy("mint", "pool").agg(F.max_by(F.struct("dex", "at_s", "_units", *more), "pos").alias("r"))
    return last.select("mint", "pool", F.col("r.dex").alias("dex"), F.col("r.at_s").alias("at_s"), F.col("r._units").alias("units"), *[F.col(f"r.{c}").alias(c) for c in more])


def _cause(event: str = "event", kind: str = "kind"):
    return F.when(F.col(event) == "liquidity", F.concat(F.lit("liquidity "), F.col(kind))).otherwise("swap")


def tradable_series(
    legs: DataFrame, ft: DataFrame, params: Params = DEFAULTS
) -> DataFrame:
    """Native units in non-curve pools at the price of the moment: peak, last, first collapse."""
    units = F.when(F.col("native"), F.col("reserve")).cast("decimal(28,6)")
    read = legs.filter(F.col("is_base") | (F.col("event") == "liquidity")).withColumn("usd", units)
    valued = state_by_bucket(_with_graduation(read, ft), read).filter(F.col("graduated") & F.col("price").isNotNull()).withColumn(
        "now_usd", (F.coalesce("total_usd", F.lit(0)) * F.col("price")).cast("decimal(28,6)")
    )
    steps = first_after(
        valued, F.col("now_usd") >= params.min_peak_usd, F.col("now_usd") <= params.max_floor_usd, ["at_s", "event", "kind", "actor"],
        [F.max("now_usd").alias("tradable_peak"), F.max_by("now_usd", "pos").alias("tradable_last"), F.max("pos").alias("_last")],
        [F.max("tradable_peak").alias("tradable_peak"), F.max_by("tradable_last", "_last").alias("tradable_last")],
    )
    gone = F.col("hit").isNotNull()
    return steps.select(
        "mint", "tradable_peak", "tradable_last", F.col("hit.at_s").alias("tradable_collapse_at_s"),
        F.when(gone, _cause("hit.event", "hit.kind")).alias("tradable_collapse_by"), F.col("hit.actor").alias("tradable_collapse_actor"),
    )


def all_pool_collapse(
    legs: DataFrame, ft: DataFrame, params: Params = DEFAULTS
) -> DataFrame:
    """First collapse under the older metric: any pool's peak, and what the token holds now."""
    read = legs.filter(F.col("is_base") | (F.col("event") == "liquidity"))
    state = tradable_state(_with_graduation(read, ft), read)
    now = F.coalesce(F.when(F.col("graduated"), F.col("total_usd")), F.col("all_usd"))
    hit = (F.col("all_peak_usd") >= params.min_peak_usd) & (now <= params.max_floor_usd)
    first = first_crossing(state.select("mint", "pos", "at_s", "event", "kind", "actor", "graduated", "total_usd", "all_usd", "all_peak_usd"),
                           ["mint"], ["pos"], hit)
    return first.select(
        "mint", F.col("at_s").alias("collapse_at_s"), _cause().alias("collapse_by"), F.col("actor").alias("collapse_actor")
    )


def capture_span(ev: DataFrame) -> DataFrame:
    span = ev.agg(F.min("block_time_s").alias("start_s"), F.max("block_time_s").alias("end_s"))
    return span.withColumn("hours", (F.col("end_s") - F.col("start_s")) / 3600)


def trader_dictionary(swaps: DataFrame, trader: str = "actor") -> DataFrame:
    """A dense number per trader in first-seen order, numbered in parallel."""
    first = swaps.groupBy(F.col(trader).alias("trader")).agg(F.min("pos").alias("first_pos"))
    numbered = running(first, [], ["first_pos", "trader"], [Running("_no", "count", "trader")])
    return numbered.select("trader", (F.col("_no") - 1).alias("id"))


def periodic_samples(ev: DataFrame, every_s: int = 1800, params: Params = DEFAULTS) -> DataFrame:
    """Events so far and tokens alive at every sample time.

    A lifetime adds one at its first sample and takes it back after its last: the tokens alive
    are a running sum over the samples, with no row per token and sample.
    """
    width = min(every_s, params.idle_curve_s, params.idle_graduated_s)
    if every_s % width:
        raise ValueError("samples must be whole steps of the shortest idle limit")
    # A row per token and step: read for the lifetimes and for the events of each sample.
    active = settle(token_activity(ev, width), "activity")
    life = token_lifetimes(active, params)
    ttl = F.when(F.col("graduated"), params.idle_graduated_s).otherwise(params.idle_curve_s)
    up = lambda c: (F.ceil(c / every_s) * every_s).cast("bigint")
    gone = ((F.floor((F.col("end_s") + ttl) / every_s) + 1) * every_s).cast("bigint")
    one = lambda v: F.lit(v).cast("bigint")
    mark = lambda df, at, tokens, events, shown=0: df.select(at.alias("at_s"), tokens.alias("_t"), events.alias("_e"), F.lit(shown).alias("_shown"))
    span = active.agg(up(F.min("start_s")).alias("lo"), up(F.max("end_s")).alias("hi")).filter("lo IS NOT NULL")
    marks = [
        mark(life, up(F.col("start_s")), one(1), one(0)),
        mark(life, gone, one(-1), one(0)),
        mark(active, up(F.col("bucket") * width), one(0), F.col("events")),
        # One row per sample time, so that quiet samples appear too; departures after the last sample do not.
        mark(span, F.explode(F.sequence("lo", "hi", F.lit(every_s).cast("bigint"))), one(0), one(0), 1),
    ]
    summed = reduce(DataFrame.unionByName, marks).groupBy("at_s").agg(F.sum("_t").alias("_t"), F.sum("_e").alias("_e"), F.max("_shown").alias("_shown"))
    # One row per sample time: a year of half hours is 17,520.
    along = Window.orderBy("at_s")
    series = summed.select("at_s", F.sum("_t").over(along).alias("tokens"), F.sum("_e").over(along).alias("events"), "_shown")
    return series.filter("_shown = 1").select("at_s", "tokens", "events")
