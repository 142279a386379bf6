"""Alert rules, drain confirmations and their statistics.

Records
    al  alerts: id, level, mint, creator, t_at (s), pos, pool, dex, ...
    rg  rugs:   mint, creator, t_at (s), pos, mechanism, actor, peak_usd, last_usd
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drainwatch.operators.quantiles import counted_quantiles
from drainwatch.operators.pools import Held, pool_totals
from drainwatch.operators.running import BUCKET, Running, running
from drainwatch.operators.select import first_crossing
from drainwatch.params import CONFIDENCE, DEFAULTS, RULE_NAME, STAGE_RANK, WRAPPED_SOL, Params
from drainwatch.plans.tokens import creator_columns, creator_then, stage_rank, tradable_venue
from drainwatch.session import settle


def fingerprint(amount: str, quote_mint: str, params: Params = DEFAULTS) -> Column:
    """The habitual amount of the measured wallets: evidence on an alert, not a rule."""
    return (F.col(quote_mint) == WRAPPED_SOL) & F.col(amount).between(params.fingerprint_min, params.fingerprint_max)


def tradable_state(rd: DataFrame, summed: DataFrame | None = None) -> DataFrame:
    """After every reading: ``total_usd`` tradable now and ``peak_usd``, the largest tradable reading so far
    (``all_usd`` and ``all_peak_usd``: the same over every pool, curve pools too).

    The total is the sum over non-curve pools of each pool's latest reading.  It is null while no
    tradable pool holds a priced reading; an unpriced reading changes nothing.
    """
    return state_by_bucket(rd, summed).select(*rd.columns, "total_usd", "peak_usd", "all_usd", "all_peak_usd")


def _contributions(rd: DataFrame) -> DataFrame:
    priced, open_ = F.col("usd").isNotNull(), tradable_venue()
    usd = F.col("usd").cast("decimal(28,6)")
    return rd.select(
        "*",
        F.when(priced, F.when(open_, usd).otherwise(F.lit(0).cast("decimal(28,6)"))).alias("_held"),
        F.when(priced, open_.cast("int")).alias("_open"),
        F.when(priced & open_, usd).alias("_top"),
        usd.alias("_any"),
    )


def state_by_bucket(rd: DataFrame, summed: DataFrame | None = None) -> DataFrame:
    """As ``tradable_state``, with the bucket that the rows are partitioned by.  ``summed``: the same readings, and maybe others, where they are cheaper to read."""
    state = pool_totals(_contributions(rd), "mint", "pool", "pos", [
        Held("_sum", "_held", "_top", "peak_usd"), Held("_pools", "_open"), Held("_sum_any", "_any", "_any", "all_peak_usd"),
    ], summed=None if summed is None else _contributions(summed))
    return state.select(
        *rd.columns, BUCKET,
        F.when(F.col("_pools") > 0, F.col("_sum")).alias("total_usd"),
        "peak_usd",
        F.when(F.col("all_peak_usd").isNotNull(), F.col("_sum_any")).alias("all_usd"),
        "all_peak_usd",
    )


def first_after(state: DataFrame, reached: Column, gone: Column, keep: list[str], per_bucket: list[Column] = (), per_token: list[Column] = ()) -> DataFrame:
    """Per token, the first row of ``gone`` at or after the first row of ``reached``, as ``hit`` (null where there is none); further aggregates go by way of the buckets.

    ``state``: output of ``state_by_bucket``.  A summary per (token, bucket) says what follows from either state at its start; buckets are then put together in order.
    """
    row = F.struct("pos", *keep)
    inside = Window.partitionBy("mint", BUCKET).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = state.withColumns({"_row": row, "_reached": F.coalesce(reached, F.lit(False)), "_gone": F.coalesce(gone, F.lit(False))})
    seen = flags.withColumn("_since", F.max("_reached").over(inside))
    steps = seen.groupBy("mint", BUCKET).agg(
        F.max("_reached").alias("_reached"),
        F.min(F.when(F.col("_gone"), F.col("_row"))).alias("_if_reached"),
        F.min(F.when(F.col("_gone") & F.col("_since"), F.col("_row"))).alias("_if_not"),
        *per_bucket,
    )
    earlier = Window.partitionBy("mint").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    hits = steps.withColumn("_hit", F.when(F.coalesce(F.max("_reached").over(earlier), F.lit(False)), F.col("_if_reached")).otherwise(F.col("_if_not")))
    return hits.groupBy("mint").agg(F.min("_hit").alias("hit"), *per_token)


def running_tradable(rd: DataFrame) -> DataFrame:
    return tradable_state(rd).select(*rd.columns, "total_usd")


def running_peak(rd: DataFrame) -> DataFrame:
    """Largest tradable reading so far, after every reading."""
    keyed = rd.withColumn("_held", F.when(tradable_venue(), F.col("usd")))
    return running(keyed, ["mint"], ["pos"], [Running("peak_usd", "max", "_held")]).drop("_held")


def stage_at_event(ev: DataFrame) -> DataFrame:
    """Stage rank of the token when each event is seen."""
    ranked = ev.withColumn("_rank", stage_rank())
    return running(ranked, ["mint"], ["pos"], [Running("stage_rank", "max", "_rank")]).drop("_rank")


def drain_candidates(rd: DataFrame, tok: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Readings of the tokens that can ever be confirmed.

    Graduated, one tradable reading at or over the peak, one at or under the floor (the total can
    only be that low if some pool is).  One map-side aggregate drops almost every token before
    anything is ordered.
    """
    bounds = rd.filter(tradable_venue()).groupBy("mint").agg(F.max("usd").alias("_max"), F.min("usd").alias("_min"))
    able = bounds.filter((F.col("_max") >= params.min_peak_usd) & (F.col("_min") <= params.max_floor_usd))
    graduated = tok.filter(F.col("stage_rank") == STAGE_RANK["graduated"]).select("mint", "graduated_pos", *creator_columns(tok))
    return rd.join(graduated.join(able.select("mint"), "mint", "left_semi"), "mint")


def rug_confirmations(
    rd: DataFrame, tok: DataFrame, params: Params = DEFAULTS, among: Column | None = None
) -> DataFrame:
    """First reading at which a graduated token, once worth the peak, holds no more than the floor.

    ``rd`` carries event (liquidity | swap), actor, pool, dex; ``tok`` carries graduated_pos.  ``among``:
    the readings that may complete a drain, where others only carry the past.
    """
    # Few tokens are left, and their readings are read twice.
    able = settle(drain_candidates(rd, tok, params), "drain-candidates")
    state = tradable_state(able)
    hit = (
        (F.col("pos") > F.col("graduated_pos"))
        & (F.col("peak_usd") >= params.min_peak_usd)
        & (F.col("total_usd") <= params.max_floor_usd)
    )
    first = first_crossing(state, ["mint"], ["pos"], hit if among is None else hit & among)
    return first.select(
        "mint", creator_then(first.columns).alias("creator"), F.col("at_s").alias("t_at"), "pos", "event", "actor", "pool", "dex",
        "peak_usd", F.col("total_usd").alias("last_usd"),
    )


def red_alerts(pair_ev: DataFrame, tok: DataFrame, rg: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The creator's first add to its own token, unless the token is already a confirmed drain.

    ``pair_ev``: mint, actor, kind, pool, dex, pos, block_time_s and optionally quote_mint, quote_units.
    An add that itself completes a drain raises nothing.
    """
    creators = tok.select("mint", *creator_columns(tok))
    adds = pair_ev.filter(F.col("kind") == "add").join(creators, "mint")
    own = adds.withColumn("creator", creator_then(creators.columns)).filter(F.col("actor") == F.col("creator"))
    first = first_crossing(own, ["mint"], ["pos"])
    gone = rg.select("mint", F.col("pos").alias("_rug_pos"))
    live = first.join(gone, "mint", "left").filter(F.col("_rug_pos").isNull() | (F.col("pos") < F.col("_rug_pos")))
    evidence = [c for c in ("quote_mint", "quote_units") if c in pair_ev.columns]
    out = live.select(
        F.concat(F.lit("red:"), F.col("mint").cast("string")).alias("id"), F.lit("red").alias("level"),
        "mint", "creator", F.col("block_time_s").alias("t_at"), "pos", "pool", "dex", *evidence,
    )
    if len(evidence) == 2:
        out = out.withColumn("fingerprint", fingerprint("quote_units", "quote_mint", params))
    return out


def mechanism(rg: DataFrame, red: DataFrame) -> DataFrame:
    """How each drain happened.  ``red`` are the alerts raised before their token's drain."""
    warned = red.select("mint", F.lit(True).alias("_red"))
    by_creator = F.coalesce(F.col("actor") == F.col("creator"), F.lit(False))
    name = (
        F.when((F.col("event") == "liquidity") & by_creator, F.when(F.col("_red"), "creator-pull").otherwise("migration-pull"))
        .when(F.col("event") == "liquidity", "third-party-remove")
        .when(by_creator, "dev-dump")
        .otherwise("sell-off")
    )
    return rg.join(warned, "mint", "left").withColumn("mechanism", name).drop("_red")


def prior_rugs(grads: DataFrame, rg: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The creator's earlier drains of other tokens at each graduation: ``n_prior`` counts them all, ``prior_rugs`` lists the newest.

    Drains are numbered per creator in the order of time, so the count is a number and nothing
    pairs graduations with drains; a graduation looks up only the numbers that it shows.
    """
    g = grads.select("creator", F.col("mint"), "pos", F.col("block_time_s").alias("t_at"), *[c for c in ("pool", "dex") if c in grads.columns])
    extra = [c for c in g.columns if c not in ("creator", "mint", "pos", "t_at")]
    marks = rg.select("creator", F.col("pos"), "t_at", F.lit(1).alias("_is_rug"), F.col("mint").alias("_rmint"), "mechanism").filter(F.col("creator").isNotNull())
    both = g.withColumn("_is_rug", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    # Only drains of an earlier second count: a graduation comes first in its second.
    numbered = running(both, ["creator"], ["t_at", "_is_rug", "pos", "_rmint"], [Running("_no", "sum", "_is_rug")])
    drains = numbered.filter("_is_rug = 1").select("creator", "_no", "_rmint", F.col("t_at").alias("_rat"), "mechanism")
    # The token's own drain, if it is among them, is the one that does not count.
    own = rg.select(F.col("mint").alias("_omint"), F.col("creator").alias("_ocreator"), F.col("t_at").alias("_oat"))
    is_own = (F.col("mint") == F.col("_omint")) & (F.col("creator") == F.col("_ocreator")) & (F.col("_oat") < F.col("t_at"))
    asks = numbered.filter("_is_rug = 0 and _no > 0").drop("_rmint", "mechanism", "_is_rug").join(own, is_own, "left")
    asks = asks.withColumn("n_prior", F.col("_no") - F.when(F.col("_omint").isNotNull(), 1).otherwise(0)).filter("n_prior > 0")
    looked = F.sequence(F.greatest(F.lit(1).cast("bigint"), F.col("_no") - params.prior_rugs_shown), F.col("_no"))
    asks = asks.select("creator", "mint", "pos", "t_at", *extra, "n_prior", F.explode(looked).alias("_no"))
    hits = asks.join(drains, ["creator", "_no"]).filter(F.col("_rmint") != F.col("mint"))
    entry = F.struct(F.col("_no").alias("no"), F.col("_rmint").alias("mint"), F.col("_rat").alias("t_at"), F.col("mechanism"))
    # One more than are shown, at most, per graduation.
    listed = hits.groupBy("creator", "mint", "pos", "t_at", *extra, "n_prior").agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("_all"))
    return listed.withColumn("prior_rugs", F.slice("_all", 1, params.prior_rugs_shown)).drop("_all")


def amber_alerts(grads: DataFrame, rg: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """A token graduates whose creator already drained another one: once per token, not after its own drain."""
    first = first_crossing(prior_rugs(grads, rg, params), ["mint"], ["pos"])
    gone = rg.select("mint", F.col("pos").alias("_rug_pos"))
    live = first.join(gone, "mint", "left").filter(F.col("_rug_pos").isNull() | (F.col("pos") < F.col("_rug_pos")))
    return live.select(
        F.concat(F.lit("amber:"), F.col("mint").cast("string")).alias("id"), F.lit("amber").alias("level"),
        "mint", "creator", "t_at", "pos", *[c for c in ("pool", "dex") if c in grads.columns], "prior_rugs", "n_prior",
    )


def alerts_union(red: DataFrame, amber: DataFrame) -> DataFrame:
    return red.unionByName(amber, allowMissingColumns=True)


def confirm_alerts(rg: DataFrame, al: DataFrame) -> DataFrame:
    """Each drain with the alerts of its token (at most one per level) and their warning time."""
    hits = al.select("mint", "id", "level", F.col("t_at").alias("alert_at")).join(
        rg.select("mint", "mechanism", F.col("t_at").alias("rug_at")), "mint"
    )
    return hits.withColumn("lead_s", F.col("rug_at") - F.col("alert_at"))


def with_confirmation(al: DataFrame, rg: DataFrame) -> DataFrame:
    return al.join(rg.select("mint", F.col("t_at").alias("rug_at"), "mechanism"), "mint", "left")


def alert_status(al: DataFrame, rg: DataFrame, clock_s: Column, params: Params = DEFAULTS) -> DataFrame:
    """confirmed, or by age against the clock: open up to the limit, unconfirmed beyond it."""
    status = (
        F.when(F.col("rug_at").isNotNull(), "confirmed")
        .when(clock_s - F.col("t_at") <= params.resolve_s, "open")
        .otherwise("unconfirmed")
    )
    return with_confirmation(al, rg).withColumn("status", status)


def open_and_unconfirmed(al: DataFrame, rg: DataFrame, clock_s: Column, params: Params = DEFAULTS) -> DataFrame:
    pending = al.join(rg.select("mint"), "mint", "left_anti")
    return pending.withColumn("status", F.when(clock_s - F.col("t_at") <= params.resolve_s, "open").otherwise("unconfirmed"))


def alert_level_stats(al: DataFrame, rg: DataFrame, clock_s: Column, params: Params = DEFAULTS) -> DataFrame:
    rows = alert_status(al, rg, clock_s, params).withColumn("lead_s", F.col("rug_at") - F.col("t_at"))
    # The alerts are read once; counts and median come from how many have each status and lead.
    by_lead = settle(rows.groupBy("level", "status", "lead_s").agg(F.count(F.lit(1)).alias("_c")), "by-lead")
    n = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("_c"))), F.lit(0)).alias(s)
    counts = by_lead.groupBy("level").agg(F.sum("_c").alias("fired"), n("confirmed"), n("unconfirmed"), n("open"))
    leads = by_lead.filter("lead_s is not null").groupBy("level", "lead_s").agg(F.sum("_c").alias("_c"))
    median = counted_quantiles(leads, ["level"], "lead_s", {"median_lead_s": 0.5}, rule="median").select("level", "median_lead_s")
    resolved = F.col("confirmed") + F.col("unconfirmed")
    return counts.join(median, "level", "left").withColumn(
        "precision", F.when(resolved > 0, F.col("confirmed") / resolved)
    )


def unwarned_rugs(rg: DataFrame, al: DataFrame) -> DataFrame:
    return rg.join(al.select("mint"), "mint", "left_anti").groupBy("mechanism").agg(F.count(F.lit(1)).alias("n"))


def sequences(rg: DataFrame, al: DataFrame) -> DataFrame:
    """Each warned drain with its alerts in time order and the lead of the earliest one."""
    hits = confirm_alerts(rg, al)
    entry = F.struct("alert_at", "level", "id")
    return hits.groupBy("mint", "mechanism", "rug_at").agg(
        F.array_sort(F.collect_list(entry)).alias("alerts"), (F.first("rug_at") - F.min("alert_at")).alias("lead_s")
    )


def rugs_by_mechanism(rg: DataFrame) -> DataFrame:
    return rg.groupBy("mechanism").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("creator").alias("creators"))


def confidence_dim(spark) -> DataFrame:
    rows = [(lv, RULE_NAME[lv], c, f, c / f, lead) for lv, (c, f, lead) in CONFIDENCE.items()]
    return spark.createDataFrame(
        rows, "level string, rule string, measured_confirmed bigint, measured_fired bigint, measured_precision double, typical_lead_s bigint"
    )


def resume_from_registry(new: DataFrame, history: DataFrame, key: str = "id") -> DataFrame:
    """Records not written before: a restart repeats nothing."""
    return new.join(history.select(key).distinct(), key, "left_anti")


def describe_records(al: DataFrame) -> DataFrame:
    """One human line per alert."""
    when = F.date_format(F.timestamp_seconds("t_at"), "yyyy-MM-dd HH:mm:ss")
    shown = F.format_string("[ALERT %s] %s %s by %s", F.upper("level"), when, F.col("mint").cast("string"), F.col("creator").cast("string"))
    return al.withColumn("line", shown)


def describe_rugs(rg: DataFrame) -> DataFrame:
    when = F.date_format(F.timestamp_seconds("t_at"), "yyyy-MM-dd HH:mm:ss")
    shown = F.format_string("[RUG] %s %s: %s by %s ($%s to $%s)", when, F.col("mint").cast("string"), F.col("mechanism"),
                            F.col("actor").cast("string"), F.round("peak_usd", 2).cast("decimal(20,2)").cast("string"),
                            F.round("last_usd", 2).cast("decimal(20,2)").cast("string"))
    return rg.withColumn("line", shown)


def alert_latency(received_ms: str = "detected_at_ms", at_s: str = "t_at") -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.round(F.col(received_ms) / 1000 - F.col(at_s)).cast("bigint"))
