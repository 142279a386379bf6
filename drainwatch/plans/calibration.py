"""The calibration report: how well each signal predicts a collapse.

``token_facts`` joins everything the report asks about a token into one row; every table below is
a small aggregate over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.operators.quantiles import compare_classes, index_quantiles
from drainwatch.operators.select import first_crossing, newest_per_key, tally
from drainwatch.params import DEFAULTS, Params
from drainwatch.plans.tokens import collapsed
from drainwatch.session import settle

EARLY_S = 300
MIN_SWAPS = 10
CUTS = (0.1, 0.15, 0.2, 0.25)
VARIANTS = ("share_all", "share_before", "share_early")
DIST = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def own_adds(liq: DataFrame, ft: DataFrame) -> DataFrame:
    mine = liq.filter(F.col("kind") == "add").join(ft.select("mint", "creator", "collapse_at_s"), "mint")
    return mine.filter(F.col("provider") == F.col("creator"))


def first_creator_add(liq: DataFrame, ft: DataFrame) -> DataFrame:
    """Earliest own add not after the collapse."""
    before = F.col("collapse_at_s").isNull() | (F.col("at_s") <= F.col("collapse_at_s"))
    first = first_crossing(own_adds(liq, ft), ["mint"], ["at_s", "pos"], before)
    return first.select("mint", F.col("at_s").alias("add_at_s"), F.col("moved").alias("add_units"), F.col("dex").alias("add_dex"))


def sell_shares(sw: DataFrame, ft: DataFrame, min_swaps: int = MIN_SWAPS, early_s: int = EARLY_S) -> DataFrame:
    """Share of sells per token: all swaps, before the collapse, and just after graduation."""
    rows = sw.join(ft.select("mint", "collapse_at_s", "grad_at_s"), "mint")
    before = F.col("collapse_at_s").isNull() | (F.col("at_s") < F.col("collapse_at_s"))
    early = before & (F.col("at_s") < F.col("grad_at_s") + early_s)
    sets = {"share_all": F.lit(True), "share_before": before, "share_early": early}
    counts = rows.groupBy("mint").agg(
        *[a for k, c in sets.items() for a in (F.count_if(c).alias(f"_n_{k}"), F.count_if(c & F.col("sell")).alias(f"_s_{k}"))]
    )
    share = lambda k: F.when(F.col(f"_n_{k}") >= min_swaps, F.col(f"_s_{k}") / F.col(f"_n_{k}")).alias(k)
    return counts.select("mint", *[share(k) for k in sets])


def net_extraction_rows(liq: DataFrame, ft: DataFrame) -> DataFrame:
    own = liq.join(ft.select("mint", "creator"), "mint").filter(F.col("provider") == F.col("creator"))
    signed = F.when(F.col("kind") == "remove", F.col("moved")).otherwise(-F.col("moved"))
    return own.groupBy("mint").agg(F.coalesce(F.sum(signed), F.lit(0)).alias("net_units"))


def selling_rows(sw: DataFrame, ft: DataFrame) -> DataFrame:
    """Per token: sells up to the collapse and the busiest wallet's part of them."""
    rows = sw.filter("sell").join(ft.select("mint", "collapse_at_s"), "mint")
    rows = rows.filter(F.col("collapse_at_s").isNull() | (F.col("at_s") <= F.col("collapse_at_s")))
    per = rows.groupBy("mint", "trader").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("mint").agg(F.sum("n").alias("sells"), F.max("n").alias("top_sells"))


def token_facts(ft: DataFrame, outcomes: DataFrame, liq: DataFrame, sw: DataFrame, params: Params = DEFAULTS, min_swaps: int = MIN_SWAPS, early_s: int = EARLY_S) -> DataFrame:
    """One row per token.  Each part is an aggregate by mint that combines on the map side."""
    removes = liq.filter(F.col("kind") == "remove").join(ft.select("mint", "creator", "collapse_at_s"), "mint")
    removes = removes.filter(F.col("collapse_at_s").isNull() | (F.col("at_s") <= F.col("collapse_at_s")))
    removed = removes.groupBy("mint").agg(F.max((F.col("provider") == F.col("creator")).cast("int")).alias("creator_removed"))
    parts = [
        outcomes.select("mint", "stage", "peak_usd", "last_usd"),
        first_creator_add(liq, ft), sell_shares(sw, ft, min_swaps, early_s), net_extraction_rows(liq, ft), selling_rows(sw, ft),
        sw.groupBy("mint").agg(F.countDistinct("trader").alias("traders")), removed,
    ]
    facts = reduce(lambda a, b: a.join(b, "mint", "left"), parts, ft.drop("graduated_pos"))
    return facts.withColumn("collapsed", collapsed(params=params)).withColumn("graduated", F.col("stage") == "graduated").withColumn(
        "signal", F.col("add_at_s").isNotNull()
    )


def _n(cond: Column | None = None, name: str = "n") -> Column:
    return (F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name)


def metric_contingency(facts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    new = F.coalesce((F.col("tradable_peak") >= params.min_peak_usd) & (F.col("tradable_last") <= params.max_floor_usd), F.lit(False))
    g = facts.filter("graduated")
    return g.groupBy(F.col("collapsed").alias("old"), new.alias("tradable"), F.col("tradable_peak").isNull().alias("no_reading")).agg(_n())


def collapse_groups(facts: DataFrame) -> DataFrame:
    pad = F.coalesce("launchpad", F.lit("?"))
    group = (
        F.when(F.col("signal"), "A creator add")
        .when(~F.col("graduated"), F.concat(F.lit("B curve "), pad))
        .when(F.col("created_s").isNull(), "C graduated, creation not seen")
        .otherwise(F.concat(F.lit("C graduated "), pad, F.lit(", no creator add")))
    )
    return tally(facts.filter("collapsed"), group, "group")


def _unsignalled(facts: DataFrame) -> DataFrame:
    return facts.filter("collapsed and graduated and not signal")


def drain_mechanism(facts: DataFrame) -> DataFrame:
    by_creator = F.col("collapse_actor") == F.col("creator")
    one = F.coalesce((F.col("top_sells") >= F.col("sells") * 0.5) & (F.col("sells") > 0), F.lit(False))
    name = (
        F.when(F.col("collapse_by") == "swap", F.concat(
            F.when(by_creator, "sold, last by the creator").otherwise("sold"),
            F.when(one, "; one wallet half or more").otherwise("; many sellers")))
        .when(F.col("collapse_by") == "liquidity remove", F.when(F.col("creator_removed") == 1, "removed by the creator").otherwise("removed by a third wallet"))
        .when(F.col("collapse_by").isNull(), "not seen")
        .otherwise(F.col("collapse_by"))
    )
    return tally(_unsignalled(facts), name, "mechanism")


def third_party_removers(liq: DataFrame, facts: DataFrame, n: int = 8) -> DataFrame:
    """The busiest wallets that removed from others' tokens, and how many there are."""
    group = _unsignalled(facts).select("mint", F.col("creator").alias("_c"), "collapse_at_s")
    rows = liq.filter(F.col("kind") == "remove").join(group, "mint").filter(
        ~F.col("provider").eqNullSafe(F.col("_c")) & (F.col("collapse_at_s").isNull() | (F.col("at_s") <= F.col("collapse_at_s")))
    )
    # A row per wallet, for the report's few rows and for the number of all.
    counted = settle(rows.groupBy("provider").agg(_n()), "removers")
    return counted.orderBy(F.desc("n"), "provider").limit(n).withColumn("distinct_wallets", F.lit(counted.count()).cast("bigint"))


def precision_of_signal(facts: DataFrame) -> DataFrame:
    s = facts.filter("signal").agg(_n(name="matches"), _n(F.col("collapsed"), "collapsed"), F.countDistinct("creator").alias("creators"))
    return s.withColumn("precision", F.when(F.col("matches") > 0, F.col("collapsed") / F.col("matches")))


def recall_by_denominator(facts: DataFrame) -> DataFrame:
    removed = F.coalesce(F.col("collapse_by") == "liquidity remove", F.lit(False))
    own = F.coalesce(F.col("collapse_actor") == F.col("creator"), F.lit(False))
    sold = F.coalesce(F.col("collapse_by") == "swap", F.lit(False))
    g = F.col("graduated")
    tests = {"all": F.lit(True), "graduated": g, "by remove": g & removed, "by creator remove": g & removed & own, "by sells": g & sold}
    # One pass: a token counts for each denominator it belongs to (five at most).
    belongs = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in tests.items()]), lambda x: x.isNotNull())
    rows = facts.filter("collapsed").select(F.explode(belongs).alias("denominator"), "signal")
    counted = rows.groupBy("denominator").agg(_n(name="total"), _n(F.col("signal"), "found"))
    # A denominator that no token belongs to is a row of zeros.
    every = facts.sparkSession.createDataFrame([(k,) for k in tests], "denominator string")
    out = every.join(counted, "denominator", "left").na.fill(0, ["total", "found"])
    return out.withColumn("recall", F.when(F.col("total") > 0, F.col("found") / F.col("total")))


def _hits(facts: DataFrame) -> DataFrame:
    return facts.filter("signal and collapsed")


def lead_rows(facts: DataFrame) -> DataFrame:
    return _hits(facts).filter("collapse_at_s is not null").select("mint", (F.col("collapse_at_s") - F.col("add_at_s")).alias("lead_s"))


def distribution(df: DataFrame, value: str, group: list[str] | None = None, below: tuple[int, ...] = ()) -> DataFrame:
    """n, min, the report's quantiles, max, and counts under some limits."""
    group = group or []
    q = index_quantiles(df, group, value, DIST, "report")
    rest = df.filter(F.col(value).isNotNull()).groupBy(*group).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), *[_n(F.col(value) < b, f"under_{b}") for b in below]
    )
    if group:
        return q.join(rest, group)
    key = F.lit(1).alias("_k")
    return q.select("*", key).join(rest.select("*", key), "_k").drop("_k")


def net_extraction(facts: DataFrame) -> DataFrame:
    h = _hits(facts)
    zero = F.coalesce(F.col("net_units"), F.lit(0))
    return h.agg(_n(), F.sum(zero).cast("double").alias("total_units"), _n(zero < 0, "losers"))


def hits_per_hour(facts: DataFrame) -> DataFrame:
    hour = F.hour(F.timestamp_seconds("add_at_s")).cast("bigint")
    return _hits(facts).groupBy(hour.alias("utc_hour")).agg(_n())


def amount_bins(facts: DataFrame) -> DataFrame:
    v = F.col("add_units")
    bins = F.when(v < 80, "<80").when(v < 84.9, "80-84.9").when(v <= 85.1, "84.9-85.1").when(v <= 90, "85.1-90").otherwise(">90")
    return facts.filter("signal and add_units is not null").groupBy(bins.alias("bin"), "collapsed").agg(_n())


def standalone_band_rule(liq: DataFrame, facts: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Any add inside the band, whoever made it: tokens and collapsed share by role and venue."""
    band = (F.col("kind") == "add") & F.col("moved").between(params.fingerprint_min, params.fingerprint_max)
    first = first_crossing(liq, ["mint"], ["at_s", "pos"], band)
    rows = first.select("mint", "provider", "dex").join(facts.select("mint", "creator", "collapsed", "stage"), "mint").filter("stage is not null")
    role = F.when(F.col("provider") == F.col("creator"), "creator").otherwise("other")
    out = rows.groupBy(role.alias("role"), "dex").agg(_n(name="tokens"), _n(F.col("collapsed"), "collapsed"))
    return out.withColumn("precision", F.col("collapsed") / F.col("tokens"))


def band_providers(liq: DataFrame, facts: DataFrame, params: Params = DEFAULTS, n: int = 5) -> DataFrame:
    """The busiest wallets behind the band's first adds that are not the creator's."""
    band = (F.col("kind") == "add") & F.col("moved").between(params.fingerprint_min, params.fingerprint_max)
    first = first_crossing(liq, ["mint"], ["at_s", "pos"], band).select("mint", "provider")
    others = first.join(facts.filter("stage is not null").select("mint", "creator"), "mint").filter(~F.col("provider").eqNullSafe(F.col("creator")))
    return tally(others, "provider", "provider").limit(n)


def group_comparison(facts: DataFrame) -> DataFrame:
    """Each sell-share variant in each population: quartiles by outcome, and AUC."""
    pops = F.array(F.lit("all"), F.when(F.col("signal"), "with signal").otherwise("without signal"))
    # A token has three variants and belongs to two populations: six rows, whatever the data size.
    long = facts.filter("graduated").select("mint", "collapsed", F.explode(pops).alias("population"), *VARIANTS).unpivot(
        ["mint", "collapsed", "population"], list(VARIANTS), "variant", "share"
    ).filter("share is not null")
    return compare_classes(long, ["variant", "population"], "share", "collapsed", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def threshold_sweep(facts: DataFrame, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """Rule "early sell share at or under the cut" on tokens without the signal."""
    rows = facts.filter("graduated and not signal and share_early is not null")
    passed = F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col("share_early") <= c)
    counted = rows.select(F.explode(passed).alias("cut"), "collapsed").groupBy("cut").agg(_n(name="flagged"), _n(F.col("collapsed"), "collapsed"))
    every = facts.sparkSession.createDataFrame([(c,) for c in cuts], "cut double")
    out = every.join(counted, "cut", "left").na.fill(0, ["flagged", "collapsed"])
    return out.withColumn("precision", F.when(F.col("flagged") > 0, F.col("collapsed") / F.col("flagged")))


def distinct_traders(facts: DataFrame) -> DataFrame:
    rows = facts.filter("graduated").withColumn("traders", F.coalesce("traders", F.lit(0))).withColumn("_k", F.lit(1))
    return compare_classes(rows, ["_k"], "traders", "collapsed", {"p50": 0.5}).drop("_k")


def serial_by_graduated_share(facts: DataFrame, la: DataFrame, over: int = 10) -> DataFrame:
    busy = la.groupBy("creator").agg(F.count(F.lit(1)).alias("_l")).filter(F.col("_l") > over)
    rows = facts.filter("stage is not null").join(busy.select("creator"), "creator", "left_semi")
    per = rows.groupBy("creator").agg(_n(name="launches"), _n(F.col("graduated"), "grads"), _n(F.col("collapsed"), "gone"))
    share = F.col("grads") / F.col("launches")
    bucket = F.when(share == 0, "0").when(share <= 0.1, "(0,0.1]").when(share <= 0.5, "(0.1,0.5]").otherwise("(0.5,1]")
    return per.groupBy(bucket.alias("graduated_share")).agg(
        _n(name="creators"), F.sum("launches").alias("launches"), F.sum("gone").alias("collapses")
    )


def graduation_to_collapse(facts: DataFrame) -> DataFrame:
    rows = _unsignalled(facts).filter("collapse_at_s is not null and grad_at_s is not null")
    return distribution(rows.select((F.col("collapse_at_s") - F.col("grad_at_s")).alias("seconds")), "seconds")


def class_percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    q = index_quantiles(df, [group], value, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "extract")
    under = df.groupBy(group).agg(_n(F.col(value) < 10, "under_10"), _n(F.col(value) < 60, "under_60"))
    return q.join(under, group)


def strata(facts: DataFrame, params: Params = DEFAULTS) -> Column:
    return (
        F.when(F.col("collapsed") & F.col("signal"), "A collapsed, creator add")
        .when(F.col("collapsed") & F.col("graduated"), "C collapsed, graduated, no creator add")
        .when(F.col("collapsed"), "B collapsed on the curve")
        .when(F.col("graduated") & (F.col("peak_usd") >= params.min_peak_usd), "alive at the end")
    )


def stratified_sample(rows: DataFrame, stratum: str, key: str, owner: str, n: int, seed: int) -> DataFrame:
    """``n`` rows per stratum, one per owner over all strata, in a seeded and repeatable order."""
    mixed = rows.filter(F.col(stratum).isNotNull() & F.col(owner).isNotNull()).withColumn(
        "_mix", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    )
    alone = newest_per_key(mixed, [owner], [F.asc("_mix")], 1)
    return newest_per_key(alone, [stratum], [F.asc("_mix")], n).drop("_mix")


def name_reuse(df: DataFrame, name: str, owner: str) -> DataFrame:
    """How many rows carry a name another owner uses too."""
    norm = F.lower(F.trim(F.col(name)))
    # Two owners exist when the least and the greatest differ: no distinct sets to hold.
    per = df.groupBy(norm.alias("_name")).agg(
        (F.min(owner) != F.max(owner)).alias("_shared"), F.count(F.lit(1)).alias("_rows")
    )
    return per.agg(
        F.sum("_rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("_shared"), F.col("_rows"))), F.lit(0)).cast("bigint").alias("reused")
    )


def repeated_final_liquidity(facts: DataFrame) -> DataFrame:
    """How many tokens of a group end at an amount another one ends at too."""
    final = facts.filter("last_usd is not null").groupBy("collapsed", F.round("last_usd", 2).alias("_last")).agg(F.count(F.lit(1)).alias("_c"))
    return final.groupBy("collapsed").agg(
        F.sum("_c").alias("tokens"), F.coalesce(F.sum(F.when(F.col("_c") > 1, F.col("_c"))), F.lit(0)).cast("bigint").alias("repeated")
    )
