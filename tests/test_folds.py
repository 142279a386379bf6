"""One step where several running sums stood: pool totals and lifetimes, and how often a plan reads its input."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from drainwatch.operators.lifetimes import activity, lifetimes
from drainwatch.operators.quantiles import auc, compare_classes, index_quantiles
from drainwatch.operators.running import BUCKET, Running, running
from drainwatch.plans import creators, features, rules

SF = "/root/testdata/sf0.001"


def readings(seed, n=400):
    rng = random.Random(seed)
    mints = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(mints), rng.choice("pqr") + str(rng.randrange(3)), rng.choice(["pumpfun", "pumpswap", "raydium"]), (t * rng.choice([1, 1, 900]), t), rng.choice([None, 0, 5, 70, 120])) for t in range(n)]
    return rows + rows[10:20]


def brute_state(rows):
    out, tokens = {}, {}
    for mint, pool, dex, pos, usd in sorted(set(rows), key=lambda r: r[3]):
        pools, tops = tokens.setdefault(mint, ({}, {"peak": None, "all": None}))
        if usd is not None:
            pools[pool] = (usd, dex != "pumpfun")
            tops["all"] = max(usd, tops["all"] or 0)
            if dex != "pumpfun":
                tops["peak"] = max(usd, tops["peak"] or 0)
        open_ = [v for v, tradable in pools.values() if tradable]
        out[mint, pos] = (sum(open_) if open_ else None, tops["peak"], sum(v for v, _ in pools.values()) if pools else None, tops["all"])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pool_totals_equal_brute_force(spark, seed):
    rows = readings(seed)
    df = spark.createDataFrame(rows, "mint string, pool string, dex string, pos struct<block_time_s:bigint,slot:bigint>, usd int").repartition(5)
    got = rules.tradable_state(df)
    assert BUCKET not in got.columns
    have = [((r.mint, tuple(r.pos)), (r.total_usd, r.peak_usd, r.all_usd, r.all_peak_usd)) for r in got.collect()]
    want = brute_state(rows)
    assert len(have) == len(rows)
    for place, state in have:
        assert tuple(None if v is None else Decimal(v) for v in want[place]) == state, place


def brute_lives(rows, short, long_):
    lives, last, session, marked = {}, {}, {}, {}
    for key, at, mark in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key in last:
            gap = at - last[key]
            if gap > long_ or (gap > short and not marked[key]):
                session[key] += 1
                marked[key] = False
        else:
            session[key], marked[key] = 0, False
        last[key] = at
        marked[key] = marked[key] or mark
        start, _, n, m = lives.get((key, session[key]), (at, 0, 0, False))
        lives[key, session[key]] = (start, at, n + 1, m or mark)
    return lives


@pytest.mark.parametrize("width", [1, 7, 30])
def test_lifetimes_equal_the_fold_row_by_row(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([rng.randrange(3000), rng.randrange(60) * 50]), rng.random() < 0.05) for _ in range(500)]
    # Marks of one second count from the second after, in either form, only if the order within it does not matter.
    rows = [(k, at, any(m for q, t, m in rows if (q, t) == (k, at))) for k, at, _ in rows]
    df = spark.createDataFrame(rows, "k string, at bigint, mark boolean")
    got = lifetimes(activity(df, "k", "at", F.col("mark"), width), "k", 30, 90)
    assert {(r.k, r.session): (r.start_s, r.end_s, r.events, r.marked) for r in got.collect()} == brute_lives(rows, 30, 90)


def test_samples_count_the_living(spark):
    rows = [("a", "token_create", 10), ("a", "swap", 500), ("b", "graduation", 100), ("b", "swap", 2000)]
    ev = spark.createDataFrame(rows, "mint string, type string, block_time_s bigint")
    params = creators.DEFAULTS.with_(idle_curve_s=600, idle_graduated_s=3000)
    got = [tuple(r) for r in features.periodic_samples(ev, 600, params).orderBy("at_s").collect()]
    assert got == [(600, 2, 3), (1200, 1, 3), (1800, 1, 3), (2400, 1, 4)]
    with pytest.raises(ValueError):
        features.periodic_samples(ev, 500, params.with_(idle_curve_s=300))


def test_classes_compared_as_apart(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(15), rng.random() < 0.3) for _ in range(300)] + [("z", 1, True), ("x", None, True)]
    df = spark.createDataFrame(rows, "g string, v int, l boolean")
    both = {(r.g, r.l): r for r in compare_classes(df, ["g"], "v", "l", {"p25": 0.25, "p50": 0.5}).collect()}
    apart = index_quantiles(df, ["g", "l"], "v", {"p25": 0.25, "p50": 0.5}).collect()
    areas = {r.g: r.auc for r in auc(df, "v", F.col("l"), ["g"]).collect()}
    assert len(both) == len(apart)
    for r in apart:
        b = both[r.g, r.l]
        assert (b.n, b.p25, b.p50, b.auc) == (r.n, r.p25, r.p50, areas[r.g])


@pytest.mark.parametrize("name, most", [("W1_running_tradable", 2), ("R4_rug_confirmations", 2), ("W7_idle_expiry", 1), ("F6_tradable_series", 3), ("F7_all_pool_collapse", 3)])
def test_scans_of_a_plan(spark, name, most):
    """Two reads of the readings at most; F6 and F7 read the token table as well."""
    from drainwatch.catalog import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan|Scan parquet", plan)) <= most


def test_lifetimes_shuffle_summaries_only(spark):
    from drainwatch.catalog import QUERIES

    plan = QUERIES["W7_idle_expiry"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) <= 2


def test_an_order_of_no_known_steps_is_refused(spark):
    df = spark.createDataFrame([(1, True)], "k int, b boolean")
    with pytest.raises(TypeError):
        running(df, ["k"], ["b"], [Running("n", "count", "k")])
