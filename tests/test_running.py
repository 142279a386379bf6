import random
import re

import pytest
from pyspark.sql import functions as F

from drainwatch.operators.quantiles import RULES, auc, index_quantiles
from drainwatch.operators.running import BUCKET, Running, running, value_bucket
from drainwatch.plans import tokens

SPECS = [
    Running("s", "sum", "v"), Running("m", "max", "v"), Running("n", "min", "v"), Running("c", "count", "v"), Running("l", "last", "v"),
    Running("sb", "sum", "v", before=True), Running("mb", "max", "v", before=True), Running("lb", "last", "v", before=True),
]


def brute(rows):
    """Row by row in plain Python."""
    out, seen = {}, {}
    for k, t, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        past = seen.setdefault(k, [])
        before = [x for x in past if x is not None]
        past.append(v)
        now = [x for x in past if x is not None]
        agg = lambda xs, f: f(xs) if xs else None
        out[(k, t)] = (agg(now, sum), agg(now, max), agg(now, min), len(now), now[-1] if now else None, agg(before, sum), agg(before, max), before[-1] if before else None)
    return out


@pytest.mark.parametrize("width", [10**9, 60, 1])
def test_running_equals_brute_force_with_a_hot_key_nulls_and_a_null_key(spark, width):
    rng = random.Random(5)
    keys = ["hot"] * 300 + ["a", "b", None] * 20 + [f"k{i}" for i in range(40)]
    rows = [(k, i, None if rng.random() < 0.2 else rng.randrange(100)) for i, k in enumerate(rng.sample(keys, len(keys)))]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(5)
    got = running(df, ["k"], ["t"], SPECS, width)
    assert BUCKET not in got.columns
    assert {(r.k, r.t): (r.s, r.m, r.n, r.c, r.l, r.sb, r.mb, r.lb) for r in got.collect()} == brute(rows)


def test_running_over_everything_in_one_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("t"), F.lit(1).alias("v")).repartition(7)
    got = running(df, [], ["t"], [Running("n", "count", "v")], 10)
    assert all(r.n == r.t + 1 for r in got.collect())


def test_index_quantiles_follow_each_rule(spark):
    values = {"a": [5, 1, 4, 4, 2, 9, 7], "b": [3], "c": list(range(100))}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v int")
    index = {"report": lambda p, n: min(n - 1, int(p * n)), "extract": lambda p, n: int(p * (n - 1)), "median": lambda p, n: n // 2}
    for rule in RULES:
        got = index_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, rule).collect()
        for r in got:
            s = sorted(values[r.g])
            assert [r.p10, r.p50, r.p90] == [s[index[rule](p, len(s))] for p in (0.1, 0.5, 0.9)], (rule, r.g)


def test_auc_counts_ties_half(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.random() < 0.4) for _ in range(200)]
    pos, neg = [v for v, p in rows if p], [v for v, p in rows if not p]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    got = auc(spark.createDataFrame(rows, "v int, p boolean"), "v", F.col("p")).first()
    assert abs(got.auc - want) < 1e-12
    assert auc(spark.createDataFrame([(1, True)], "v int, p boolean"), "v", F.col("p")).first().auc is None


def plan_of(df):
    return re.sub(r"#\d+|plan_id=\d+|\[\d+\]|Location: .*|/tmp/\S+", "", df._jdf.queryExecution().executedPlan().toString())


def test_the_plan_is_the_same_for_three_rows_and_for_many_and_buckets_bound_the_rows(spark):
    few, many = (spark.range(n).select((F.col("id") % 2).alias("k"), (F.col("id") * 60).alias("t"), F.lit(1).alias("v")) for n in (3, 200_000))
    shapes = [re.findall(r"\b(Window|Exchange|HashAggregate|Sort|Union|Join)\b", plan_of(running(df, ["k"], ["t"], [Running("n", "count", "v")]))) for df in (few, many)]
    assert shapes[0] == shapes[1] and "Join" not in shapes[0]
    got = running(many, ["k"], ["t"], [Running("n", "count", "v")])
    # A window task takes one hour of a key and the row in front.
    assert many.groupBy("k", F.floor(F.col("t") / 3600)).count().agg(F.max("count")).first()[0] == 30
    assert got.filter(F.col("n") != F.floor(F.col("t") / 120) + 1).count() == 0


def test_value_buckets_never_fall(spark):
    rng = random.Random(8)
    values = sorted([rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 20) for _ in range(500)] + [0.0, 1e-300, 1e300])
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", value_bucket(F.col("v")).alias("b")).orderBy("i").collect()
    assert all(a.b <= b.b for a, b in zip(rows, rows[1:]))


def test_peak_counts_what_downsampling_replaces(spark):
    pos = lambda t: (t, t)
    rows = [("M", "pool", "p", "pumpswap", t, pos(t), u, None) for t, u in ((600, 10), (605, 50), (610, 20), (665, 5))]
    rd = spark.createDataFrame(rows, "mint string, source string, pool string, dex string, at_s bigint, pos struct<a:bigint,b:bigint>, usd int, holders bigint")
    assert sorted(r.usd for r in tokens.downsample_readings(rd).collect()) == [5, 20]
    peak = tokens.peak_liquidity(rd).first()
    assert (peak.peak_usd, peak.peak_at_s) == (50, 605)


def test_a_large_key_is_dealt_over_tasks_that_adaptive_execution_does_not_join(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 60).alias("t"), F.lit(1).alias("v")).repartition("k")
    got = running(rows, ["k"], ["t"], [Running("s", "sum", "v")])
    at = got.select(F.spark_partition_id().alias("p"), "s", "t").collect()
    assert len({r.p for r in at}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(r.s == r.t // 60 + 1 for r in at)


def test_busy_creators_are_counted_over_the_window_unknown_times_aside(spark):
    from drainwatch.params import DEFAULTS
    from drainwatch.plans.creators import serial_creators

    la = spark.range(3000).select(F.concat(F.lit("C"), F.col("id") % 100).alias("creator"), F.col("id").cast("string").alias("mint"), (F.col("id") * 60).alias("created_s"))
    late = spark.createDataFrame([("C0", "x", None), ("few", "y", 1), ("few", "z", None)], "creator string, mint string, created_s bigint")
    got = serial_creators(la.unionByName(late))
    # A launch every 6000 s.
    assert {(r.creator, r.most) for r in got.collect()} == {(f"C{i}", -(-DEFAULTS.burst_window_s // 6000)) for i in range(100)}
