import json
import random
from decimal import Decimal, getcontext

from pyspark.sql import functions as F

from drainwatch.functions.exact import exact, fits, order_key, times, told
from drainwatch.plans import normalize as nz

getcontext().prec = 100
TEXTS = ["0", "-0", "0.000", "1", "-1", "1e-25", "1e21", "1E+21", "-2.50e-30", "100", "1200.0300", "99999999999999999999.999999999999999999", "100000000000000000000", "0.0000000000000000001",
         "123456789012345678901234567890123456789", "1.5e-18", "1e-18", "1e-19", "007.100", "x", "", "1.", ".5", "1e", "9" * 38]


def number(text):
    try:
        return Decimal(text) if text and text[0] != "." and text[-1] not in ".e" else None
    except ArithmeticError:
        return None


def plain(n):
    return None if n is None else Decimal(n.digits) * Decimal(10) ** n.power


def test_numbers_keep_every_digit(spark):
    rng = random.Random(1)
    texts = TEXTS + [f"{rng.choice(['', '-'])}{rng.randrange(10**rng.randrange(1, 20))}{rng.choice(['', '.' + str(rng.randrange(10**9))])}{rng.choice(['', f'e{rng.randrange(-30, 30)}'])}" for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exact(F.col("t")).alias("n"), fits(F.col("t")).alias("f")).collect()
    for r in rows:
        want = number(r.t)
        if want is not None and len(want.normalize().as_tuple().digits) > 38:
            want = None
        assert plain(r.n) == want, r.t
        held = number(r.t)
        small = held is not None and abs(held) < Decimal(10) ** 20 and held == round(held, 18)
        assert r.f == small, r.t


def test_order_and_products(spark):
    rng = random.Random(2)
    texts = [f"{rng.choice(['', '-'])}{rng.randrange(1000)}{rng.choice(['', '.5', '.025'])}e{rng.randrange(-30, 30)}" for _ in range(80)] + ["0", "1e-25", "1e21"]
    df = spark.createDataFrame([(t, u) for t, u in zip(texts, reversed(texts))], "t string, u string").select("t", "u", exact(F.col("t")).alias("a"), exact(F.col("u")).alias("b"))
    ordered = [Decimal(r.t) for r in df.orderBy(order_key(F.col("a"))).collect()]
    assert ordered == sorted(ordered)
    for r in df.select("t", "u", times(F.col("a"), F.col("b")).alias("p")).collect():
        assert plain(r.p) == Decimal(r.t) * Decimal(r.u), (r.t, r.u)


def test_a_frame_loses_no_number(spark):
    frame = {"type": "stats", "mint": "M", "price_usd": "1e-25", "block_time": 1_802_000_000, "windows": {"60": {"volume_usd": "1e21", "trades": 1, "buys": 1, "sells": 0, "price_change_pct": "0.5"}}}
    routed = nz.frames_to_routed(spark.createDataFrame([(json.dumps(frame),), (json.dumps(frame | {"price_usd": "0.25"}),)], "value string"))
    rows = nz.normalize(routed, "stats").select("inexact", told("price_usd").alias("n")).collect()
    assert sorted(str(plain(r.n).normalize()) for r in rows) == ["0.25", "1E-25"]
    assert {tuple(r.inexact) for r in rows} == {("price_usd=1e-25", "windows.60.volume_usd=1e21"), ("windows.60.volume_usd=1e21",)}


def test_a_plainly_written_number_is_told_by_one_pattern(spark):
    """Taking it apart comes after: the dozen patterns are for the few others."""
    plan = spark.range(1).select(fits(F.col("id").cast("string")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE" in plan
    edge = ["9" * 20, "9" * 21, "0." + "1" * 18, "0." + "1" * 19, "-" + "9" * 20 + "." + "1" * 18, "0" * 30 + "5", "5\n", None, ""]
    rows = spark.createDataFrame([(t,) for t in edge], "t string").select(fits(F.col("t")).alias("f")).collect()
    assert [r.f for r in rows] == [True, False, True, False, True, True, True, None, False]
