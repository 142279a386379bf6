from decimal import Decimal

from pyspark.sql import functions as F

from drainwatch.plans import prices


def amounts(spark):
    big = 10**30
    rows = [(0, 5, 0, "10"), (1, 2_000_000_000, 9, "300"), (2, 1000, 18, "0.5"), (3, big, 30, "2"), (4, 7, 255, "1"), (5, 10**9, 9, "20000000000"), (6, 10**9, 9, "0"), (7, 0, 9, "3"),
            (8, 3 * 10**18, 18, "6"), (9, 10**36, 0, "0.0000000000000000000000001")]
    typed = [(i, Decimal(raw), d, Decimal(usd)) for i, raw, d, usd in rows]
    return spark.createDataFrame(typed, "id int, raw decimal(38,0), d bigint, usd decimal(38,18)")


def test_no_amount_fails_the_job_and_18_decimals_have_a_price(spark):
    price = prices.usd_per_unit(F.col("usd"), F.col("raw"), F.col("d"))
    got = {r.id: r.p for r in amounts(spark).select("id", price.alias("p")).collect()}
    assert (float(got[0]), float(got[1]), float(got[3]), float(got[8])) == (2.0, 150.0, 2.0, 2.0)
    assert got[4] is None and float(got[5]) == 2e10 and got[6] is None and got[7] is None and got[9] is None
    # 10^-15 units for half a dollar: a price, too large for its type, counted as such.
    assert got[2] is None
    worth = prices.value_usd(F.col("raw"), F.col("d"), F.lit(Decimal("1.5")))
    value = {r.id: r.v for r in amounts(spark).select("id", worth.alias("v")).collect()}
    assert float(value[1]) == 3.0 and float(value[8]) == 4.5 and value[9] is None and float(value[4]) == 0.0


def test_outcomes_are_counted(spark):
    got = {r.outcome: r.n for r in prices.price_outcomes(amounts(spark), "usd", "raw", "d").collect()}
    assert sum(got.values()) == 10 and got["exact"] == 2 and got["unknown"] == 3 and got["does not fit"] == 2 and got["rounded"] == 3
