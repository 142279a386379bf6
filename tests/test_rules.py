from pyspark.sql import functions as F

from builders import T0, History, detect
from drainwatch.params import DEFAULTS
from drainwatch.plans import rules


def story(h):
    return h.create("M", "dev", 0).graduate("M", "dev", 100)


def test_red_only_by_the_creator_and_only_once(spark):
    h = History().create("M", "dev", 0).liquidity("M", "lp", 10, "add", 50).liquidity("M", "dev", 20, "add", 60).liquidity("M", "dev", 30, "add", 70)
    h.liquidity("M", "dev", 40, "remove", 65)
    alerts, rugs = detect(h.df(spark))
    assert {k: r.t_at - T0 for k, r in alerts.items()} == {"red:M": 20} and not rugs


def test_creator_pull_with_lead(spark):
    h = story(History()).liquidity("M", "dev", 110, "add", 8500).liquidity("M", "dev", 615, "remove", 2)
    alerts, rugs = detect(h.df(spark))
    assert rugs["M"].mechanism == "creator-pull" and rugs["M"].t_at - alerts["red:M"].t_at == 505


def test_migration_pull_sell_off_third_party_and_dev_dump(spark):
    h = History()
    for mint, actor, how in (("A", "devA", "remove"), ("B", "someone", "swap"), ("C", "someone", "remove"), ("D", "devD", "swap")):
        h.create(mint, f"dev{mint}", 0).graduate(mint, f"dev{mint}", 10).swap(mint, "t", 20, 2000)
        h = h.swap(mint, actor, 30, 1) if how == "swap" else h.liquidity(mint, actor, 30, "remove", 1)
    _, rugs = detect(h.df(spark))
    assert {m: r.mechanism for m, r in rugs.items()} == {"A": "migration-pull", "B": "sell-off", "C": "third-party-remove", "D": "dev-dump"}


def test_value_left_in_the_curve_pool_does_not_hide_a_drain(spark):
    h = story(History()).swap("M", "t", 110, 1200, "curve-M", "pumpfun").swap("M", "t", 120, 2000).swap("M", "dev", 130, 1)
    _, rugs = detect(h.df(spark))
    assert rugs["M"].mechanism == "dev-dump" and (float(rugs["M"].peak_usd), float(rugs["M"].last_usd)) == (2000.0, 1.0)


def test_no_drain_below_the_peak_or_before_graduation(spark):
    h = story(History()).swap("M", "t", 110, 500).swap("M", "t", 120, 1)
    h.create("N", "dev", 0).swap("N", "t", 110, 5000).swap("N", "t", 120, 1)
    assert detect(h.df(spark))[1] == {}


def test_a_second_pool_still_holding_value_prevents_confirmation(spark):
    h = story(History()).swap("M", "t", 110, 5000).swap("M", "t", 111, 900, "other").swap("M", "t", 120, 1).swap("M", "t", 130, 2, "other")
    assert detect(h.df(spark))[1]["M"].t_at - T0 == 130


def test_add_that_follows_the_drain_raises_nothing(spark):
    h = story(History()).swap("M", "t", 110, 5000).swap("M", "x", 120, 1).liquidity("M", "dev", 130, "add", 3)
    alerts, _ = detect(h.df(spark))
    assert alerts == {}


def amber_history():
    h = History()
    h.create("First", "dev", 7).graduate("First", "dev", 33).swap("First", "buyer", 61, 3100).swap("First", "dev", 415, 2)
    h.create("Next", "dev", 500).graduate("Next", "dev", 777)
    # Graduated before the drain, though it arrives after.
    return h.create("Early", "dev", 90).graduate("Early", "dev", 120)


def test_amber_needs_an_earlier_drain_of_another_token(spark):
    alerts, _ = detect(amber_history().df(spark))
    assert set(alerts) == {"amber:Next"} and alerts["amber:Next"].n_prior == 1


def test_amber_counts_all_earlier_drains_and_lists_the_newest(spark):
    h = History()
    for i in range(25):
        h.create(f"R{i}", "dev", i * 10).graduate(f"R{i}", "dev", i * 10 + 1).swap(f"R{i}", "t", i * 10 + 2, 2000).swap(f"R{i}", "dev", i * 10 + 3, 1)
    h.create("Z", "dev", 900).graduate("Z", "dev", 901)
    alerts, _ = detect(h.df(spark))
    z = alerts["amber:Z"]
    assert z.n_prior == 25
    assert [p["mint"] for p in z.prior_rugs] == ["R24", "R23", "R22", "R21", "R20"]


def test_order_and_repeats_change_nothing(spark):
    h = amber_history().liquidity("Next", "dev", 810, "add", 3000).liquidity("Next", "dev", 905, "remove", 4)
    ev = h.df(spark)
    want = [{k: (r.t_at, r.creator) for k, r in part.items()} for part in detect(ev)]
    for seed in (1, 2):
        mixed = ev.unionByName(ev).orderBy(F.rand(seed))
        assert [{k: (r.t_at, r.creator) for k, r in part.items()} for part in detect(mixed)] == want


def test_alert_is_open_until_the_limit_and_unconfirmed_after_it(spark):
    al = spark.createDataFrame([("red:M", "red", "M", T0)], "id string, level string, mint string, t_at bigint")
    rg = spark.createDataFrame([], "mint string, t_at bigint, mechanism string")
    status = [rules.open_and_unconfirmed(al, rg, F.lit(T0 + s)).first().status for s in (3600, 3601)]
    assert status == ["open", "unconfirmed"]
