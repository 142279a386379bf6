"""The detector as a stream of slices, against the batch form."""

import json
import random

import pytest
from test_detect import AT, Feed

from drainwatch.params import DEFAULTS
from drainwatch.plans import detect
from drainwatch.session import work_path
from drainwatch.sources import registry
from drainwatch.streaming import slices
from drainwatch.streaming.slices import Slices, said, table_of, warm


def raw(spark, frames):
    return spark.createDataFrame([(json.dumps(r),) for r in frames], "value string")


def shown(df):
    return sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())


def market(seed, tokens=14):
    """Tokens of few creators, in any state of trade; some pair events come before their token."""
    rng = random.Random(seed)
    f = Feed()
    for k in range(tokens):
        mint, who, t = f"M{k}", f"dev{rng.randrange(4)}", rng.randrange(0, 2500)
        if rng.random() < 0.3:
            f.move(max(0, t - rng.choice([50, 900])), mint, who, "add", 30, 30, 100 + k)
        f.create(t, mint, who)
        if rng.random() < 0.8:
            f.graduate(t + 100, mint, who)
        reserve = 60
        for step in range(rng.randrange(2, 7)):
            t += rng.randrange(1, 400)
            reserve = rng.choice([reserve + 5, 80, 0.01, 0.02])
            if rng.random() < 0.4:
                f.move(t + 110, mint, rng.choice([who, who, "friend"]), rng.choice(["add", "remove"]), 10, reserve, 100 + step)
            else:
                f.swap(t + 110, mint, rng.choice([who, "crowd"]), 3, reserve, 100 + step)
    return sorted(f.frames, key=lambda r: r["block_time"])


@pytest.fixture(scope="module")
def story(spark):
    """An unbroken run of three batches, out of order by up to 300 seconds, with repeats and bad lines; and its frames."""
    frames = market(4)
    rng = random.Random(9)
    sent = sorted([(r["block_time"] + rng.randrange(300), i, r) for i, r in enumerate(frames)] + [(r["block_time"] + rng.randrange(300), -i, r) for i, r in enumerate(frames[::4])], key=lambda x: x[:2])
    rows = [r for *_, r in sent]
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third] + [{"type": "nothing"}, {**frames[0], "slot": "x"}], rows[2 * third :]]
    run = Slices(spark, work_path(spark, "state"), work_path(spark, "out"), delay_s=300, keep_facts=True)
    for n, part in enumerate(parts):
        run(raw(spark, part), n)
    run.close(3)
    return frames, parts, run


def test_slices_give_the_batch_records(spark, story):
    frames, parts, run = story
    alerts, drains = detect.detect(raw(spark, frames))
    assert shown(table_of(spark, run.out_dir, "alerts")) == shown(alerts)
    assert shown(table_of(spark, run.out_dir, "rugs")) == shown(drains)
    assert alerts.count() > 4 and drains.count() > 4
    told = {r.metric: r.s for r in table_of(spark, run.out_dir, "counters").groupBy("metric").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()}
    assert told["received"] == sum(len(p) for p in parts)
    assert (told["unknown_type"], told["invalid_shape"], told["late"]) == (1, 1, 0)
    assert (told["admitted"], told["duplicate"]) == (len(frames), len(frames[::4]))


def test_a_batch_that_runs_again_replaces_itself(spark, story):
    _, parts, run = story
    before = shown(spark.read.parquet(f"{run.out_dir}/alerts/batch=2")), shown(spark.read.parquet(f"{run.state_dir}/batch=2/pools"))
    run(raw(spark, parts[2]), 2)
    assert (shown(spark.read.parquet(f"{run.out_dir}/alerts/batch=2")), shown(spark.read.parquet(f"{run.state_dir}/batch=2/pools"))) == before


def test_a_restart_from_registry_and_archive_goes_on_as_if_unbroken(spark, story):
    frames, _, run = story
    half = len(frames) // 2
    # What a first process filed before it stopped.
    first_alerts, first_drains = detect.detect(raw(spark, frames[:half]))
    path = work_path(spark, "registry")
    registry.write_registry(registry.as_records(first_alerts, first_drains), path)
    good, bad = registry.load_registry(spark, path, 30, AT + 10_000)
    assert bad.count() == 0
    alerts, drains = registry.full_records(good)
    assert shown(alerts) == shown(first_alerts) and shown(drains) == shown(first_drains)
    start = warm(spark, raw(spark, frames[:half]), said(alerts, drains), DEFAULTS, delay_s=0)
    again = Slices(spark, work_path(spark, "state"), work_path(spark, "out"), delay_s=0, start=start)
    again(raw(spark, frames[half:]), 0)
    ids = lambda *dfs: sorted(r.id for df in dfs for r in df.select("id").collect())
    assert ids(alerts, drains, table_of(spark, again.out_dir, "alerts"), table_of(spark, again.out_dir, "rugs")) == ids(table_of(spark, run.out_dir, "alerts"), table_of(spark, run.out_dir, "rugs"))


def test_late_frames_are_applied_and_what_they_change_is_told(spark):
    f = Feed()
    f.create(0, "One", "dev").graduate(30, "One", "dev").swap(300, "One", "crowd", 2, 95).swap(900, "One", "dev", 2, 0.01)
    for k, mint in enumerate(("Two", "Three")):
        t = 1000 + 100 * k
        f.create(t, mint, "x").graduate(t + 10, mint, "x").swap(t + 20, mint, "crowd", 2, 95).swap(t + 90, mint, "crowd", 2, 0.01)
    timely = len(f.frames)
    # An add before the drain; an earlier drain; a second pool that still held something.
    f.move(200, "One", "dev", "add", 85, 85).swap(1050, "Two", "crowd", 2, 0.02).move(1150, "Three", "friend", "add", 50, 50)
    f.frames[-1]["pool"] = "Three-other"
    run = Slices(spark, work_path(spark, "state"), work_path(spark, "out"), delay_s=0, keep_facts=True)
    run(raw(spark, f.frames[:timely]), 0)
    run(raw(spark, f.frames[timely:]), 1)
    ids = {r.id for name in ("alerts", "rugs") for r in table_of(spark, run.out_dir, name).collect()}
    assert ids == {"rug:One", "rug:Two", "rug:Three", "red:One", "amber:Three"}
    assert table_of(spark, run.out_dir, "late").count() == 3
    told = {r.id: (r.action, r.t_at and r.t_at - AT, r.was_t_at and r.was_t_at - AT, r.mechanism) for r in slices.corrections(spark, run, 1).collect()}
    assert told == {"rug:Two": ("change", 1050, 1090, "sell-off"), "rug:Three": ("retract", None, 1190, None)}
