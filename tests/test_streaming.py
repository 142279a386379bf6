"""Streams fed in several small batches against the batch form."""

import pytest
from pyspark.sql import functions as F

from builders import T0, History, detect
from drainwatch.params import DEFAULTS
from drainwatch.session import work_path
from drainwatch.streaming import feed, lifecycle


def as_stream(spark, ev, parts, delay="1 hour"):
    """The history in ``parts`` files by time, one file per micro-batch."""
    path = work_path(spark, "history")
    rows = ev.orderBy("block_time_s", "slot").collect()
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], ev.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return feed.event_clock(stream, DEFAULTS, delay)


def history():
    h = History()
    h.create("First", "dev", 7).graduate("First", "dev", 33).swap("First", "buyer", 61, 3100).swap("First", "dev", 215, 2)
    h.create("Next", "dev", 250).graduate("Next", "dev", 277).liquidity("Next", "dev", 310, "add", 3000).liquidity("Next", "dev", 390, "remove", 4)
    h.create("A", "x", 5).graduate("A", "x", 15).liquidity("A", "x", 25, "add", 1500).swap("A", "t", 400, 1600)
    return h


@pytest.mark.parametrize("parts", [1, 5])
def test_records_and_amber_equal_the_batch(spark, parts):
    ev = history().df(spark)
    alerts, rugs = detect(ev)
    out = feed.drain(lifecycle.token_records(as_stream(spark, ev, parts)), "records").collect()
    assert {(r.id, r.t_at) for r in out if r.kind == "alert"} == {(k, r.t_at) for k, r in alerts.items() if r.level == "red"}
    assert {(r.mint, r.t_at, r.mechanism) for r in out if r.kind == "rug"} == {(m, r.t_at, r.mechanism) for m, r in rugs.items()}
    amber = feed.drain(lifecycle.amber_records(lifecycle.token_records(as_stream(spark, ev, parts))), "amber").collect()
    assert {(r.id, r.t_at, r.n_prior) for r in amber} == {(k, r.t_at, r.n_prior) for k, r in alerts.items() if r.level == "amber"}


def test_unresolved_alert_and_idle_token_are_reported_by_the_clock(spark):
    h = history().create("Late", "z", 20000).create("End", "z", 200000)
    stream = as_stream(spark, h.df(spark), 4)
    out = feed.drain(lifecycle.token_records(stream, resolve=True), "resolve").filter("kind = 'unconfirmed'").collect()
    assert [(r.id, r.t_at) for r in out] == [("unconfirmed:A", T0 + 25)]
    out = feed.drain(lifecycle.token_records(as_stream(spark, h.df(spark), 4), fold_idle=True), "fold").filter("kind = 'outcome'").collect()
    folded = {r.mint: (r.stage, r.peak_usd and float(r.peak_usd), r.last_usd and float(r.last_usd)) for r in out}
    assert folded["A"] == ("graduated", 1600.0, 1600.0) and folded["Next"] == ("graduated", 3000.0, 4.0) and folded["Late"] == ("created", None, None)


def shared_slots(spark):
    """Every event of a minute in one slot: only the index inside it tells their order."""
    ev = history().df(spark)
    at = F.col("block_time_s") - F.col("block_time_s") % 60
    pos = F.struct(at.alias("block_time_s"), F.floor(at / 60).alias("slot"), F.col("slot").alias("tx_index"))
    return ev.withColumn("pos", pos).withColumn("block_time_s", at).withColumn("slot", F.floor(at / 60))


@pytest.mark.parametrize("parts", [1, 3])
def test_order_inside_a_slot(spark, parts):
    ev = shared_slots(spark)
    alerts, rugs = detect(ev)
    out = feed.drain(lifecycle.token_records(as_stream(spark, ev, parts)), "slots").collect()
    assert {(r.id, r.t_at) for r in out if r.kind == "alert"} == {(k, r.t_at) for k, r in alerts.items() if r.level == "red"}
    assert {(r.mint, r.t_at, r.mechanism) for r in out if r.kind == "rug"} == {(m, r.t_at, r.mechanism) for m, r in rugs.items()}
    # Two readings of one pool in one slot: the second one drains it.
    both = History().create("M", "dev", 0).graduate("M", "dev", 1)
    both.slot = 9
    both.swap("M", "t", 60, 2000)
    both.slot = 9
    both.swap("M", "t", 60, 1)
    rows = both.df(spark).withColumn("pos", F.struct("block_time_s", "slot", (F.lit(5000) - F.col("usd")).cast("bigint").alias("tx_index")))
    out = feed.drain(lifecycle.token_records(as_stream(spark, rows, 1)), "one-slot").collect()
    assert [r.id for r in out if r.kind == "rug"] == ["rug:M"]


def test_both_timers_at_one_moment_and_no_second_alert_after_the_fold(spark):
    params = DEFAULTS.with_(idle_curve_s=3600, idle_graduated_s=3600, resolve_s=3600)
    h = History().create("T", "dev", 0).liquidity("T", "dev", 10, "add", 50).create("Clock", "z", 20000).create("Tick", "z", 30000)
    h.create("T", "dev", 40000).liquidity("T", "dev", 40010, "add", 60).create("End", "z", 90000)
    out = feed.drain(lifecycle.token_records(as_stream(spark, h.df(spark), 7), params, fold_idle=True, resolve=True), "timers").collect()
    said = sorted(r.id for r in out if r.mint == "T" and r.kind in ("alert", "unconfirmed"))
    assert said == ["red:T", "unconfirmed:T"]
    assert sum(r.kind == "outcome" and r.mint == "T" for r in out) == 2


def test_all_earlier_drains_count_in_the_stream_too(spark):
    h = History()
    for i in range(25):
        h.create(f"D{i}", "dev", i * 20).graduate(f"D{i}", "dev", i * 20 + 1).swap(f"D{i}", "t", i * 20 + 2, 2000).swap(f"D{i}", "dev", i * 20 + 3, 1)
    h.create("Z", "dev", 900).graduate("Z", "dev", 901)
    rows = lifecycle.amber_records(lifecycle.token_records(as_stream(spark, h.df(spark), 3)))
    z = next(r for r in feed.drain(rows, "amber").collect() if r.mint == "Z")
    assert z.n_prior == 25 and z.prior_rugs == ["D24", "D23", "D22", "D21", "D20"]


def test_early_pair_events_wait_for_their_token_and_lapse(spark):
    h = History().liquidity("M", "a", 0, "add", 1).liquidity("M", "a", 500, "add", 1).create("M", "dev", 900).liquidity("M", "a", 950, "add", 1)
    h.liquidity("Never", "a", 10, "add", 1).create("Clock", "z", 9000)
    out = feed.drain(lifecycle.release_early_pairs(as_stream(spark, h.df(spark), 3)), "held").collect()
    assert sorted((r.mint, r.slot, r.held) for r in out) == [("M", 2, True), ("M", 4, False)]


def test_records_are_written_once_and_a_batch_replaces_itself(spark):
    source, path = work_path(spark, "ids"), work_path(spark, "sink")
    for ids in (["a", "b", "a"], ["b", "c"], ["c", "a"]):
        spark.createDataFrame([(i, 1) for i in ids], "id string, t int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id string, t int").option("maxFilesPerTrigger", 1).parquet(source)
    sink = feed.records_sink(path)
    feed.run_to_end(feed.once(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-progress"))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    for _ in range(2):
        sink(spark.createDataFrame([("z", 1)], "id string, t int"), 99)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "z"]


def test_stream_dedup_forgets_only_after_the_delay(spark):
    """A key is dropped by the first micro-batch that runs with the clock past its delay."""
    h = History().create("M", "dev", 0).create("M", "dev", 60).create("Clock", "z", 50000).create("Tick", "z", 50001).create("M", "dev", 100000)
    ev = as_stream(spark, h.df(spark), 5, "10 minutes").withColumn("key", F.col("mint"))
    kept = feed.drain(feed.dedup_stream(ev).select("mint", "slot"), "dedup").collect()
    assert sorted(r.slot for r in kept) == [1, 3, 4, 5]


@pytest.mark.parametrize("rows", [3, 600])
def test_each_stretch_is_one_batch_however_many_files_its_table_has(spark, rows):
    """Rows of any moment lie in each of the table's files: a batch that is a part of a stretch would move the watermark past the rest of it."""
    ev = spark.range(rows).select("id", (F.col("id") * 7200 / rows).cast("bigint").alias("block_time_s")).repartition(6, "id")
    at = F.floor(F.col("block_time_s") / 2400)
    stream = feed.landed(ev, at, 3, "id", work_path(spark, "landed"), ["block_time_s"])
    clocked = feed.event_clock(stream, DEFAULTS, "1 second")
    batches = []
    feed.run_to_end(clocked.writeStream.foreachBatch(lambda df, n: batches.append({r[0] // 2400 for r in df.collect()})).option("checkpointLocation", work_path(spark, "progress")))
    assert [b for b in batches if b] == [{0}, {1}, {2}]
    counted = feed.drain(feed.rate_stream(clocked, 60), "rate")
    closed = 7200 * (rows - 1) // rows // 60 * 60
    assert counted.agg(F.sum("n")).first()[0] == ev.filter(F.col("block_time_s") < closed).count()


def test_events_of_a_table_of_several_files_all_count(spark):
    from drainwatch.catalog.stream_queries import x13

    path = work_path(spark, "tables")
    rows = spark.range(2000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(T0) + F.col("id") * 60).alias("ts"), (F.col("id") % 9).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    rows.repartition(6, "event_id").write.parquet(f"{path}/events.parquet")
    hours = rows.groupBy(F.floor(F.unix_timestamp("ts") / 3600) * 3600).count().collect()
    last = T0 + 1999 * 60 - 3600
    assert {tuple(r) for r in x13(spark, path).collect()} == {(h, n) for h, n in hours if h + 3600 <= last}


def test_frames_are_built_by_as_many_tasks_as_run_at_a_time(spark):
    from drainwatch.catalog.feed_adapter import build_frames

    path = work_path(spark, "tables")
    spark.createDataFrame([(i, "2024-01-01 00:00:00", i, "click", 1.0, '{"k": 1}') for i in range(64)], "event_id long, ts string, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    assert build_frames(spark, path).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
