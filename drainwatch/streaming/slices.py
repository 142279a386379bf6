"""Frames to alerts and drains as a stream, one closed slice of event time after the other.

Every micro-batch puts its frames to those that wait, moves the event clock to the newest event less ``delay_s``, and releases what the clock has passed.  So whatever order frames come in, a slice holds all
events between two clock times, and the batch operators run over it: typing, prices of the moment, pool totals, rules.  What a slice must know of the past is kept as tables of few rows:

* waiting frames and the keys of frames seen (``seen_s`` of event time),
* the identity rows that decide a token's table row, at most nine a token,
* the newest price of each quote asset; the newest reading of each pool and the largest of each token,
* pair events of tokens not yet known (``pending_ttl_s``), with the prices of their moment,
* the alerts and drains so far.

The same operators over these rows and the slice give what they give over the whole past, because each row kept is the one their minimum, maximum or newest value comes from.  A quote asset or token
that has nearly all events is split by the batch operators as in a batch, and adds one row to the next slice.

State is a table per batch number below ``state_dir``: batch n reads n - 1 and writes n, so a batch that runs again after a lost executor or driver replaces what it wrote.  Records are a
folder per batch.  Only a clock, a handful of counts, reaches the driver.

Frames behind the clock are late: they are counted and applied (identity, prices, peaks, adds), but what was confirmed before them stands; ``corrections`` re-evaluates the tokens they touch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from drainwatch.functions import validate as v
from drainwatch.functions.events import POSITION
from drainwatch.params import DEFAULTS, MINT_KEYS, WRAPPED_SOL, Params
from drainwatch.plans import normalize as nz
from drainwatch.plans import prices, rules
from drainwatch.plans.detect import alert_records, graduations, pair_moves, rug_records
from drainwatch.plans.joins import late_token_join, price_asof
from drainwatch.plans.tokens import token_dim, tradable_venue
from drainwatch.session import settle, work_path
from drainwatch.sources.tables import write_routed

KINDS = ("token_create", "meme", "graduation", "liquidity", "swap")
FRAME = "type string, v variant, reason string, key string, at_s bigint"
DAY = 86400
# A price that is only remembered gives way to one that was learned at the same position.
REMEMBERED = 99
POS = f"struct<{','.join(f'{p}:bigint' for p in POSITION)}>"
RUGS = f"mint string, creator string, t_at bigint, pos {POS}, event string, actor string, pool string, dex string, peak_usd decimal(28,6), last_usd decimal(38,6), mechanism string"
ALERTS = f"""id string, level string, mint string, creator string, t_at bigint, pos {POS}, pool string, dex string, quote_mint string, quote_units {prices.UNITS}, fingerprint boolean,
prior_rugs array<struct<no:bigint,mint:string,t_at:bigint,mechanism:string>>, n_prior bigint"""
GRADUATION = ("mint", "creator", "pos", "block_time_s", "pool", "dex")
REASONS = ("invalid_json", "not_an_object", "unknown_type", "invalid_shape")


def frame_key(kind: Column) -> Column:
    """The deduplication key of a frame, read from the frame itself."""
    text = lambda path: v.get(F.col("v"), path, "string")
    spot = F.concat_ws("|", text("signature"), text("ix_index"), text("inner_ix_index"))
    whole = F.sha2(F.to_json(F.col("v")), 256)
    return (
        F.when(kind.isin("swap", "transfer", "token_create", "pool_create"), F.concat_ws("|", spot, text("mint")))
        .when(kind == "liquidity", F.concat_ws("|", spot, text("base_mint")))
        .when(kind == "graduation", F.concat_ws("|", text("mint"), text("slot")))
        .otherwise(whole)
    )


def keep_rows(rows: DataFrame, key: str, picks: list[Column]) -> DataFrame:
    """The rows that the picks (aggregates of whole rows) choose per key, each once."""
    kept = rows.groupBy(F.col(key).alias("_key")).agg(F.array_distinct(F.filter(F.array(*picks), lambda r: r.isNotNull())).alias("_rows"))
    return kept.select(F.inline("_rows")).select(*rows.columns)


def identity_rows(ident: DataFrame) -> DataFrame:
    """The rows from which ``token_dim`` gives the same row as from all."""
    row = F.struct(*ident.columns)
    born = F.col("type") == "token_create"
    firsts = [born, F.col("type") == "graduation", F.col("type") == "meme", F.lit(True)]
    firsts += [~born & F.col(c).isNotNull() for c in ("actor", "launchpad", "name", "symbol", "quote_mint")]
    return keep_rows(ident, "mint", [*[F.min_by(row, F.when(c, F.col("pos"))) for c in firsts], F.max_by(row, "block_time_s")])


def reading_rows(rd: DataFrame) -> DataFrame:
    """The newest priced reading of each pool, and each token's largest, tradable and not."""
    row, priced = F.struct(*rd.columns), F.col("usd").isNotNull()
    newest = rd.filter(priced).groupBy("mint", "pool").agg(F.max_by(row, "pos").alias("_row")).select("_row.*")
    largest = keep_rows(rd.filter(priced), "mint", [F.max_by(row, F.when(tradable_venue(), F.col("usd"))), F.max_by(row, "usd")])
    return newest.union(largest.select(*newest.columns)).distinct()


def newest_prices(px: DataFrame) -> DataFrame:
    row = F.struct(*px.columns)
    return px.groupBy("quote_mint").agg(F.max_by(row, F.struct("pos", -F.col("seq"))).alias("_row")).select("_row.*")


@dataclass
class Slices:
    """The function of each micro-batch.

    ``start``: tables of an earlier run by name (``warm``, ``said``), where the stream does not begin from nothing.  ``keep_facts``: file readings, pair moves and graduations too, for ``corrections``.
    """

    spark: SparkSession
    state_dir: str
    out_dir: str
    params: Params = DEFAULTS
    delay_s: int = 60
    seen_s: int = DAY
    keep_facts: bool = False
    start: dict[str, DataFrame] = field(default_factory=dict)

    # ---- state

    def _old(self, n: int, name: str, like: DataFrame | str) -> DataFrame:
        """A table of the batch before; of the shape of ``like`` and empty where there is none."""
        empty = self.spark.createDataFrame([], like if isinstance(like, str) else like.schema)
        if n > 0:
            return self.spark.read.schema(empty.schema).parquet(f"{self.state_dir}/batch={n - 1}/{name}")
        return self.start[name].select(*[F.col(f.name).cast(f.dataType) for f in empty.schema]) if name in self.start else empty

    def _keep(self, n: int, name: str, rows: DataFrame) -> DataFrame:
        path = f"{self.state_dir}/batch={n}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _clock(self, n: int) -> tuple[int, int]:
        """(newest event second, released up to) of the batch before."""
        if n == 0 and "clock" not in self.start:
            return -(1 << 62), -(1 << 62)
        table = self.spark.read.parquet(f"{self.state_dir}/batch={n - 1}/clock") if n > 0 else self.start["clock"]
        row = table.first()
        return row["newest_s"], row["cut_s"]

    def _shaped(self, rows: DataFrame, ddl: str) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], ddl).schema])

    def _put(self, n: int, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out_dir}/{name}/batch={n}")

    # ---- one batch

    def __call__(self, frames: DataFrame, n: int, closing: bool = False) -> None:
        newest, old_cut = self._clock(n)
        counts = Observation(f"frames-{n}")
        fresh = self._admit(frames, n, counts)
        seen = fresh.agg(F.max("at_s").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("at_s") <= old_cut).alias("late")).first()
        newest = max(newest, seen["m"] if seen["m"] is not None else newest)
        cut = (1 << 61) if closing else max(old_cut, newest - self.delay_s)
        keys = fresh.select("type", "key", "at_s")
        self._keep(n, "seen", self._old(n, "seen", keys).union(keys).filter(F.col("at_s") > newest - self.seen_s))
        due, late = self._release(fresh, n, cut, old_cut)
        # Typed once: every later plan starts from narrow tables.
        norm = {k: settle(nz.normalize(due, k, checked=True), k) for k in KINDS}
        self._detect(norm, n, cut, old_cut)
        if late is not None:
            self._put(n, "late", late)
        told = counts.get
        tally = [(n, "received", told["received"]), *[(n, r, told[r]) for r in REASONS], (n, "not followed", told["other"]), (n, "duplicate", told["good"] - seen["n"]), (n, "late", seen["late"]), (n, "admitted", seen["n"])]
        self._put(n, "counters", self.spark.createDataFrame(tally, "batch bigint, metric string, n bigint"))
        self._keep(n, "clock", self.spark.createDataFrame([(newest, cut)], "newest_s bigint, cut_s bigint"))

    def close(self, n: int) -> None:
        """The feed is over: release what waits, as batch ``n``."""
        self(self.spark.createDataFrame([], "value string"), n, closing=True)

    def _admit(self, frames: DataFrame, n: int, counts: Observation) -> DataFrame:
        """Valid frames of the types that feed state, once per key; how many were not, and why, is observed on the way."""
        checked = nz.validated(nz.frames_to_routed(frames.select("value")))
        good, followed = F.col("reason").isNull(), F.col("type").isin(*KINDS)
        checked = checked.observe(
            counts, F.count(F.lit(1)).alias("received"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS],
            F.count_if(good & ~followed).alias("other"), F.count_if(good & followed).alias("good"),
        )
        rows = checked.filter(good & followed).select(
            "type", "v", "reason", frame_key(F.col("type")).alias("key"), v.get(F.col("v"), "block_time", "bigint").alias("at_s")
        ).dropDuplicates(["type", "key"])
        seen = self._old(n, "seen", rows.select("type", "key", "at_s")).select("type", "key")
        path = work_path(self.spark, "admitted")
        rows.join(seen, ["type", "key"], "left_anti").write.parquet(path)
        return self.spark.read.schema(FRAME).parquet(path)

    def _release(self, fresh: DataFrame, n: int, cut: int, old_cut: int) -> tuple[DataFrame, DataFrame]:
        here = fresh.select("type", "v", "reason", "key", "at_s")
        waiting = self._old(n, "waiting", here).unionByName(here)
        self._keep(n, "waiting", waiting.filter(F.col("at_s") > cut))
        path = work_path(self.spark, "slice")
        write_routed(waiting.filter(F.col("at_s") <= cut), path)
        late = here.filter(F.col("at_s") <= old_cut).select("type", "key", "at_s", F.to_json("v").alias("value"))
        return self.spark.read.schema("v variant, reason string, key string, at_s bigint, type string").parquet(path), late

    def _detect(self, norm: dict[str, DataFrame], n: int, cut: int, old_cut: int) -> None:
        p, old = self.params, self._old
        ident = prices.identity_events(norm)
        ident = self._keep(n, "ident", identity_rows(old(n, "ident", ident).unionByName(ident)))
        tok = settle(token_dim(ident, online=True), "tokens")

        # Pairs: of this slice and held ones whose token has come.
        liquidity = norm["liquidity"]
        early = old(n, "early", liquidity)
        pairs = prices.pair_rows(early.unionByName(liquidity), tok).filter("mint is not null")
        pairs = settle(late_token_join(pairs, tok.select("mint", "first_seen_s"), p.pending_ttl_s).drop("held"), "pairs")
        swaps = settle(prices.swap_rows(norm["swap"], tok), "swaps")
        learned = prices.learn_quote_prices(liquidity, pairs, swaps)
        px = settle(old(n, "prices", learned).unionByName(old(n, "early_prices", learned)).unionByName(learned), "prices")
        self._keep(n, "prices", newest_prices(px))
        known = tok.filter(F.col("mint") != WRAPPED_SOL).select("mint")
        unknown = lambda rows: rows.join(known, rows["base_mint"] == known["mint"], "left_anti").join(known, rows["quote_mint"] == known["mint"], "left_anti").filter(F.col("block_time_s") >= cut - p.pending_ttl_s)
        held = self._keep(n, "early", unknown(early).unionByName(unknown(liquidity)))
        asks = held.withColumn("pos", prices.tx_position()).select(F.explode(F.array("base_mint", "quote_mint")).alias("quote_mint"), "pos")
        remembered = price_asof(asks.distinct(), px).filter("usd_per_unit is not null").withColumn("seq", F.lit(REMEMBERED))
        self._keep(n, "early_prices", remembered.select(*learned.columns))

        # Readings: the slice's, in front of them the few that carry the past.
        fresh = settle(prices.pool_readings(pairs, swaps, px), "readings")
        past = old(n, "pools", fresh)
        self._keep(n, "pools", reading_rows(past.unionByName(fresh)))
        rd = past.withColumn("_new", F.lit(False)).unionByName(fresh.withColumn("_new", F.col("at_s") > old_cut))
        rugs_before, said = old(n, "rugs", RUGS), old(n, "alerts", ALERTS)
        drained = settle(rules.rug_confirmations(rd.join(rugs_before.select("mint"), "mint", "left_anti"), tok, p, among=F.col("_new")), "drained")
        warned = lambda level: said.filter(F.col("level") == level).select("mint")
        red = rules.red_alerts(pair_moves(pairs), tok, rugs_before.select("mint", "pos").unionByName(drained.select("mint", "pos")), p)
        red = settle(red.join(warned("red"), "mint", "left_anti").select(*red.columns), "red")
        rugs = self._shaped(rules.mechanism(drained, warned("red").unionByName(red.select("mint"))), RUGS)
        rugs = settle(rugs, "rugs")
        rugs_all = self._keep(n, "rugs", rugs_before.unionByName(rugs))
        amber = rules.amber_alerts(graduations(norm["graduation"], tok), rugs_all, p)
        amber = amber.join(warned("amber"), "mint", "left_anti").select(*amber.columns)
        alerts = settle(self._shaped(rules.alerts_union(red, amber), ALERTS), "alerts")
        alerts_all = self._keep(n, "alerts", said.unionByName(alerts))

        self._put(n, "alerts", alert_records(alerts))
        self._put(n, "rugs", rug_records(rugs, alerts_all))
        if self.keep_facts:
            self._put(n, "readings", fresh)
            self._put(n, "moves", pair_moves(pairs))
            self._put(n, "graduations", graduations(norm["graduation"], tok).select(*GRADUATION))


def run_feed(frames: DataFrame, run: Callable, checkpoint: str) -> int:
    """Feed the stream to its end through ``run``; the number of the next batch."""
    last = [-1]

    def step(batch: DataFrame, n: int) -> None:
        run(batch, n)
        last[0] = max(last[0], n)

    query = frames.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last[0] + 1


def table_of(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The records of all batches."""
    return spark.read.parquet(f"{out_dir}/{name}").drop("batch")


def said(alerts: DataFrame, rugs: DataFrame) -> dict[str, DataFrame]:
    """What a detector remembers of its own records, from full records (a registry's): the state tables ``alerts`` and ``rugs``."""
    t, e = "trigger", "evidence"
    al = alerts.select("id", "level", "mint", "creator", "t_at", f"{t}.pos", f"{t}.pool", f"{t}.dex", f"{e}.quote_mint", f"{e}.quote_units", f"{e}.fingerprint", f"{e}.prior_rugs", f"{e}.n_prior")
    rg = rugs.select("mint", "creator", "t_at", f"{t}.pos", F.col(f"{t}.type").alias("event"), "actor", f"{t}.pool", f"{t}.dex", "peak_usd", "last_usd", "mechanism")
    return {"alerts": al, "rugs": rg}


def warm(spark: SparkSession, frames: DataFrame, known: dict[str, DataFrame], params: Params = DEFAULTS, **options) -> dict[str, DataFrame]:
    """The state after archived frames, as the start of a new stream.  ``known`` (``said``) is not said again; nothing of the archive is reported."""
    state, out = work_path(spark, "warm-state"), work_path(spark, "warm-out")
    run = Slices(spark, state, out, params, start={k: t for k, t in known.items()}, **options)
    run(frames.select("value"), 0)
    names = ("waiting", "seen", "ident", "prices", "early", "early_prices", "pools", "clock", "rugs", "alerts")
    return {k: spark.read.parquet(f"{state}/batch=0/{k}") for k in names}


def corrections(spark: SparkSession, run: Slices, n: int) -> DataFrame:
    """What late frames changed, up to batch ``n`` (of a run that keeps its facts): (kind, id, action, t_at, was_t_at, mechanism).

    The tokens that late frames name, and the graduations of their creators, are evaluated again over all filed facts.  A record that no longer comes out is a ``retract``, a new one an
    ``add``, one at another second or of another mechanism a ``change``.  Only the facts of those tokens are shuffled.
    """
    p, state = run.params, lambda name: spark.read.parquet(f"{run.state_dir}/batch={n}/{name}")
    facts = lambda name: table_of(spark, run.out_dir, name)
    named = facts("late").select(F.explode(F.regexp_extract_all("value", F.lit(MINT_KEYS), 1)).alias("mint")).distinct()
    tok = settle(token_dim(state("ident"), online=True), "tokens")
    touched = settle(tok.join(named, "mint", "left_semi"), "touched")
    mints, makers = touched.select("mint"), touched.select("creator").distinct()
    rd, moves = (facts(name).join(mints, "mint", "left_semi") for name in ("readings", "moves"))
    drained = settle(rules.rug_confirmations(rd, touched, p), "drained")
    red = settle(rules.red_alerts(moves, touched, drained, p), "red")
    rugs = rules.mechanism(drained, red)
    old_rugs, old_alerts = state("rugs"), state("alerts")
    all_rugs = old_rugs.join(mints, "mint", "left_anti").unionByName(run._shaped(rugs, RUGS)).join(makers, "creator", "left_semi")
    amber = rules.amber_alerts(facts("graduations").join(makers, "creator", "left_semi"), settle(all_rugs, "rugs"), p)
    none = F.lit(None).cast("string").alias("mechanism")
    shown = lambda rows, kind, id_, how=none: rows.select(F.lit(kind).alias("kind"), id_.alias("id"), "t_at", how)
    rug_id = F.concat(F.lit("rug:"), "mint")
    now = shown(rugs, "rug", rug_id, F.col("mechanism")).union(shown(red, "alert", F.col("id"))).union(shown(amber, "alert", F.col("id")))
    was_red = old_alerts.filter("level = 'red'").join(mints, "mint", "left_semi")
    was_amber = old_alerts.filter("level = 'amber'").join(makers, "creator", "left_semi")
    was = shown(old_rugs.join(mints, "mint", "left_semi"), "rug", rug_id, F.col("mechanism")).union(shown(was_red, "alert", F.col("id"))).union(shown(was_amber, "alert", F.col("id")))
    both = now.join(was.select("kind", "id", F.col("t_at").alias("was_t_at"), F.col("mechanism").alias("_how")), ["kind", "id"], "full")
    action = F.when(F.col("t_at").isNull(), "retract").when(F.col("was_t_at").isNull(), "add").when((F.col("t_at") != F.col("was_t_at")) | ~F.col("mechanism").eqNullSafe(F.col("_how")), "change")
    return both.withColumn("action", action).filter("action is not null").select("kind", "id", "action", "t_at", "was_t_at", "mechanism")
