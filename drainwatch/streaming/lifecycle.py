"""Stateful streams: the token's life and the creator's memory.

Two chained operators.  The first is keyed by token and raises red alerts, confirms drains, resolves
alerts by time and folds idle tokens; the second is keyed by creator and raises amber alerts.  The
processors only hold the running facts; everything before and after them is built-in
expressions.  Rows of a key come unsorted within a micro-batch and are put in chain order first.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from drainwatch.params import CURVE_DEXES, DEFAULTS, Params
from drainwatch.plans.tokens import tradable_venue

TOKEN = """creator string, created boolean, stage string, graduated boolean, peak decimal(28,6), top decimal(28,6), last_s bigint,
timer_ms bigint"""
# What the detector said of a token outlives the token's own state: it is not said twice.
SAID = "red_at bigint, rug_at bigint"
POOL = "usd decimal(28,6), dex string, place array<bigint>"
RECORD = """kind string, id string, mint string, creator string, t_at bigint, slot bigint, mechanism string, actor string,
peak_usd decimal(28,6), last_usd decimal(28,6), stage string, at timestamp, place array<bigint>"""
INPUT = ("mint", "type", "kind", "actor", "pool", "dex", "usd", "block_time_s", "slot", "at")


def place_of(ev: DataFrame) -> Column:
    """The whole position, part by part: many transactions share a second and a slot."""
    return F.array(*[F.col(f"pos.{f}").cast("bigint") for f in ev.schema["pos"].dataType.names])


def _by_position(row: Row) -> list[int]:
    return row.place


class TokenLife(StatefulProcessor):
    def __init__(self, params: Params = DEFAULTS, fold_idle: bool = False, resolve: bool = False):
        self.params, self.fold_idle, self.resolve = params, fold_idle, resolve

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.token = handle.getValueState("token", TOKEN)
        self.said = handle.getValueState("said", SAID)
        self.pools = handle.getMapState("pools", "pool string", POOL)

    def _load(self) -> tuple[dict, dict]:
        held = self.token.get() if self.token.exists() else (None, False, "created", False, None, None, 0, 0)
        said = self.said.get() if self.said.exists() else (None, None)
        names = [part.split()[0] for part in f"{TOKEN}, {SAID}".replace("decimal(28,6)", "decimal").split(",")]
        return dict(zip(names, (*held, *said), strict=True)), {k[0]: (v[0], v[1], list(v[2])) for k, v in self.pools.iterator()}

    def _store(self, tok: dict) -> None:
        self.token.update(tuple(tok.values())[:-2])
        if tok["red_at"] is not None or tok["rug_at"] is not None:
            self.said.update((tok["red_at"], tok["rug_at"]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Warm start: facts of one token from the batch state; nothing is emitted."""
        s = initialState
        self._store(dict(creator=s.creator, created=s.created, stage=s.stage, graduated=s.stage == "graduated", peak=s.peak, top=s.top, last_s=s.last_s, timer_ms=0,
                         red_at=s.red_at, rug_at=s.rug_at))
        for p in s.pools or []:
            self.pools.updateValue((p["pool"],), (p["usd"], p["dex"], list(p["place"])))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mint, (tok, pools) = key[0], self._load()
        out, changed = [], set()
        for r in sorted(rows, key=_by_position):
            tok["last_s"] = max(tok["last_s"], r.block_time_s)
            if r.type == "token_create":
                if not tok["created"]:
                    tok["creator"], tok["created"] = r.actor, True
            elif r.type == "graduation":
                tok["creator"] = tok["creator"] or r.actor
                tok["graduated"], tok["stage"] = True, "graduated"
                if tok["rug_at"] is None:
                    out.append(self._record("graduation", f"amber:{mint}", mint, tok, r))
            else:
                rug = self._reading(mint, tok, pools, changed, r)
                if rug is not None:
                    out.append(rug)
                if r.kind == "add" and r.actor == tok["creator"] and tok["red_at"] is None and tok["rug_at"] is None:
                    tok["red_at"] = r.block_time_s
                    out.append(self._record("alert", f"red:{mint}", mint, tok, r))
                    if self.resolve:
                        self.handle.registerTimer((r.block_time_s + self.params.resolve_s + 1) * 1000)
        for pool in changed:
            self.pools.updateValue((pool,), pools[pool])
        if self.fold_idle:
            limit = self.params.idle_graduated_s if tok["graduated"] else self.params.idle_curve_s
            due = (tok["last_s"] + limit + 1) * 1000
            if due != tok["timer_ms"]:
                if tok["timer_ms"]:
                    self.handle.deleteTimer(tok["timer_ms"])
                self.handle.registerTimer(due)
                tok["timer_ms"] = due
        self._store(tok)
        yield from out

    def _reading(self, mint: str, tok: dict, pools: dict, changed: set, r: Row) -> Row | None:
        """Apply one pool reading; the drain's record if this is the reading that completes it."""
        if r.usd is not None:
            tok["top"] = r.usd if tok["top"] is None else max(tok["top"], r.usd)
            if r.dex not in CURVE_DEXES:
                tok["peak"] = r.usd if tok["peak"] is None else max(tok["peak"], r.usd)
            before = pools.get(r.pool)
            if before is None or _by_position(r) > before[2]:
                pools[r.pool] = (r.usd, r.dex, list(r.place))
                changed.add(r.pool)
        if not tok["graduated"] or tok["rug_at"] is not None or tok["peak"] is None or tok["peak"] < self.params.min_peak_usd:
            return None
        held = [p[0] for p in pools.values() if p[1] not in CURVE_DEXES]
        if not held or sum(held) > self.params.max_floor_usd:
            return None
        tok["rug_at"] = r.block_time_s
        own = r.actor == tok["creator"]
        if r.type == "liquidity":
            how = ("creator-pull" if tok["red_at"] is not None else "migration-pull") if own else "third-party-remove"
        else:
            how = "dev-dump" if own else "sell-off"
        return self._record("rug", f"rug:{mint}", mint, tok, r, how, sum(held))

    def _record(self, kind: str, id_: str, mint: str, tok: dict, r: Row, how: str | None = None, last: Decimal | None = None) -> Row:
        return Row(kind=kind, id=id_, mint=mint, creator=tok["creator"], t_at=r.block_time_s, slot=r.slot, mechanism=how, actor=r.actor,
                   peak_usd=tok["peak"], last_usd=last, stage=tok["stage"], at=r.at, place=list(r.place))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mint, (tok, pools) = key[0], self._load()
        due = expiredTimerInfo.getExpiryTimeInMs()
        base = dict(mint=mint, creator=tok["creator"], slot=None, mechanism=None, actor=None, stage=tok["stage"], place=None)
        # Both may fall due at one moment.
        # A drain after the limit comes too late to confirm, whether or not the stream has seen it by now.
        late = tok["red_at"] is not None and (tok["rug_at"] is None or tok["rug_at"] > tok["red_at"] + self.params.resolve_s)
        if self.resolve and late and due == (tok["red_at"] + self.params.resolve_s + 1) * 1000:
            yield Row(kind="unconfirmed", id=f"unconfirmed:{mint}", t_at=tok["red_at"], peak_usd=None, last_usd=None, at=_moment(due), **base)
        if self.fold_idle and due == tok["timer_ms"]:
            held = [p[0] for p in pools.values() if not tok["graduated"] or p[1] not in CURVE_DEXES] or [p[0] for p in pools.values()]
            peak = tok["peak"] if tok["graduated"] and tok["peak"] is not None else tok["top"]
            self.token.clear()
            self.pools.clear()
            yield Row(kind="outcome", id=f"outcome:{mint}:{tok['last_s']}", t_at=tok["last_s"], peak_usd=peak, last_usd=sum(held) if held else None,
                      at=_moment(due), **base)

    def close(self) -> None:
        pass


def _put(state, rows: list) -> None:
    """A list state cannot hold an empty list."""
    if rows:
        state.put(rows)
    elif state.exists():
        state.clear()


def _moment(ms: int):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc).replace(tzinfo=None)


class CreatorMemory(StatefulProcessor):
    """How many drains a creator has, the newest of them, and the tokens already warned about."""

    def __init__(self, params: Params = DEFAULTS):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")
        self.newest = handle.getListState("newest", "mint string, t_at bigint")
        self.drained = handle.getMapState("drained", "mint string", "t_at bigint")
        self.warned = handle.getMapState("warned", "mint string", "t_at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        count = self.count.get()[0] if self.count.exists() else 0
        newest = [tuple(d) for d in self.newest.get()] if self.newest.exists() else []
        for r in sorted(rows, key=_by_position):
            if r.kind == "rug":
                if not self.drained.containsKey((r.mint,)):
                    self.drained.updateValue((r.mint,), (r.t_at,))
                    count, newest = count + 1, [*newest, (r.mint, r.t_at)]
                    # Enough to show, one more as one may be the asking token, and all of the newest second.
                    older = [d for d in newest if d[1] < r.t_at][-self.params.prior_rugs_shown - 1 :]
                    newest = older + [d for d in newest if d[1] >= r.t_at]
                continue
            if self.warned.containsKey((r.mint,)):
                continue
            own = self.drained.getValue((r.mint,))[0] if self.drained.containsKey((r.mint,)) else None
            n_prior = count - sum(d[1] >= r.t_at for d in newest) - (own is not None and own < r.t_at)
            if n_prior > 0:
                self.warned.updateValue((r.mint,), (r.t_at,))
                shown = [d[0] for d in reversed(newest) if d[0] != r.mint and d[1] < r.t_at][: self.params.prior_rugs_shown]
                yield Row(id=f"amber:{r.mint}", mint=r.mint, creator=key[0], t_at=r.t_at, slot=r.slot, n_prior=n_prior, prior_rugs=shown)
        self.count.update((count,))
        _put(self.newest, newest)

    def close(self) -> None:
        pass


AMBER = "id string, mint string, creator string, t_at bigint, slot bigint, n_prior bigint, prior_rugs array<string>"


def token_records(ev: DataFrame, params: Params = DEFAULTS, fold_idle: bool = False, resolve: bool = False, initial: DataFrame | None = None) -> DataFrame:
    """Red alerts, drains and graduations (and, on request, resolutions and outcomes) as they happen.

    ``ev`` carries a watermark on ``at`` (event_clock).
    """
    rows = ev.select(*INPUT, place_of(ev).alias("place")).withColumn("usd", F.col("usd").cast("decimal(28,6)"))
    return rows.groupBy("mint").transformWithState(
        statefulProcessor=TokenLife(params, fold_idle, resolve), outputStructType=RECORD, outputMode="Append", timeMode="EventTime",
        initialState=None if initial is None else initial.groupBy("mint"), eventTimeColumnName="at",
    )


def initial_tokens(ev: DataFrame, rd: DataFrame, tok: DataFrame, red: DataFrame, rg: DataFrame) -> DataFrame:
    """The batch state as the first state of the stream: one row per token with its few pools."""
    usd = lambda c: c.cast("decimal(28,6)")
    latest = rd.groupBy("mint", "pool").agg(F.max_by(F.struct("usd", "dex", place_of(rd).alias("place")), "pos").alias("r"))
    pools = latest.groupBy("mint").agg(F.collect_list(F.struct(
        "pool", usd(F.col("r.usd")).alias("usd"), F.col("r.dex").alias("dex"), F.col("r.place").alias("place"))).alias("pools"))
    tops = rd.groupBy("mint").agg(usd(F.max(F.when(tradable_venue(), F.col("usd")))).alias("peak"), usd(F.max("usd")).alias("top"))
    seen = ev.groupBy("mint").agg(F.max("block_time_s").alias("last_s"))
    rows = seen.join(tok.select("mint", "creator", F.col("created_at_s").isNotNull().alias("created"), "stage"), "mint", "left")
    for part in (tops, pools, red.select("mint", F.col("t_at").alias("red_at")), rg.select("mint", F.col("t_at").alias("rug_at"))):
        rows = rows.join(part, "mint", "left")
    return rows.na.fill({"stage": "created", "created": False})


def amber_records(records: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Amber alerts from drains and graduations, by creator."""
    rows = records.filter(F.col("kind").isin("rug", "graduation") & F.col("creator").isNotNull())
    return rows.groupBy("creator").transformWithState(
        statefulProcessor=CreatorMemory(params), outputStructType=AMBER, outputMode="Append", timeMode="None"
    )


class HeldPairs(StatefulProcessor):
    """Pair events that come before their token wait for it, and lapse after the limit."""

    def __init__(self, ttl_s: int = DEFAULTS.pending_ttl_s):
        self.ttl_s = ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "t bigint")
        self.waiting = handle.getListState("waiting", "t bigint, slot bigint, place array<bigint>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.known.get()[0] if self.known.exists() else None
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        for r in sorted(rows, key=_by_position):
            if r.type == "liquidity":
                if known is not None:
                    yield Row(mint=key[0], slot=r.slot, held=False, place=list(r.place))
                else:
                    waiting.append((r.block_time_s, r.slot, list(r.place)))
                    self.handle.registerTimer((r.block_time_s + self.ttl_s + 1) * 1000)
            elif known is None:
                known = r.block_time_s
                self.known.update((known,))
                for t, slot, place in waiting:
                    if t >= known - self.ttl_s:
                        yield Row(mint=key[0], slot=slot, held=True, place=list(place))
                waiting = []
        _put(self.waiting, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now_s = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if self.waiting.exists():
            _put(self.waiting, [tuple(w) for w in self.waiting.get() if w[0] + self.ttl_s >= now_s])
        return iter(())

    def close(self) -> None:
        pass


def release_early_pairs(ev: DataFrame, ttl_s: int = DEFAULTS.pending_ttl_s) -> DataFrame:
    """mint, slot, held, place: pair events of followed tokens, early ones once their token appears."""
    rows = ev.filter(F.col("type").isin("token_create", "graduation", "liquidity")).select("mint", "type", "block_time_s", "slot", "at", place_of(ev).alias("place"))
    return rows.groupBy("mint").transformWithState(
        statefulProcessor=HeldPairs(ttl_s), outputStructType="mint string, slot bigint, held boolean, place array<bigint>", outputMode="Append", timeMode="EventTime"
    )
