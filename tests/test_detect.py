"""Raw frames in, records out."""

import json

from drainwatch.params import WRAPPED_SOL
from drainwatch.plans import detect

AT = 1_802_000_000


class Feed:
    """Frames of a small market; one slot per call unless told otherwise."""

    def __init__(self):
        self.frames, self.n = [], 0

    def tx(self, t, type_, **fields):
        self.n += 1
        self.frames.append({"type": type_, "signature": f"s{self.n}", "slot": 900_000 + t // 2, "block_time": AT + t, "tx_index": self.n, "ix_index": 0, "inner_ix_index": -1,
                            "indexed_at": (AT + t) * 1000 + 300, **fields})
        return self

    def create(self, t, mint, who):
        return self.tx(t, "token_create", kind="token", dex="pumpfun", mint=mint, pool=f"{mint}-curve", base_mint=mint, quote_mint=WRAPPED_SOL, name="n", symbol="s", creator=who)

    def graduate(self, t, mint, who):
        self.n += 1
        self.frames.append({"type": "graduation", "mint": mint, "launchpad": "pumpfun", "creator": who, "created_time": AT, "pool": f"{mint}-amm", "dex": "pumpswap", "slot": 900_000 + t // 2, "block_time": AT + t})
        return self

    def move(self, t, mint, who, kind, sol, reserve, usd=120):
        return self.tx(t, "liquidity", dex="pumpswap", pool=f"{mint}-amm", kind=kind, provider=who, base_mint=mint, quote_mint=WRAPPED_SOL, base_amount=5, quote_amount=int(sol * 10**9), base_decimals=6,
                       quote_decimals=9, base_reserve=7, quote_reserve=int(reserve * 10**9), base_usd="0", quote_usd=str(sol * usd))

    def swap(self, t, mint, who, sol, reserve, usd=120):
        return self.tx(t, "swap", dex="pumpswap", pool=f"{mint}-amm", mint=mint, quote_mint=WRAPPED_SOL, trader=who, side="sell", base_amount=5, quote_amount=int(sol * 10**9), base_decimals=6, quote_decimals=9,
                       base_reserve=7, quote_reserve=int(reserve * 10**9), fee_amount=0, fee_mint=WRAPPED_SOL, fee_pct="0.1", fee_paid_out=0, price_impact_pct="0", price="1", price_usd="1", volume_usd=str(sol * usd),
                       candle_ok=True, virtual_base_reserve=0, virtual_quote_reserve=0)


def market():
    f = Feed()
    f.create(0, "One", "dev").graduate(30, "One", "dev").move(60, "One", "dev", "add", 85, 85).swap(300, "One", "crowd", 2, 95).move(650, "One", "dev", "remove", 94.99, 0.01)
    f.create(700, "Two", "dev").graduate(760, "Two", "dev").swap(790, "Two", "crowd", 1, 20).swap(900, "Two", "dev", 19.99, 0.01)
    f.create(5, "Calm", "other").graduate(100, "Calm", "other").move(140, "Calm", "friend", "add", 50, 50)
    return f.frames


def test_frames_to_records_whatever_the_order_and_the_repeats(spark):
    frames = market()
    broken = [{**frames[0], "slot": "x"}, {"type": "nothing"}]
    for rows in (frames, [*reversed(frames), *frames[:5], *broken]):
        raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
        alerts, drains = detect.detect(raw)
        al, rg = {r.id: r for r in alerts.collect()}, {r.mint: r for r in drains.collect()}
        assert set(al) == {"red:One", "amber:Two"} and set(rg) == {"One", "Two"}
        red, amber = al["red:One"], al["amber:Two"]
        assert (red.t_at - AT, red.rule, float(red.evidence.quote_units), red.evidence.fingerprint, red.trigger.type) == (60, "creator-adds-liquidity", 85.0, True, "liquidity")
        assert (amber.t_at - AT, amber.evidence.n_prior, [p["mint"] for p in amber.evidence.prior_rugs], amber.trigger.type) == (760, 1, ["One"], "graduation")
        assert red.confidence.fired > 0 and 0 < red.confidence.precision < 1
        assert (rg["One"].mechanism, [(a.id, a.lead_s) for a in rg["One"].alerts]) == ("creator-pull", [("red:One", 590)])
        assert (rg["Two"].mechanism, [(a.id, a.lead_s) for a in rg["Two"].alerts]) == ("dev-dump", [("amber:Two", 140)])
        lines = [r.line for r in detect.describe(alerts).orderBy("t_at").collect()]
        assert "85.0000 of the quote asset" in lines[0] and "drained 1 before" in lines[1]
