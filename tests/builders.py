"""Small hand-made histories."""

from decimal import Decimal

T0 = 1_805_000_040
EV = """type string, kind string, mint string, pool string, dex string, actor string, block_time_s bigint, slot bigint,
pos struct<block_time_s:bigint,slot:bigint>, usd decimal(18,2)"""


class History:
    """Token events in the operators' shape; each call adds one event at T0 + t."""

    def __init__(self):
        self.rows, self.slot = [], 0

    def _add(self, type_, t, mint, actor, pool=None, dex=None, kind=None, usd=None):
        self.slot += 1
        at = T0 + t
        self.rows.append((type_, kind, mint, pool, dex, actor, at, self.slot, (at, self.slot), None if usd is None else Decimal(str(usd))))
        return self

    def create(self, mint, actor, t):
        return self._add("token_create", t, mint, actor, f"curve-{mint}", "pumpfun")

    def graduate(self, mint, actor, t):
        return self._add("graduation", t, mint, actor, f"amm-{mint}", "pumpswap")

    def liquidity(self, mint, actor, t, kind, usd, pool=None, dex="pumpswap"):
        return self._add("liquidity", t, mint, actor, pool or f"amm-{mint}", dex, kind, usd)

    def swap(self, mint, actor, t, usd, pool=None, dex="pumpswap"):
        return self._add("swap", t, mint, actor, pool or f"amm-{mint}", dex, None, usd)

    def df(self, spark):
        return spark.createDataFrame(self.rows, EV)


def detect(ev, params=None):
    """(alerts by id, drains by mint) of a history."""
    from drainwatch.catalog.adapter import readings
    from drainwatch.params import DEFAULTS
    from drainwatch.plans import rules, tokens

    from pyspark.sql import functions as F

    params = params or DEFAULTS
    rd, tok = readings(ev), tokens.token_dim(ev)
    rug0 = rules.rug_confirmations(rd, tok, params)
    red = rules.red_alerts(ev.filter("type = 'liquidity'"), tok, rug0, params)
    rg = rules.mechanism(rug0, red)
    grads = ev.filter("type = 'graduation'").join(tok.select("mint", F.col("creator").alias("c")), "mint", "left").withColumn("creator", F.coalesce("c", "actor"))
    amber = rules.amber_alerts(grads, rg, params)
    al = rules.alerts_union(red, amber)
    return {r.id: r for r in al.collect()}, {r.mint: r for r in rg.collect()}
