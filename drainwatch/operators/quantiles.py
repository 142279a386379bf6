"""Exact index quantiles and AUC over distributed groups.

Both count equal values first, so what is ordered is the table of distinct values, and both use
``running`` for the order, so a group with very many distinct values is not one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drainwatch.operators.running import Running, running, value_bucket
from drainwatch.session import settle

# Which sorted element (0-based) a quantile is.  The three reports use three rules.
RULES = {
    "report": lambda p, n: F.least(n - 1, F.floor(F.lit(p) * n)),
    "extract": lambda p, n: F.floor(F.lit(p) * (n - 1)),
    "median": lambda p, n: F.floor(n / F.lit(2)),
}


def _counted(df: DataFrame, group: list[str], value: str, aggs: list[Column]) -> DataFrame:
    """Equal values counted, and written: what follows reads the counts several times, the input once."""
    return settle(df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(*aggs), "counted")


def _ranked(counted: DataFrame, group: list[str], value: str, specs: list[Running]) -> DataFrame:
    return running(counted, group, [value], specs, bucket=value_bucket(F.col(value)))


def _with_sizes(ranked: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """Sizes of the groups beside their values (a null group is one)."""
    renamed = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[c for c in sizes.columns if c not in group])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    return ranked.join(renamed, same).drop(*[f"_g_{g}" for g in group])


def _pick(value: str, count: str, upto: str, n: str, ps: dict[str, float], rule: str) -> list[Column]:
    """The value that holds each index, as aggregates over ranked counts."""
    out = []
    for name, p in ps.items():
        index = RULES[rule](p, F.col(n))
        hit = (F.col(upto) - F.col(count) <= index) & (index < F.col(upto))
        out.append(F.max(F.when(hit, F.col(value))).alias(name))
    return out


def index_quantiles(
    df: DataFrame,
    group: list[str],
    value: str,
    ps: dict[str, float],
    rule: str = "report",
) -> DataFrame:
    """One row per group: ``n`` and one column per entry of ``ps`` (column name -> p)."""
    if not group:
        one = index_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, ps, rule)
        return one.drop("_all")
    return counted_quantiles(_counted(df, group, value, [F.count(F.lit(1)).alias("_c")]), group, value, ps, rule)


def counted_quantiles(counted: DataFrame, group: list[str], value: str, ps: dict[str, float], rule: str = "report") -> DataFrame:
    """The same from a table of (group, value, _c), which is read several times."""
    ranked = _ranked(counted, group, value, [Running("_upto", "sum", "_c")])
    joined = _with_sizes(ranked, counted.groupBy(*group).agg(F.sum("_c").alias("n")), group)
    return joined.groupBy(*group).agg(F.max("n").alias("n"), *_pick(value, "_c", "_upto", "n", ps, rule))


def compare_classes(df: DataFrame, group: list[str], score: str, label: str, ps: dict[str, float], rule: str = "report") -> DataFrame:
    """Quantiles of either class (one row per group and ``label``) beside the group's AUC, from one table of counts and one running sum."""
    both = _counted(df, group, score, [F.count_if(F.col(label)).alias("_p"), F.count_if(~F.col(label)).alias("_n")])
    ranked = _ranked(both, group, score, [Running("_p_upto", "sum", "_p"), Running("_n_upto", "sum", "_n")])
    joined = _with_sizes(ranked, both.groupBy(*group).agg(F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns")), group)
    picks = [*[x.alias(f"_p_{n}") for x, n in zip(_pick(score, "_p", "_p_upto", "_ps", ps, rule), ps, strict=True)],
             *[x.alias(f"_n_{n}") for x, n in zip(_pick(score, "_n", "_n_upto", "_ns", ps, rule), ps, strict=True)]]
    won = F.col("_p").cast("decimal(19,0)") * ((F.col("_n_upto") - F.col("_n")) * 2 + F.col("_n")).cast("decimal(19,0)")
    rows = joined.groupBy(*group).agg(F.max("_ps").alias("_ps"), F.max("_ns").alias("_ns"), F.sum(won).alias("_won"), *picks)
    pairs = F.col("_ps").cast("double") * F.col("_ns").cast("double")
    side = lambda flag, c: F.struct(F.lit(flag).alias(label), F.col(f"_{c}s").alias("n"), *[F.col(f"_{c}_{n}").alias(n) for n in ps])
    sides = rows.select(*group, F.when(pairs > 0, F.col("_won").cast("double") / (pairs * 2)).alias("auc"), F.explode(F.array(side(True, "p"), side(False, "n"))).alias("_side"))
    return sides.select(*group, "_side.*", "auc").filter("n > 0")


def auc(df: DataFrame, score: str, label: Column, group: list[str] | None = None) -> DataFrame:
    """P(a positive scores above a negative), ties half: one row per group, null if a side is empty."""
    group = group or []
    base = df.withColumn("_pos", F.when(label, 1).otherwise(0).cast("long"))
    counts = _counted(base, group, score, [F.sum("_pos").alias("_p"), F.sum(F.lit(1) - F.col("_pos")).alias("_n")])
    counted = _ranked(counts, group, score, [Running("_below", "sum", "_n", before=True)])
    # Twice the number of won pairs is a whole number: summed exactly, divided once.
    won = F.col("_p").cast("decimal(19,0)") * (F.coalesce("_below", F.lit(0)) * 2 + F.col("_n")).cast("decimal(19,0)")
    totals = counted.groupBy(*group).agg(F.sum(won).alias("_won"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    value = F.when(pairs > 0, F.col("_won").cast("double") / (pairs * 2))
    return totals.select(*group, "n_pos", "n_neg", value.alias("auc"))
