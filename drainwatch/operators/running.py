"""Running aggregates that stay exact and parallel whatever the size of a key.

A plain ``Window.partitionBy(key).orderBy(pos)`` puts a whole key into one task.  Here the order is cut into buckets of
fixed width (an hour of chain time, a block of lines, a step of value), and one plan serves every size:

* each (key, bucket) is summed up by an aggregate that combines before the shuffle;
* a window over those sums, one row per bucket, gives what every bucket inherits from the earlier ones of its key;
* the inherited value joins the bucket's rows as one more row in front of them, and a window over (key, bucket) runs over both.

The rows are shuffled once.  No count decides anything, nothing is written in between, and no row is joined to another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType, StructType, TimestampType

from drainwatch.session import dealt

BUCKET = "_bucket"
FRONT = "_front"
# Width of a bucket in the unit of the order's first number: an hour of seconds.
HOUR = 3600


@dataclass(frozen=True)
class Running:
    """One output column.  ``fn``: sum, max, min, count or last (newest non-null value).

    ``before=True`` leaves the current row out (a lag-like view of everything earlier).
    """

    name: str
    fn: str
    col: str
    before: bool = False


_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}


def _leading(column: Column, kind: DataType) -> tuple[Column, DataType]:
    while isinstance(kind, StructType):
        column, kind = column[kind[0].name], kind[0].dataType
    return column, kind


def bucket_of(df: DataFrame, order: str, width: int = HOUR) -> Column:
    """A coarse step of the order: rows of a lower bucket come before rows of a higher one."""
    column, kind = _leading(F.col(order), df.select(order).schema[0].dataType)
    if isinstance(kind, TimestampType):
        column = F.unix_timestamp(column)
    if isinstance(kind, NumericType | TimestampType):
        return F.floor(column / width)
    if isinstance(kind, StringType):
        # Stamped names: their beginning, down to the minute of the stamp.
        return F.substring(column, 1, 24)
    raise TypeError(f"no steps are known for an order of {kind.simpleString()}: give a bucket that does not fall along it")


def value_bucket(column: Column) -> Column:
    """Steps of about 0.4 % of a value, either sign: for orders by value, whose scale is not known."""
    value = column.cast("double")
    # In millionths, so that small values spread as well.
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1_000_000) * 256)


def _all(spec: Running, order: list[str]) -> Column:
    if spec.fn == "last":
        return F.max_by(spec.col, F.when(F.col(spec.col).isNotNull(), F.struct(*order)))
    return F.count(spec.col) if spec.fn == "count" else _AGG[spec.fn](spec.col)


def _over(spec: Running, column: str, window) -> Column:
    value = F.last(column, ignorenulls=True).over(window) if spec.fn == "last" else _AGG[spec.fn](column).over(window)
    return F.coalesce(value, F.lit(0).cast("bigint")) if spec.fn == "count" else value


def running(df: DataFrame, keys: list[str], order: list[str], specs: list[Running], width: int = HOUR, bucket: Column | None = None) -> DataFrame:
    """Add one running column per spec.  ``order`` must identify a row within its key; ``bucket`` must not fall along it."""
    rows = df.withColumn(BUCKET, bucket_of(df, order[0], width) if bucket is None else bucket)
    held = [f"_held_{s.name}" for s in specs]
    totals = rows.groupBy(*keys, BUCKET).agg(*[_all(s, order).alias(h) for s, h in zip(specs, held, strict=True)])
    totals = dealt(totals, *keys) if keys else totals
    # One row per key and bucket; nulls of the order come first here as they do in it.
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    fronts = totals.select(*keys, BUCKET, F.lit(0).alias(FRONT), *[_over(s, h, earlier).alias(h) for s, h in zip(specs, held, strict=True)])

    def own(spec: Running, name: str) -> Column:
        value = F.col(spec.col).isNotNull().cast("bigint") if spec.fn == "count" else F.col(spec.col).cast(totals.schema[name].dataType)
        return value.alias(name)

    both = rows.select("*", F.lit(1).alias(FRONT), *[own(s, h) for s, h in zip(specs, held, strict=True)]).unionByName(fronts, allowMissingColumns=True)
    # By key and bucket also where the input is by key already: a large key is not one task.
    both = dealt(both, *keys, BUCKET)
    window = Window.partitionBy(*keys, BUCKET).orderBy(FRONT, *order)
    frame = lambda s: window.rowsBetween(Window.unboundedPreceding, -1 if s.before else Window.currentRow)
    run = both.select("*", *[_over(s, h, frame(s)).alias(s.name) for s, h in zip(specs, held, strict=True)])
    return run.filter(F.col(FRONT) == 1).select(*df.columns, *[s.name for s in specs])
