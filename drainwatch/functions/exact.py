"""Decimal text as an exact number: a whole number of up to 38 digits and a power of ten.

The feed writes amounts as text of any size ("1e-25", "1e21").  A column of one scale holds most of them; ``fits`` tells which, and the rest stay exact here.  Numbers are kept without trailing zeros, so equal
numbers are equal structs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(-?)(\d+)(?:\.(\d+))?(?:[eE]([-+]?\d+))?$"
# What a decimal(38,18) column holds: digits before and after the point.
WHOLE, FRACTION = 20, 18
DIGITS = 38
# Nearly every number of the feed: it fits as it is written.
PLAIN = rf"^-?\d{{1,{WHOLE}}}(\.\d{{1,{FRACTION}}})?$"


def _parts(text: Column) -> tuple[Column, Column, Column, Column]:
    """(sign, significant digits without zeros at either end, power of ten of the last of them, its text is a number)."""
    part = lambda n: F.regexp_extract(text, PARTS, n)
    told = F.concat(part(2), part(3))
    digits = F.regexp_replace(told, "^0+|0+$", "")
    behind = F.length(told) - F.length(F.regexp_replace(told, "0+$", ""))
    power = F.coalesce(part(4).try_cast("int"), F.lit(0)) - F.length(part(3)) + behind
    return part(1), digits, F.when(digits != "", power).otherwise(F.lit(0)), text.rlike(PARTS)


def exact(text: Column) -> Column:
    """struct<digits: decimal(38,0), power: int>; null for what is no number or has more than 38 digits."""
    sign, digits, power, number = _parts(text)
    whole = F.concat(sign, F.when(digits == "", "0").otherwise(digits)).try_cast("decimal(38,0)")
    return F.when(number & (F.length(digits) <= DIGITS), F.struct(whole.alias("digits"), power.alias("power")))


def fits(text: Column) -> Column:
    """Whether a decimal(38,18) holds the number to its last digit."""
    _, digits, power, number = _parts(text)
    long = number & ((digits == "") | ((power >= -FRACTION) & (F.length(digits) + power <= WHOLE)))
    # Taking a number apart is a dozen patterns: only where one does not tell.
    return F.when(text.rlike(PLAIN), F.lit(True)).otherwise(long)


def order_key(number: Column) -> Column:
    """A struct that compares as the number does."""
    digits = F.abs(number["digits"]).cast("string")
    sign = F.signum(number["digits"].cast("double")).cast("int")
    size = F.when(sign != 0, F.length(digits) + number["power"]).otherwise(F.lit(0))
    padded = F.rpad(digits, DIGITS, "0").cast("decimal(38,0)")
    return F.when(number.isNotNull(), F.struct(sign.alias("sign"), (sign * size).alias("size"), (sign * padded).cast("decimal(38,0)").alias("digits")))


def times(a: Column, b: Column) -> Column:
    """The exact product; null where it has more than 38 digits."""
    shown = F.try_multiply(a["digits"].cast("decimal(38,0)"), b["digits"].cast("decimal(38,0)")).try_cast("decimal(38,0)")
    long = F.length(F.abs(a["digits"]).cast("string")) + F.length(F.abs(b["digits"]).cast("string")) > DIGITS
    bare = F.regexp_replace(shown.cast("string"), "0+$", "")
    zeros = F.length(shown.cast("string")) - F.length(bare)
    product = F.when(shown == 0, F.struct(F.lit(0).cast("decimal(38,0)").alias("digits"), F.lit(0).alias("power"))).otherwise(
        F.struct(bare.try_cast("decimal(38,0)").alias("digits"), (a["power"] + b["power"] + zeros).cast("int").alias("power"))
    )
    return F.when(shown.isNotNull() & ~long, product)


def told(name: str, column: str | None = None, inexact: str = "inexact") -> Column:
    """The exact number of a typed column: its own value, or the text kept beside the row where the column could not hold it."""
    kept = F.filter(inexact, lambda x: F.startswith(x, F.lit(name + "=")))
    text = F.substring(F.get(kept, 0), len(name) + 2, 1000)
    return exact(F.coalesce(text, F.col(column or name).cast("string")))
