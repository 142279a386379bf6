"""Field rules of the raw frames, as column expressions over VARIANT values.

A VARIANT keeps what JSON said: an integer past 2^53 stays exact, and text that looks like a number
stays text, so a field that changes its JSON kind is caught instead of coerced.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The decimal text pattern, the safe integer bound, the border between seconds and
# milliseconds, and the resolver's "no timestamp".
DECIMAL_TEXT = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
SAFE_INT = 9007199254740991
UNIT_BORDER = 100_000_000_000
NO_TIMESTAMP = 9223372036854775807


def get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def kind_of(raw: Column) -> Column:
    """JSON kind of a value: STRING, BIGINT, DECIMAL(p,s), VOID ...; null when it is missing."""
    return F.schema_of_variant(raw)


def _value(raw: Column, kind: str) -> Column:
    return F.try_variant_get(raw, "$", kind)


def text_of(raw: Column) -> Column:
    return _value(raw, "string")


def is_text(raw: Column) -> Column:
    return F.coalesce(kind_of(raw) == "STRING", F.lit(False))


def is_whole(raw: Column) -> Column:
    return F.coalesce(kind_of(raw).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$"), F.lit(False))


def is_missing(raw: Column) -> Column:
    return kind_of(raw).isNull()


def is_null(raw: Column) -> Column:
    return F.coalesce(kind_of(raw) == "VOID", F.lit(False))


def _between(raw: Column, low: int, high: int) -> Column:
    whole = _value(raw, "decimal(38,0)")
    return is_whole(raw) & F.coalesce(whole.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)")), F.lit(False))


def validate_decimal(raw: Column) -> Column:
    return is_text(raw) & F.coalesce(_value(raw, "string").rlike(DECIMAL_TEXT), F.lit(False))


def validate_int(raw: Column) -> Column:
    return _between(raw, -SAFE_INT, SAFE_INT)


def validate_seconds(raw: Column) -> Column:
    return _between(raw, 0, UNIT_BORDER - 1)


def validate_millis(raw: Column) -> Column:
    return _between(raw, UNIT_BORDER, SAFE_INT)


def validate_millis_or_none(raw: Column) -> Column:
    return validate_millis(raw) | _between(raw, NO_TIMESTAMP, NO_TIMESTAMP)


def validate_bool(raw: Column) -> Column:
    return F.coalesce(kind_of(raw) == "BOOLEAN", F.lit(False))


def validate_enum(*allowed: str) -> Callable[[Column], Column]:
    return lambda raw: is_text(raw) & F.coalesce(_value(raw, "string").isin(*allowed), F.lit(False))


def validate_texts(raw: Column) -> Column:
    items = _value(raw, "array<variant>")
    return F.coalesce(F.forall(items, is_text), F.lit(False))


def validate_text_map(raw: Column) -> Column:
    values = F.map_values(_value(raw, "map<string,variant>"))
    return F.coalesce(F.forall(values, lambda x: is_text(x) | is_null(x)), F.lit(False))


def to_decimal(raw: Column) -> Column:
    return _value(raw, "string").try_cast("decimal(38,18)")


def _as(kind: str) -> Callable[[Column], Column]:
    return lambda raw: _value(raw, kind)


def blank_as_null(raw: Column) -> Column:
    text = _value(raw, "string")
    return F.when(text != "", text)


@dataclass(frozen=True)
class Kind:
    """What a field must be and how it is read."""

    expected: str
    valid: Callable[[Column], Column]
    read: Callable[[Column], Column]


def enum(*allowed: str) -> Kind:
    return Kind("one of " + ", ".join(allowed), validate_enum(*allowed), _as("string"))


def optional(kind: Kind) -> Kind:
    """May be missing, but not null."""
    return Kind(kind.expected, lambda raw: is_missing(raw) | kind.valid(raw), kind.read)


def nullish(kind: Kind) -> Kind:
    """May be missing or null."""
    return Kind(kind.expected, lambda raw: is_missing(raw) | is_null(raw) | kind.valid(raw), kind.read)


TEXT = Kind("text", is_text, _as("string"))
BLANKABLE = nullish(Kind("text", is_text, blank_as_null))
DECIMAL = Kind("a decimal text", validate_decimal, to_decimal)
INT = Kind("a whole number", validate_int, _as("bigint"))
RAW = Kind("a whole amount", is_whole, _as("decimal(38,0)"))
SECONDS = Kind("unix seconds", validate_seconds, _as("bigint"))
MILLIS = Kind("unix milliseconds", validate_millis, _as("bigint"))
MILLIS_OR_NONE = Kind(
    "unix milliseconds", validate_millis_or_none, lambda raw: F.nullif(_value(raw, "bigint"), F.lit(NO_TIMESTAMP))
)
SECONDS_OR_ZERO = Kind("unix seconds", validate_seconds, lambda raw: F.nullif(_value(raw, "bigint"), F.lit(0).cast("bigint")))
BOOL = Kind("true or false", validate_bool, _as("boolean"))
TEXTS = Kind("a list of texts", validate_texts, _as("array<string>"))
TEXT_MAP = Kind("a map of texts", validate_text_map, _as("map<string,string>"))
ANY = Kind("anything", lambda raw: F.lit(True), lambda raw: raw)


def collect_issues(checks: list[tuple[str, Column]], shown: int | None = None) -> Column:
    """``path: expected ...`` for every failed check, in declared order."""
    issues = F.filter(F.array(*[F.when(~ok, F.lit(text)) for text, ok in checks]), lambda x: x.isNotNull())
    return issues if shown is None else F.slice(issues, 1, shown)
