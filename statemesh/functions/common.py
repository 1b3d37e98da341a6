"""Building blocks for Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal types: raw numerals, scale words and ratio factors, so chosen that their products are exact; canonical values.
RAW, SCALE, FACTOR, CANONICAL = "decimal(24,6)", "decimal(13,0)", "decimal(4,4)", "decimal(38,10)"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: expressions stay as long as they are written."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null where there is no match or the group took no part."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def first_of(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first case that holds."""
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def lookup(key: Column, table: dict[str, object], kind: str = "string") -> Column:
    """table[key], or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key).cast(kind)


def make_date(year: Column, month: Column | int, day: Column | int) -> Column:
    """A date, or null where there is no such day."""
    part = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    sound = part(year).between(1, 9999)
    return F.when(sound, F.try_to_date(F.format_string("%04d-%02d-%02d", part(year), part(month), part(day)), "yyyy-MM-dd"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def escape(text: str) -> str:
    """text as a literal in a pattern."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in text)
