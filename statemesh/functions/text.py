"""Text as it was typeset: what differs only by extraction is made equal."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import strip

#: Invisible characters that count as blanks.
INVISIBLE = "\u00a0\u2007\u202f\u2009\u200a\u200b\u200c\u200d\u2060\u00ad\ufeff"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), INVISIBLE, " " * len(INVISIBLE)), r"(?U)\s+", " "))


def normalise_text(text: Column, ascii_only: bool = False) -> Column:
    """NFKC, invisible characters and runs of white space to one blank.

    Spark has no NFKC: texts beyond ASCII go through an Arrow UDF. ascii_only leaves that out for data known to be ASCII,
    which keeps the expression in generated code.
    """
    if ascii_only:
        return collapsed(text)
    return collapsed(_nfkc(F.translate(F.coalesce(text, F.lit("")), INVISIBLE, " " * len(INVISIBLE))))


def numeric_key(text: Column, ascii_only: bool = False) -> Column:
    """What identifies a numeral: no commas, blanks, long dashes, leading plus or trailing stop."""
    bare = F.regexp_replace(normalise_text(text, ascii_only), "(?U)[,\\s−–—]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^\++", ""), r"\.+$", "")


def digit_ratio(text: Column) -> Column:
    """Share of digits; 1 for an empty text."""
    digits = F.length(F.regexp_replace(text, r"(?U)\D", ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(digits / F.greatest(F.length(text), F.lit(1)))


def is_prose(text: Column, kind: Column) -> Column:
    """A block worth reading for facts: 60 to 2000 characters, no table, few digits, two plain words in a row."""
    t = strip(text)
    fits = F.length(t).between(60, 2000)
    return fits & (kind != "table") & (digit_ratio(t) <= 0.16) & t.rlike(r"(?U)[a-z]{3,}\s+[a-z]{3,}")


def tolerant_json(text: Column, schema: str) -> Column:
    """from_json of the whole text, else of what stands between the first and the last brace."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.from_json(F.trim(text), schema)
    complete = text.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(complete, whole).when(inner != "", F.from_json(inner, schema))


def markdown_table(rows: Column) -> Column:
    """Rows (array of arrays of cells) as a pipe table, padded to the widest row, ruled under the first."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))

    def line(row: Column) -> Column:
        padded = F.concat(F.transform(row, cell), F.array_repeat(F.lit(""), width - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")).otherwise(F.lit(""))


def header_path(rows: Column) -> Column:
    """Non-empty cells of the first row, or null."""
    cells = F.filter(F.transform(F.get(rows, 0), lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return F.nullif(F.array_join(cells, " | "), F.lit(""))


def normalise_rect(rect: Column, width: Column, height: Column) -> Column:
    """Coordinates as shares of the page, clamped to 0..1."""
    part = lambda v, full: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(v, full), F.lit(0.0))))
    return F.struct(
        part(rect["x0"], width).alias("x0"), part(rect["y0"], height).alias("y0"), part(rect["x1"], width).alias("x1"), part(rect["y1"], height).alias("y1")
    )


#: Fixed value: namespace of document identifiers.
NAMESPACE = "6f4a1c2e9d3b4e578a102c5f7b91d0a4"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 identifier of a name, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws(
        "-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)
    )
