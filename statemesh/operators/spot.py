"""The spot sweep: every numeral, date and period of a block with its place, kind and surroundings.

Built-in functions give matches without their offsets, so the sweep itself is one Arrow pass over blocks; everything that
follows is declarative. It comes after all filters that can be pushed to the scan.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import strip
from ..session import ship

#: Characters around a candidate: for reading, and for what binds to it.
WINDOW, TIGHT = 220, 28
#: Patterns of dates, periods, numerals and markers.
_MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec"
DATE = rf"\b(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|(?:{_MONTH})[a-z]*\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+(?:{_MONTH})[a-z]*\.?,?\s+\d{{4}})\b"
PERIOD = (
    r"(?<![A-Za-z]{2})(?:Q[1-4]\s*[-/ ]?\s*FY\s*'?\d{2,4}|(?:3|6|9|12)\s*M\s*[-/ ]?\s*FY\s*'?\d{2,4}"
    r"|H[12]\s*[-/ ]?\s*(?:FY|CY)\s*'?\d{2,4}|FY\s*'?\d{2,4}|CY\s*'?\d{2,4}|\d{4}\s*[-–]\s*\d{2,4})\b"
)
NUMBER = r"\d+(?:,\d{2,3})*(?:\.\d+)?|\.\d+"
_UNIT = r"\s*(?:%|per\s*cent(?:age)?|bps|basis\s+points?|crores?|lakhs?|lacs?|millions?|billions?|trillions?|thousands?|mn|bn|cr)?"
_MONEY = (
    r"[₹$€£¥]|\b(?:rs\.?|inr|usd|eur|gbp|jpy|rupees?|dollars?|revenue|ebitda|profit|loss|income|expense|cost|turnover|capex|opex|"
    r"cash|debt|equity|assets?|liabilit(?:y|ies))\b"
)
_PERCENT = r"%|\bper\s*cent|\bbps\b|\bbasis\s+points?\b"
_NOISE = (
    r"\b(?:page|pg\.?|note|notes|clause|section|para(?:graph)?|annexure|schedule|regulation|rule|chapter|table|figure|fig\.?|"
    r"exhibit|item|sr\.?\s*no|s\.?\s*no)\s*$"
)
FOLIO = r"^[ivxlcdm]*\s*\d{1,4}\s*[ivxlcdm]*$"
FOLIO_MARGIN = 0.06

SPOTS = "start int, end int, kind string, text string, tight string, noise boolean"
_DATE, _DIGITS = re.compile(DATE, re.I), re.compile(r"\d+")
# PERIOD and NUMBER with the characters that they can begin with first: the search then passes over all others quickly
_PERIOD = re.compile(
    r"[\dQqHhFfCc](?i:(?<![A-Za-z]{2}.)(?:(?<=Q)[1-4]\s*[-/ ]?\s*FY\s*'?\d{2,4}|(?:(?<=[369])|(?<=1)2)\s*M\s*[-/ ]?\s*FY\s*'?\d{2,4}"
    r"|(?<=H)[12]\s*[-/ ]?\s*(?:FY|CY)\s*'?\d{2,4}|(?<=[FC])Y\s*'?\d{2,4}|(?<=\d)\d{3}\s*[-–]\s*\d{2,4})\b)"
)
_NUMBER = re.compile(r"[\d.](?:(?<=\d)\d*(?:,\d{2,3})*(?:\.\d+)?|(?<=\.)\d+)")
_AFTER = re.compile(_UNIT, re.I)
_KINDS = [("percent", re.compile(_PERCENT, re.I)), ("money", re.compile(_MONEY, re.I))]
_REFERENCE = re.compile(_NOISE, re.I)
#: What ASCII text has, in lower case, wherever the patterns of a kind, or of references, match: most text is told by that.
_SIGNS = {
    "percent": ("%", "cent", "bps", "basis"),
    "money": tuple("$ rs inr usd eur gbp jpy rupee dollar revenue ebitda profit loss income expense cost turnover capex opex cash debt equity asset liabilit".split()),
}
_ENDINGS = tuple("page pg pg. note notes clause section para paragraph annexure schedule regulation rule chapter table figure fig fig. exhibit item no".split())


def _dates(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of DATE, tried only where one can begin: at one or two digits, and at the word before those that follow a blank."""
    last = 0
    for at, end in runs:
        if end - at > 2 or at < last:
            continue
        after, word = text[end : end + 1], at
        blank = after.isspace()
        if blank or after == ",":
            while word > last and text[word - 1].isspace():
                word -= 1
            if word < at:
                word -= word > last and text[word - 1] == "."
                while word > last and text[word - 1].isalpha():
                    word -= 1
        found = (word < at and _DATE.match(text, word)) or ((blank or (after and after in "./-")) and _DATE.match(text, at))
        if found:
            last = found.end()
            yield found.span()


def places(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Intervals (start, end, kind) of a block in reading order, none meeting another. Matches of all kinds are laid over the
    text in the order of their rank, and what is covered already is given up; a numeral has two digits or more. runs: where
    digits stand."""
    free, out = bytearray(b"\x01") * len(text), []
    for start, end in _dates(text, runs):
        free[start:end] = bytes(end - start)
        out.append((start, end, "date"))
    for kind, pattern in (("duration", _PERIOD), ("number", _NUMBER)):
        for m in pattern.finditer(text):
            start, end = m.span()
            if kind == "number" and (end - start == 1 or (not text[start : start + 2].isdigit() and sum(map(str.isdigit, text[start:end])) < 2)):
                continue
            if free.find(0, start, end) < 0:
                free[start:end] = bytes(end - start)
                out.append((start, end, kind))
    out.sort()
    return out


def spots_of(text: str) -> list[tuple]:
    """(start, end, kind, text, tight, noise) of each place; brackets right around a place belong to it.

    To a place are bound TIGHT characters on its left and right, ending where another numeral with its unit stands. A first line
    without numerals is the row's label, and stands before what is on the left."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    found = places(text, runs)
    if not found:
        return []
    rows, starts, size = [], [r[0] for r in runs], len(text)
    line = text.find("\n") + 1
    label = text[:line] if 1 < line <= starts[0] else ""
    plain = text.isascii()
    low = text.lower() if plain else ""
    kinds = [(name, pattern, there) for name, pattern in _KINDS if (there := [sign for sign in _SIGNS[name] if sign in low]) or not plain]

    def bound(start: int, end: int) -> tuple[str, str]:
        left, right = max(start - TIGHT, 0), min(end + TIGHT, size)
        i = bisect_left(starts, start)  # the last digit before, if any, ends the last numeral there
        if i and (digit := min(runs[i - 1][1], start)) > left:
            left = _AFTER.match(text, digit, start).end()
        i = bisect_left(starts, end)
        if i and runs[i - 1][1] > end:
            right = end
        elif i < len(starts) and starts[i] < right:
            right = starts[i]
        near = text[left:start]
        if label and line <= start and label[:-1] not in near:
            near = label + near
        return near, text[end:right]

    for start, end, kind in found:
        near, after = bound(start, end)
        if kind == "number":
            words, kind = f"{near} {text[start:end]} {after}", "quantity"
            if kinds:
                has = words.lower().__contains__
                for name, pattern, signs in kinds:
                    if (not plain or any(map(has, signs))) and pattern.search(words):
                        kind = name
                        break
        before = (low or text)[max(start - 128, 0) : start].rstrip()
        if len(before) < 30 and start > 128:
            before = (low or text)[:start].rstrip()
        reference = (not plain or before.endswith(_ENDINGS)) and _REFERENCE.search(before[-30:]) is not None
        if start and text[start - 1] == "(" and text[end : end + 1] == ")":
            start, end = start - 1, end + 1
            near, after = bound(start, end)
        shown = text[start:end]
        rows.append((start, end, kind, shown, near + shown + after, reference))
    return rows


def is_folio(text: Column, rects: Column) -> Column:
    """A page number in the margin: a bare number, all of it in the top or bottom strip of the page."""
    top = F.array_min(F.transform(rects, lambda r: r["y0"]))
    bottom = F.array_max(F.transform(rects, lambda r: r["y1"]))
    return F.coalesce(strip(text).rlike(f"(?iU){FOLIO}") & ((bottom <= FOLIO_MARGIN) | (top >= 1 - FOLIO_MARGIN)), F.lit(False))


def spot(blocks: DataFrame) -> DataFrame:
    """One row per candidate of blocks(document_id, page, ord, text, char_start, ...): offsets within the page, kind, text,
    tight, noise_hint. Other columns of blocks are kept; rects, if any, tell folios."""
    ship(blocks.sparkSession)
    kept = [c for c in blocks.columns if c != "_spots"]
    kinds = {"start": pa.int32(), "end": pa.int32(), "kind": pa.string(), "text": pa.string(), "tight": pa.string(), "noise": pa.bool_()}
    schema = f"_spots array<struct<{SPOTS.replace(' ', ':').replace(',:', ',')}>>"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, rows = [0], []
            for t in b.column("text").to_pylist():
                rows += spots_of(t or "")
                ends.append(len(rows))
            columns = zip(*rows) if rows else [()] * len(kinds)
            spots = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spots)
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "_spots"])

    out_schema = blocks.select(*kept).schema
    from pyspark.sql.types import StructType

    both = StructType([*out_schema.fields, *StructType.fromDDL(schema).fields])
    digits = blocks.select(*kept).where(F.col("text").rlike(r"(?U)\d"))  # a block without a digit has no candidate
    swept = digits.mapInArrow(sweep, both).withColumn("s", F.explode("_spots")).drop("_spots")
    folio = is_folio(F.col("text"), F.col("rects")) if "rects" in kept else F.lit(False)
    named = [c for c in kept if c != "text"]
    return swept.select(
        *named,
        F.col("text").alias("block_text"),
        (F.col("char_start") + F.col("s.start")).alias("at"),
        (F.col("char_start") + F.col("s.end")).alias("until"),
        F.col("s.start").alias("in_block"),
        F.col("s.kind").alias("spot_kind"),
        F.col("s.text").alias("text"),
        F.col("s.tight").alias("tight"),
        (F.col("s.noise") | folio).alias("noise_hint"),
    )


def with_window(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """candidates with the page text around them."""
    own = pages.select("document_id", "page", F.col("text").alias("_page"))
    start = F.greatest(F.col("at") - WINDOW, F.lit(0))
    return candidates.join(own, ["document_id", "page"]).withColumn("window", F.substr("_page", start + 1, F.col("until") + WINDOW - start)).drop("_page")


def density(candidates: DataFrame) -> DataFrame:
    """(document_id, page, total, density): candidates, and those that are no references."""
    return candidates.groupBy("document_id", "page").agg(F.count("*").alias("total"), F.count_if(~F.col("noise_hint")).alias("density"))


def by_kind(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("spot_kind").agg(F.count("*").alias("n"))


def pages_by_density(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages in the order of work: densest first, per document; with a rank."""
    order = Window.partitionBy("document_id").orderBy(F.desc("density"), "page")
    ranked = density(candidates).withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
