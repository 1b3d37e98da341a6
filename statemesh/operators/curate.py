"""Selection of telling cases among the edges, by score. Scores are sums of points; ties go by load order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import first_of
from ..functions.labels import words
from ..functions.numbers import significant_digits
from .evals import relative_gap

#: Scales that a canonical and a written value may lie apart.
SCALES = {1: "units", 100_000: "lakh", 1_000_000: "million", 10_000_000: "crore", 1_000_000_000: "billion", 1_000_000_000_000: "trillion"}
#: Points that two unequal values can have, at most: the sum of those of score_corroborations, without the ones for equal values.
UNEQUAL_MOST = 10 + 8 + 12 + 3 + 4
NO_MEASUREMENT = ["year", "years", "date", "period", "fiscal year"]


def units(side: str) -> Column:
    part = lambda c: F.coalesce(F.col(f"{side}_{c}"), F.lit(""))
    return F.regexp_replace(F.concat_ws("|", part("currency"), part("unit"), part("ratio_basis")), r"^\|+|\|+$", "")


def implied_scale(magnitude: Column, raw: Column) -> Column:
    """Name of the scale between a canonical and a written value, within 2 percent, or null."""
    written = F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
    factor = F.try_divide(magnitude.cast("double"), written)
    return first_of([(F.abs(factor - v) / v < 0.02, F.lit(name)) for v, name in SCALES.items()])


def written_differently(a_raw: Column, b_raw: Column, units_differ: Column) -> Column:
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    return (F.trim(a_raw) != F.trim(b_raw)) & (units_differ | (bare(a_raw) != bare(b_raw)))


def reads_as_a_statement(quote: Column) -> Column:
    """Not a row of numbers."""
    q = F.trim(quote)
    numbers = F.regexp_count(q, F.lit(r"\d+(?:[.,]\d+)*"))
    density = F.try_divide(F.length(F.regexp_replace(q, r"(?U)\D", "")), F.length(q))
    return F.coalesce((q != "") & ~((F.length(q) > 60) & (density > 0.22) & (numbers >= 6)), F.lit(False))


def is_a_measurement(kind: Column, magnitude: Column, predicate: Column) -> Column:
    huge = (kind == "ratio") & (F.abs(magnitude) > 5)
    return kind.isin("money", "quantity", "ratio") & ~F.coalesce(huge, F.lit(False)) & ~F.lower(F.trim(predicate)).isin(NO_MEASUREMENT)


def _common(edges: DataFrame) -> DataFrame:
    """edges with gap, units_differ, word counts, and usable: both sides are measurements of three digits, stated as text."""
    out = edges.withColumns({"gap": relative_gap(F.col("a_magnitude"), F.col("b_magnitude")), "units_differ": units("a") != units("b"), "a_words": words(F.col("a_predicate_raw")), "b_words": words(F.col("b_predicate_raw"))})
    usable = F.lit(True)
    for s in "ab":
        c = lambda n, s=s: F.col(f"{s}_{n}")
        usable = usable & (significant_digits(c("raw")) >= 3) & reads_as_a_statement(c("quote")) & is_a_measurement(c("kind"), c("magnitude"), c("predicate_raw"))
    return out.withColumn("usable", usable)


def _points(cases: list[tuple[Column, float | Column]]) -> Column:
    total = F.lit(0.0)
    for condition, value in cases:
        total = total + F.when(F.coalesce(condition, F.lit(False)), value if isinstance(value, Column) else F.lit(float(value))).otherwise(F.lit(0.0))
    return total


def score_corroborations(edges: DataFrame) -> DataFrame:
    """Equal values in different words: across documents, written differently, in different scales."""
    e = _common(edges.where("relation = 'corroboration'")).where("usable and gap is not null and gap <= 0.005")
    scales = ~implied_scale(F.col("a_magnitude"), F.col("a_raw")).eqNullSafe(implied_scale(F.col("b_magnitude"), F.col("b_raw")))
    dated = F.col("a_p_start").isNotNull() & F.col("b_p_start").isNotNull()
    score = _points(
        [
            (F.col("cross_document"), 10),
            (F.col("gap") == 0, 6),
            (written_differently(F.col("a_raw"), F.col("b_raw"), F.col("units_differ")), 8),
            (scales, 12),
            (~scales & F.col("units_differ"), 6),
            (dated, 3),
        ]
    )
    return e.withColumn("score", F.round(score + F.least(F.col("a_words"), F.lit(4)), 6))


def score_contradictions(edges: DataFrame) -> DataFrame:
    """Real disagreements across documents, with a gap that a reader takes seriously."""
    e = _common(edges.where("relation = 'contradiction' and cross_document")).where("usable and a_words >= 3 and b_words >= 3 and not units_differ and gap between 0.01 and 0.6")
    basis = F.col("a_basis") != F.col("b_basis")
    dated = F.col("a_p_start").isNotNull() & F.col("b_p_start").isNotNull()
    near = F.lit(8.0) * (1 - F.abs(F.col("gap") - 0.15) / 0.45)
    score = _points([(F.lit(True), 10), (dated, 5), (F.lit(True), near), (basis, -4)])
    return e.withColumn("score", F.round(score + F.least(F.col("a_words"), F.lit(4)), 6))


def score_reconciliations(edges: DataFrame) -> DataFrame:
    """Apparent conflicts that one axis explains."""
    dated = "a_p_start is not null and b_p_start is not null"
    e = _common(edges.where("relation = 'reconciled'")).where(f"usable and a_words >= 3 and b_words >= 3 and not units_differ and gap between 0.02 and 4.0 and {dated}")
    period = F.col("axis") == "period"
    calendars = F.array_distinct(F.array("a_convention", "b_convention"))
    mixed = F.array_contains(calendars, "CALENDAR") & (F.size(calendars) > 1)
    score = _points([(F.col("cross_document"), 14), (period, 8), (period & mixed, 12), (F.col("axis").isin("basis", "segment", "modality"), 6), (F.col("gap") > 0.05, 4)])
    return e.withColumn("score", F.round(score + F.least(F.col("a_words"), F.lit(4)), 6))


def best(scored: DataFrame, n: int = 1) -> DataFrame:
    """The report's first cases."""
    return scored.orderBy(F.desc("score"), "a_seq", "b_seq").limit(n)


def render(case: dict) -> str:
    """One case as text for a reader (driver side: a single row)."""
    lines = [f"{case['relation']}" + (f" ({case['axis']})" if case.get("axis") else "")]
    for s in "ab":
        lines.append(f"- {case[f'{s}_subject_raw']}: {case[f'{s}_predicate_raw']} = {case[f'{s}_raw']} [{case[f'{s}_document_id']}]")
    return "\n".join(lines)
