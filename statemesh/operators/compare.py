"""The comparator: a pure function from two claims to a relation, its axis, a confidence and a trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import CANONICAL, first_of, strip
from ..schema import UNKNOWN

#: Percentages agree within this, other numbers within one part in RELATIVE of the first.
RATIO_TOLERANCE, RELATIVE = "0.0006", 200
#: Why an axis explains a difference.
AXIS_EXPLANATION = {
    "period": "the two statements cover different periods",
    "basis": "one is consolidated and the other is not",
    "segment": "the two statements cover different business segments",
    "geography": "the two statements cover different geographies",
    "accounting": "the two statements are prepared under different accounting standards",
    "modality": "one is a projection or estimate and the other is a reported actual",
}


def pair_sides(a: str = "a_", b: str = "b_"):
    """Accessors of both sides of a pair row."""
    return (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))


def _yes(condition: Column) -> Column:
    """Three-valued logic ends here: null is no."""
    return F.coalesce(condition, F.lit(False))


def axis_tests(a, b) -> dict[str, Column]:
    """For each axis whether it differs. Unknown is no difference for enumerations; for free text, null is a value."""
    both_known = a("p_start").isNotNull() & a("p_end").isNotNull() & b("p_start").isNotNull() & b("p_end").isNotNull()
    same = _yes((a("p_start") == b("p_start")) & (a("p_end") == b("p_end")))

    def enumerated(c: str) -> Column:
        return _yes((a(c) != UNKNOWN) & (b(c) != UNKNOWN) & (a(c) != b(c)))

    def free(c: str) -> Column:
        return ~F.nullif(a(c), F.lit("")).eqNullSafe(F.nullif(b(c), F.lit("")))

    tests = {"period": both_known & ~same, "basis": enumerated("basis"), "segment": free("segment"), "geography": free("geography")}
    return tests | {"accounting": enumerated("accounting"), "modality": enumerated("modality")}


def differing_axes(a, b) -> Column:
    """Names of the axes that differ, in their order."""
    named = F.array(*(F.when(test, F.lit(axis)) for axis, test in axis_tests(a, b).items()))
    return F.filter(named, lambda x: x.isNotNull())


def currencies_clash(a, b) -> Column:
    """Both are money, of different currencies."""
    return _yes((a("kind") == "money") & (b("kind") == "money") & (a("currency") != b("currency")))


def agreement_cases(a, b) -> list[tuple[Column, Column, Column]]:
    """(condition, whether the values agree, why), tried in order. Not symmetric: percentages and relative distance go
    by the first value. Each side's ``tolerance`` is computed once per claim."""
    lit = F.lit
    money_and_quantity = a("kind").isin("money", "quantity") & b("kind").isin("money", "quantity")
    kinds = (a("kind") != b("kind")) & ~money_and_quantity
    either = lambda kind: (a("kind") == kind) | (b("kind") == kind)
    dates = a("date_value").eqNullSafe(b("date_value"))
    shown = lambda x: F.lower(strip(F.coalesce(F.nullif(x("text_value"), lit("")), x("raw"))))
    texts = shown(a).eqNullSafe(shown(b))
    bools = a("bool_value").eqNullSafe(b("bool_value"))
    ra = a("range_low").isNotNull() & a("range_high").isNotNull()
    rb = b("range_low").isNotNull() & b("range_high").isNotNull()
    overlap = ~((a("range_high") < b("range_low")) | (b("range_high") < a("range_low")))

    def inside(point, span) -> tuple[Column, Column]:
        test = point("magnitude").between(span("range_low"), span("range_high"))
        where = F.when(test, lit(" falls inside the stated range ")).otherwise(lit(" falls outside the stated range "))
        return test, F.concat(point("raw"), where, span("raw"))

    def told(test: Column, yes: Column | str, no: Column | str) -> tuple[Column, Column]:
        as_column = lambda x: x if isinstance(x, Column) else lit(x)
        return test, F.when(test, as_column(yes)).otherwise(as_column(no))

    gap = F.abs(a("magnitude") - b("magnitude")).cast(CANONICAL)
    points = gap.cast("double") * 100
    near = gap <= lit(RATIO_TOLERANCE).cast(CANONICAL)
    ratio = told(
        near,
        F.concat(lit("agree within "), F.format_number(points, 3), lit(" percentage points")),
        F.concat(lit("differ by "), F.format_number(points, 2), lit(" percentage points")),
    )
    # exact where the product fits a decimal, else in doubles
    share = F.coalesce(
        (gap.try_cast("decimal(34,10)") * lit(RELATIVE).cast("decimal(3,0)")) <= F.abs(a("magnitude")),
        gap.cast("double") * RELATIVE <= F.abs(a("magnitude")).cast("double"),
    )
    within = _yes(gap <= a("tolerance")) | _yes(gap <= b("tolerance")) | share
    percent = F.coalesce(F.try_divide(gap.cast("double") * 100, F.abs(a("magnitude")).cast("double")), lit(0.0))
    rounded = told(
        within,
        F.concat(lit("agree within rounding ("), F.format_number(percent, 4), lit("% apart)")),
        F.concat(lit("differ by "), F.format_number(percent, 2), lit("%")),
    )
    no = lit(False)
    named = lambda what, field, end: F.concat(lit(f"different {what} ("), a(field), lit(" vs "), b(field), lit(end))
    return [
        (kinds, no, named("value kinds", "kind", ")")),
        (currencies_clash(a, b), no, named("currencies", "currency", "), not converted")),
        (either("date"), *told(dates, "same date", "different dates")),
        (either("text"), *told(texts, "identical text", "different text")),
        (either("bool"), *told(bools, "same", "different")),
        (ra & rb, *told(overlap, "ranges overlap", "ranges do not overlap")),
        (ra & b("magnitude").isNotNull(), *inside(b, a)),
        (rb & a("magnitude").isNotNull(), *inside(a, b)),
        (a("magnitude").isNull() | b("magnitude").isNull(), no, lit("one or both values could not be normalised")),
        (a("magnitude") == b("magnitude"), lit(True), lit("identical after normalisation")),
        (a("kind") == "ratio", *ratio),
        (lit(True), *rounded),
    ]


def values_agree(a, b) -> Column:
    return _yes(first_of([(test, agree) for test, agree, _ in agreement_cases(a, b)]))


def agreement_reason(a, b) -> Column:
    return first_of([(test, why) for test, _, why in agreement_cases(a, b)])


def with_verdict(pairs: DataFrame, with_trace: bool = False, agree: Column | None = None) -> DataFrame:
    """Pairs (a_*, b_*) with relation, axis, confidence and trace (null unless asked for). agree: whether the values agree, where
    that is known.

    In steps of flat columns, so that each step is generated code and shared tests are computed once.
    """
    a, b = pair_sides()
    lit = F.lit
    tests = axis_tests(a, b)
    step = pairs.withColumns({f"_{axis}": test for axis, test in tests.items()} | {"_agree": values_agree(a, b) if agree is None else agree})
    flags = [F.col(f"_{axis}") for axis in tests]
    count = sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))
    first = first_of([(F.col(f"_{axis}"), lit(axis)) for axis in tests])
    apart = ~_yes(a("subject_id") == b("subject_id")) | ~_yes(a("predicate_id") == b("predicate_id"))
    step = step.withColumns({"_n": count, "_axis": first, "_apart": apart, "_least": F.least(a("confidence"), b("confidence"))})
    agree, undated = F.col("_agree"), a("p_start").isNull() | b("p_start").isNull()
    one_page = _yes((a("document_id") == b("document_id")) & (a("page") == b("page")))
    doubtful = a("unreliable") | b("unreliable")
    # A filter on the relation is pushed down with all of this in it, so each test is named as seldom as can be.
    outcomes = [
        (F.col("_apart"), lit(0)),
        (F.col("_n") > 1, lit(8)),
        (agree, F.when(F.col("_n") == 0, 1).otherwise(6)),
        (F.col("_n") == 1, lit(7)),
        (undated, lit(2)),
        (one_page, lit(3)),
        (doubtful, lit(4)),
    ]
    step = step.withColumn("_case", first_of(outcomes, lit(5)))
    case = F.col("_case")
    at = lambda values: F.element_at(F.array(*map(lit, values)), case + 1)
    relations = ["unrelated", "corroboration", "ambiguous", "ambiguous", "ambiguous", "contradiction", "corroboration", "reconciled", "ambiguous"]
    step = step.withColumns(
        {
            "relation": at(relations),
            "axis": F.when(case.isin(6, 7), F.col("_axis")),
            "confidence": F.when(case == 0, lit(1.0)).otherwise(F.col("_least") * at([1.0, 1.0, 0.5, 0.5, 0.5, 1.0, 0.8, 1.0, 0.6])),
            "trace": _trace(a, b, tests) if with_trace else lit(None).cast("array<string>"),
        }
    )
    return step.drop(*(f"_{axis}" for axis in tests), "_agree", "_n", "_axis", "_apart", "_least", "_case")


def _trace(a, b, tests: dict[str, Column]) -> Column:
    lit, case = F.lit, F.col("_case")
    diffs = F.filter(F.array(*(F.when(F.col(f"_{axis}"), lit(axis)) for axis in tests)), lambda x: x.isNotNull())
    why = agreement_reason(a, b)
    shown = lambda side: F.concat(lit("'"), side("raw"), lit("' → "), F.coalesce(side("magnitude").cast("string"), lit("none")))
    scopes = F.when(F.col("_n") == 0, lit("scopes are identical on every axis")).otherwise(F.concat(lit("scope differs on: "), F.array_join(diffs, ", ")))
    explained = first_of([(F.col("_axis") == k, lit(v)) for k, v in AXIS_EXPLANATION.items()])
    ends = {
        1: F.concat(lit("→ corroboration: same scope, values "), why),
        2: lit("→ ambiguous: the values differ and no resolved period shows that both cover the same thing"),
        3: lit("→ ambiguous: one measure twice on one page, the shape of a two-column statement"),
        4: lit("→ ambiguous: a page prints the measure at more than one value for the period"),
        5: lit("→ contradiction: every scope axis was checked and is identical"),
        6: F.concat(lit("→ corroboration across a difference in "), F.col("_axis")),
        7: F.concat(lit("→ reconciled: the values differ because "), explained),
    }
    last = first_of([(case == k, v) for k, v in ends.items()], lit("→ ambiguous: more than one axis differs"))
    told = F.array(
        F.concat(lit("subject ≡ '"), a("subject_raw"), lit("'")),
        F.concat(lit("predicate ≡ '"), a("predicate_raw"), lit("'")),
        scopes,
        F.concat(lit("values "), F.when(F.col("_agree"), lit("agree: ")).otherwise(lit("disagree: ")), why),
        shown(a),
        shown(b),
        last,
    )
    subjects = _yes(a("subject_id") == b("subject_id"))
    pair = lambda what: F.concat(lit(f"{what}s differ: '"), a(f"{what}_raw"), lit("' vs '"), b(f"{what}_raw"), lit("'"))
    return F.when(case == 0, F.array(F.when(subjects, pair("predicate")).otherwise(pair("subject")))).otherwise(told)


def compare_pairs(pairs: DataFrame, with_trace: bool = False, keep_unrelated: bool = False) -> DataFrame:
    """Edges of pairs (a_*, b_*): ids, documents, relation, axis, confidence, trace, cross_document; unrelated pairs are dropped."""
    if not keep_unrelated:  # known before anything is judged; a filter on the relation would judge every pair twice
        pairs = pairs.where("a_subject_id = b_subject_id and a_predicate_id = b_predicate_id")
    judged = with_verdict(pairs, with_trace)
    return judged.select(
        *(F.col(f"{s}_{c}") for s in "ab" for c in ("id", "seq", "document_id", "subject_raw", "predicate_raw", "raw", "kind", "magnitude")),
        F.col("a_subject_id").alias("subject_id"),
        F.col("a_predicate_id").alias("predicate_id"),
        "relation",
        "axis",
        F.round("confidence", 6).alias("confidence"),
        "trace",
        (F.col("a_document_id") != F.col("b_document_id")).alias("cross_document"),
        "reason",
    )


def edge_order(edges: DataFrame) -> DataFrame:
    """Across documents first, then by confidence; ties by the claims' load order."""
    return edges.orderBy(F.desc("cross_document"), F.desc("confidence"), "a_seq", "b_seq")


def fallback_explanation(relation: Column, axis: Column, a_raw: Column, b_raw: Column) -> Column:
    """One sentence for each relation, without a model."""
    lit = F.lit
    pair = F.concat(lit("'"), a_raw, lit("' and '"), b_raw, lit("'"))
    explained = F.coalesce(first_of([(axis == k, lit(v)) for k, v in AXIS_EXPLANATION.items()]), lit("their scopes differ"))
    return first_of(
        [
            (relation == "corroboration", F.concat(pair, lit(" state the same value."))),
            (relation == "contradiction", F.concat(pair, lit(" disagree, and no difference in scope explains it."))),
            (relation == "reconciled", F.concat(pair, lit(" differ because "), explained, lit("."))),
            (relation == "ambiguous", F.concat(pair, lit(" cannot be compared with confidence."))),
        ],
        F.concat(pair, lit(" are about different things.")),
    )
