"""The grounding gate: a claim counts only if what it cites is on the page and holds its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import first_of
from ..functions.text import normalise_text, numeric_key

#: Reasons of refusal, most telling first.
REASONS = ["value_not_in_quote", "quote_mismatch", "span_out_of_range", "empty_quote", "page_not_found", "no_evidence"]


def value_present(raw: Column, quote: Column, ascii_only: bool = False) -> Column:
    """The value as written is in the quote, as it stands or as a numeral."""
    r, q = normalise_text(raw, ascii_only), normalise_text(quote, ascii_only)
    key, quote_key = numeric_key(raw, ascii_only), numeric_key(quote, ascii_only)
    bare = F.regexp_replace(key, "^[-()]+", "")
    within = lambda x, y: (x != "") & y.contains(x)
    return (r != "") & (q.contains(r) | within(key, quote_key) | within(bare, quote_key))


def evidence_outcome(page_text: Column, evidence: Column, raw: Column, ascii_only: bool = False) -> Column:
    """null if the citation holds and shows the value, else the first reason against it."""
    start, end, quote = evidence["char_start"], evidence["char_end"], evidence["quote"]
    inside = (start >= 0) & (start < end) & (end <= F.length(page_text))
    actual = F.substr(page_text, F.greatest(start, F.lit(0)) + 1, F.greatest(end - start, F.lit(0)))
    return first_of(
        [
            (page_text.isNull(), F.lit("page_not_found")),
            (F.trim(F.coalesce(quote, F.lit(""))) == "", F.lit("empty_quote")),
            (~F.coalesce(inside, F.lit(False)), F.lit("span_out_of_range")),
            (normalise_text(actual, ascii_only) != normalise_text(quote, ascii_only), F.lit("quote_mismatch")),
            (~F.coalesce(value_present(raw, quote, ascii_only), F.lit(False)), F.lit("value_not_in_quote")),
        ]
    )


def verify(claims: DataFrame, pages: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(id, ok, reason) for claims(id, value, evidence) against pages(document_id, page, text).

    Primary citations are judged, or all where none is primary; one good citation is enough. Citations are joined to
    their pages as rows and come together per claim in an aggregation with a partial step.
    """
    primary = F.filter("evidence", lambda e: e["kind"] == "primary")
    judged = F.when(F.size(primary) > 0, primary).otherwise(F.col("evidence"))
    cited = claims.select("id", F.col("value.raw").alias("raw"), F.explode_outer(judged).alias("e"))
    own = pages.select(F.col("document_id").alias("_d"), F.col("page").alias("_p"), F.col("text").alias("_t"))
    joined = cited.join(own, (F.col("e.document_id") == F.col("_d")) & (F.col("e.page") == F.col("_p")), "left")
    outcome = F.when(F.col("e").isNull(), F.lit("no_evidence")).otherwise(evidence_outcome(F.col("_t"), F.col("e"), F.col("raw"), ascii_only))
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("outcome"))
    seen = joined.select("id", outcome.alias("outcome"))
    one = seen.groupBy("id").agg(F.bool_or(F.col("outcome").isNull()).alias("ok"), F.min_by("outcome", rank).alias("worst"))
    return one.select("id", "ok", F.when(~F.col("ok"), F.col("worst")).alias("reason"))


def gate(claims: DataFrame, pages: DataFrame, ascii_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Grounded claims, and refused ones with their reason."""
    judged = claims.join(verify(claims, pages, ascii_only), "id")
    return judged.where("ok").drop("ok", "reason"), judged.where("not ok").drop("ok")


def report(verified: DataFrame) -> DataFrame:
    """One row: grounded, quarantined, pass_rate (0 for nothing)."""
    counts = verified.agg(F.count_if("ok").alias("grounded"), F.count_if(~F.col("ok")).alias("quarantined"))
    rate = F.coalesce(F.try_divide(F.col("grounded"), F.col("grounded") + F.col("quarantined")), F.lit(0.0))
    return counts.withColumn("pass_rate", F.round(rate, 4))


def by_reason(quarantined: DataFrame) -> DataFrame:
    return quarantined.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
