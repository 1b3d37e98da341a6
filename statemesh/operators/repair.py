"""Repairs of stored claims: each rewrites what an older reading got wrong, and counts what it did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import first_of
from ..functions.periods import enforce_plausibility, period_is_possible
from ..functions.text import uuid5


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(F.lit(0))


def sign_outcome(span: Column, quote: Column, raw: Column) -> Column:
    """What to do with a value's sign by the text it cites: offset_mismatch, unchanged, ambiguous or negated."""
    wrapped = occurrences(span, F.concat(F.lit("("), raw, F.lit(")")))
    cases = [(~span.eqNullSafe(quote), F.lit("offset_mismatch")), (wrapped == 0, F.lit("unchanged")), (occurrences(span, raw) != wrapped, F.lit("ambiguous"))]
    return first_of(cases, F.lit("negated"))


def repair_signs(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """claims with sign_outcome, and negative value where the cited text has it only in parentheses."""
    e = F.get("evidence", 0)
    own = pages.select(F.col("document_id").alias("_d"), F.col("page").alias("_p"), F.col("text").alias("_t"))
    joined = claims.join(own, (e["document_id"] == F.col("_d")) & (e["page"] == F.col("_p")), "left")
    span = F.substr("_t", e["char_start"] + 1, e["char_end"] - e["char_start"])
    outcome = sign_outcome(span, e["quote"], F.col("value.raw"))
    raw, magnitude = F.concat(F.lit("("), F.col("value.raw"), F.lit(")")), (-F.abs("value.canonical_magnitude")).cast("decimal(38,10)")
    fixed = F.col("value").withField("raw", raw).withField("canonical_magnitude", magnitude)
    judged = joined.withColumn("sign_outcome", outcome).withColumn("value", F.when(F.col("sign_outcome") == "negated", fixed).otherwise(F.col("value")))
    return judged.drop("_d", "_p", "_t")


def repair_document_ids(claims: DataFrame, hashes: DataFrame) -> DataFrame:
    """Evidence with document ids derived from hashes(document_id, sha256)."""
    ids = hashes.select("document_id", uuid5(F.col("sha256")).alias("new"))
    old = F.transform("evidence", lambda e: e["document_id"])
    named = claims.select("id", F.explode(F.array_distinct(old)).alias("document_id")).join(ids, "document_id")
    maps = named.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("document_id", "new"))).alias("_m"))
    joined = claims.join(maps, "id", "left")
    changed = F.transform("evidence", lambda e: e.withField("document_id", F.coalesce(F.try_element_at("_m", e["document_id"]), e["document_id"])))
    return joined.withColumn("evidence", changed).drop("_m")


def clear_impossible_periods(claims: DataFrame) -> DataFrame:
    """claims without the dates of periods that end after their document appeared; was_impossible tells which."""
    impossible = ~period_is_possible(F.col("scope.period.end"), F.col("scope.vintage"))
    return claims.withColumn("was_impossible", impossible).withColumn("scope", enforce_plausibility(F.col("scope")))


def clear_unevidenced_accounting(claims: DataFrame, standards: DataFrame) -> DataFrame:
    """Accounting set to unknown unless standards(document_id, standards) of its document hold it."""
    s = standards.select(F.col("document_id").alias("_d"), F.col("standards").alias("_s"))
    joined = claims.join(s, F.get("evidence", 0)["document_id"] == F.col("_d"), "left")
    known = F.coalesce(F.array_contains("_s", F.col("scope.accounting")), F.lit(False))
    cleared = F.col("scope").withField("accounting", F.when(known, F.col("scope.accounting")).otherwise(F.lit("unknown")))
    return joined.withColumn("scope", cleared).drop("_d", "_s")


def name_extractors(claims: DataFrame, models: dict[str, str]) -> DataFrame:
    """Provenance as tier:model, where only the tier was kept."""
    x = F.col("provenance.extractor")
    named = first_of([(x == tier, F.lit(f"{tier}:{model}")) for tier, model in models.items()], x)
    return claims.withColumn("provenance", F.when(F.col("provenance").isNotNull(), F.col("provenance").withField("extractor", named)))


def is_mistyped(value: Column) -> Column:
    """A grouped numeral that was read as a ratio or as a count."""
    grouped = value["raw"].contains(",")
    return grouped & ((value["kind"] == "ratio") | ((value["kind"] == "quantity") & F.coalesce(value["unit"] == "count", F.lit(False))))


def suspect_pages(claims: DataFrame) -> DataFrame:
    """(document_id, page, n): pages with mistyped values."""
    e = F.get("evidence", 0)
    return claims.where(is_mistyped(F.col("value"))).groupBy(e["document_id"].alias("document_id"), e["page"].alias("page")).agg(F.count("*").alias("n"))


def drop_version(claims: DataFrame, version: str) -> DataFrame:
    """claims but those of one prompt version."""
    return claims.where(~F.coalesce(F.col("provenance.prompt_version") == version, F.lit(False)))
