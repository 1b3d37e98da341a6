"""The knowledge layer: claims, their pairs and the edges between them, as ordinary DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compare import compare_pairs
from ..operators.evals import relative_gap
from ..operators.pairing import CAP, SAME_BLOCK, exact_pairs, narrowed, unreliable_periods, whole_pairs
from ..operators.tally import near_pairs, relation_totals
from ..schema import RELATIONS
from ..session import stored


@dataclass
class Layer:
    claims: DataFrame
    narrow: DataFrame
    edges: DataFrame | None
    quarantined: DataFrame | None = None


def build(claims: DataFrame, cap: int = CAP, cross_document: bool = False, with_trace: bool = False) -> Layer:
    """Edges of all exact pairs. Value pairs never become edges (their predicates differ), so they are not formed here."""
    narrow = flagged(claims)
    edges = compare_pairs(exact_pairs(narrow, cap, cross_document), with_trace)
    return Layer(claims, narrow, edges)


def flagged(claims: DataFrame) -> DataFrame:
    """The claims flat and narrow, stored, with unreliable periods marked."""
    return unreliable_periods(stored(narrowed(claims), "narrow"))


def whole_counts(narrow: DataFrame) -> DataFrame:
    """(relation, n) of all pairs of whole blocks, with every relation present."""
    return _named(relation_totals(narrow))


def contradictions(narrow: DataFrame) -> DataFrame:
    """Edges of all contradictions of whole blocks. Only claims with a resolved and reliable period contradict each other, in one
    segment and geography (blank is none): no others are paired."""
    sure = narrow.where("subject_id is not null and predicate_id is not null and p_start is not null and not unreliable")
    alike = sure.withColumns({f"_{c}": F.coalesce(c, F.lit("")) for c in ("segment", "geography")})
    pairs = whole_pairs(alike, ["subject_id", "predicate_id", "_segment", "_geography"]).withColumn("reason", F.lit(SAME_BLOCK))
    return compare_pairs(pairs).where("relation = 'contradiction'")


def corroborations(narrow: DataFrame, equal: str | None = None) -> DataFrame:
    """Edges of the corroborations of whole blocks whose values are at most half a percent of the first apart; none is zero. They
    meet in the order of their size. equal: only equal values, of pairs for which this condition holds."""
    valued = narrow.where("subject_id is not null and predicate_id is not null and magnitude != 0")
    block = ["subject_id", "predicate_id"]
    if equal:
        near = whole_pairs(valued, [*block, "magnitude"]).where(equal)
    else:
        near = near_pairs(valued, block).where(relative_gap(F.col("a_magnitude"), F.col("b_magnitude")) <= 0.005)
    return compare_pairs(near.withColumn("reason", F.lit(SAME_BLOCK))).where("relation = 'corroboration'")


def relation_counts(edges: DataFrame) -> DataFrame:
    """(relation, n) with every relation present."""
    return _named(edges.groupBy("relation").agg(F.count("*").alias("n")))


def _named(counts: DataFrame) -> DataFrame:
    names = counts.sparkSession.createDataFrame([(r,) for r in RELATIONS], "relation string")
    return names.join(counts, "relation", "left").select("relation", F.coalesce("n", F.lit(0)).alias("n"))


def relation_by_axis(edges: DataFrame) -> DataFrame:
    """(relation, axis, n)."""
    return edges.groupBy("relation", F.coalesce("axis", F.lit("none")).alias("axis")).agg(F.count("*").alias("n"))


def layer_stats(layer: Layer, counts: DataFrame | None = None) -> DataFrame:
    """One row: documents, claims, quarantined, pass rate and a count for each relation. counts: (relation, n), if they are not
    those of the layer's edges."""
    claims = layer.narrow.agg(F.count("*").alias("claims"), F.countDistinct("document_id").alias("documents"))
    counts = relation_counts(layer.edges) if counts is None else counts
    counts = counts.agg(*(F.coalesce(F.sum(F.when(F.col("relation") == r, F.col("n"))), F.lit(0)).alias(r) for r in RELATIONS))
    out = claims.crossJoin(counts)  # one row each
    refused = layer.quarantined.agg(F.count("*").alias("quarantined")) if layer.quarantined is not None else None
    out = out.crossJoin(refused) if refused is not None else out.withColumn("quarantined", F.lit(0).cast("bigint"))
    rate = F.coalesce(F.try_divide(F.col("claims"), F.col("claims") + F.col("quarantined")), F.lit(0.0))
    return out.withColumn("pass_rate", F.round(rate, 4))


def assign_subjects(claims: DataFrame) -> DataFrame:
    """(document_id, subject_id, n): each document's most common subject; of equals the first met."""
    first = claims.select(F.get("evidence", 0)["document_id"].alias("document_id"), "subject_id", "seq")
    counts = first.where("subject_id is not null").groupBy("document_id", "subject_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = F.max_by(F.struct("subject_id", "n"), F.struct(F.col("n"), -F.col("first")))
    return counts.groupBy("document_id").agg(best.alias("b")).select("document_id", "b.subject_id", "b.n")
