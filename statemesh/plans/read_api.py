"""The read side: filters, orders and pages over claims and edges. Each call is one declarative query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.compare import edge_order
from ..schema import RELATIONS


def _contains(column: str | Column, text: str) -> Column:
    return F.lower(column).contains(text.lower())


def claims(
    df: DataFrame,
    entity_id: str | None = None,
    document_id: str | None = None,
    predicate: str | None = None,
    period: str | None = None,
    basis: str | None = None,
    q: str | None = None,
    limit: int = 200,
    offset: int = 0,
) -> DataFrame:
    """Claims that meet all given conditions, in load order."""
    if entity_id is not None:
        df = df.where(F.col("subject_id") == entity_id)
    if document_id is not None:
        df = df.where(F.get("evidence", 0)["document_id"] == document_id)
    if predicate:
        df = df.where(_contains("predicate_raw", predicate))
    if period:
        df = df.where(F.lower("scope.period.label") == period.lower())
    if basis:
        df = df.where(F.col("scope.basis") == basis)
    if q:
        df = df.where(_contains("predicate_raw", q) | _contains("value.raw", q) | _contains("subject_raw", q))
    return df.orderBy("seq").offset(offset).limit(min(limit, 2000))


def edges_of_claim(edges: DataFrame, claim_id: str, limit: int = 50) -> DataFrame:
    return edge_order(edges.where((F.col("a_id") == claim_id) | (F.col("b_id") == claim_id))).limit(limit)


def relations(
    edges: DataFrame,
    entity_id: str | None = None,
    document_id: str | None = None,
    relation: str | None = None,
    cross_document: bool | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """Edges that meet all given conditions; a document counts on either side."""
    if relation is not None and relation not in RELATIONS:
        raise ValueError(f"no such relation: {relation}")
    if entity_id is not None:
        edges = edges.where(F.col("subject_id") == entity_id)
    if document_id is not None:
        edges = edges.where((F.col("a_document_id") == document_id) | (F.col("b_document_id") == document_id))
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    if cross_document is not None:
        edges = edges.where(F.col("cross_document") == cross_document)
    return edge_order(edges).offset(offset).limit(min(limit, 500))


def documents_of_entity(subjects: DataFrame, rows: DataFrame, entity_id: str, column: str = "document_id") -> DataFrame:
    """Rows of the documents whose subject is the entity."""
    own = subjects.where(F.col("subject_id") == entity_id).select(F.col("document_id").alias(column))
    return rows.join(own, column, "left_semi")


def ontology(nodes: DataFrame, kind: str | None = None, limit: int = 200) -> DataFrame:
    """Nodes with the most aliases first; at most twelve aliases are shown."""
    df = nodes if kind is None else nodes.where(F.col("kind") == kind)
    shown = df.withColumns({"alias_count": F.size("aliases"), "aliases": F.slice(F.array_sort("aliases"), 1, 12)})
    return shown.orderBy(F.desc("alias_count"), "label").limit(limit)


def quarantine(quarantined: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first refused claims, and the counts by reason."""
    counts = quarantined.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    return quarantined.limit(limit), counts
