"""Evaluations without labels: grounding, conversion, coherence, determinism; and figures of the layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import any_of

#: Words of a total line; its parts may miss it by one in a thousand.
TOTAL_WORDS, TOLERANCE, MOST = ["total", "aggregate", "sum of"], 0.001, 60


def grounding_layer(grounded: DataFrame, refused: DataFrame) -> DataFrame:
    """One row: grounded, quarantined, pass_rate, scale_inferred share, passed (0.95 or more)."""
    g = grounded.agg(F.count("*").alias("grounded"), F.avg(F.col("scale_inferred").cast("double")).alias("inferred"))
    out = g.crossJoin(refused.agg(F.count("*").alias("quarantined")))  # one row each
    rate = F.coalesce(F.try_divide(F.col("grounded"), F.col("grounded") + F.col("quarantined")), F.lit(0.0))
    return out.withColumns({"pass_rate": F.round(rate, 4), "passed": rate >= 0.95, "inferred": F.round(F.coalesce("inferred", F.lit(0.0)), 4)})


def spot_conversion(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """(document_id, claims, candidates, rate): claims for each candidate that is no reference, on pages with claims."""
    per = claims.groupBy("document_id").agg(F.count("*").alias("claims"))
    pages = claims.select("document_id", "page").distinct()
    seen = candidates.where("not noise_hint").join(pages, ["document_id", "page"], "left_semi").groupBy("document_id").agg(F.count("*").alias("candidates"))
    joined = per.join(seen, "document_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return joined.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("claims"), F.col("candidates")), F.lit(0.0)), 4))


def arithmetic(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Total lines of claims(*keys, seq, predicate_raw, magnitude) with satisfied: two parts of the group sum up to them.

    Only groups of 3 to 60 members are looked at, so the pairs of parts of a group are bounded. Sizes are aggregated and
    joined back; a frequent group is dropped before any row of it meets another.
    """
    valued = claims.where("magnitude is not null")
    same = lambda x, y: [x[k].eqNullSafe(y[k]) for k in keys]
    sizes = valued.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 2) & (F.col("n") <= MOST))
    sized = sizes.select(*(F.col(k).alias(f"s_{k}") for k in keys))
    members = valued.join(sized, [valued[k].eqNullSafe(sized[f"s_{k}"]) for k in keys], "left_semi")
    is_total = any_of([F.lower("predicate_raw").contains(w) for w in TOTAL_WORDS])
    flagged = members.select(*keys, "seq", F.col("magnitude").cast("double").alias("v"), is_total.alias("total"))
    parts = flagged.where("not total")
    enough = parts.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    e = enough.select(*(F.col(k).alias(f"e_{k}") for k in keys))
    totals = flagged.where("total and v != 0")
    totals = totals.join(e, [totals[k].eqNullSafe(e[f"e_{k}"]) for k in keys], "left_semi")
    side = lambda s: parts.select(*(F.col(k).alias(f"{s}_{k}") for k in keys), F.col("seq").alias(f"{s}_seq"), F.col("v").alias(f"{s}_v"))
    a, b = side("a"), side("b")
    sums = a.join(b, [a[f"a_{k}"].eqNullSafe(b[f"b_{k}"]) for k in keys] + [a["a_seq"] < b["b_seq"]])
    sums = sums.select(*(F.col(f"a_{k}") for k in keys), (F.col("a_v") + F.col("b_v")).alias("s"))
    near = F.abs(F.col("s") - F.col("v")) <= F.abs("v") * TOLERANCE
    hit = totals.join(sums, [totals[k].eqNullSafe(sums[f"a_{k}"]) for k in keys] + [near], "left_semi").select("seq", F.lit(True).alias("satisfied"))
    del same
    return totals.select("seq").join(hit, "seq", "left").withColumn("satisfied", F.coalesce("satisfied", F.lit(False)))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that is equal for equal tables, whatever their order: count and sum of row hashes."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("hash"))


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| / |a|, or null without a."""
    return F.when(a != 0, F.try_divide(F.abs(a - b).cast("double"), F.abs(a).cast("double")))


def period_resolution(claims: DataFrame) -> DataFrame:
    """One row: claims, resolved, rate."""
    out = claims.agg(F.count("*").alias("claims"), F.count_if(F.col("p_start").isNotNull()).alias("resolved"))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("resolved"), F.col("claims")), F.lit(0.0)), 4))


def disagreements(edges: DataFrame) -> DataFrame:
    """One row on pairs whose values differ: same-page share, share with a gap beyond 5, by relation."""
    gap = relative_gap(F.col("a_magnitude"), F.col("b_magnitude"))
    return edges.where("a_magnitude != b_magnitude").groupBy("relation").agg(
        F.count("*").alias("n"), F.round(F.avg((~F.col("cross_document")).cast("double")), 4).alias("same_document_share"), F.round(F.avg((gap > 5).cast("double")), 4).alias("wide_share")
    )
