"""Candidate pairs: blocked self-joins, whole or with a cap on the block.

With a cap, a block of more than ``cap`` claims is cut to its most confident ones before the join, so no block gives more
than cap * (cap - 1) / 2 pairs whatever its size. The cut is a window with a limit on its rank, which Spark pushes below the
sort's shuffle as a group limit: a hot key sends at most ``cap`` rows a task. Without one (``cap=None``) every pair of a
block is formed, in tiles: no task holds more than TILE claims of a block, and a large block is the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounding_tolerance, value_bucket

CAP = 60
#: Claims of a block that one task of a whole self-join holds at once.
TILE = 20_000
#: Why two claims are a pair.
SAME_BLOCK, SAME_VALUE = "same subject and predicate", "same subject, equal value under different predicates"
#: What a pair needs of a claim; the rest is joined again by id where it is wanted.
NARROW = [
    "id",
    "seq",
    "subject_id",
    "predicate_id",
    "subject_raw",
    "predicate_raw",
    "kind",
    "raw",
    "magnitude",
    "tolerance",
    "currency",
    "date_value",
    "text_value",
    "bool_value",
    "range_low",
    "range_high",
    "p_start",
    "p_end",
    "basis",
    "segment",
    "geography",
    "accounting",
    "modality",
    "document_id",
    "page",
    "confidence",
    "unreliable",
]


def narrowed(claims: DataFrame) -> DataFrame:
    """Claims as flat rows: value, scope and first evidence spread out."""
    v, s, e = F.col("value"), F.col("scope"), F.get("evidence", 0)
    flag = F.col("unreliable") if "unreliable" in claims.columns else F.lit(False)
    return claims.select(
        "id",
        "seq",
        "subject_id",
        "predicate_id",
        "subject_raw",
        "predicate_raw",
        v["kind"].alias("kind"),
        v["raw"].alias("raw"),
        v["canonical_magnitude"].alias("magnitude"),
        rounding_tolerance(v["canonical_magnitude"], v["raw"]).alias("tolerance"),
        v["currency"].alias("currency"),
        v["date_value"].alias("date_value"),
        v["text_value"].alias("text_value"),
        v["bool_value"].alias("bool_value"),
        v["range_low"].alias("range_low"),
        v["range_high"].alias("range_high"),
        s["period"]["start"].alias("p_start"),
        s["period"]["end"].alias("p_end"),
        s["basis"].alias("basis"),
        s["segment"].alias("segment"),
        s["geography"].alias("geography"),
        s["accounting"].alias("accounting"),
        s["modality"].alias("modality"),
        e["document_id"].alias("document_id"),
        e["page"].alias("page"),
        "confidence",
        flag.alias("unreliable"),
    )


def unreliable_periods(narrow: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """narrow with unreliable: its page gives the same measure and period with more than one magnitude.

    Aggregated before the join back, so a frequent key is never one task's window. A null magnitude counts as a value.
    over: the claims to judge by, if they are not narrow's own.
    """
    keys = ["document_id", "page", "predicate_id", "p_start", "p_end"]
    known = (narrow if over is None else over).where("document_id is not null and predicate_id is not null")
    shown = F.struct("magnitude")
    mixed = known.groupBy(*keys).agg(F.min(shown).alias("lo"), F.max(shown).alias("hi")).where("not (lo <=> hi)").select(*keys)
    flags = mixed.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [narrow[k].eqNullSafe(flags[f"_{k}"]) for k in keys]
    joined = narrow.drop("unreliable").join(flags.withColumn("_mixed", F.lit(True)), [c for c in same], "left")
    return joined.withColumn("unreliable", F.coalesce("_mixed", F.lit(False))).select(*NARROW)


def capped_blocks(narrow: DataFrame, cap: int = CAP) -> DataFrame:
    """Members of exact blocks with their rank ``rn`` in the order in which pairs are formed.

    Small blocks keep the load order; larger ones go by confidence, then load order, cut at the cap. Both ranks are
    taken over at most ``cap + 1`` rows a block.
    """
    keyed = narrow.where("subject_id is not null and predicate_id is not null")
    block = Window.partitionBy("subject_id", "predicate_id")
    by_confidence = F.row_number().over(block.orderBy(F.desc("confidence"), "seq"))
    few = keyed.withColumn("_by_confidence", by_confidence).where(F.col("_by_confidence") <= cap + 1)
    sized = few.withColumn("_n", F.count("*").over(block))
    in_order = F.row_number().over(block.orderBy("seq"))
    ranked = sized.withColumn("rn", F.when(F.col("_n") > cap, F.col("_by_confidence")).otherwise(in_order))
    return ranked.where(F.col("rn") <= cap).drop("_by_confidence", "_n")


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))


def whole_pairs(members: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """All pairs (a_*, b_*) of members with equal keys (null is a value), a before b in load order, which ``rn`` counts.

    Members lie in tiles of the group's load order. A tile meets itself and all that comes after it, so a task holds one tile
    and streams past it; only groups of more than one tile send a claim more than once.
    """
    ranked = members.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    own = F.floor((F.col("rn") - 1) / tile).cast("int")
    a, b = _side(ranked.withColumn("tile", own), "a"), _side(ranked.withColumn("tile", F.explode(F.sequence(F.lit(0), own))), "b")
    same = (a["a_tile"] == b["b_tile"]) & (a["a_rn"] < b["b_rn"])
    for k in keys:
        same = same & a[f"a_{k}"].eqNullSafe(b[f"b_{k}"])
    return b.join(a, same).drop("a_tile", "b_tile").select(*(f"{s}_{c}" for s in "ab" for c in ranked.columns))


def exact_pairs(narrow: DataFrame, cap: int | None = CAP, cross_document: bool = False) -> DataFrame:
    """Pairs (a_*, b_*) of claims with one subject and predicate, a before b in its block. cap None: of whole blocks."""
    apart = (F.col("a_document_id") != F.col("b_document_id")) if cross_document else F.lit(True)
    if cap is None:
        known = narrow.where("subject_id is not null and predicate_id is not null")
        return whole_pairs(known, ["subject_id", "predicate_id"]).where(apart).withColumn("reason", F.lit(SAME_BLOCK))
    members = capped_blocks(narrow, cap)
    a, b = _side(members, "a"), _side(members, "b")
    same = (a["a_subject_id"] == b["b_subject_id"]) & (a["a_predicate_id"] == b["b_predicate_id"])
    return a.join(b, same & (F.col("a_rn") < F.col("b_rn")) & apart).withColumn("reason", F.lit(SAME_BLOCK))


def value_pairs(narrow: DataFrame, cap: int | None = CAP) -> DataFrame:
    """Pairs of one subject with equal rounded values under different predicates. Buckets beyond the cap give none; with cap
    None every bucket gives all of its pairs."""
    keyed = narrow.withColumn("bucket", value_bucket(F.col("kind"), F.col("magnitude"))).where("bucket is not null")
    if cap is None:
        met = whole_pairs(keyed, ["bucket", "subject_id"]).where("not (a_predicate_id <=> b_predicate_id)")
        return met.drop("a_bucket", "b_bucket", "a_rn", "b_rn").withColumn("reason", F.lit(SAME_VALUE))
    fits = keyed.groupBy("bucket").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, cap)).select("bucket")
    members = keyed.join(fits, "bucket")
    a, b = _side(members, "a"), _side(members, "b")
    apart = ~F.col("a_predicate_id").eqNullSafe(F.col("b_predicate_id")) & F.col("a_subject_id").eqNullSafe(F.col("b_subject_id"))
    pairs = a.join(b, (a["a_bucket"] == b["b_bucket"]) & (F.col("a_seq") < F.col("b_seq")) & apart)
    return pairs.drop("a_bucket", "b_bucket").withColumn("reason", F.lit(SAME_VALUE))


def all_pairs(narrow: DataFrame, cap: int = CAP, cross_document: bool = False) -> DataFrame:
    """Exact and value pairs, each pair of claims once. The two kinds have no pair in common (one has equal predicates, the
    other different ones), and each gives a pair once, so nothing has to be moved to find repetitions."""
    exact = exact_pairs(narrow, cap, cross_document).drop("a_rn", "b_rn")
    value = value_pairs(narrow, cap)
    return exact.unionByName(value.where("a_document_id != b_document_id") if cross_document else value)


def pairs_by_reason(pairs: DataFrame) -> DataFrame:
    """(reason, n) of all_pairs, with both reasons present."""
    counts = pairs.groupBy("reason").agg(F.count("*").alias("n"))
    names = pairs.sparkSession.createDataFrame([(SAME_BLOCK,), (SAME_VALUE,)], "reason string")
    return names.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


def first_of_blocks(narrow: DataFrame, cap: int = CAP) -> DataFrame:
    """The first ``cap`` claims of each block, in load order."""
    block = Window.partitionBy("subject_id", "predicate_id").orderBy("seq")
    known = narrow.where("subject_id is not null and predicate_id is not null")
    return known.withColumn("_rn", F.row_number().over(block)).where(F.col("_rn") <= cap).drop("_rn")


def incremental_pairs(new: DataFrame, existing: DataFrame, cap: int = CAP) -> DataFrame:
    """Each new claim with the first ``cap`` existing ones of its block, in load order; the new one is a."""
    a, b = _side(new, "a"), _side(first_of_blocks(existing, cap), "b")
    same = (a["a_subject_id"] == b["b_subject_id"]) & (a["a_predicate_id"] == b["b_predicate_id"])
    return a.join(b, same).withColumn("reason", F.lit("same subject and predicate (incremental)"))


def pairing_report(narrow: DataFrame, cap: int = CAP, pairs: DataFrame | None = None) -> DataFrame:
    """One row: claims, exact_blocks, value_blocks, pairs, oversized_blocks, skipped_for_size."""
    n = F.col("n")
    exact = narrow.where("subject_id is not null and predicate_id is not null").groupBy("subject_id", "predicate_id").agg(F.count("*").alias("n"))
    over = n > cap
    blocks = exact.agg(
        F.count("*").alias("exact_blocks"),
        F.coalesce(F.sum(F.least(n, F.lit(cap)) * (F.least(n, F.lit(cap)) - 1) / 2), F.lit(0)).cast("bigint").alias("pairs"),
        F.count_if(over).alias("oversized_blocks"),
        F.coalesce(F.sum(F.when(over, n * (n - 1) / 2)), F.lit(0)).cast("bigint").alias("skipped_for_size"),
    )
    buckets = narrow.select(value_bucket(F.col("kind"), F.col("magnitude")).alias("b")).where("b is not null")
    values = buckets.groupBy("b").count().agg(F.count("*").alias("value_blocks"))
    total = narrow.agg(F.count("*").alias("claims"))
    if pairs is not None:
        blocks = blocks.drop("pairs").crossJoin(pairs.agg(F.count("*").alias("pairs")))
    one = total.crossJoin(blocks).crossJoin(values)  # one row each
    return one.select("claims", "exact_blocks", "value_blocks", "pairs", "oversized_blocks", "skipped_for_size")
