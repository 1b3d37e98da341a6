"""A pipeline of five stages over documents; each stage is one operator of statemesh.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; where a stage changes texts, n_chars follows. run() writes each stage's result to the shared folder and reads
it again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statemesh.llm import near_dup, packing, pii, quality_rules, wu_manber
from statemesh.llm.exchange import stored

#: Near copies share at least this much of their five-word shingles; 85 is op10's own threshold.
SIMILAR_PERCENT = 80


def _tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _filtered(docs: DataFrame, judge, condition: str) -> DataFrame:
    """Rows of docs for which the judge's columns meet the condition; columns of docs never clash with those."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = {c: f"_own_{i}" for i, c in enumerate(others)}
    judged = judge(docs.withColumnsRenamed(aside)).where(condition)
    return judged.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _filtered(docs, lambda d: quality_rules.quality_rules(d, labels), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (of several with that id in the group, the first)."""
    return near_dup.one_of_each(docs, percent=SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _filtered(docs, lambda d: wu_manber.decontaminate(d, benchmark), "not contaminated")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal values replaced."""
    out = pii.pseudonymise(docs, pii.key_of(spark))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("n_private") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack_documents(docs, _tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: The near-duplicate and packing stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
