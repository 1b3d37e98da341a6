"""Statements and claims drawn from the driver's relational tables.

Each order is stated twice, in two dialects: in millions with thousands separators and in crore. Both statements go
through the parsers like any text would. The rules use integer arithmetic only, so that SQL can say the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import normalise_label
from ..functions.numbers import parse_value
from ..functions.periods import parse_period
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def period_text(key, year) -> "F.Column":
    """The order year as a period, in four equivalent forms; blank for every seventh key."""
    four = F.format_string("%04d", year.cast("int"))
    before = F.format_string("%04d", (year - 1).cast("int"))
    forms = [
        F.concat(F.lit("FY"), four),
        F.concat(F.lit("FY "), before, F.lit("-"), four),
        F.concat(F.lit("year ended March 31, "), four),
        F.concat(F.lit("fiscal "), four),
    ]
    out = F.when(key % 7 == 0, F.lit(""))
    for i, form in enumerate(forms):
        out = out.when(key % 4 == i, form)
    return out


def order_statements(spark: SparkSession, sf_dir: str, with_period: bool = False) -> DataFrame:
    """Two raw statements for each order: texts only, and the scope as it is stated. with_period: also that text parsed, once
    for both (_period)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    base = spread(orders).join(customers, orders["o_custkey"] == customers["c_custkey"])
    key, k = F.col("o_orderkey"), F.col("k")
    w = F.floor("o_totalprice").cast("bigint")
    base = base.withColumn("period_raw", period_text(key, F.year("o_orderdate")))
    if with_period:
        base = base.withColumn("_period", parse_period(F.col("period_raw")))
    both = base.withColumn("w", w).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    lot = F.concat(F.lit("order value "), F.lower("o_orderpriority"), F.lit(" lot "), (key % 40).cast("string"))
    basis = F.when((k == 1) & (key % 5 == 0), "unknown").when(F.col("o_orderstatus") == "O", "consolidated").when(F.col("o_orderstatus") == "F", "standalone").otherwise("unknown")
    return both.select(
        (key * 2 + k).alias("seq"),
        F.concat("c_mktsegment", F.when(k == 0, " Limited").otherwise(" Ltd")).alias("subject_raw"),
        F.when(key % 10 == 0, F.lit("order value")).otherwise(lot).alias("predicate_raw"),
        F.when(k == 0, F.format_number("w", 0)).otherwise(F.expr("cast((w + 5) div 10 as string)")).alias("raw"),
        F.when(k == 0, "(Rs. in millions)").otherwise("(₹ in crore)").alias("context"),
        "period_raw",
        basis.alias("basis"),
        F.when(key % 11 == 0, "Express").alias("segment"),
        ((F.col("o_custkey") + k) % 6).cast("string").alias("document_id"),
        (key % 40).cast("int").alias("page"),
        F.element_at(F.array(*map(F.lit, (0.45, 0.6, 0.85, 0.9))), (key % 4 + 1).cast("int")).alias("confidence"),
        F.col("c_mktsegment").alias("market"),
        key.alias("order_key"),
        k.cast("int").alias("dialect"),
        *(["_period"] if with_period else []),
    )


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the order statements; subject and predicate ids are label keys."""
    s = order_statements(spark, sf_dir, with_period=True)
    # parsed once: the structs would otherwise be computed anew for each field that is read
    parsed = s.withColumn("value", parse_value(F.col("raw"), F.col("context")))
    none = F.lit(None)
    scope = F.struct(
        F.col("_period").alias("period"),
        "basis",
        "segment",
        none.cast("string").alias("geography"),
        F.lit("unknown").alias("accounting"),
        F.lit("reported").alias("modality"),
        none.cast("date").alias("vintage"),
    )
    evidence = F.struct(
        "document_id",
        "page",
        F.lit(0).alias("char_start"),
        F.length("raw").alias("char_end"),
        F.col("raw").alias("quote"),
        F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("rects"),
        none.cast("string").alias("block_id"),
        F.lit("primary").alias("kind"),
    )
    return parsed.select(
        F.col("seq").cast("string").alias("id"),
        "seq",
        normalise_label(F.col("subject_raw"), strip_suffixes=True).alias("subject_id"),
        normalise_label(F.col("predicate_raw")).alias("predicate_id"),
        "subject_raw",
        "predicate_raw",
        "value",
        scope.alias("scope"),
        F.array(evidence).alias("evidence"),
        "confidence",
        F.lit(False).alias("scale_inferred"),
        none.cast("struct<extractor:string,prompt_version:string,pipeline_run_id:string,extracted_at:timestamp>").alias("provenance"),
    )
