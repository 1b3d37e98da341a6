"""The usage ledger: JSON lines of usage and of what a provider said was left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "t string, at timestamp, provider string, model string, pt bigint, ct bigint, req bigint, chars bigint, req_remaining bigint"
COMPACT_AT, KEEP_DAYS = 512_000, 7


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Sound lines with their order as line."""
    read = spark.read.schema(f"{LEDGER}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return read.where("t is not null and _corrupt_record is null").drop("_corrupt_record").withColumn("line", F.monotonically_increasing_id())


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def compacted(ledger: DataFrame, today: str, size: int) -> DataFrame:
    """The last days only, once the ledger is large."""
    return ledger if size <= COMPACT_AT else ledger.where(F.to_date("at") > F.date_sub(F.lit(today).cast("date"), KEEP_DAYS))


def reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored reports: whole JSON files."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows, kept with its time and as the latest."""
    stamped = report.withColumn("written_at", F.current_timestamp())
    stamped.coalesce(1).write.mode("append").json(f"{path}/history")
    stamped.coalesce(1).write.mode("overwrite").json(f"{path}/latest")
