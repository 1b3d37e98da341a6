"""Checkpoint files: one JSON line per page, plain or gzipped; what is torn or unknown is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CLAIM_NAMES, EVIDENCE, PROVENANCE, SCOPE, VALUE

#: Stored claims have magnitudes as text.
_STORED_VALUE = VALUE.replace("decimal(38,10)", "string")
_STORED_CLAIM = (
    f"struct<id:string,subject_id:string,predicate_id:string,subject_raw:string,predicate_raw:string,value:{_STORED_VALUE},scope:{SCOPE},"
    f"evidence:array<{EVIDENCE}>,confidence:double,scale_inferred:boolean,provenance:{PROVENANCE}>"
)
LINES = (
    f"page int, document string, document_sha256 string, extracted_at string, claims array<{_STORED_CLAIM}>, "
    f"quarantined array<struct<claim:{_STORED_CLAIM},reason:string,detail:string>>, _corrupt_record string"
)


GLOB = "*.{jsonl,jsonl.gz,json,json.gz}"


def stem_of(path: str):
    folder = F.regexp_extract(path, "/stem=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_extract(path, r"([^/]+?)\.jsonl?(?:\.gz)?$", 1))


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem) of the checkpoint files: a plain file shadows a gzipped one of the same stem. Files that append_pages()
    wrote lie in a folder for each stem and shadow nothing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder).select("path")
    named = files.withColumn("stem", stem_of("path")).withColumn("plain", ~F.col("path").endswith(".jsonl.gz"))
    plain = named.where("plain").select("stem").distinct()
    return named.where("plain").unionByName(named.where("not plain").join(plain, "stem", "left_anti")).select("path", "stem")


def signature(spark: SparkSession, folder: str) -> DataFrame:
    """(name, modified, size) of the plain files, by which a change is seen. Only metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(name.alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy("name")


def _paths(spark: SparkSession, folder: str) -> list[str]:
    return [r["path"] for r in sources(spark, folder).orderBy("path").collect()]  # file names only


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Sound lines of the files, with their place (_file, _block, _at)."""
    read = spark.read.schema(LINES).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)
    named = read.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    return named.where("_corrupt_record is null and page is not null").drop("_corrupt_record")


_PLACE = ["_file", "_block", "_at"]


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Sound lines with their file's stem and their place."""
    paths = _paths(spark, folder)
    if not paths:
        return spark.createDataFrame([], f"{LINES.replace(', _corrupt_record string', '')}, stem string, _file string, _block bigint, _at bigint")
    return _read(spark, paths).withColumn("stem", stem_of("_file"))


def _numbered(placed: DataFrame) -> DataFrame:
    return placed.withColumn("line", F.row_number().over(Window.partitionBy("stem").orderBy(*_PLACE))).drop(*_PLACE)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sound lines with their file's stem and their order: seq of lines follows path and place in the file."""
    return _numbered(_placed(spark, folder))


INDEX = "path string, stem string, modified timestamp, size bigint, document_id string, document string, pages bigint, claims bigint"


def refresh_index(spark: SparkSession, folder: str, index: str) -> tuple[DataFrame, int]:
    """(INDEX of the checkpoint files of the folder, how many of them were read): files with the time and size that the stored
    index has are taken from it, only the others are opened. The new index is stored as another version.

    Of a file the index holds its first line's document, and how many pages and claims it has.
    """
    there = spark.read.format("binaryFile").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(folder)
    now = there.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).join(sources(spark, folder), "path")
    try:
        versions = spark.read.parquet(index)
        last = versions.agg(F.max("version")).first()[0] or 0
        old = versions.where(F.col("version") == last).drop("version")
    except Exception as e:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        last, old = 0, spark.createDataFrame([], INDEX)
    same = ["path", "modified", "size"]
    changed = now.join(old, same, "left_anti")
    paths = [r["path"] for r in changed.select("path").collect()]  # names of files that changed
    columns = [c.split()[0] for c in INDEX.split(", ")]
    fresh = spark.createDataFrame([], INDEX)
    if paths:
        place = F.struct("_block", "_at")
        read = _read(spark, paths).groupBy(F.col("_file").alias("path")).agg(
            F.min_by(F.get("claims", 0)["evidence"][0]["document_id"], place).alias("document_id"),
            F.min_by("document", place).alias("document"),
            F.count("*").alias("pages"),
            F.sum(F.coalesce(F.size("claims"), F.lit(0))).cast("bigint").alias("claims"),
        )
        base = F.regexp_extract("path", "([^/]+)$", 1)  # the two listings escape paths differently
        read = read.withColumns({"stem": stem_of("path"), "_base": base}).drop("path")
        fresh = changed.withColumn("_base", base).join(read, ["stem", "_base"], "left")
        fresh = fresh.withColumn("document_id", F.coalesce("document_id", "stem")).fillna(0, ["pages", "claims"])
    kept = old.join(now.select(*same), same, "left_semi")
    kept.select(*columns).unionByName(fresh.select(*columns)).write.parquet(f"{index}/version={last + 1}")
    return spark.read.schema(INDEX).parquet(f"{index}/version={last + 1}"), len(paths)


def _typed(claim: str) -> list:
    """Columns of CLAIMS from a stored claim, but for seq."""
    c = F.col(claim)
    number = lambda n: F.col(f"{claim}.value.{n}").try_cast("decimal(38,10)")
    value = c["value"]
    for n in ("canonical_magnitude", "range_low", "range_high"):
        value = value.withField(n, number(n))
    named = ["id", "subject_id", "predicate_id", "subject_raw", "predicate_raw"]
    rest = ["scope", "evidence", "confidence", "scale_inferred", "provenance"]
    return [c[n].alias(n) for n in named] + [value.alias("value")] + [c[n].alias(n) for n in rest]


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with seq: by stem, line and place in the line. The first two parts of the number are bit fields, so no global
    sort is needed: files are ranked among their few names, lines within their file."""
    names = rows.select("stem").distinct().withColumn("_f", F.row_number().over(Window.orderBy("stem")) - 1)
    seq = F.shiftleft(F.col("_f").cast("bigint"), 40) + F.shiftleft(F.col("line").cast("bigint"), 16) + F.col("_i")
    return rows.join(names, "stem").withColumn("seq", seq)


def load_claims(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, quarantined, documents). A document's id is its first claim's, else its file's stem."""
    placed = _placed(spark, folder)
    page = _numbered(placed)
    exploded = page.select("stem", "line", F.posexplode("claims").alias("_i", "c")).where("c.id is not null and c.value is not null")
    claims = _ordered(exploded).select("seq", "stem", *_typed("c"))
    claims = claims.select(*CLAIM_NAMES, "stem")
    refused = page.select("stem", "page", F.explode("quarantined").alias("q")).select("stem", "page", F.col("q.claim.id").alias("id"), "q.reason", "q.detail")
    per = page.groupBy("stem").agg(
        F.max("document").alias("document"), F.count("*").alias("pages"), F.sum(F.coalesce(F.size("claims"), F.lit(0))).alias("claims"), F.sum(F.coalesce(F.size("quarantined"), F.lit(0))).alias("quarantined")
    )
    # the first claim by place: lines are not moved to be numbered
    each = placed.select("stem", *_PLACE, F.posexplode("claims").alias("_i", "c")).where("c.id is not null and c.value is not null")
    ids = each.groupBy("stem").agg(F.min_by(F.get("c.evidence", 0)["document_id"], F.struct(*_PLACE, "_i")).alias("_id"))
    documents = per.join(ids, "stem", "left").withColumn("document_id", F.coalesce("_id", "stem")).drop("_id")
    return claims.drop("stem"), refused, documents


def first_line_index(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, document): from the first line of each file."""
    first = lines(spark, folder).where("line = 1")
    return first.select(F.coalesce(F.get("claims", 0)["evidence"][0]["document_id"], F.col("stem")).alias("document_id"), "document")


def pages_done(spark: SparkSession, folder: str, prompt_version: str | None = None) -> DataFrame:
    """(stem, page) that checkpoints hold; with a version, only pages with a claim of it."""
    page = lines(spark, folder)
    if prompt_version is not None:
        page = page.where(F.exists("claims", lambda c: c["provenance"]["prompt_version"] == prompt_version))
    return page.select("stem", "page").distinct()


def pages_todo(pages: DataFrame, done: DataFrame) -> DataFrame:
    return pages.join(done, ["stem", "page"], "left_anti")


def append_pages(pages: DataFrame, folder: str, done: DataFrame | None = None) -> None:
    """Append page lines(stem, page, document, claims, ...), gzipped, in a folder for each stem; pages that are done are left out.
    Pages that lie by stem and page already are not moved for that."""
    new = pages if done is None else pages_todo(pages, done)
    new.write.partitionBy("stem").mode("append").option("compression", "gzip").json(folder)


def snapshot(spark: SparkSession, folder: str, target: str) -> None:
    """All sound lines, gzipped."""
    _placed(spark, folder).drop(*_PLACE).write.partitionBy("stem").mode("overwrite").option("compression", "gzip").json(target)
