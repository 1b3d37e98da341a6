"""Documents as tables: content hashes, stable ids, blocks and page texts; uploads and their refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import first_of
from ..functions.text import uuid5

MOST_BYTES = 80 * 1024 * 1024


def content_hashes(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, sha256, document_id): identity is a function of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return with_document_id(files.select("path", "length", F.sha2("content", 256).alias("sha256")))


def with_document_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("document_id", uuid5(F.col("sha256")))


def page_texts(blocks: DataFrame) -> DataFrame:
    """(document_id, page, text): the blocks of a page in order, with an empty line between them."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks.groupBy("document_id", "page").agg(F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n").alias("text"))


def with_offsets(blocks: DataFrame) -> DataFrame:
    """blocks with char_start and char_end such that the page's text from start to end is the block's."""
    order = Window.partitionBy("document_id", "page").orderBy("ord")
    end = F.sum(F.length("text") + 2).over(order) - 2
    return blocks.withColumns({"char_end": end.cast("int"), "char_start": (end - F.length("text")).cast("int")})


def overlapping(a, b):
    """Share of a's area within b, of structs x0, y0, x1, y1; blocks over 0.6 within a table are the table's."""
    width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.coalesce(F.try_divide(width * height, area), F.lit(0.0))


def block_kind(text, bold, size):
    """heading for a short line that is bold or of 13 points and more, else paragraph."""
    return F.when((F.length(text) <= 120) & (bold | (size >= 13)), F.lit("heading")).otherwise(F.lit("paragraph"))


def text_blocks(docs: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """Plain texts(document_id, text) as blocks: paragraphs at empty lines or line ends, pages of so many lines."""
    cut = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    placed = cut.select("document_id", (F.floor(F.col("i") / lines_per_page) + 1).cast("int").alias("page"), F.col("i").alias("ord"), F.lit("paragraph").alias("kind"), "text")
    return with_offsets(placed)


def safe_stem(filename):
    """A file name without folders or extension, of letters, digits, _ and -, at most 80 characters."""
    base = F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.substr(F.regexp_replace(F.regexp_replace(base, r"[^\p{L}\p{N}_-]", "-"), r"^-+|-+$", ""), F.lit(1), F.lit(80))


def judge_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """uploads(filename, content) with sha256, stem and refusal: not_pdf, empty, too_large, duplicate (409), or null."""
    u = uploads.withColumns({"sha256": F.sha2("content", 256), "stem": safe_stem(F.col("filename")), "size": F.octet_length("content")})
    have = known.select("sha256").distinct().withColumn("_known", F.lit(True))
    joined = u.join(have, "sha256", "left")
    rows = [(~F.lower("filename").endswith(".pdf"), "not_pdf"), (F.col("size") == 0, "empty"), (F.col("size") > MOST_BYTES, "too_large"), (F.coalesce("_known", F.lit(False)), "duplicate")]
    return joined.withColumn("refusal", first_of([(c, F.lit(n)) for c, n in rows])).drop("_known")
