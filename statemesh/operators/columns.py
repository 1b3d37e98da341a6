"""Recovery of table columns: header tables, flattened runs of numbers, and the cells where both fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import strip
from ..functions.periods import has_period
from ..functions.scale import parse_scale

#: Fixed value: a line that holds one number, or a dash, and nothing else.
NUMERIC_LINE = r"(?U)^\s*[(\-–—]?\s*(?:[\d,]+(?:\.\d+)?|[-–—])\s*\)?\s*$"


def forward_filled(cells: Column) -> Column:
    """Each empty cell takes the last cell before it that is not."""
    step = lambda s, c: F.concat(s, F.array(F.when(c != "", c).otherwise(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit("")))))
    return F.aggregate(cells, F.array().cast("array<string>"), step)


def header_cells(text: Column) -> Column:
    """Rows of a pipe table (array of arrays), rules left out."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.ltrim(r).startswith("|") & (F.regexp_replace(r, r"[|\-\s]", "") != ""))
    bare = lambda r: F.regexp_replace(F.regexp_replace(strip(r), r"^\|+", ""), r"\|+$", "")
    return F.transform(rows, lambda r: F.transform(F.split(bare(r), r"\|"), lambda c: strip(c)))


def combined_header(grid: Column) -> Column:
    """Labels of the value columns: the rows' filled cells joined, each distinct part once; empty labels left out."""
    width = lambda g: F.array_max(F.transform(g, lambda r: F.size(r)))
    padded = lambda r, n: forward_filled(F.concat(r, F.array_repeat(F.lit(""), n - F.size(r))))
    parts = lambda rows, i: F.array_distinct(F.filter(F.transform(rows, lambda r: F.get(r, i)), lambda c: c != ""))
    # the filled rows are worked out once, and not for each label
    filled = F.transform(F.array(width(grid)), lambda n: F.struct(n.alias("n"), F.transform(grid, lambda r: padded(r, n)).alias("rows")))
    joined = lambda x: F.transform(F.sequence(F.lit(1), x["n"] - 1), lambda i: F.array_join(parts(x["rows"], i), " "))
    wide = F.filter(filled, lambda x: x["n"] > 1)
    return F.filter(F.flatten(F.transform(wide, joined)), lambda c: c != "")


def header_layouts(blocks: DataFrame) -> DataFrame:
    """(document_id, page, labels): the first table of each page whose two or more labels are all periods."""
    # arrays of one: each step is worked out once, where filters on columns would have it worked out anew for every use
    grids = F.filter(F.array(header_cells(F.col("text"))), lambda g: F.size(g) >= 2)
    labels = F.filter(F.transform(grids, combined_header), lambda x: (F.size(x) >= 2) & F.forall(x, has_period))
    labelled = blocks.where("kind = 'table'").select("document_id", "page", "ord", F.explode(labels).alias("labels"))
    return labelled.groupBy("document_id", "page").agg(F.min_by("labels", "ord").alias("labels"))


def numeric_runs(blocks: DataFrame) -> DataFrame:
    """(document_id, page, ord, label_at, row_label, cells): a label line and the two or more number lines below it.

    A block is one row and its lines are gone through within it: every line that is no number starts a run, the number lines
    after it are its cells. Nothing is shuffled, and blocks without two number lines in a row are passed over.
    """
    run = "struct<label_at:bigint,row_label:string,cells:array<struct<start:bigint,end:bigint>>>"
    start = F.struct(F.col("char_start").cast("bigint").alias("at"), F.expr(f"cast(null as {run})").alias("open"), F.expr(f"cast(array() as array<{run}>)").alias("done"))

    def closed(s: Column) -> Column:
        """The runs with the open one, if it is one."""
        ended = (F.size(s["open"]["cells"]) >= 2) & (s["open"]["row_label"] != "")
        return F.when(ended, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        after = s["at"] + F.length(line)
        cell = F.struct(s["at"].alias("start"), after.alias("end"))
        number = line.rlike(NUMERIC_LINE)
        longer = s["open"].withField("cells", F.concat(s["open"]["cells"], F.array(cell)))
        fresh = F.struct(s["at"].alias("label_at"), strip(line).alias("row_label"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("cells"))
        return F.struct((after + 1).alias("at"), F.when(number, longer).otherwise(fresh).alias("open"), F.when(number, s["done"]).otherwise(closed(s)).alias("done"))

    some = blocks.where("kind != 'table'").where(F.col("text").rlike(r"(?U)[\d,\-–—]\s*\)?\s*\n\s*[(\-–—]?\s*[\d,\-–—]"))
    found = F.aggregate(F.split("text", "\n"), start, step, closed)
    return some.select("document_id", "page", "ord", F.inline(found)).select("document_id", "page", "ord", "label_at", "row_label", "cells")


def column_cells(blocks: DataFrame) -> DataFrame:
    """(document_id, page, start, end, column, row_label): only runs as long as their page's header is wide."""
    joined = numeric_runs(blocks).join(header_layouts(blocks), ["document_id", "page"]).where(F.size("cells") == F.size("labels"))
    one = F.explode(F.arrays_zip("cells", "labels")).alias("z")
    return joined.select("document_id", "page", "row_label", one).select("document_id", "page", F.col("z.cells.start").alias("start"), F.col("z.cells.end").alias("end"), F.col("z.labels").alias("column"), "row_label")


#: Characters in a bin of places on a page.
BIN = 256


def attach_columns(candidates: DataFrame, cells: DataFrame) -> DataFrame:
    """candidates with column_header and row_label of the first cell that holds them.

    An interval join by bins: a cell stands in each bin of places that it reaches, a candidate is in one. Cells are lines of a
    page, so a bin has few: they are put together as one row, and candidates are read and moved once.
    """
    reach = F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))
    one = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("column").alias("column"), F.col("row_label").alias("row_label"))
    c = cells.where(F.col("end") > F.col("start")).select("document_id", "page", F.explode(reach).alias("_bin"), one.alias("c"))
    bins = c.groupBy("document_id", "page", "_bin").agg(F.collect_list("c").alias("_cells"))
    own = [x for x in candidates.columns if x not in ("column_header", "row_label")]
    asked = candidates.select(*own, F.floor(F.col("at") / BIN).alias("_bin"))
    hit = F.array_min(F.filter("_cells", lambda x: (F.col("at") >= x["start"]) & (F.col("at") < x["end"])))
    met = asked.join(bins, ["document_id", "page", "_bin"], "left").select(*own, hit.alias("_c"))
    return met.withColumns({"column_header": F.col("_c.column"), "row_label": F.col("_c.row_label")}).drop("_c")


def page_scale_captions(blocks: DataFrame) -> DataFrame:
    """(document_id, page, caption): the first short line of a page that names a scale."""
    t = strip(F.col("text"))
    short = (t != "") & (F.length(t) <= 60) & ~t.contains("\n")
    named = blocks.where(short).where(parse_scale(t).isNotNull())
    return named.groupBy("document_id", "page").agg(F.min_by(t, "ord").alias("caption"))
