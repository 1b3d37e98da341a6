"""Blocks of pages from boxes: spans of text and tables, whoever found them, as tables of numbers.

Tables come first on a page, as pipe tables. Text that lies within a table for the most part is the table's own and is left out.
Which block lies in which table is a spatial join: boxes are put on a grid of their page, only boxes that share a cell meet, and
a pair counts in the one cell where their common part begins. So a page of many boxes costs what its neighbours are, and
not the product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import strip
from ..functions.text import header_path, markdown_table, normalise_rect
from .documents import block_kind, overlapping, with_offsets

#: Cells of a page's grid, each way.
GRID = 8
#: Fixed value: the share of a block within a table from which the text is the table's.
WITHIN = 0.6
_PAGE = ["document_id", "page"]
BOX = ["x0", "y0", "x1", "y1"]


def text_boxes(spans: DataFrame) -> DataFrame:
    """(document_id, page, block, text, bold, size, box) of spans(document_id, page, block, line, span, text, bold, size, x0, y0,
    x1, y1): spans of a line are run together, lines stay apart, and a block without text is none."""
    part = F.sort_array(F.collect_list(F.struct("line", "span", F.coalesce("text", F.lit("")).alias("text"))))
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    blocks = spans.groupBy(*_PAGE, "block").agg(part.alias("parts"), F.bool_or("bold").alias("bold"), F.max("size").alias("size"), *sides)
    numbers = F.array_distinct(F.transform("parts", lambda p: p["line"]))
    line = lambda n: F.array_join(F.transform(F.filter("parts", lambda p: p["line"] == n), lambda p: p["text"]), "")
    text = strip(F.array_join(F.filter(F.transform(numbers, line), lambda t: strip(t) != ""), "\n"))
    return blocks.select(*_PAGE, "block", text.alias("text"), "bold", "size", F.struct(*BOX).alias("box")).where("text != ''")


def _cells(box: Column, page: Column) -> tuple[Column, Column, Column, Column]:
    """The first and last cells of a box, across and down."""

    def cell(at: Column, low: Column, high: Column) -> Column:
        share = F.coalesce(F.try_divide(at - low, high - low), F.lit(0.0))
        return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), F.floor(share * GRID))).cast("int")

    across = lambda at: cell(at, page["x0"], page["x1"])
    down = lambda at: cell(at, page["y0"], page["y1"])
    return across(box["x0"]), across(box["x1"]), down(box["y0"]), down(box["y1"])


def on_grid(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """boxes(document_id, page, box, ...) once for each cell (cx, cy) that they reach, with their first cell (fx, fy)."""
    placed = boxes.join(pages.select(*_PAGE, F.struct(*BOX).alias("_page")), _PAGE)
    a, b, c, d = _cells(F.col("box"), F.col("_page"))
    placed = placed.withColumns({"fx": a, "_lx": F.greatest(a, b), "fy": c, "_ly": F.greatest(c, d)}).drop("_page")
    wide = placed.withColumn("cx", F.explode(F.sequence("fx", "_lx")))
    return wide.withColumn("cy", F.explode(F.sequence("fy", "_ly"))).drop("_lx", "_ly")


def within_tables(blocks: DataFrame, tables: DataFrame, pages: DataFrame, share: float = WITHIN) -> DataFrame:
    """(document_id, page, block, table): blocks that lie within a table by more than ``share`` of their area."""
    one = on_grid(blocks.select(*_PAGE, "block", "box"), pages)
    other = on_grid(tables.select(*_PAGE, "table", "box"), pages).select(*_PAGE, "cx", "cy", "table", F.col("box").alias("t_box"), F.col("fx").alias("t_fx"), F.col("fy").alias("t_fy"))
    met = one.join(other, [*_PAGE, "cx", "cy"])
    first = (F.col("cx") == F.greatest("fx", "t_fx")) & (F.col("cy") == F.greatest("fy", "t_fy"))
    return met.where(first & (overlapping(F.col("box"), F.col("t_box")) > share)).select(*_PAGE, "block", "table")


def with_inside(blocks: DataFrame, tables: DataFrame, pages: DataFrame, share: float = WITHIN) -> DataFrame:
    """blocks with inside: whether they lie within a table by more than ``share`` of their area; and with _page, their page's box.

    The tables of a page come as one row, by cell, and a block looks up the cells that it reaches. So blocks meet them by page
    alone: what lies by page already stays where it is, with its text. Blocks of unknown pages count as outside.
    """
    cells = on_grid(tables.select(*_PAGE, "table", "box"), pages)
    by_page = cells.groupBy(*_PAGE).agg(F.collect_list(F.struct((F.col("cx") * GRID + F.col("cy")).alias("cell"), "box")).alias("t"))
    of_cell = lambda i: F.transform(F.filter("t", lambda x: x["cell"] == i), lambda x: x["box"])
    sides = pages.select(*_PAGE, F.struct(*BOX).alias("_page"))
    grid = sides.join(by_page.select(*_PAGE, F.transform(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)), of_cell).alias("_cells")), _PAGE, "left")
    a, b, c, d = _cells(F.col("box"), F.col("_page"))
    reach = F.flatten(F.transform(F.sequence(a, F.greatest(a, b)), lambda x: F.transform(F.sequence(c, F.greatest(c, d)), lambda y: x * GRID + y)))
    held = F.exists(reach, lambda i: F.exists(F.get("_cells", i), lambda t: overlapping(F.col("box"), t) > share))
    return blocks.join(grid, _PAGE, "left").withColumn("inside", F.coalesce(held, F.lit(False))).drop("_cells")


def page_blocks(spans: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page, ord, kind, text, char_start, char_end, rect, header_path, table_index) of pages(document_id, page, x0, y0,
    x1, y1) and tables(document_id, page, table, rows, x0, y0, x1, y1): tables in their order, then text in its.

    Rects are shares of the page. Short text that is bold or of 13 points and more is a heading.
    """
    box = F.struct(*BOX).alias("box")
    full = tables.select(*_PAGE, "table", markdown_table(F.col("rows")).alias("text"), header_path(F.col("rows")).alias("header_path"), box).where(strip(F.coalesce("text", F.lit(""))) != "")
    text = text_boxes(spans)
    free = with_inside(text, full, pages).where("not inside and _page is not null")
    placed = full.join(pages.select(*_PAGE, F.struct(*BOX).alias("_page")), _PAGE)
    one = placed.select(*_PAGE, "_page", F.lit(0).alias("_after"), F.col("table").cast("long").alias("_n"), F.lit("table").alias("kind"), "text", "box", "header_path", F.col("table").cast("int").alias("table_index"))
    kind = block_kind(F.col("text"), F.coalesce("bold", F.lit(False)), F.coalesce("size", F.lit(0.0)))
    two = free.select(*_PAGE, "_page", F.lit(1).alias("_after"), F.col("block").cast("long").alias("_n"), kind.alias("kind"), "text", "box", F.lit(None).cast("string").alias("header_path"), F.lit(None).cast("int").alias("table_index"))
    order = Window.partitionBy(*_PAGE).orderBy("_after", "_n")
    every = one.unionByName(two).withColumn("ord", F.row_number().over(order) - 1)
    sized = with_offsets(every)
    page, own = F.col("_page"), F.col("box")
    moved = F.struct(*((own[c] - page[c[0] + "0"]).alias(c) for c in BOX))
    rect = normalise_rect(moved, page["x1"] - page["x0"], page["y1"] - page["y0"])
    return sized.select(*_PAGE, "ord", "kind", "text", "char_start", "char_end", rect.alias("rect"), "header_path", "table_index")
