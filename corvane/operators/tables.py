"""Table blocks from raw tables: normalisation, filters, titles, headers, text, HTML, placement on the page.

Raw tables are rows (doc_id, page_no, page_width, page_height, table_idx, bbox, rows array<array<string>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import overlap_of_own_area
from corvane.functions.text import bind, let, squeeze

ROWS = "array<array<string>>"


def filled(row: Column) -> Column:
    return F.filter(row, lambda c: c != "")


def normalized_rows(rows: Column) -> Column:
    """Cells squeezed; empty rows and columns gone; ragged rows padded."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda c: squeeze(F.coalesce(c, F.lit("")))))
    return let(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")), _compact)


def _compact(solid: Column) -> Column:
    widest = F.coalesce(F.array_max(F.transform(solid, F.size)), F.lit(0))
    numbers = F.when(widest > 0, F.sequence(F.lit(1), widest)).otherwise(F.array().cast("array<int>"))
    every = F.filter(numbers, lambda i: F.exists(solid, lambda r: F.coalesce(F.try_element_at(r, i), F.lit("")) != ""))
    # mostly the used columns are the first ones of whole rows, which can be cut without looking at cells
    first = lambda used: (F.coalesce(F.array_max(used), F.lit(0)) == F.size(used)) & F.forall(solid, lambda r: F.size(r) >= F.size(used))
    picked = lambda used: F.transform(solid, lambda r: F.transform(used, lambda i: F.coalesce(F.try_element_at(r, i), F.lit(""))))
    return let(every, lambda used: F.when(first(used), F.transform(solid, lambda r: F.slice(r, F.lit(1), F.size(used)))).otherwise(picked(used)))


def title(rows: Column) -> Column:
    """The only cell of the first row, if it starts like a table title; else null."""
    return let(filled(F.try_element_at(rows, F.lit(1))), lambda first: F.when((F.size(first) == 1) & first[0].rlike("^(?:Table|表)"), first[0]))


def without_title(rows: Column, name: Column) -> Column:
    return F.when(name.isNotNull(), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)


def data_row(cells: Column) -> Column:
    numeric = F.size(F.filter(cells, lambda c: c.rlike(r"(?U)\d")))
    return let(numeric, lambda n: (n >= F.greatest(F.lit(1), F.floor(F.size(cells) / 2))) | ((n >= 1) & (F.size(cells) >= 3)))


def header_rows(full: Column) -> Column:
    """Rows before the first data row among three; at least one of any rows. ``full`` has each row's filled cells."""
    # rows that are empty don't count; the first data row, if there is one, ends the head
    three = F.filter(F.slice(full, 1, 3), lambda r: F.size(r) > 0)
    kinds = let(three, lambda rows: F.array_position(F.transform(rows, data_row), F.lit(True)) - 1)
    n = let(kinds, lambda at: F.when(at >= 0, at).otherwise(F.size(three)))
    return F.greatest(n.cast("int"), F.when(F.size(full) > 0, 1).otherwise(0))


def text_box(rows: Column) -> Column:
    """Running text that was taken for a table of one column."""
    mean = F.aggregate(rows, F.lit(0), lambda s, r: s + F.length(F.array_join(r, ""))) / F.size(rows)
    return (F.size(rows) >= 5) & F.forall(rows, lambda r: F.size(filled(r)) <= 1) & (mean >= 12)


def info_box(rows: Column) -> Column:
    """Contact details and the like: few, mostly single cells."""
    n = F.size(rows)
    wide = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    single = F.size(F.filter(rows, lambda r: F.size(filled(r)) <= 1))
    long = F.size(F.filter(rows, lambda r: F.length(F.array_join(r, "")) >= 14))
    mail = F.exists(rows, lambda r: F.exists(r, lambda c: c.contains("@")))
    return (n >= 3) & (wide <= 2) & ((mail & (n <= 6)) | ((single / n >= 0.6) & (long / n >= 0.5)))


def decorative(box: Column, width: Column, height: Column) -> Column:
    return F.coalesce((box["x1"] - box["x0"] <= width * 0.08) & (box["y1"] - box["y0"] >= height * 0.25), F.lit(False))


def page_number(rows: Column, box: Column, width: Column, height: Column, page_no: Column) -> Column:
    cells = F.filter(F.flatten(rows), lambda c: c != "")
    return F.coalesce((box["x0"] >= width * 0.8) & (box["y0"] >= height * 0.9) & (F.size(cells) == 1) & (cells[0] == page_no.cast("string")), F.lit(False))


def as_text(rows: Column, name: Column) -> Column:
    line = lambda r, i, heads: F.when(F.size(r) > 0, F.concat(F.when(i < heads, "表头: ").otherwise("数据: "), F.array_join(r, " | ")))
    listed = let(F.transform(rows, filled), lambda full: let(header_rows(full), lambda heads: F.transform(full, lambda r, i: line(r, i, heads))))
    return F.array_join(F.concat(F.array(F.concat(F.lit("表格标题: "), name)), listed), "\n")


def escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def as_html(rows: Column, name: Column) -> Column:
    def row(r: Column) -> Column:
        cells = F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), "")
        plain = (F.size(r) > 0) & ~F.array_join(r, "").rlike("[&<>\"']")
        return F.when(plain, F.concat(F.lit("<tr><td>"), F.array_join(r, "</td><td>"), F.lit("</td></tr>"))).otherwise(F.concat(F.lit("<tr>"), cells, F.lit("</tr>")))

    body = F.array_join(F.transform(rows, row), "")
    caption = F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("<caption>"), escaped(name), F.lit("</caption>"))).otherwise("")
    return F.concat(F.lit("<table>"), caption, body, F.lit("</table>"))


def table_blocks(raw: DataFrame) -> DataFrame:
    """Raw tables that are tables, with title, text, table_html and table_json."""
    w, h, b = F.col("page_width"), F.col("page_height"), F.col("bbox")
    clean = bind(raw.where(~decorative(b, w, h)), rows=normalized_rows(F.col("rows"))).where(F.size("rows") > 0)
    r = F.col("rows")
    kept = clean.where(~page_number(r, b, w, h, F.col("page_no")) & ~text_box(r) & ~info_box(r))
    titled = bind(kept, title=title(r))
    named = bind(titled, rows=without_title(r, F.col("title"))).where(F.size("rows") > 0)
    json = F.struct("title", "rows", F.size("rows").alias("row_count"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)).alias("column_count"))
    block_id = F.concat(F.lit("tbl_"), F.col("page_no").cast("string"), F.lit("_"), F.col("table_idx").cast("string"))
    return named.select("doc_id", "page_no", "table_idx", "bbox", block_id.alias("block_id"), F.lit("table").alias("type"), as_text(r, F.col("title")).alias("text"), as_html(r, F.col("title")).alias("table_html"), json.alias("table_json"))


def place(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of each page with its tables: texts that a table covers by 60 % go, tables take the section of the last block above them, and pages that have tables are ordered by position.

    ``blocks``: (doc_id, page_no, block_ord, block_id, type, text, bbox, section_path)."""
    b, t = blocks.alias("b"), tables.alias("t")
    same = (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page_no") == F.col("t.page_no"))
    covered = same & (F.col("b.type") != "table") & (overlap_of_own_area(F.col("b.bbox"), F.col("t.bbox")) >= 0.6)
    rest = b.join(t, covered, "left_anti")
    above = t.join(blocks.alias("b"), same & (F.col("b.bbox.y0") <= F.col("t.bbox.y0")), "left").groupBy("t.doc_id", "t.page_no", "t.table_idx").agg(F.max_by("b.section_path", "b.block_ord").alias("section_path"))
    own = tables.join(above, ["doc_id", "page_no", "table_idx"]).select("doc_id", "page_no", (F.lit(1_000_000) + F.col("table_idx")).alias("block_ord"), "block_id", "type", "text", "bbox", F.coalesce("section_path", F.array(F.lit("Document"))).alias("section_path"))
    both = rest.select("doc_id", "page_no", "block_ord", "block_id", "type", "text", "bbox", "section_path").unionByName(own)
    page = Window.partitionBy("doc_id", "page_no")
    far = F.lit(1e9)
    has = F.max((F.col("type") == "table") & (F.col("block_ord") >= 1_000_000)).over(page)
    key = F.when(has, F.struct(F.coalesce(F.col("bbox.y0"), far).alias("y"), F.coalesce(F.col("bbox.x0"), far).alias("x"))).otherwise(F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("x")))
    return both.withColumn("_key", key).withColumn("block_ord", F.row_number().over(page.orderBy("_key", "block_ord"))).drop("_key")


