"""From tables of texts and web pages to blocks, and from blocks to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import blocks as B
from corvane.functions.text import strip
from corvane.operators import chunking, cleaning, sections

LINES_PER_PAGE = 20


def text_blocks(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """A block for each line that isn't blank; lines are laid out per_page to a page, without boxes or fonts."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).where(strip(F.col("text")) != "")
    page = (F.floor(F.col("pos") / per_page) + 1).cast("int")
    size = F.when(F.length(strip(F.col("text"))) <= 36, 14.0).otherwise(10.0)
    kind = B.block_type(F.col("text"), F.lit(1), size, F.lit(1.0))
    none = F.lit(None).cast("double")
    return cut.select("doc_id", page.alias("page_no"), none.alias("page_width"), none.alias("page_height"), (F.col("pos") + 1).cast("int").alias("block_ord"), F.concat(F.lit("b_"), page.cast("string"), F.lit("_"), (F.col("pos") % per_page).cast("string")).alias("block_id"), kind.alias("type"), "text", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs and list items of web pages, one page each."""
    tagged = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", ""), F.lit(r"(?is)(<(?:h[1-6]|p|li)\b[^>]*>[^<]*(?:<(?!/?(?:h[1-6]|p|li|ul|div|nav|article|footer|body)\b)[^>]*>[^<]*)*)"), F.lit(1))
    cut = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(tagged).alias("pos", "raw"))
    text = F.regexp_replace(F.col("raw"), "(?s)<[^>]*>", " ")
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    kind = F.when(F.col("raw").rlike("(?i)^<h[1-6]"), "heading").when(F.col("raw").rlike("(?i)^<li"), "list_item").otherwise("paragraph")
    none = F.lit(None).cast("double")
    out = cut.select("doc_id", F.lit(1).alias("page_no"), none.alias("page_width"), none.alias("page_height"), (F.col("pos") + 1).cast("int").alias("block_ord"), F.concat(F.lit("b_1_"), F.col("pos").cast("string")).alias("block_id"), kind.alias("type"), strip(text).alias("text"), F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox"))
    return out.where("text <> ''")


def chunk_table(blocks: DataFrame, sizes: chunking.Sizes = chunking.Sizes()) -> DataFrame:
    """Cleaned, sectioned, packed."""
    return chunking.chunks(sections.section_paths(cleaning.clean(blocks)), sizes)
