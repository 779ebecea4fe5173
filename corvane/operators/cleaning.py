"""Block cleaning: repeated noise, normalisation, wrapped-block merging, page profiles.

Blocks are rows (doc_id, page_no, page_width, page_height, block_ord, block_id, type, text, bbox). All groupings are by
document or by (document, page), so one exchange on doc_id serves the whole operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import blocks as B
from corvane.functions.numeric import union_box
from corvane.functions.text import bind, squeeze, strip

BLOCK = "struct<block_ord:int,block_id:string,type:string,text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"


def repeated_noise(blocks: DataFrame) -> DataFrame:
    """(doc_id, noise): short texts on two pages or more of a document."""
    short = blocks.where((F.length(strip(F.col("text"))) <= 30) & (F.col("text") != ""))
    return short.groupBy("doc_id", squeeze(F.col("text")).alias("noise")).agg(F.min("page_no").alias("first"), F.max("page_no").alias("last")).where("first < last").select("doc_id", "noise")


def repeated_positional_noise(blocks: DataFrame) -> DataFrame:
    """(doc_id, noise, zone): texts that occur twice or more in one zone."""
    t = squeeze(F.col("text"))
    placed = blocks.where(F.col("text") != "").select("doc_id", t.alias("noise"), B.zone(F.col("bbox"), F.col("page_height")).alias("zone")).where("zone is not null and length(noise) <= 80")
    return placed.groupBy("doc_id", "noise", "zone").count().where("count >= 2").drop("count")


def noise(text: Column) -> Column:
    """Noise that the text alone shows."""
    t = strip(text)
    return (F.length(t) <= 1) | t.rlike(r"(?U)^\d+$") | t.rlike(r"(?iU)^page\s+\d+(\s+of\s+\d+)?$") | B.source_note(t)


def separator(left: Column, right: Column) -> Column:
    return F.when(left.rlike("[A-Za-z0-9]$") & right.rlike("^[A-Za-z0-9]"), " ").when(F.substring(left, -1, 1).isin(*B.BULLETS), " ").otherwise("")


def mergeable(a: Column, b: Column) -> Column:
    la, lb = F.length(strip(a["text"])), F.length(strip(b["text"]))
    both = (a["type"] == "heading") & (b["type"] == "heading")
    kinds = ~a["type"].isin("table", "list_item") & ~b["type"].isin("table", "list_item") & (both & ~((la <= 24) & (lb <= 24)) | ~both & (a["type"] != "heading") & (b["type"] != "heading"))
    ended = B.terminal(a["text"])
    x, y = a["bbox"], b["bbox"]
    gap = y["y0"] - x["y1"]
    near = (F.abs(x["x0"] - y["x0"]) <= 45) & (F.abs(x["x1"] - y["x1"]) <= 70) & gap.between(0, 28)
    # what is cheap to tell comes first
    ok = x.isNotNull() & y.isNotNull() & near & kinds & ~B.structured(a["text"]) & ~B.structured(b["text"]) & ~(ended & (F.length(a["text"]) > 24)) & (F.length(a["text"]) <= 120) & (((la <= 40) & (lb <= 40)) | ~ended)
    return F.coalesce(ok, F.lit(False))


def merged(a: Column, b: Column) -> Column:
    left, right = strip(a["text"]), strip(b["text"])
    text = F.when(left == "", right).when(right == "", left).otherwise(B.inline_layout(F.concat(left, separator(left, right), right), F.lit("paragraph")))
    return F.struct(a["block_ord"].alias("block_ord"), F.concat(a["block_id"], F.lit("+"), b["block_id"]).alias("block_id"), F.lit("paragraph").alias("type"), text.alias("text"), union_box(a["bbox"], b["bbox"]).alias("bbox")).cast(BLOCK)


def merge_wrapped(page: Column) -> Column:
    """Left fold over a page's blocks: each is merged into the one before it while that may go on."""
    none = F.array().cast(f"array<{BLOCK}>")
    return F.aggregate(page, none, lambda done, b: F.when((F.size(done) > 0) & mergeable(F.element_at(done, -1), b), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(merged(F.element_at(done, -1), b)))).otherwise(F.concat(done, F.array(b))).cast(f"array<{BLOCK}>"))


def clean(blocks: DataFrame) -> DataFrame:
    """Cleaned blocks with content_role, role_confidence, page_profile and page signals; block_ord is kept, merged blocks have that of their first."""
    raw = blocks.withColumn("zone", B.zone(F.col("bbox"), F.col("page_height")))
    text = bind(raw, text=B.clean_text(F.col("text"), F.col("type"))).where("text <> ''")
    own = text.where(~noise(F.col("text")) & ~B.visual_noise(F.col("text"), F.col("type"), F.col("bbox"), F.col("page_width"), F.col("page_height")))
    # a document's noise in one row: joined by document alone, blocks are sent once for this and for their pages
    listed = repeated_noise(blocks).groupBy("doc_id").agg(F.collect_set("noise").alias("_noise"))
    first = own.join(listed, "doc_id", "left").where(F.col("_noise").isNull() | ~F.array_contains("_noise", F.col("text"))).drop("_noise")
    second = first.alias("o").join(repeated_positional_noise(blocks).alias("n"), F.expr("o.doc_id = n.doc_id and o.text = n.noise and o.zone = n.zone"), "left_anti")
    block = F.struct("block_ord", "block_id", "type", "text", "bbox").cast(BLOCK)
    pages = second.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(block)).alias("page"))
    pages = bind(pages, page=F.transform(merge_wrapped(F.col("page")), lambda b: b.withField("type", B.demoted(b["text"], b["type"]))))
    n = F.size("page")
    count = lambda f: F.size(F.filter("page", f))
    pages = pages.select("*", n.alias("block_count"), count(lambda b: b["type"] == "heading").alias("heading_count"), count(lambda b: F.length(strip(b["text"])) <= 24).alias("short_block_count"), count(lambda b: F.length(strip(b["text"])) >= 50).alias("long_count"))
    dense = (F.col("block_count") >= 8) & (F.col("heading_count") >= 5) & (F.col("short_block_count") >= 5) & (F.col("long_count") <= F.greatest(F.lit(4), F.floor(F.col("block_count") / 3)))
    rows = pages.withColumn("label_dense", dense).select("doc_id", "page_no", "label_dense", "block_count", "heading_count", "short_block_count", F.inline("page"))
    d, t, k = F.col("label_dense"), F.col("text"), F.col("type")
    return rows.select("doc_id", "page_no", "block_ord", "block_id", B.cleaned_type(t, k, d).alias("type"), "text", "bbox", B.cleaned_role(t, k, d).alias("content_role"), B.role_confidence(k, d).alias("role_confidence"), F.when(d, "label_dense").otherwise("narrative").alias("page_profile"), "block_count", "heading_count", "short_block_count")
