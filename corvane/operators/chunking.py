"""Section-aware chunking: islands of blocks of one section and page, packed to a target size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import bind, ends_sentence, starts_any, strip

PART = "struct<block_ord:int,block_ids:array<string>,type:string,text:string,roles:array<string>,page_profile:string,blocks:int>"
STATE = f"struct<done:array<array<{PART}>>,now:array<{PART}>,sizes:array<int>>"


@dataclass(frozen=True)
class Sizes:
    target: int = 800
    overlap: int = 100
    least: int = 120


def islands(blocks: DataFrame, order: tuple[str, ...] = ("page_no", "block_ord")) -> DataFrame:
    """``blocks`` without blank ones, with island: runs of one section and page; tables and figure captions stand alone."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    solid = blocks.where(strip(F.col("text")) != "").withColumn("_alone", F.col("type").isin("figure_caption", "table"))
    before = F.lag(F.struct("section_path", "page_no", "_alone")).over(w)
    fresh = before.isNull() | F.col("_alone") | before["_alone"] | (before["section_path"] != F.col("section_path")) | (before["page_no"] != F.col("page_no"))
    return solid.withColumn("_new", fresh.cast("int")).withColumn("island", F.sum("_new").over(w)).drop("_new", "_alone")


def joined_size(sizes: Column) -> Column:
    """Length of parts joined by a blank line."""
    return F.aggregate(sizes, F.lit(0), lambda s, x: s + x) + 2 * F.greatest(F.size(sizes) - 1, F.lit(0))


def tail(sizes: Column, overlap: int) -> Column:
    """The whole trailing parts that first reach the overlap. They count for the next chunk's size; its text doesn't repeat them."""
    if overlap <= 0:
        return F.array().cast("array<int>")
    kind = "struct<kept:array<int>,sum:int>"
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).alias("sum")).cast(kind)
    return F.aggregate(F.reverse(sizes), start, lambda s, x: F.when(s["sum"] >= overlap, s).otherwise(F.struct(F.concat(F.array(x), s["kept"]).alias("kept"), (s["sum"] + x).alias("sum")).cast(kind)))["kept"]


def pack(parts: Column, sizes: Sizes) -> Column:
    """array<array<part>>: chunks of an island, by a left fold."""
    start = F.struct(F.array().cast(f"array<array<{PART}>>").alias("done"), F.array().cast(f"array<{PART}>").alias("now"), F.array().cast("array<int>").alias("sizes")).cast(STATE)

    def step(s: Column, p: Column) -> Column:
        n = F.length(p["text"])
        full = (F.size(s["sizes"]) > 0) & (joined_size(s["sizes"]) + 2 + n > sizes.target) & (joined_size(s["sizes"]) >= sizes.least)
        done = F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        now = F.when(full, F.array(p)).otherwise(F.concat(s["now"], F.array(p)))
        kept = F.when(full, tail(s["sizes"], sizes.overlap)).otherwise(s["sizes"])
        return F.struct(done.alias("done"), now.alias("now"), F.concat(kept, F.array(n)).alias("sizes")).cast(STATE)

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def with_heading_prefix(parts: Column) -> Column:
    """A short heading at an island's start becomes the start of the block behind it."""
    a, b = parts[0], parts[1]
    both = F.struct(b["block_ord"].alias("block_ord"), F.array(F.concat(a["block_ids"][0], F.lit("+"), b["block_ids"][0])).alias("block_ids"), b["type"].alias("type"), strip(F.concat(strip(a["text"]), F.lit("\n\n"), strip(b["text"]))).alias("text"), F.concat(a["roles"], b["roles"]).alias("roles"), F.lit(None).cast("string").alias("page_profile"), F.lit(1).alias("blocks")).cast(PART)
    merges = (F.size(parts) >= 2) & (a["type"] == "heading") & (F.length(strip(a["text"])) <= 40)
    return F.when(merges, F.concat(F.array(both), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))).otherwise(parts)


def separator(before: Column, p: Column) -> Column:
    a, b = strip(before["text"]), strip(p["text"])
    goes_on = ~ends_sentence(a) & ~starts_any(a, ("图表", "图：", "数据:", "表头:")) & ~starts_any(b, ("•", "◆", "◼", "➢", "图表", "数据:", "表头:"))
    inline = F.when(a.rlike("[A-Za-z0-9]$") & b.rlike("^[A-Za-z0-9]"), " ").otherwise("")
    return F.when((a == "") | (b == ""), "").when(((before["type"] == "heading") & (p["type"] != "heading")) | (p["type"] == "list_item"), "\n\n").when(goes_on, inline).otherwise("\n\n")


def compose(parts: Column) -> Column:
    pairs = F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").otherwise(separator(parts[F.greatest(i - 1, F.lit(0))], p)), strip(p["text"])))
    return strip(F.array_join(pairs, ""))


def evidence_type(roles: Column, profile: Column, source_type: Column) -> Column:
    among = lambda *names: F.forall(roles, lambda r: r.isin(*names))
    return (
        F.when(F.array_contains(roles, "table"), "table_evidence")
        .when(F.exists(roles, lambda r: r.isin("figure_caption", "table_caption")), "caption_evidence")
        .when((profile == "label_dense") & among("chart_label", "figure_caption", "heading"), "chart_evidence")
        .when(among("heading", "source_note"), "navigational_evidence")
        .when(F.array_contains(roles, "source_note"), "low_value_evidence")
        .when(source_type == "table_corpus", "table_evidence")
        .otherwise("narrative_evidence")
    )


def chunks(blocks: DataFrame, sizes: Sizes = Sizes(), source_type: str = "pdf_corpus") -> DataFrame:
    """Chunk rows of blocks that have section_path, content_role and page_profile."""
    part = F.struct("block_ord", F.array("block_id").alias("block_ids"), "type", "text", F.array(F.coalesce("content_role", "type")).alias("roles"), "page_profile", F.lit(1).alias("blocks")).cast(PART)
    grouped = islands(blocks).groupBy("doc_id", "island").agg(F.first("page_no").alias("page_no"), F.min_by("section_path", "block_ord").alias("section_path"), F.array_sort(F.collect_list(part)).alias("parts"))
    grouped = bind(grouped, parts=with_heading_prefix(F.col("parts")))
    packed = grouped.select("doc_id", "island", "page_no", "section_path", F.posexplode(pack(F.col("parts"), sizes)).alias("sub", "p"))
    kinds = F.array_distinct(F.transform("p", lambda x: x["type"]))
    profile = F.filter(F.transform("p", lambda x: x["page_profile"]), lambda x: x.isNotNull())
    rows = packed.select("doc_id", "page_no", "section_path", "island", "sub", compose(F.col("p")).alias("text"), F.when(F.size(kinds) > 1, "mixed").otherwise(kinds[0]).alias("chunk_type"), F.flatten(F.transform("p", lambda x: x["block_ids"])).alias("block_ids"), F.size("p").alias("source_block_count"), F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: x["roles"])))).alias("source_roles"), F.try_element_at(profile, F.lit(1)).alias("source_page_profile"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("island", "sub"))
    named = rows.withColumn("chunk_no", n).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page_no").cast("string"), F.lit("_c"), F.col("chunk_no").cast("string")))
    return named.select("chunk_id", "doc_id", "chunk_no", "page_no", "chunk_type", "section_path", "text", F.length("text").alias("char_count"), "block_ids", "source_block_count", "source_roles", "source_page_profile", F.lit(source_type).alias("document_source_type"), evidence_type(F.col("source_roles"), F.coalesce("source_page_profile", F.lit("")), F.lit(source_type)).alias("evidence_type"))
