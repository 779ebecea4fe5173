"""Chunk-quality audit: pages, documents, corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import lines, strip


@dataclass(frozen=True)
class Thresholds:
    ratio_high: float = 8.0
    ratio_critical: float = 12.0
    page_chunks: int = 18
    heading_ratio: float = 0.6
    short_chunks: int = 10
    short_length: int = 24
    table_rows: int = 5


def single_column(text: Column, kind: Column, rows: int) -> Column:
    ls = lines(text)
    return (kind == "table") & (F.size(ls) >= rows) & F.forall(ls, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) <= 1)


def reasons(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def page_alerts(chunks: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Pages with a reason: doc_id, page_no, chunk_count, heading_ratio, short_chunk_count, dominant_type (first seen wins ties), reasons.

    ``chunks``: (doc_id, chunk_no, page_no, chunk_type, text)."""
    per_type = chunks.groupBy("doc_id", "page_no", "chunk_type").agg(
        F.count("*").alias("n"),
        F.min("chunk_no").alias("first"),
        F.count_if(F.length(strip(F.coalesce("text", F.lit("")))) <= t.short_length).alias("short"),
        F.max(F.coalesce(single_column(F.col("text"), F.col("chunk_type"), t.table_rows), F.lit(False))).alias("single"),
    )
    page = per_type.groupBy("doc_id", "page_no").agg(
        F.sum("n").alias("chunk_count"),
        F.sum(F.when(F.col("chunk_type") == "heading", F.col("n")).otherwise(0)).alias("headings"),
        F.sum("short").alias("short_chunk_count"),
        F.max_by("chunk_type", F.struct("n", -F.col("first"))).alias("dominant_type"),
        F.max("single").alias("single"),
    )
    ratio = F.col("headings") / F.greatest(F.col("chunk_count"), F.lit(1))
    why = reasons((F.col("chunk_count") >= t.page_chunks, "high_page_chunk_count"), (ratio >= t.heading_ratio, "high_heading_ratio"), (F.col("short_chunk_count") >= t.short_chunks, "many_short_chunks"), (F.col("single"), "single_column_table_like_text"))
    return page.select("doc_id", "page_no", "chunk_count", F.round(ratio, 2).alias("heading_ratio"), "short_chunk_count", "dominant_type", why.alias("reasons")).where(F.size("reasons") > 0)


def ratios(chunks: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_count, chunk_count, ratio); page counts come from the manifest, else from the last page seen."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.max("page_no").alias("last_page"))
    if manifest is not None:
        per = per.join(manifest.select("doc_id", F.col("page_count").alias("known")), "doc_id", "left")
    known = F.nullif(F.col("known"), F.lit(0)) if manifest is not None else F.lit(None).cast("long")
    counted = per.withColumn("page_count", F.coalesce(known, F.col("last_page")))
    return counted.select("doc_id", "page_count", "chunk_count", (F.col("chunk_count") / F.greatest(F.col("page_count"), F.lit(1))).alias("ratio"))


def document_alerts(chunks: DataFrame, manifest: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """Documents with a reason: doc_id, page_count, chunk_count, chunk_page_ratio, reasons, alerted_pages."""
    pages = page_alerts(chunks, t)
    has = lambda name: F.array_contains("reasons", name)
    per = pages.groupBy("doc_id").agg(F.count("*").alias("alerted_pages"), F.count_if(has("high_heading_ratio")).alias("heavy"), F.count_if(has("many_short_chunks")).alias("short"), F.count_if(has("single_column_table_like_text")).alias("single"))
    joined = ratios(chunks, manifest).join(per, "doc_id", "left").na.fill(0, ["alerted_pages", "heavy", "short", "single"])
    r = F.col("ratio")
    why = reasons((r >= t.ratio_critical, "critical_chunk_page_ratio"), ((r >= t.ratio_high) & (r < t.ratio_critical), "high_chunk_page_ratio"), (F.col("heavy") >= 2, "repeated_heading_heavy_pages"), (F.col("short") >= 2, "repeated_short_chunk_pages"), (F.col("single") > 0, "suspicious_table_detection"))
    return joined.select("doc_id", "page_count", "chunk_count", F.round(r, 2).alias("chunk_page_ratio"), why.alias("reasons"), "alerted_pages").where(F.size("reasons") > 0)


def in_order(alerts: DataFrame) -> DataFrame:
    """Alerts with alert_no: documents by ratio, pages by chunk count and heading ratio within their document, highest first (as rounded); ties by document and page."""
    if "page_no" in alerts.columns:
        w = Window.partitionBy("doc_id").orderBy(F.desc("chunk_count"), F.desc("heading_ratio"), "page_no")
        return alerts.withColumn("alert_no", F.row_number().over(w))
    # alerts are what the audit reports, one a document at most; the range partitioning of a global sort carries them
    return alerts.orderBy(F.desc("chunk_page_ratio"), "doc_id")


def ratio_summary(chunks: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    zero = lambda c: F.coalesce(F.round(c, 2), F.lit(0.0))
    r = ratios(chunks, manifest)
    return r.agg(F.count("*").alias("document_count"), zero(F.min("ratio")).alias("min"), zero(F.expr("percentile(ratio, 0.5)")).alias("p50"), zero(F.avg("ratio")).alias("mean"), zero(F.max("ratio")).alias("max"))


def ingest_totals(files: DataFrame) -> DataFrame:
    """One row of scanned, success and failed from rows with a status."""
    return files.agg(F.count("*").alias("scanned"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))
