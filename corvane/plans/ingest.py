"""From a folder of files to parsed documents, chunks and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import blocks as B
from corvane.operators import chunking, cleaning, sections, tables
from corvane.sources import files as S


def parsed(files: DataFrame, reader, finder=None) -> dict[str, DataFrame]:
    """files, spans, blocks: cleaned and sectioned blocks of files (scan()), with their tables in place.

    Sections come before tables, so that tables inherit them, and once more after, for what has none."""
    spans = S.read_pages(files, reader)
    ids = files.select("path", "doc_id")
    flat = S.flatten_spans(spans).join(ids, "path")
    kind = B.block_type(F.col("text"), F.col("line_count"), F.col("max_size"), F.col("bold_ratio"))
    cut = flat.select("doc_id", "page_no", "page_width", "page_height", F.col("block_ord").cast("int").alias("block_ord"), "block_id", kind.alias("type"), "text", "bbox")
    own = sections.section_paths(cleaning.clean(cut))
    if finder is None:
        return {"spans": spans, "blocks": own}
    found = tables.table_blocks(S.read_tables(files, finder).join(ids, "path"))
    placed = tables.place(own, found)
    roles = own.select("doc_id", "page_no", "block_id", "content_role", "page_profile")
    role = F.coalesce("content_role", F.when(F.col("type") == "table", "table"))
    whole = placed.join(roles, ["doc_id", "page_no", "block_id"], "left").withColumn("content_role", role)
    return {"spans": spans, "blocks": sections.section_paths(whole), "tables": found}


def ingest(spark: SparkSession, root: str, reader, finder=None, *, pattern: str = "*.pdf", sizes: chunking.Sizes = chunking.Sizes(), out: str | None = None) -> dict[str, DataFrame]:
    """files, blocks, chunks and summary of all files under a folder; with ``out``, written there (parsed, chunks, manifest) and read back.

    A file that can't be read fails alone, and its summary says why."""
    files = S.scan(spark, root, pattern)
    made = parsed(files, reader, finder)
    chunks = chunking.chunks(made["blocks"], sizes).join(files.select("doc_id", F.col("name").alias("source_file")), "doc_id")
    summary = S.ingest_summary(files, made["spans"]).join(files.select("path", "name", "doc_id", "sha256", "source_collection", "document_source_type"), "path")
    if out:
        S.write_parsed(made["blocks"], f"{out}/parsed")
        S.write_chunk_artifacts(chunks, f"{out}/chunks")
        chunks = S.read_chunk_artifacts(spark, f"{out}/chunks")
        counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
        summary.join(counts, "doc_id", "left").na.fill(0, ["chunk_count"]).write.mode("overwrite").parquet(f"{out}/manifest")
        summary = spark.read.parquet(f"{out}/manifest")
    return made | {"files": files, "chunks": chunks, "summary": summary}


def preview(spark: SparkSession, root: str, reader, finder=None, *, pattern: str = "*.pdf", n: int = 5) -> DataFrame:
    """The first n blocks of each document as ingest() would have them; nothing is written."""
    made = parsed(S.scan(spark, root, pattern), reader, finder)["blocks"]
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "block_ord"))
    return made.withColumn("at", at).where(F.col("at") <= n).drop("at")
