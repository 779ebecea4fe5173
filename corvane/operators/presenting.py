"""Results and answers as rows of text or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_json(ranked: DataFrame) -> DataFrame:
    """(query_id, rank, evidence): one JSON object for each ranked chunk, its sources sorted."""
    item = F.struct("chunk_id", "doc_id", "page_no", "chunk_type", "section_path", F.round("score", 9).alias("score"), F.array_sort("sources").alias("sources"), "text")
    return ranked.select("query_id", "rank", F.to_json(item, {"ignoreNullFields": "false"}).alias("evidence"))


def citations_json(cited: DataFrame) -> DataFrame:
    return cited.select("query_id", "citation_no", F.to_json(F.struct("claim", "doc_id", "page_no", "chunk_id", "excerpt"), {"ignoreNullFields": "false"}).alias("citation"))


def preview(text: Column, most: int) -> Column:
    flat = F.trim(F.regexp_replace(text, "\n", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("..."))).otherwise(flat)


def result_lines(ranked: DataFrame, most: int = 220) -> DataFrame:
    """(query_id, rank, lines): what a result list shows of each hit."""
    section = F.when(F.size("section_path") > 0, F.array_join("section_path", " > ")).otherwise("Document")
    said = F.format_string("%d. %s\n   type=%s page=%d score=%.4f sources=%s\n   section=%s\n   text=%s", F.col("rank"), F.col("chunk_id").cast("string"), F.col("chunk_type"), F.col("page_no"), F.col("score"), F.array_join("sources", ","), section, preview(F.col("text"), most))
    return ranked.select("query_id", "rank", said.alias("lines"))


def result_pages(queries: DataFrame, ranked: DataFrame, *, tables_only: bool = False, backend: str = "tfidf", most: int = 220) -> DataFrame:
    """(query_id, page): a heading and the lines of a query's hits; top_k bounds each page."""
    listed = result_lines(ranked, most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lines"))).alias("l"))
    hits = F.coalesce(F.size("l"), F.lit(0))
    head = F.format_string('Query: "%s"\nMode: %s\nEmbedding: %s\nHits: %d', F.col("query"), F.lit("tables" if tables_only else "chunks"), F.lit(backend), F.when(hits > 0, hits).otherwise(0))
    body = F.when(hits > 0, F.array_join(F.transform("l", lambda x: x["lines"]), "\n")).otherwise("No results found.")
    return queries.join(listed, "query_id", "left").select("query_id", F.concat_ws("\n", head, body).alias("page"))


def answer_pages(answers: DataFrame, cited: DataFrame, *, model: str = "extractive", backend: str = "tfidf") -> DataFrame:
    """(query_id, page): the answer, its confidence and its citations. ``answers`` has query_id, query, answer, confidence."""
    line = F.format_string("%d. %s page=%d chunk=%s\n   %s", F.col("citation_no"), F.col("doc_id").cast("string"), F.col("page_no"), F.col("chunk_id").cast("string"), F.trim("excerpt"))
    listed = cited.select("query_id", "citation_no", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation_no", "line"))).alias("l"))
    head = F.format_string('Query: "%s"\nConfidence: %s\nModel: %s\nEmbedding: %s\n\nAnswer:\n%s', F.col("query"), F.col("confidence"), F.lit(model), F.lit(backend), F.col("answer"))
    tail = F.when(F.size("l") > 0, F.concat(F.lit("\nCitations:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")))
    return answers.join(listed, "query_id", "left").select("query_id", F.concat_ws("\n", head, tail).alias("page"))
