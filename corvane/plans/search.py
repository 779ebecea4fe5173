"""Ranked retrieval for a batch of questions, and answers with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import answering, indexing, ranking


def recall(queries: DataFrame, chunks: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Lexical and TF-IDF vector recall; the vector model is fitted on the chunks."""
    lexical = indexing.bm25(queries, chunks, n)
    texts = chunks.select(F.col("chunk_id").alias("key"), "text")
    model = indexing.tfidf_model(texts).toArrow()
    asked = indexing.tfidf_vectors(queries.select(F.col("query_id").alias("key"), F.col("query").alias("text")), model)
    dense = indexing.sparse_search(asked, indexing.tfidf_vectors(texts, model), model, n).withColumnRenamed("key", "chunk_id")
    return lexical, dense


def recall_index(queries: DataFrame, index: dict[str, DataFrame], n: int) -> tuple[DataFrame, DataFrame]:
    """recall() from a persisted index: posting lists and sparse vectors, no texts."""
    model = index["model"].toArrow()
    asked = indexing.tfidf_vectors(queries.select(F.col("query_id").alias("key"), F.col("query").alias("text")), model)
    return indexing.bm25_index(queries, index, n), indexing.sparse_search(asked, index["weights"], model, n).withColumnRenamed("key", "chunk_id")


def indexed_search(queries: DataFrame, index: dict[str, DataFrame], top_k: int = 6, *, chunk_types: set[str] | None = None, mode: str = "rrf", k: int = 60, weights: tuple[float, float] = (1.0, 1.0), rerank=None) -> DataFrame:
    """hybrid_search() over a persisted index; texts are read for what is left after the cut."""
    lexical, dense = recall_index(queries, index, 2 * top_k)
    fused = ranking.fuse(lexical, dense, 3 * top_k, mode=mode, k=k, weights=weights)
    return ranking.rank(fused, queries, index["chunks"], top_k, chunk_types=chunk_types, rerank=rerank)


def configured(settings, scorer=None) -> dict:
    """The keywords of indexed_search() that settings stand for; ``scorer`` is the model of a reranker other than noop."""
    name = settings.reranker.lower().strip()
    if name not in ("noop", "cross_encoder"):
        raise ValueError(f"Unsupported reranker: {settings.reranker}")
    if name == "cross_encoder" and scorer is None:
        raise ValueError("Missing reranker model")
    return {"top_k": settings.top_k, "mode": settings.fusion_mode, "k": settings.rrf_k, "weights": (settings.bm25_weight, settings.vector_weight), "rerank": ranking.cross_encoder(scorer, settings.rerank_top_n) if name == "cross_encoder" else None}


def described(settings, backend: str = "tfidf") -> dict[str, str]:
    """Where results come from: fusion and its weights, reranker, embedding."""
    return {"fusion": f"{settings.fusion_mode}(k={settings.rrf_k}, bm25={settings.bm25_weight}, vector={settings.vector_weight})", "reranker": settings.reranker, "embedding": backend}


def hybrid_search(queries: DataFrame, chunks: DataFrame, top_k: int = 6, *, chunk_types: set[str] | None = None, mode: str = "rrf", prefilter: bool = False, rerank=None) -> DataFrame:
    """Recall 2k and 2k, fuse to 3k, filter by type, rerank, dedup, collapse, k.

    With ``prefilter`` (an addition) the type filter is before recall, so fewer than k results mean that there are no more."""
    source = chunks.where(F.col("chunk_type").isin(*sorted(chunk_types))) if prefilter and chunk_types else chunks
    lexical, dense = recall(queries, source, 2 * top_k)
    fused = ranking.fuse(lexical, dense, 3 * top_k, mode=mode)
    return ranking.rank(fused, queries, source, top_k, chunk_types=chunk_types, rerank=rerank)


def answer(queries: DataFrame, ranked: DataFrame, generator=answering.extractive, most: int = 8) -> dict[str, DataFrame]:
    """answers, verified claims and citations of ranked evidence."""
    evidence = answering.pack(ranked, most)
    answers = answering.generate(answering.prompts(queries, answering.evidence_block(evidence)), generator)
    claims = answers.select("query_id", F.posexplode("claims").alias("claim_ord", "c")).select("query_id", "claim_ord", "c.claim", "c.supporting_chunk_ids")
    verified = answering.audit(claims, evidence)
    return {"answers": answers, "verified": verified, "citations": answering.citations(verified, evidence), "confidence": answering.confidence(queries, verified)}
