"""Hybrid ranking of recalled chunks, for a batch of queries: fusion, filter, rerank, dedup, collapse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import bind, chunk_profile, let, normalized, query_signature, strip

MODES = ("rrf", "weighted_rank")
PRIORITY = {"paragraph": 3, "mixed": 3, "table": 2, "figure_caption": 2, "heading": 1}


def fuse(first: DataFrame, second: DataFrame, top_n: int, *, mode: str = "rrf", k: int = 60, weights: tuple[float, float] = (1.0, 1.0), names: tuple[str, str] = ("bm25", "vector"), key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, sources, component_scores, rank) from two lists (query_id, key, score, rank).

    Equal scores: the first list's rank decides, then the second's."""
    if mode not in MODES:
        raise ValueError(f"Unknown fusion mode: {mode}")

    def scored(ranked: DataFrame, weight: float, name: str) -> DataFrame:
        total = F.count("*").over(Window.partitionBy("query_id"))
        s = weight / (k + F.col("rank")) if mode == "rrf" else weight * (total - F.col("rank") + 1) / total
        return ranked.select("query_id", key, s.alias(f"{name}_s"), F.col("rank").alias(f"{name}_r"), F.col("score").alias(f"{name}_score"))

    a, b = names
    both = scored(first, weights[0], a).join(scored(second, weights[1], b), ["query_id", key], "full")
    score = F.coalesce(F.col(f"{a}_s"), F.lit(0.0)) + F.coalesce(F.col(f"{b}_s"), F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col(f"{a}_r").asc_nulls_last(), F.col(f"{b}_r").asc_nulls_last())
    out = both.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    present = F.array_compact(F.array(F.when(F.col(f"{a}_s").isNotNull(), F.lit(a)), F.when(F.col(f"{b}_s").isNotNull(), F.lit(b))))
    parts = F.map_filter(F.create_map(F.lit(a), F.col(f"{a}_score"), F.lit(b), F.col(f"{b}_score")), lambda _, v: v.isNotNull())
    return out.select("query_id", key, "score", present.alias("sources"), parts.alias("component_scores"), "rank")


def relevance_bonus(text: Column, section: Column, q: Column) -> Column:
    return let(normalized(F.concat_ws(" ", section, F.substring(text, 1, 280))), lambda hay: _bonus(hay, q))


def _bonus(hay: Column, q: Column) -> Column:
    hits = lambda terms: F.size(F.filter(terms, lambda t: F.contains(hay, t)))
    terms, times = hits(q["terms"]), hits(q["time_terms"])
    phrase = F.when((q["phrase"] != "") & F.contains(hay, q["phrase"]), 0.012).otherwise(0.0)
    none = (F.size(q["terms"]) == 0) & (F.size(q["time_terms"]) == 0)
    return F.when(none, 0.0).otherwise(phrase + F.least(0.006 * terms, F.lit(0.018)) + F.least(0.008 * times, F.lit(0.016)))


def structural_bonus(profile: Column, prefers: Column) -> Column:
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    return on(profile["navigational"], -0.02) + on(profile["sparse"] & ~prefers, -0.03) + on(profile["sparse"] & prefers, 0.012) + on(profile["narrative"] & ~prefers, 0.01)


def priority(kind: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, value in PRIORITY.items():
        out = out.when(kind == name, value)
    return out.otherwise(0)


def deduplicated(items: Column, tables_only: bool) -> Column:
    """A fold over candidates in rank order: repeated texts go, and short headings that an accepted text of their scope holds.

    Items are structs with sig, kind, norm and scope; what is rejected leaves no trace."""
    empty = F.slice(items, 1, 0)

    def step(done: Column, x: Column) -> Column:
        again = F.exists(done, lambda d: d["sig"] == x["sig"])
        held = F.lit(False) if tables_only else (x["kind"] == "heading") & (F.length(x["norm"]) <= 64) & (x["norm"] != "") & F.exists(done, lambda d: (d["kind"] != "heading") & (d["scope"] == x["scope"]) & F.contains(d["norm"], x["norm"]))
        return F.when(again | held, done).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(items, empty, step)


def rank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int, *, chunk_types: set[str] | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, key: str = "chunk_id") -> DataFrame:
    """Final ranking of fused candidates: filter by type (after the cut), rerank, dedup, one chunk for each (document, page, section), order by (type, adjusted score, length).

    The score given is the unadjusted one. Candidates carry ids and scores alone; texts join here, after the cut."""
    text = candidates.join(chunks.select(key, "doc_id", "page_no", "chunk_type", "section_path", "text"), key).join(queries.select("query_id", "query"), "query_id")
    if chunk_types:
        text = text.where(F.col("chunk_type").isin(*sorted(chunk_types)))
    if rerank:
        text = rerank(text)
    norm = normalized(F.col("text"))
    item = F.struct("rank", F.col(key).alias("id"), "score", "sources", F.sha1(norm).alias("sig"), F.col("chunk_type").alias("kind"), norm.alias("norm"), F.struct("doc_id", "page_no", "section_path").alias("scope"), "text")
    listed = text.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("query").alias("query"))
    signed = bind(listed, q=query_signature(F.col("query")))
    kept = signed.select("query_id", "q", F.inline(deduplicated(F.col("items"), chunk_types == {"table"})))
    section = F.col("scope")["section_path"]
    structural = let(chunk_profile(F.col("text"), section), lambda profile: structural_bonus(profile, F.col("q.prefers")))
    adjusted = F.col("score") + relevance_bonus(F.col("text"), section, F.col("q")) + structural
    keyed = bind(kept, k=F.struct(priority(F.col("kind")).alias("p"), F.round(adjusted, 12).alias("a"), F.length(strip(F.col("text"))).alias("n")))
    group = Window.partitionBy("query_id", "scope")
    firsts = keyed.select("*", F.row_number().over(group.orderBy(F.desc("k"), "rank")).alias("at"), F.min("rank").over(group).alias("seen")).where("at = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("k"), "seen")
    out = firsts.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)
    return out.select("query_id", F.col("final_rank").alias("rank"), F.col("id").alias(key), "scope.doc_id", "scope.page_no", F.col("kind").alias("chunk_type"), "scope.section_path", "score", F.col("k.a").alias("adjusted_score"), "sources", "text")


def no_rerank(candidates: DataFrame) -> DataFrame:
    return candidates


def cross_encoder(score: Callable, top_n: int = 20) -> Callable[[DataFrame], DataFrame]:
    """A reranker from a pandas function (query, text) -> score: the first top_n are rescored and reordered, the rest follow in their order with the scores they had."""

    def apply(candidates: DataFrame) -> DataFrame:
        udf = F.pandas_udf(score, "double")
        inside = F.col("rank") <= top_n
        head = candidates.where(inside).withColumn("score", udf("query", "text"))
        both = head.unionByName(candidates.where(~inside))
        w = Window.partitionBy("query_id").orderBy(F.when(inside, 0).otherwise(1), F.when(inside, -F.col("score")), "rank")
        return both.withColumn("rank", F.row_number().over(w))

    return apply
