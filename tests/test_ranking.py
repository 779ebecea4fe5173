"""Fusion, dedup, collapse, citations and audit on small fixtures."""

import pytest
from corvane.operators import answering, audit, dialogue, ranking, routing, tables
from corvane.streaming import sessions
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, doc_id string, page_no int, chunk_type string, section_path array<string>, text string"


def ranked(spark, rows):
    return spark.createDataFrame([(1, c, 1.0 - i / 10, i + 1) for i, c in enumerate(rows)], "query_id int, chunk_id string, score double, rank int")


def test_fusion_modes_and_ties(spark):
    a, b = ranked(spark, ["a", "b"]), ranked(spark, ["b", "a"])
    order = lambda **k: [r["chunk_id"] for r in ranking.fuse(a, b, 5, **k).orderBy("rank").collect()]
    assert order() == ["a", "b"]  # equal scores: the first list decides
    assert order(mode="weighted_rank", weights=(2.0, 0.5)) == ["a", "b"]
    assert order(mode="weighted_rank", weights=(0.5, 2.0)) == ["b", "a"]
    with pytest.raises(ValueError):
        ranking.fuse(a, b, 5, mode="other")


def test_rank_drops_held_headings_and_collapses(spark):
    long = "Growth of units was strong in the year, as the report says in some detail."
    chunks = spark.createDataFrame(
        [("p", "d", 1, "paragraph", ["S"], long), ("h", "d", 1, "heading", ["S"], "growth of  UNITS"), ("x", "e", 1, "heading", ["S"], "growth of units"), ("q", "f", 2, "paragraph", ["S"], long), ("t", "d", 2, "table", ["S"], "a | b")],
        CHUNKS,
    )
    queries = spark.createDataFrame([(1, "growth of units")], "query_id int, query string")
    cand = ranked(spark, ["p", "h", "x", "q", "t"]).withColumn("sources", F.array(F.lit("bm25")))
    got = [r["chunk_id"] for r in ranking.rank(cand, queries, chunks, 10).orderBy("rank").collect()]
    assert got == ["p", "t", "x"]  # h is held by p, q repeats p; type goes before score
    only = ranking.rank(cand, queries, chunks, 10, chunk_types={"table"}).collect()
    assert [r["chunk_id"] for r in only] == ["t"]


def test_citations(spark):
    claims = spark.createDataFrame([(1, 0, "one", ["a", "zz", "b"]), (1, 1, "two", ["b"]), (2, 0, "none", ["zz"])], "query_id int, claim_ord int, claim string, supporting_chunk_ids array<string>")
    evidence = spark.createDataFrame([(1, "a", "d", 1, "x" * 300), (1, "b", "d", 2, "y")], "query_id int, chunk_id string, doc_id string, page_no int, text string")
    verified = answering.audit(claims, evidence)
    assert sorted((r["claim"], r["chunk_ids"]) for r in verified.collect()) == [("one", ["a", "b"]), ("two", ["b"])]
    got = [(r["claim"], r["chunk_id"], len(r["excerpt"])) for r in answering.citations(verified, evidence).orderBy("citation_no").collect()]
    assert got == [("one", "a", 240), ("one", "b", 1)]


def test_audit(spark):
    rows = [("d", i, 1, "heading" if i < 12 else "paragraph", "x" if i < 10 else "y" * 40) for i in range(20)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_no int, page_no int, chunk_type string, text string")
    manifest = spark.createDataFrame([("d", 2)], "doc_id string, page_count int")
    page = audit.page_alerts(chunks).first()
    assert page["reasons"] == ["high_page_chunk_count", "high_heading_ratio", "many_short_chunks"] and page["dominant_type"] == "heading"
    doc = audit.document_alerts(chunks, manifest).first()
    assert doc["chunk_page_ratio"] == 10.0 and doc["reasons"] == ["high_chunk_page_ratio"]
    assert audit.ratio_summary(chunks.where("false")).first()["max"] == 0.0


def test_tables(spark):
    raw = spark.createDataFrame([("d", 1, 600.0, 800.0, 0, (10.0, 100.0, 500.0, 300.0), [["Table 1 units", None, ""], ["name", " a  b ", ""], ["x<y", "12", None], ["z"]])], "doc_id string, page_no int, page_width double, page_height double, table_idx int, bbox struct<x0:double,y0:double,x1:double,y1:double>, rows array<array<string>>")
    r = tables.table_blocks(raw).first()
    assert r["text"] == "表格标题: Table 1 units\n表头: name | a b\n数据: x<y | 12\n数据: z"
    assert "<caption>Table 1 units</caption>" in r["table_html"] and "x&lt;y" in r["table_html"]
    blocks = spark.createDataFrame([("d", 1, i + 1, f"b{i}", "paragraph", t, box, [s]) for i, (t, box, s) in enumerate([("above", (10.0, 20.0, 500.0, 40.0), "S1"), ("inside", (20.0, 120.0, 400.0, 150.0), "S1"), ("below", (10.0, 320.0, 500.0, 340.0), "S2")])], "doc_id string, page_no int, block_ord int, block_id string, type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, section_path array<string>")
    placed = tables.place(blocks, tables.table_blocks(raw)).orderBy("block_ord").collect()
    assert [p["block_id"] for p in placed] == ["b0", "tbl_1_0", "b2"] and placed[1]["section_path"] == ["S1"]


def test_dialogue_and_routes(spark):
    turn = spark.createDataFrame([("它今年销量如何", ["苹果 2025Q4 销量"], "苹果", None, ["华为", "苹果"])], "user_query string, messages array<string>, last_entity string, conversation_anchor string, recent array<string>")
    r = dialogue.resolve(turn).first()
    assert r["resolved_query"] == "苹果今年销量如何" and r["follow_up"] and r["inherited_times"] == ["2025Q4"] and r["metric_hints"] == ["销量"]
    p = spark.range(1).select(F.struct(F.array(F.lit("a")).alias("entity_scope"), *[F.array().cast("array<string>").alias(n) for n in ("dialogue_referents", "time_terms", "metric_scope", "aspect_scope", "summary_terms")], F.lit(None).cast("string").alias("topic_product"), F.lit(None).cast("string").alias("topic"), F.lit(None).cast("string").alias("comparison_target")).alias("p"))
    assert p.select(dialogue.search_query(F.lit("q"), F.col("p"))).first()[0] == "q a"  # a null target adds nothing
    s = spark.createDataFrame([(None, False, 0, 0, [], None, 0, 0, 0), ("q", True, 3, 2, ["caption_evidence"], None, 0, 2, 0), ("q", True, 3, 2, ["narrative_evidence"], "a", 1, 0, 0)], "resolved_query string, has_plan boolean, n_candidates int, n_evidence int, evidence_types array<string>, draft_answer string, n_citations int, retry_count int, max_retry_count int")
    assert [r["next_node"] for r in routing.route(s).collect()] == ["conversation_resolver", "synthesizer", "finish"]


def test_sessions():
    state = sessions.advance(None, [("a", "b")])
    state = sessions.advance(state, [(f"q{i}", " x  y ") for i in range(12)])
    import json

    held = json.loads(state[1])
    assert state[0] == 13 and len(held) == 20 and sessions.said(held).split("\n")[-1] == "assistant: x y"
