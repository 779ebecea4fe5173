"""Files to chunks to a persisted index to answers, with readers and models that stand in for real ones."""

import hashlib
import json
import os
import sys

import pytest
from corvane import __main__ as cli
from corvane.operators import answering, audit, dialogue, indexing, presenting, routing
from corvane.plans import agentic, ingest, search
from corvane.sources import files, workspace
from corvane.streaming import sessions
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


def reader(path, content):
    """A page for each form feed, a block for each blank-line-separated part; parts that start with # are large and bold."""
    if b"broken" in content:
        raise ValueError("not readable")
    for page, text in enumerate(content.decode().split("\f"), 1):
        for b, part in enumerate(text.split("\n\n")):
            for n, line in enumerate(part.split("\n")):
                large = line.startswith("#")
                yield (page, 600.0, 800.0, b, n, 0, 0, line.lstrip("# "), 16.0 if large else 10.0, 16 if large else 0, 50.0, 100.0 + 60 * b, 500.0, 130.0 + 60 * b)


def finder(path, content):
    if b"table" in content:
        yield (1, 600.0, 800.0, 0, 50.0, 215.0, 500.0, 255.0, [["name", "units"], ["alpha", "12"], ["beta", "30"]])


TEXT = "# Annual Overview\n\nSales of the alpha product grew by a third over the year, and the board expects more growth.\n\nname units table of all products that the page has in its lower part\n\nCosts of the beta line fell in the same period, which the notes explain in detail for each plant."


@pytest.fixture
def root(tmp_path):
    (tmp_path / "in" / "finance").mkdir(parents=True)
    (tmp_path / "in" / "finance" / "a.pdf").write_text(TEXT + "\f# Second Chapter\n\nThe second page tells of plans for the alpha product in the coming year, and of what they cost.")
    (tmp_path / "in" / "b.pdf").write_text("broken")
    (tmp_path / "in" / "c.txt").write_text("not asked for")
    return tmp_path


def test_ingest_to_index_to_pages(spark, root, capsys):
    made = ingest.ingest(spark, str(root / "in"), reader, finder, out=str(root / "out"))
    got = {r["name"]: r for r in made["summary"].collect()}
    assert set(got) == {"a.pdf", "b.pdf"}
    assert got["b.pdf"]["status"] == "failed" and got["b.pdf"]["chunk_count"] == 0 and got["a.pdf"]["page_count"] == 2
    assert got["a.pdf"]["sha256"] == hashlib.sha256((root / "in" / "finance" / "a.pdf").read_bytes()).hexdigest()
    chunks = made["chunks"].orderBy("chunk_no").collect()
    assert got["a.pdf"]["chunk_count"] == len(chunks) and all(c["source_file"] == "a.pdf" for c in chunks)
    table = [c for c in chunks if "alpha | 12" in c["text"]]
    assert len(table) == 1 and table[0]["section_path"] == ["Annual Overview"]  # sections come before tables
    assert not any("in its lower part" in c["text"] for c in chunks)  # what a table covers goes
    assert {tuple(c["section_path"]) for c in chunks} == {("Annual Overview",), ("Second Chapter",)}
    parsed = [json.loads(x) for f in os.listdir(root / "out" / "parsed") if f.endswith(".json") for x in open(root / "out" / "parsed" / f)]
    assert len(parsed) == 1 and [b["page_no"] for b in parsed[0]["blocks"]] == sorted(b["page_no"] for b in parsed[0]["blocks"])
    assert ingest.preview(spark, str(root / "in"), reader, n=2).count() == 2

    assert cli.main(["index", str(root / "out" / "chunks"), "--out", str(root / "index")]) == [f"indexed {len(chunks)} chunks (tfidf)"]
    page = cli.main(["search", str(root / "index"), "--query", "alpha product growth", "--query", "zzzz"])
    assert page[0].startswith('Query: "alpha product growth"\nMode: chunks\nEmbedding: tfidf\nHits: ') and "section=Annual Overview" in page[0]
    assert cli.main(["answer", str(root / "index"), "--query", "alpha product"])[0].count("Citations:") == 1
    capsys.readouterr()


def test_index_equals_recall_over_texts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.lit(1).alias("page_no"), F.lit("paragraph").alias("chunk_type"), F.array(F.lit("Document")).alias("section_path"))
    queries = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(5).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    at = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        files.read_index(spark, at)
    index = files.load_or_build(spark, at, chunks)
    again = files.load_or_build(spark, at, None)
    plain = lambda f: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in f.collect())
    want = plain(search.hybrid_search(queries, chunks, 4))
    assert plain(search.indexed_search(queries, index, 4)) == plain(search.indexed_search(queries, again, 4)) == want
    assert workspace.exists(spark, at) and not workspace.exists(spark, at + "-no")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("CORVANE_TOP_K=9\n# no\nCORVANE_DATA_DIR='own'\nCORVANE_RERANKER=cross_encoder\nCORVANE_FUSION_MODE=weighted_rank\n")
    monkeypatch.setenv("CORVANE_TOP_K", "3")
    s = files.Settings.load(str(tmp_path / ".env"))
    assert s.top_k == 3 and s.data_dir == str(tmp_path / "own") and files.Settings().top_k == 6
    with pytest.raises(ValueError, match="model"):
        search.configured(s)
    made = search.configured(s, lambda q, t: q)
    assert made["mode"] == "weighted_rank" and made["rerank"] is not None and search.configured(files.Settings())["rerank"] is None
    with pytest.raises(ValueError, match="Unsupported reranker"):
        search.configured(files.Settings(reranker="x"))
    assert answering.template("auto", "Qwen-7b") == answering.template("qwen") != answering.template("zh")
    with pytest.raises(ValueError, match="prompt family"):
        answering.template("x")
    assert search.described(s)["reranker"] == "cross_encoder"


def test_encoders_and_dimensions(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id int, text string")

    def encoder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = {r["id"]: r["vector"] for r in indexing.encode(rows, encoder, batch=2).collect()}
    assert got[2] == [0.0, 1.0] and got[3][0] == pytest.approx(3 / 10**0.5)
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id int, vector array<double>")
    assert {(r["dimension"], r["n"]) for r in indexing.dimensions(vectors).collect()} == {(2, 1), (1, 1)}
    assert indexing.checked(vectors.where("id < 3"), 2).count() == 2
    with pytest.raises(Exception, match="length"):
        indexing.checked(vectors, 2).collect()
    said = []
    assert indexing.provider(encoder, "/no/model", said.append)[0] == "tfidf" and said
    assert indexing.provider(encoder)[0] == "encoder" and indexing.provider()[0] == "tfidf"


def test_agentic_answer(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "d", t, 1, "paragraph", ["S"]) for i, t in enumerate(["alpha sales grew in 2024Q1 by a third", "beta costs fell in the plants", "nothing else is here"])], "chunk_id string, doc_id string, text string, page_no int, chunk_type string, section_path array<string>")
    files.write_index(chunks, str(tmp_path / "i"))
    turns = spark.createDataFrame([("s1", "alpha sales 2024Q1", [("user", "hello there"), ("assistant", "yes")], None), ("s2", "qqqq", None, None)], "session_id string, user_query string, messages array<struct<role:string,content:string>>, last_entity string")
    got = agentic.answer(turns, files.read_index(spark, str(tmp_path / "i")), top_k=2)
    answers = {r["session_id"]: r for r in got["answers"].collect()}
    assert "alpha sales" in answers["s1"]["answer"] and answers["s1"]["confidence"] == "medium"
    assert answers["s2"]["answer"] == answering.REFUSAL
    trace = sorted((r["session_id"], r["step"], r["next_node"], r["status"]) for r in got["trace"].collect())
    assert [t[2] for t in trace if t[0] == "s1"] == ["conversation_resolver", "query_planner", "retrieval_strategist", "synthesizer", "citation_auditor", "finish"]
    assert [t[3] for t in trace if t[0] == "s2"] == ["stopped"] * 8
    kept = {r["session_id"]: r for r in got["sessions"].collect()}
    assert kept["s1"]["turn"] == 2 and kept["s2"]["turn"] == 1 and kept["s1"]["question"] == "alpha sales 2024Q1"
    context = got["plans"].where("session_id = 's1'").select(answering.context_block(F.col("context")).alias("b")).first()["b"]
    assert "So far: user: hello there" in context


def test_sessions_of_a_stream(spark, tmp_path):
    turns = [("a", 1, "q1", "r1"), ("b", 1, "x", "y"), ("a", 3, "q3", "r3"), ("a", 2, "q2", "r2")]
    spark.createDataFrame(turns, "session_id string, turn long, question string, answer string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, turn long, question string, answer string").json(str(tmp_path / "in"))
    run = sessions.track(stream).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {r["session_id"]: r for r in spark.table("tracked").collect()}
    assert got["a"]["turn_index"] == 3 and got["a"]["n_messages"] == 6 and got["a"]["summary"].split("\n")[-1] == "assistant: r3" and got["b"]["turn_index"] == 1


def test_presenting_and_order(spark):
    ranked = spark.createDataFrame([(1, 1, "c", "d", 3, "table", [], 0.25, ["vector", "bm25"], " a\nb " + "x" * 300)], "query_id long, rank int, chunk_id string, doc_id string, page_no int, chunk_type string, section_path array<string>, score double, sources array<string>, text string")
    one = json.loads(presenting.evidence_json(ranked).first()["evidence"])
    assert one["sources"] == ["bm25", "vector"] and one["score"] == 0.25
    line = presenting.result_lines(ranked).first()["lines"].split("\n")
    assert line[:3] == ["1. c", "   type=table page=3 score=0.2500 sources=vector,bm25", "   section=Document"] and line[3].endswith("...") and len(line[3]) == 8 + 220 + 3
    queries = spark.createDataFrame([(1, "q"), (2, "none")], "query_id long, query string")
    pages = {r["query_id"]: r["page"] for r in presenting.result_pages(queries, ranked).collect()}
    assert pages[2].endswith("Hits: 0\nNo results found.")
    alerts = spark.createDataFrame([("d", 2, 20, 0.1), ("d", 1, 20, 0.5), ("d", 3, 30, 0.0), ("d", 4, 20, 0.5)], "doc_id string, page_no int, chunk_count long, heading_ratio double")
    assert [r["page_no"] for r in audit.in_order(alerts).orderBy("alert_no").collect()] == [3, 1, 4, 2]
    state = spark.createDataFrame([(1, 3, ["caption_evidence"], 1), (2, 3, ["narrative_evidence"], 0)], "query_id long, n_candidates long, evidence_types array<string>, n_citations long")
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    state = state.select("*", none.alias("resolved_query"), none.alias("anchor"), F.lit(0).alias("n_messages"), none.alias("search_query"), F.lit(1).alias("answer_len"), F.lit(1).alias("n_claims"), none.alias("confidence"), F.struct(none.alias("intent"), empty.alias("sub_intents"), F.lit(4).alias("top_k"), F.lit(False).alias("tables_only"), *[empty.alias(n) for n in ("time_terms", "metric_scope", "aspect_scope")], none.alias("comparison_target"), none.alias("output_style")).alias("plan"))
    steps = sorted((r["query_id"], r["step"], r["route_type"]) for r in routing.trace(state).collect())
    assert [s[2] for s in steps if s[0] == 1].count("refine_retrieve") == 1 and len([s for s in steps if s[0] == 2]) == 8
    assert spark.range(1).select(dialogue.appended(F.lit("a b"), F.array(F.lit("b"), F.lit("c"), F.lit(" c ")))).first()[0] == "a b c"
