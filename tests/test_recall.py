"""Recall and its indexes against plain counting; pairs of queries and rows stay in their tasks."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corvane.functions import grams
from corvane.operators import indexing, recall

DOCS = "chunk_id string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(indexing, "AT_ONCE", 7)  # several passes
    rng = np.random.default_rng(4)
    rows = [(f"k{i:03}", [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)] + [("null", None), ("hole", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("short", [9.0, 9.0]), ("zero", [0.0] * 6), ("nan", [math.nan] + [1.0] * 5)]
    asked = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(20)] + [(90, None), (91, [1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id string, vector array<double>").repartition(5)
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in indexing.vector_search(spark.createDataFrame(asked, "query_id long, vector array<double>"), chunks, 9).where("chunk_id <> 'nan'").collect())
    want = []
    for i, q in asked:
        scores = [(sum(a * b for a, b in zip(q, v)), k) for k, v in rows if q and v and len(v) == len(q) and None not in v and k != "nan"]
        first = 2 if q and len(q) == 6 else 1  # not a number goes before all numbers
        want += [(i, n, k, s) for n, (s, k) in enumerate(sorted(((s, k) for s, k in scores if s > 0), key=lambda x: (-x[0], x[1]))[: 10 - first], first)]
    assert got == want and any(a[3] == b[3] and a[0] == b[0] for a, b in zip(want, want[1:]))  # with ties, by key


def test_pairs_stay_in_their_tasks(spark):
    """A join made a row of each query and row, or of each query, row and feature, before the best were looked for."""
    v = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, vector array<double>")
    assert "Join" not in plan(indexing.vector_search(v.withColumnRenamed("chunk_id", "query_id"), v, 3)) and "CartesianProduct" not in plan(indexing.vector_search(v.withColumnRenamed("chunk_id", "query_id"), v, 3))
    docs = spark.createDataFrame([("a", "some words"), ("b", "other words")], DOCS)
    asked = spark.createDataFrame([(1, "words")], "query_id long, query string")
    assert "Join" not in plan(indexing.bm25(asked, docs, 3))
    texts = docs.withColumnRenamed("chunk_id", "key")
    model = indexing.tfidf_model(texts).toArrow()
    vectors = indexing.tfidf_vectors(texts, model)
    assert "Exchange" not in plan(vectors) and "Join" not in plan(indexing.sparse_search(vectors, vectors, model, 3)) and "Exchange" not in plan(indexing.posting_lists(docs))


def test_bm25_by_plain_counting(spark):
    texts = {"a": "Growth of UNITS, growth", "b": None, "c": "units 增长率 units 增", "d": "a-b.c/d", "e": "growth of units", "f": "growth of units"}
    docs = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    queries = {1: "growth units units", 2: "增长", 3: "nothing else", 4: None, 5: "A-B.C/D"}
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in indexing.bm25(spark.createDataFrame(list(queries.items()), "query_id long, query string"), docs, 3).collect())

    def cut(t):
        t = (t or "").lower()
        return re.findall("[a-z0-9][a-z0-9._/-]*", t) + [x for r in re.findall("[一-鿿]+", t) for x in ([r] if len(r) == 1 else [r, *(r[i : i + 2] for i in range(len(r) - 1))])]

    own = {k: cut(t) for k, t in texts.items()}
    mean, df, want = sum(map(len, own.values())) / len(own), Counter(x for ts in own.values() for x in set(ts)), []
    for q, t in queries.items():
        score = {k: sum(math.log(1 + (len(own) - df[x] + 0.5) / (df[x] + 0.5)) * ts.count(x) * 2.5 / (ts.count(x) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for x in cut(t) if x in ts) for k, ts in own.items()}
        want += [(q, n, k, round(s, 9)) for n, (s, k) in enumerate(sorted(((s, k) for k, s in score.items() if s > 0), key=lambda x: (-round(x[0], 9), x[1]))[:3], 1)]
    assert got == want and {w[0] for w in want} == {1, 2, 5}
    lists = {r["chunk_id"]: r for r in indexing.posting_lists(docs).collect()}
    assert all(lists[k]["dl"] == len(ts) and dict(zip(lists[k]["terms"], lists[k]["tfs"])) == Counter(ts) for k, ts in own.items())


@pytest.mark.parametrize("most", [3_000_000, 40])
def test_grams_by_plain_counting(most):
    rng = np.random.default_rng(2)
    letters = list("abc  \n\t\x1f　é") + ["𝒳", "\0"]
    texts = ["".join(rng.choice(letters, size=n)) for n in [0, 1, 2, 3, 4, *[30] * 60]] + ["".join(map(chr, range(0x4E00, 0x4E40)))]
    own = []
    for t in texts:
        t = re.sub(f"[{re.escape(grams.SPACES)}]{{2,}}", " ", t)
        own.append(Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)))
    total, df = Counter(), Counter()
    counts = grams.Counts(most)
    found = [x for part in grams.slices(texts, 100) for x in counts.add(part)] + list(counts.drain()) + list(counts.drain())
    plainly = list(grams.Counts.plainly(texts))
    for some in (found, plainly):
        total, df = Counter(), Counter()
        for high, low, n, d in [r for x in some for r in zip(*(c.tolist() for c in x))]:
            total[grams.spelled(high, low)] += n
            df[grams.spelled(high, low)] += d
        assert total == sum(own, Counter()) and df == Counter(g for c in own for g in c)
    assert (len(found) > 1) == (most == 40)
    model = [g for g, _ in total.most_common(50)]
    got = {(int(t), model[int(i)]): int(n) for part in grams.Trie(model, list(range(50))).counts(texts) for t, i, n in zip(*part)}
    assert got == {(i, g): n for i, c in enumerate(own) for g, n in c.items() if g in model}


def test_best_keeps_ties_by_key_and_holds_little():
    best = recall.Best(2, 3)
    best.most = 10
    for s in range(0, 1000, 10):  # all rows tie
        key = pa.array([f"k{(i * 7) % 1000:03}" for i in range(s, s + 10)])
        best.add(np.zeros(10, dtype=np.int64), np.full(10, 0.5), key)
        assert sum(len(x[0]) for x in best.held) <= 20
    (rows,) = best.rows(pa.array([10, 20]))
    assert sorted(rows.column("key").to_pylist()) == ["k000", "k001", "k002"] and set(rows.column("query_id").to_pylist()) == {10}
