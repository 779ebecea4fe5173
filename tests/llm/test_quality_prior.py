"""The classifier on the tables' own labels, positives alone; its prior; odd rows."""

import zlib

import numpy as np
from corvane.llm import quality
from corvane.llm.queries import op5_quality

SF = "/root/testdata/sf0.01"


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for pi in (0.2, 0.6, 0.9):
        good, bad = (lambda n: rng.normal(1.5, 1, (n, 4))), (lambda n: rng.normal(-1.5, 1, (n, 4)))
        mixed = np.vstack((good(int(3000 * pi)), bad(3000 - int(3000 * pi))))
        assert abs(quality.estimate_prior(good(1500), rng.permutation(mixed)) - pi) < 0.08


def test_positives_alone_sort_out_held_out_rows(spark):
    """Negative labels play no part: without them scores are the same, and bad held-out rows go."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in op5_quality(spark, SF).collect()}
    alone = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels.where("quality = 1")).collect()}
    assert alone == {k: r["score"] for k, r in got.items()} and len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for k, r in got.items())
    held = [(r["predicted"], truth[k]) for k, r in got.items() if r["held_out"] and k in truth]
    assert len(held) > 50
    assert sum(p for p, y in held if y == 0) <= 0.1 * sum(y == 0 for _, y in held)
    assert sum(p for p, y in held if y == 1) >= 0.95 * sum(y == 1 for _, y in held)


def test_odd_rows(spark):
    """Nulls, repeats, very long texts and clashing columns; of an id's several texts always the same is learned from."""
    rows = [(i, ("word here and there. " * (i % 7 + 1)) if i % 3 else "###" * 30, "t") for i in range(1, 90)] + [(5, "another text", "t"), (None, None, None), (91, None, "x"), (92, "a b " * 200_000, "x"), (93, "", "x"), (93, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string").selectExpr("*", "1 as score", "2 as k", "true as held_out", "'z' as scored_text")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(1, 90)] + [(None, 1), (7, None)], "doc_id long, quality int")
    a = sorted(map(str, quality.score_documents(docs, labels).collect()))
    b = sorted(map(str, quality.score_documents(docs.repartition(5), labels.repartition(3)).collect()))
    assert a == b and len(a) == len(rows)
    assert quality.score_documents(docs.where("false"), labels).collect() == []
    none = quality.score_documents(docs, labels.where("false")).collect()
    assert len(none) == len(rows) and all(r["score"] >= 0.3 or not r["score"] for r in none)
    assert list(quality.class_counts("Ab1 \n" * 100_000, 1000)) == list(quality.class_counts("Ab1 \n" * 100_000))
