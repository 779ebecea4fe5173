"""How the near-duplicate stage finds its pairs, what it sends and how that grows."""

import random

import numpy as np
import pytest
from corvane.llm import resemblance, simhash
from corvane.llm.common import among, prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], SCHEMA)


def shuffled(spark):
    """Bytes that all stages so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, getattr(spark._jvm.scala, "Array").emptyDoubleArray(), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_near_duplicates_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "SAMPLE", 8)
    rng = random.Random(5)
    texts = [" ".join(rng.randbytes(60).hex() for _ in range(40)) for _ in range(1500)]
    texts += [texts[i] + " more" for i in range(0, 1500, 100)]
    before = shuffled(spark)
    got = simhash.one_of_each(docs(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    assert shuffled(spark) - before < 0.5 * sum(map(len, texts))


def test_shingles_of_many_documents_are_known_however_many_there_are(spark, monkeypatch):
    """A sample of fixed size would miss them, and all their documents would meet there."""
    monkeypatch.setattr(resemblance, "SAMPLE", 8)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(20)) + (" one two three four five" if i % 8 == 0 else "") for i in range(1600)]
    src = prepare(spark).createDataFrame(list(enumerate(texts)), "k long, t string")
    (s,) = resemblance.shingles("one two three four five").tolist()
    assert s in resemblance.frequent_shingles(src, 5).tolist()


def test_among_holds_all_keys_and_few_others(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(null as string) as h")
    keys = rows.where("id % 20 = 0")
    got = {r["id"] for r in rows.where(among(keys)).collect()}
    assert set(range(0, 20_000, 20)) <= got and len(got) < 4000
    assert rows.where(among(keys.where("id < 0"))).count() == 0
    assert rows.where(among(keys, most=1 << 15)).where("id % 20 = 0").count() == 1000


@pytest.mark.parametrize("radius, bands, depth", [(4, None, 1), (4, None, 2), (6, 4, 1)])
def test_trees_report_all_pairs_once(spark, radius, bands, depth):
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    for f in list(fps):
        for _ in range(4):
            fps.append(f ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(0, 8)), replace=False)))
    ids = rng.permutation(len(fps)).tolist()
    points = spark.createDataFrame([(i, simhash.signed(f)) for i, f in zip(ids, fps)], "id long, fp long")
    got = [(r["a"], r["b"]) for r in simhash.pairs(points, radius, bands=bands, depth=depth, block=16).collect()]
    assert sorted(got) == sorted((i, j) for i, f in zip(ids, fps) for j, g in zip(ids, fps) if i < j and (f ^ g).bit_count() <= radius)


def test_near_duplicates_within_the_radius_come_from_the_trees(spark, monkeypatch):
    """With no first elements, pairs within the radius are found and confirmed, and no others."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        own = words(400)
        texts += [" ".join(own), " ".join([*own, "end"]), " ".join(own[40:]), " ".join(words(20))]
    bits = [simhash.majority(resemblance.shingles(t)) for t in texts]
    near = [j for i in range(0, 48, 4) for j in (i + 1, i + 2) if any((bits[i_] ^ bits[j]).bit_count() <= 4 for i_ in range(i, j))]
    assert 12 <= len(near) < 24
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()) == sorted(i for i in range(48) if i % 4 in (0, 3))
    monkeypatch.setattr(resemblance, "candidates", lambda src, *_: src.sparkSession.createDataFrame([], "a long, b long"))
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs(spark, texts)).collect()) == sorted(set(range(48)) - set(near))
