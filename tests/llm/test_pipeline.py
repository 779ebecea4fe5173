"""The pipeline's stages, one by one and together, on planted cases and odd rows."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from corvane.llm import bpe, lines
from corvane.llm.queries import tokenizer

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key int, k string, t string, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t) if t is not None else None, 1, "k", "t", 0.5) for i, t, s in rows], SCHEMA)


def clean(rng, n=60):
    return ". ".join(" ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}n" for _ in range(9)) for _ in range(n // 9)) + "."


def planted(rng):
    """Documents in groups of copies, near copies at 0.8 and above, and apart."""
    rows, group = [], {}
    for g in range(30):
        words = [f"w{g}x{i}" for i in range(100)]
        for c in range(rng.randint(1, 5)):
            own = list(words)
            if c % 2:
                own[rng.randrange(10, 90)] = f"new{g}y{c}"
            rows.append((len(rows), " ".join(own), f"s{g % 4}"))
            group[len(rows) - 1] = g
    return rows, group


def test_stages_on_odd_rows(spark):
    """All stages but the last keep the columns; none fails on nulls, empty texts, repeats, odd columns or no rows at all."""
    rng = random.Random(1)
    odd = [(None, None, None), (None, "", "a"), (3, None, "a"), (4, " \n", None), (5, clean(rng), "b"), (5, clean(rng), "b"), (6, "x " * 50_000, "b"), *[(7, "same text of some length. " * 4, "c")] * 3, *[(i, clean(rng), "d") for i in range(10, 30)]]
    for rows in (odd, []):
        frame = docs(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            got = out.collect()
            if name != "bpe":
                assert out.columns == frame.columns
            else:
                assert len(got) == len(rows) and {"doc_id", "n_tokens"} <= set(out.columns)
            if not rows:
                assert got == []


def test_near_duplicates_leave_one_of_each_group(spark):
    rows, group = planted(random.Random(2))
    got = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), SF).collect()]
    assert sorted(got) == sorted(min(i for i in group if group[i] == g) for g in set(group.values()))


def test_quality_keeps_clean_documents_and_drops_junk(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, frame, SF).collect()}
    good, bad = ([i in kept for i, y in truth.items() if y == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_run_equals_its_stages_by_plain_means(spark):
    """The stages applied by hand: lines by their own function, groups by sets of shingles, quotas by sizes, tokens by the library."""
    tokenizers = pytest.importorskip("tokenizers")
    spark_rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.keep_quality(spark, frame, SF)
    kept = {r["doc_id"]: r["text"] for r in lines.drop_lines(good, least=1).collect()}
    word_sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in kept.items()}
    shared, root = defaultdict(list), {i: i for i in kept}
    for i, s in word_sets.items():
        for x in s or {()}:
            shared[x].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for owners in shared.values():
        for a, b in zip(owners, owners[1:]):
            for j in [x for x in owners if x > a][: 200]:
                both = len(word_sets[a] & word_sets[j])
                if both * 5 >= 4 * (len(word_sets[a]) + len(word_sets[j]) - both):
                    x, y = sorted((find(a), find(j)))
                    root[y] = x
    heads = {i for i in kept if find(i) == i}
    assert {r["doc_id"] for r in got} <= heads
    size = {i: len((kept[i] or "").split()) for i in heads}
    times, of = Counter(r["doc_id"] for r in got), {i: spark_rows[i]["source"] for i in heads}
    total = defaultdict(int)
    for i in heads:
        total[of[i]] += size[i]
        assert times[i] <= 3 and (size[i] or times[i] == 1)
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    targets, free, left = {}, list(order), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            targets |= {s: level * weight[s] for s in free}
            break
        for s in over:
            targets[s] = 3 * total[s]
            left -= targets[s]
            free.remove(s)
    most = max(size.values(), default=0)
    for s in order:  # documents are taken whole: half a document for each of a source's shards
        assert abs(sum(size[i] * times[i] for i in heads if of[i] == s) - targets[s]) <= max(64 * most / 2, 0.05 * targets[s])
    lib = tokenizers.Tokenizer.from_file(tokenizer())
    for r in got[:200]:
        assert r["n_tokens"] == len(lib.encode(kept[r["doc_id"]] or "", add_special_tokens=False).ids)
    assert bpe is not None
