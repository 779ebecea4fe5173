"""Operators 4, 6, 7, 8 and 9 against brute force."""

import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash
from corvane.llm import components, lines, mixing, sharding, simhash, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, bytes string, fingerprint string"


def docs(spark, rows):
    """rows: (id, text, source)"""
    return spark.createDataFrame([(i, t, None, s, len(t) if t is not None else None, "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 16))
    x = centre[rng.integers(0, 5, 300)] + rng.normal(size=(300, 16)) * 0.2
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[10] = x[20]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7, [float(v) for v in x[3]]), (20, [float(v) for v in x[4]]), (400, None), (440, [1.0, None] + [0.0] * 14), (460, [float("nan")] * 16), (480, [float("inf")] * 16), (None, [0.5] * 16), (500, [1.0])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "1 as rank")
    for seed_rows, block in ((2048, 4096), (30, 37), (3, 64)):
        got = topk.top_k(data, seed_rows=seed_rows, block_rows=block, query_rows=4, k=20).collect()
        good = [(i, np.floor(np.array(v, dtype=np.float32).astype(float) * 64).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
        asked = {}
        for i, v in good:
            if i % 20 == 0:
                asked[i] = min(asked.get(i, v.tolist()), v.tolist())
        want = set()
        for q, v in asked.items():
            best = sorted((-int(np.dot(v, w)), i) for i, w in good if i != q)[:20]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)
    assert topk.top_k(data.where("false")).count() == 0
    assert topk.top_k(data.where("vec_id = 0")).count() == 0


def test_topk_of_components_of_any_size(spark):
    """Scores are exact integers, held to a long."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(120)]
    rows += [(200, [1e9] + [0.5] * 7), (201, [-1e9] * 8), (202, [3e5] * 8), (203, [3e5 + 0.25] * 8), (220, [1e300, 0.0] + [0.25] * 6), (240, [0.0, 7e6] + [1e-3] * 6)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    long = lambda v: max(-(2**63), min(2**63 - 1, v))
    whole = {i: [long(math.floor(64 * x)) for x in v] for i, v in rows}
    for block in (16, 16384):
        got = topk.top_k(data, k=20, pivots=5, block_rows=block, query_rows=3).collect()
        for q in (i for i in whole if i % 20 == 0):
            best = sorted((-long(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q)[:20]
            assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in best]


def test_pivots_bound_scores_and_eliminate():
    rng = np.random.default_rng(6)
    x = np.floor(64 * (y := rng.normal(size=(3000, 64))) / np.linalg.norm(y, axis=1, keepdims=True))
    pivots, norm = topk.Pivots(x[:1000], 48, 64), (x * x).sum(axis=1)
    place = pivots.places(pivots.table(x))
    bound = topk.upper_bounds(tuple(a[:50] for a in place), norm[:50], place, norm)
    score = x[:50] @ x.T
    assert (bound >= score).all()
    done = [topk.best(x[j].astype(int), j, bound[j], x.astype(int), np.arange(3000), 20, float(np.sort(score[j])[-40]))[2] for j in range(50)]
    assert sum(done) < 0.5 * 50 * 3000


def roots(n, pairs):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)]
    want = roots(400, pairs)
    got = dict(components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: r for i, r in enumerate(want) if r != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, k=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("radius", "bands", "depth"), [(4, None, 1), (4, None, 2), (9, 5, 1), (4, 3, 1)])
def test_links_are_exact(spark, radius, bands, depth):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:120]:  # chains around some of them
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, radius + 1)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    want = roots(len(fps), pairs)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, radius, bands=bands, depth=depth).collect()
    at = {simhash.signed(f): i for i, f in enumerate(fps)}
    assert roots(len(fps), [(at[a], at[b]) for a, b in edges]) == want


def test_local_search_recurses():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    fps[250:] = fps[:250] ^ (np.uint64(1) << rng.integers(0, 63, 250).astype(np.uint64))
    a, b = simhash.forest(fps, np.ones(500, dtype=bool), 4, block=64, level=15)
    assert len(a) == 250


def test_near_duplicates(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "Gamma", "delta,", "é"]) + str(rng.randint(0, 50)) for _ in range(n))
    one = text(300)
    rows = [(9, one, "a"), (4, one + " end", "a"), (7, one, None), (7, one, None), (1, text(200), "b"), (3, None, "b"), (2, "", "b"), (8, " \n", "c"), (None, text(50), "c"), (11, "one two", None), (12, "One\ttwo", None), (13, "x " * 5000, None)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = roots(len(rows), pairs)
    least = defaultdict(list)
    for (i, *_), r in zip(rows, root):
        if i is not None:
            least[r].append(i)
    want = sorted((str(i), f"{f:016x}", min(least[r], default=None)) for (i, *_), f, r in zip(rows, fps, root))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each(spark):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(400)]
    near = " ".join([*words[:200], "new", *words[201:]])
    rows = [(9, " ".join(words), "a"), (4, near, "b"), (4, near, "c"), (None, "alone one two three four five six", "d"), (None, "another seven eight nine ten eleven", None), (5, None, "e"), (6, "", "f"), (7, "other " * 40, "g"), (4, "same id, other text " + " ".join(words[:9]), "h")]
    got = simhash.one_of_each(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    want = [4, 4, 5, 7, None, None]
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)
    assert simhash.one_of_each(docs(spark, [])).count() == 0


def test_lines(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, other = prose(60), prose(30)
    words = passage.split()
    varied = " ".join([*words[:30], "changed", *words[31:]])
    own = [prose(8) + "\n" + prose(20) for _ in range(8)]
    rows = [
        (5, own[0] + "\n" + passage, "a"),
        (2, passage + "\n" + own[1], "a"),
        (9, own[2] + "\n" + varied, "b"),
        (4, "Error 12 at host h1 on port 8080 now\n" + own[3], "b"),
        (6, own[4] + "\nError 99 at host h2 on port 22 now", None),
        (7, other + "\n" + other + "\n" + own[5], None),
        (8, "short line\n" + own[6], "c"),
        (10, "short line\n" + own[7], "c"),
        (11, None, "c"),
        (12, "", "c"),
        (None, passage, "d"),
        (5, own[0] + "\n" + passage, "a"),
    ]
    out = lines.drop_lines(docs(spark, rows), count="size_")
    assert out.columns[:-1] == docs(spark, rows).columns
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else 99, r["text"], r["size_"], r["n_chars"]) for r in out.collect()), key=str)
    want = []
    for i, t, _ in rows:
        gone = {5: [passage], 9: [varied], 6: ["Error 99 at host h2 on port 22 now"], None: [passage]}.get(i, [])
        kept = "\n".join(x for x in t.split("\n") if x not in gone) if t else t
        want.append((i if i is not None else 99, kept, len(gone), len(kept) if kept is not None else None))
    assert got == sorted(want, key=str)
    assert lines.drop_lines(docs(spark, [])).count() == 0


def brute_targets(sizes, weights):
    """sizes: list of source sizes in order; shares, stops and reshares as the contract says."""
    total, n = Fraction(sum(sizes)), len(sizes)
    stopped, out = set(), [Fraction(0)] * n
    while True:
        free = [i for i in range(n) if i not in stopped]
        left = total - sum(3 * sizes[i] for i in stopped)
        for i in free:
            out[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if out[i] > 3 * sizes[i]]
        if not over:
            return out
        for i in over:
            stopped.add(i)
            out[i] = Fraction(3 * sizes[i])


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "Z", "a", "é", "src1", "src10", "src2"]
    rows = [(rng.randint(0, 400), " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 300]))), rng.choice(names[: 2 + 2 * seed] + ["a"] * 4)) for _ in range(300)] + [(None, None, None)]
    got = mixing.mix(docs(spark, rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(docs(spark, rows).repartition(3)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    want = dict(zip(order, brute_targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))])))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(float(want[r["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 2 + 0.001 * float(want[s])
    assert mixing.mix(docs(spark, [])).count() == 0


def highest_quotients(votes, n):
    seats = dict.fromkeys(votes, 0)
    for _ in range(n):
        s = max((x for x in votes if votes[x]), key=lambda x: (Fraction(votes[x], 2 * seats[x] + 1), -list(votes).index(x)))
        seats[s] += 1
    return seats


def test_sainte_lague(spark):
    rng = random.Random(2)
    groups = {"x": ([53_000, 24_000, 23_000, 10, 0], 1), "y": ([53_000, 24_000, 23_000, 10, 0], 100), "z": ([rng.randint(0, 30) for _ in range(60)], 333), "v": ([7] * 9, 5), "none": ([3, 4], 0)}
    df = spark.createDataFrame([(g, i, w, n) for g, (weights, n) in groups.items() for i, w in enumerate(weights)], "g string, i int, w long, n long")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.sainte_lague(df, ["g"], "i", "w", F.col("n"), []).collect()}
    for g, (weights, n) in groups.items():
        assert {i: got.get((g, i), 0) for i in range(len(weights))} == highest_quotients(dict(enumerate(weights)), n)


@pytest.mark.parametrize("block", [1, 7])
def test_quotas_of_shards(spark, block):
    """Each shard's quota of a source is what the highest quotients give it, and what its documents take there."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(["a", "b", "b", "b", None])) for i in range(500)]
    got = mixing.mix(docs(spark, rows), block=block).collect()
    size, taken, here, source = defaultdict(int), defaultdict(int), defaultdict(dict), defaultdict(int)
    for r in got:
        taken[r["source"], r["shard"]] += r["taken"]
        here[r["source"]][r["shard"]] = here[r["source"]].get(r["shard"], 0) + r["size"]
        source[r["source"]] += r["size"]
    order = ["a", "b", None]
    want = highest_quotients(dict(zip(order, brute_targets([source[s] for s in order], [1, 2, 3]))), sum(source.values()) // block)
    for s in order:
        shards = highest_quotients({k: here[s][k] for k in sorted(here[s])}, min(want[s], 3 * source[s] // block))
        for k, n in shards.items():
            assert taken[s, k] == min(n * block, 3 * here[s][k])
    assert len({r["shard"] for r in got}) == 64


@pytest.mark.parametrize("step", [2, 5, 12])
def test_sharding(spark, step):
    rng = random.Random(8)
    rows = [(i, "x" * rng.choice([0, 3, 10, 100]), None) for i in range(200)] + [(None, None, None), (1, "é" * 600, None)] + [(7, "same " * 10, "s")] * 40
    limit = 500
    got = sharding.shard(docs(spark, rows), limit=limit, step=step).collect()
    assert len(got) == len(rows)
    size, prefixes = defaultdict(int), {}
    for r in got:
        size[r["shard"]] += r["bytes"]
        prefixes[r["shard"]] = (r["depth"], r["bucket"], r["page"])
    assert all(v <= limit or sum(r["shard"] == s for r in got) == 1 for s, v in size.items())
    parts = {p[:2] for p in prefixes.values()}
    assert sum(Fraction(1, 2**d) for d, _ in parts) <= 1
    for d, b in parts:  # only oversized buckets split
        if d and d < 60:
            assert sum(r["bytes"] for r in got if r["depth"] >= d and r["bucket"] >> (r["depth"] - d) == b) <= limit
            assert sum(r["bytes"] for r in got if r["depth"] >= d - 1 and r["bucket"] >> (r["depth"] - d + 1) == b >> 1) > limit
    one = sharding.shard(docs(spark, rows[:5]), limit=10**9).collect()
    assert {r["shard"] for r in one} == {"0b"}
    assert sharding.shard(docs(spark, [])).count() == 0
