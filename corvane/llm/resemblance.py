"""Documents that resemble each other: an exact self-join of their sets of word shingles.

Two documents are linked if the Jaccard similarity of their sets of shingles (64-bit hashes, XXH3) is ``least`` or
more. Pairs whose SimHash fingerprints are within ``radius`` bits come from the vantage-point trees of ``simhash``. Those further apart
come from a join, and no such pair is missed: all sets are put into one order, and two sets that similar share one of the first
n - ceil(least * n) + 1 elements of each (prefix filter). Sets that meet at a shared element go on if their
sizes and their positions there still allow the similarity, and if the differences of their bucket counts, which sum to no
more than the number of elements in which the sets differ, do. What is left is counted on the texts themselves.

Any one order is right. The one used has shingles frequent in a sample last, so that few sets meet at common phrases. Equal
sets are one set from the start. Fewer words than a shingle are one shingle; texts without words have the empty set
and are linked with each other alone.

Texts are read three times: for the name, size and bucket counts of each set, for the first elements, which go through the one large
shuffle packed, 18 bytes each, to as many parts as hold ``PART`` of them, and for the texts to count on, which are those alone
whose bucket counts allow a link. Copies in one batch send their elements once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.common import among, map_batches, prepare

#: Buckets of a set's counts.
BUCKETS = 128
#: Documents of the sample that frequent shingles are looked for in, and the most of these that tasks hold. From
#: SAMPLE * EVERY documents on, one of EVERY: a fixed sample would know ever fewer of them and pairs grow as the square.
SAMPLE, EVERY, FREQUENT = 8192, 16, 200_000
#: Cells of one comparison of rows that meet at a shingle.
CELLS = 1 << 20
#: First elements of one part.
PART = 1_000_000
#: Sizes from here on are not told to where sets meet, and rule nothing out there.
LARGE = 65535


def shingles(text: str, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh3_64_intdigest
    if len(words) <= shingle:
        return np.array([h(b" ".join(words))] if words else [], dtype=np.uint64)
    return np.unique(np.fromiter((h(b" ".join(words[i : i + shingle])) for i in range(len(words) - shingle + 1)), np.uint64, len(words) - shingle + 1))


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def prefix_size(n: int, least: Fraction) -> int:
    return n - -(-n * least.numerator // least.denominator) + 1 if n else 0


def prefix(own: np.ndarray, frequent: np.ndarray, least: Fraction) -> np.ndarray:
    """The first elements of a set, in the order of all sets; empty for the empty set."""
    if not len(own):
        return own
    last = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own if len(frequent) else np.zeros(len(own), dtype=bool)
    return np.concatenate([own[~last], own[last]])[: prefix_size(len(own), least)]


def counts(own: np.ndarray) -> np.ndarray:
    # stopped counts differ by no more than the counts themselves
    return np.minimum(np.bincount((own >> np.uint64(32)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8)


def meet(g: np.ndarray, n: np.ndarray, left: np.ndarray, least: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the sets g, of sizes n, that share an element behind which (with it) ``left`` ones come, and can be ``least`` similar if it is their first shared."""
    order = np.argsort(n, kind="stable")
    g, n, left = g[order], n[order].astype(np.int64), left[order].astype(np.int64)
    up, down = least.numerator, least.numerator + least.denominator
    # partners of a set that aren't smaller: up to n / least; LARGE ones may be of any size from there
    ends = np.where(n * least.denominator // up >= LARGE, len(n), np.searchsorted(n, n * least.denominator // up, side="right"))
    s = 0
    while s < len(g) - 1:
        e = min(len(g) - 1, s + max(1, CELLS // max(1, int(ends[s]) - s)))
        stop = int(ends[e - 1])
        x, y = np.arange(s, e)[:, None], np.arange(s, stop)[None]
        a, b = np.nonzero((y > x) & ((np.minimum(left[x], left[y]) * down >= up * (n[x] + n[y])) | (n[y] >= LARGE)))
        if len(a):
            yield np.minimum(g[s + a], g[s + b]), np.maximum(g[s + a], g[s + b])
        s = e


def frequent_shingles(src: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that three or more texts of a sample of ``src`` (t) have."""
    rate = max(1, min(src.count() // SAMPLE, EVERY))
    sample = src.select("t", F.xxhash64("t", F.lit(3)).alias("h")).where(F.pmod("h", F.lit(rate)) == 0).dropDuplicates(["h"]).select("t")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t, shingle) for t in batch.column("t").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["s"])

    rows = map_batches(sample, run, "s long").groupBy("s").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "s").limit(FREQUENT).collect()
    return np.sort(np.array([r["s"] for r in rows], dtype=np.int64).view(np.uint64))


def sets(src: DataFrame, shingle: int) -> DataFrame:
    """(k, fp, n, bits, counts) for rows (k, t): fp names the set of shingles, n is its size, bits its SimHash fingerprint."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, bits, buckets = [], [], [], []
        for t in batch.column("t").to_pylist():
            own = shingles(t, shingle)
            names.append(name(own))
            sizes.append(len(own))
            bits.append(simhash.signed(simhash.majority(own)))
            buckets.append(counts(own).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.int64()), pa.array(buckets, pa.binary())], ["k", "fp", "n", "bits", "counts"])

    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, fp long, n long, bits long, counts binary")


def name(own: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(own.tobytes())
    return h - (1 << 64) if h >> 63 else h


def elements(src: DataFrame, frequent: np.ndarray, least: Fraction, shingle: int, parts: int) -> DataFrame:
    """(part, s, fp, size): the first elements of the sets of rows (t), packed by part; size has n and what is left from the element on."""
    shared = src.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            seen, own = set(), []
            for t in batch.column("t").to_pylist():
                a = shingles(t, shingle)
                fp = name(a)
                if len(a) and fp not in seen:
                    seen.add(fp)
                    first = prefix(a, last, least)
                    n = min(len(a), LARGE)
                    own.append((first, np.full(len(first), fp, dtype=np.int64), np.full(len(first), n, dtype=np.uint16), np.maximum(0, n - np.arange(len(first))).astype(np.uint16)))
            if not own:
                continue
            s, fp, n, left = (np.concatenate(x) for x in zip(*own))
            part = ((s & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, s, fp, size = part[order], s[order] >> np.uint64(16), fp[order], np.stack((n, left), axis=1)[order]
            high, low = (s >> np.uint64(16)).astype("<u4"), s.astype("<u2")
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            pieces = list(zip(cut, cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cut[:-1]]), *[pa.array([x[i:j].tobytes() for i, j in pieces], pa.binary()) for x in (high, low, fp, size)]],
                ["part", "high", "low", "fp", "size"],
            )

    return src.select("t").mapInArrow(run, "part long, high binary, low binary, fp binary, size binary")


def met(s: np.ndarray, fp: np.ndarray, size: np.ndarray, least: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different sets that meet at an element of one part."""
    order = np.lexsort((fp, s))
    s, fp, size = s[order], fp[order], size[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])])
    s, fp, size = s[new], fp[new], size[new]
    cut = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
    crowd = np.diff(cut)
    # most elements that meet at all do so in twos
    two = cut[:-1][crowd == 2]
    n, left = size[:, 0].astype(np.int64), size[:, 1].astype(np.int64)
    up, down = least.numerator, least.numerator + least.denominator
    keep = (np.minimum(left[two], left[two + 1]) * down >= up * (n[two] + n[two + 1])) | (n[two] >= LARGE) | (n[two + 1] >= LARGE)
    yield fp[two[keep]], fp[two[keep] + 1]
    for at in np.flatnonzero(crowd > 2).tolist():
        i, j = cut[at], cut[at + 1]
        yield from meet(fp[i:j], n[i:j], left[i:j], least)


def candidates(src: DataFrame, frequent: np.ndarray, least: Fraction, shingle: int, parts: int) -> DataFrame:
    """(a, b): pairs of sets of rows (t) that meet and aren't ruled out there, a < b, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
            high, low, fp, size = (b"".join(x) for x in zip(*rows))
            s = np.frombuffer(high, "<u4").astype(np.uint64) << np.uint64(16) | np.frombuffer(low, "<u2").astype(np.uint64)
            for a, b in met(s, np.frombuffer(fp, np.int64), np.frombuffer(size, np.uint16).reshape(-1, 2), least):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held, now = [], None
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "high", "low", "fp", "size"))):
                if part != now and held:
                    yield from found(held)
                    held = []
                now = part
                held.append(tuple(row))
        if held:
            yield from found(held)

    packed = elements(src, frequent, least, shingle, parts)
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "a long, b long").distinct()


def links(src: DataFrame, own: DataFrame, least: Fraction, shingle: int, radius: int) -> DataFrame:
    """Edges (a, b) between all sets that are ``least`` similar, of texts ``src`` (k, t) and their sets ``own`` (k, fp, n, bits, counts)."""
    size = F.col("n") - F.ceil(F.col("n") * least.numerator / least.denominator) + 1
    first = own.agg(F.sum(size).alias("c")).first()["c"] or 0
    parts = max(src.sparkSession.sparkContext.defaultParallelism, -(-first // PART))
    beyond = candidates(src, frequent_shingles(src, shingle), least, shingle, parts)
    pairs = within(own, radius).withColumn("tree", F.lit(True)).union(beyond.withColumn("tree", F.lit(False))).checkpoint()
    return confirmed(src, own, close(own, pairs, least, radius), least, shingle)


def within(own: DataFrame, radius: int, split_at: int = 4_000_000) -> DataFrame:
    """(a, b): all pairs of sets that aren't empty whose fingerprints are within ``radius``, by vantage-point trees."""
    points = own.where("n > 0").groupBy("fp").agg(F.min("bits").alias("bits")).toDF("id", "fp").checkpoint()
    return simhash.pairs(points, radius, depth=2 if points.count() > split_at else 1)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()


def close(own: DataFrame, pairs: DataFrame, least: Fraction, radius: int) -> DataFrame:
    """Those of ``pairs`` (a, b, tree) whose bucket counts allow ``least``: the trees' own, and of the others those beyond ``radius``, so each once."""
    of = own.join(ends(pairs), "fp").groupBy("fp").agg(F.min(F.struct("n", "bits", "counts")).alias("x")).select("fp", "x.n", "x.bits", "x.counts").checkpoint()
    allowed = F.col("tree") | (F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) > radius)

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int64) for c in ("ca", "cb"))
        n = batch.column("n").to_numpy(zero_copy_only=False)
        # sets that similar differ in at most (1 - least) / (1 + least) of the sum of their sizes
        keep = np.abs(x - y).sum(axis=1) * (least.denominator + least.numerator) <= n * (least.denominator - least.numerator)
        return pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    joined = pairs.join(of.toDF("a", "na", "xa", "ca"), "a").join(of.toDF("b", "nb", "xb", "cb"), "b").where(allowed).select("a", "b", "ca", "cb", (F.col("na") + F.col("nb")).alias("n"))
    return map_batches(joined, near, "a long, b long").checkpoint()


def confirmed(src: DataFrame, own: DataFrame, pairs: DataFrame, least: Fraction, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are ``least`` similar, counted on the texts; no other text is sent."""
    asked = own.select("k", "fp").join(ends(pairs), "fp").groupBy("fp").agg(F.min("k").alias("k")).checkpoint()
    texts = src.where(among(asked.select("k"))).join(asked, "k").groupBy("fp").agg(F.min("t").alias("t")).checkpoint()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        last: tuple[str | None, np.ndarray] = (None, np.array([], dtype=np.uint64))
        keep = []
        for x, y in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
            if x != last[0]:
                last = x, shingles(x, shingle)
            keep.append(similar(last[1], shingles(y, shingle), least))
        return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    return map_batches(both, run, "a long, b long")


def rooted(src: DataFrame, *, least: float = 0.8, shingle: int = 5, radius: int = 4) -> DataFrame:
    """(k, root) for rows (k, t), k and t not null: rows of one component have one root."""
    from corvane.llm.components import components

    prepare(src.sparkSession)
    part = Fraction(least).limit_denominator(1000)
    own = sets(src, shingle).checkpoint()
    found = components(links(src, own, part, shingle, radius))
    return own.select("k", "fp").join(found, F.col("fp") == F.col("node"), "left").select("k", F.coalesce("root", "fp").alias("root"))
