"""SimHash near-duplicates, linked through sharded vantage-point trees.

A fingerprint has one bit for each bit of its shingles' 64-bit hashes (XXH64, seed 42): 1 where over half
the hashes have it set. Fingerprints link at Hamming distances up to ``radius``; a document's component is
all it reaches by links.

Links are found exactly, without comparing all pairs. The 64 bits are split into ``bands`` masks. Two linked
fingerprints differ by at most r = radius // bands bits within one of them (pigeonhole), so for each mask
fingerprints are partitioned by their Hamming distances, within the mask, to a fixed list of vantage points: the
path of distances is the top of a vantage-point tree, and its leaf is the shard. By the triangle inequality
a neighbour's distance to each vantage point differs by at most r, so a fingerprint is at home in one shard
and visits only those whose shells its ball of radius r overlaps (none besides its own when r is 0, that is, radius < bands). A crowded
shard goes on down its tree in memory, to vantage points whose shells differ by at most r, and at last by
at most ``radius`` over all 64 bits; what is left is compared in blocks. Where fingerprints decide alone (``near_duplicates``), each shard reports
a spanning forest, never its pairs, and ``components`` joins the forests; where an exact check follows (``one_of_each``), the same trees report pairs.

More fingerprints than ``split_at`` double the depth: each mask's rest is split into bands again, which squares
the number of shards, still exactly.

Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Repeated
rows and ids are rows of the same component; the smallest id that is not null names it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import among, fresh, map_batches, prepare
from corvane.llm.components import components

#: byte -> eight 8-bit counters in one word
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], dtype=np.uint64)
SEED = 42
#: Vantage points of a mask's tree, those that only a crowded shard descends to included.
LAST_LEVEL = 16


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some 64-bit hashes."""
    n = len(hashes)
    if not n:
        return 0
    lanes = _LANES[hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0)  # 255: a counter's most
    counts = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str, shingle: int = 4) -> int:
    """SimHash of a text's word shingles, repeats included; fewer words than a shingle are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces alone
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return majority(np.array([h(b" ".join(words), SEED)], dtype=np.uint64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return majority(np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(k, fp): key and fingerprint as a signed long, a row for each row of ``docs``."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [signed(fingerprint(t, shingle)) for t in batch.column("t").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(made, pa.int64())], ["k", "fp"])

    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, fp long")


def _splitmix(n: int) -> int:
    z = (n * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % 2**64
    return z ^ (z >> 31)


def masks(bands: int, depth: int = 1, within: int = 2**64 - 1) -> list[int]:
    """Bit masks; fingerprints within ``radius`` agree but for radius // bands bits in at least one."""
    bits = [i for i in range(64) if within >> i & 1]
    cut = [len(bits) * i // bands for i in range(bands + 1)]
    own = [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:])]
    if depth == 1:
        return own
    return [m | n for m in own for n in masks(bands, depth - 1, within & ~m)]


def shards(fps: np.ndarray, mask: int, number: int, r: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one mask: positions of fingerprints, the shards they go to, and whether they are at home there."""
    at = np.arange(len(fps))
    code = np.full(len(fps), _splitmix(1000 + number), dtype=np.uint64)
    home = np.ones(len(fps), dtype=bool)
    with np.errstate(over="ignore"):
        for level in range(levels):
            v = np.uint64(_splitmix(level) & mask)
            d = np.bitwise_count((fps[at] & np.uint64(mask)) ^ v).astype(np.int64)
            moved = []
            for off in range(-r, r + 1):
                c = (code * np.uint64(0x9E3779B97F4A7C15)) ^ (d + off + 64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                c ^= c >> np.uint64(29)
                moved.append((at, c, home & (off == 0)))
            at, code, home = (np.concatenate(x) for x in zip(*moved))
    return at, code.view(np.int64), home


def _shells(a: np.ndarray, b: np.ndarray, fps: np.ndarray, radius: int, mask: int, r: int, level: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of a x b within ``radius`` whose masked distance is at most r: further vantage points of
    the mask's tree, then one level over all bits, then blocks."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= block or level >= LAST_LEVEL:
        step = max(1, max(block, 1 << 20) // len(b))
        for s in range(0, len(a), step):
            i, j = np.nonzero(np.bitwise_count(fps[a[s : s + step], None] ^ fps[None, b]) <= radius)
            if len(i):
                yield a[s : s + step][i], b[j]
        return
    if level == LAST_LEVEL - 1:  # the shard's own fingerprint in the middle, all bits, the whole radius
        v, m, off = fps[a[len(a) // 2]], np.uint64(2**64 - 1), radius
    else:
        v, m, off = np.uint64(_splitmix(level) & mask), np.uint64(mask), r
    da, db = np.bitwise_count((fps[a] & m) ^ v).astype(np.int64), np.bitwise_count((fps[b] & m) ^ v).astype(np.int64)
    for shell in np.unique(da).tolist():
        yield from _shells(a[da == shell], b[np.abs(db - shell) <= off], fps, radius, mask, r, level + 1, block)


def forest(fps: np.ndarray, home: np.ndarray, radius: int, mask: int = 2**64 - 1, r: int | None = None, level: int = 0, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smaller fingerprint of its tree) for those of one shard that are linked there."""
    label = np.arange(len(fps))
    for i, j in _shells(np.flatnonzero(home), np.arange(len(fps)), fps, radius, mask, radius if r is None else r, level, block):
        while True:
            x, y = label[i], label[j]
            differ = x != y
            if not differ.any():
                break
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(nxt := label[label], label):
                label = nxt
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _search(points: DataFrame, extra: list[str], report: Callable[..., Iterator[pa.RecordBatch]], radius: int, bands: int | None, levels: int | None, depth: int) -> DataFrame:
    """What ``report`` (fps, home, extra columns, number of the tree, masks, r, levels) finds in each shard: edges (a, b). ``points`` has fp and longs ``extra``."""
    bands = bands or radius + 1
    r, all_masks = radius // bands, masks(bands, depth)
    # A visit multiplies rows by 2 r + 1 at each level, so trees with overlapping shells are sharded by fewer levels.
    levels = levels or (4 * depth if not r else 2)

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, *more = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", *extra))
            fps = fps.view(np.uint64)
            for number, mask in enumerate(all_masks):
                at, code, home = shards(fps, mask, number, r, levels)
                tree = np.full(len(at), number, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(code), pa.array(fps[at].view(np.int64)), pa.array(home), *(pa.array(x[at]) for x in more)], ["tree", "shard", "fp", "home", *extra])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(tree: int, shard: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            fps, home, *more = (np.concatenate(x) for x in zip(*shard))
            if len(fps) > 1:
                yield from report(fps.view(np.uint64), home, *more, tree, all_masks, r, levels)

        held, now = [], None
        for batch in batches:
            tree, shard, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "shard", "fp", "home", *extra))
            cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                if held and (int(tree[s]), shard[s]) != now:
                    yield from found(now[0], held)
                    held = []
                now = int(tree[s]), shard[s]
                held.append(tuple(x[s:e] for x in columns))
        if held:
            yield from found(now[0], held)

    placed = points.select("fp", *extra).mapInArrow(sharded, "tree int, shard long, fp long, home boolean" + "".join(f", {c} long" for c in extra))
    return placed.repartition("tree", "shard").sortWithinPartitions("tree", "shard").mapInArrow(searched, "a long, b long")


def _edges(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(distinct: DataFrame, radius: int = 4, *, bands: int | None = None, levels: int | None = None, depth: int = 1) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct`` (column fp, no repeats) within ``radius``."""

    def report(fps: np.ndarray, home: np.ndarray, tree: int, all_masks: list[int], r: int, levels: int) -> Iterator[pa.RecordBatch]:
        a, b = forest(fps, home, radius, all_masks[tree], r, levels)
        yield from _edges(a.view(np.int64), b.view(np.int64))

    return _search(distinct, [], report, radius, bands, levels, depth)


def pairs(points: DataFrame, radius: int = 4, *, bands: int | None = None, levels: int | None = None, depth: int = 1, block: int = 1 << 14) -> DataFrame:
    """All pairs (a, b) of ids, a < b, each once, of ``points`` (fp, id; ids don't repeat, fingerprints may) within ``radius``."""

    def report(fps: np.ndarray, home: np.ndarray, ids: np.ndarray, tree: int, all_masks: list[int], r: int, levels: int) -> Iterator[pa.RecordBatch]:
        for i, j in _shells(np.flatnonzero(home), np.arange(len(fps)), fps, radius, all_masks[tree], r, levels, block):
            i, j = (x[ids[i] < ids[j]] for x in (i, j))
            # of the trees that hold a pair, the first reports it, where the smaller id is at home
            apart = [np.bitwise_count((fps[i] ^ fps[j]) & np.uint64(m)) <= r for m in all_masks[: tree + 1]]
            first = apart[-1] & ~np.any(apart[:-1], axis=0) if tree else apart[-1]
            yield from _edges(ids[i][first], ids[j][first])

    return _search(points, ["id"], report, radius, bands, levels, depth)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, bands: int | None = None, split_at: int = 4_000_000) -> DataFrame:
    """key, fingerprint (16 lowercase hex digits) and component_id, a row for each row of ``docs``."""
    prepare(docs.sparkSession)
    fps = fingerprints(docs, key=key, text=text, shingle=shingle).checkpoint()
    return labelled(fps, radius, bands=bands, split_at=split_at).select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def labelled(fps: DataFrame, radius: int, *, bands: int | None = None, split_at: int = 4_000_000) -> DataFrame:
    """``fps`` (k, fp and any other columns) with root, the component's least fingerprint, and component_id, its least k."""
    distinct = fps.groupBy("fp").agg(F.min("k").alias("least")).checkpoint()
    deep = bands is None and distinct.count() > split_at
    found = components(links(distinct, radius, bands=bands, depth=2 if deep else 1))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (rows without id after all others),
    then of the smallest text hash; of rows that agree in both, any one. All columns pass.

    Links are all pairs whose sets of shingles have a Jaccard similarity of ``least`` or more. Fingerprints of the sets propose
    all pairs within ``radius`` bits, through the vantage-point trees, and an exact count on the texts confirms them. A distance
    can't stand for the similarity: a pair at 0.8 is expected at ten bits, and at a radius wide enough for all, unrelated
    texts meet in numbers that grow as the square of the table. So pairs that are further apart, and these alone,
    are proposed by the sets' first elements (``resemblance``); the same count confirms them.
    """
    from corvane.llm import resemblance

    prepare(docs.sparkSession)
    d, h = fresh(docs.columns, "row_key", "row_hash")
    # far above any id, apart from each other
    no_id = F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(F.col(text), F.lit(1)), F.lit(1 << 40))
    keyed = docs.withColumn(d, F.coalesce(F.col(key).cast("long"), no_id)).withColumn(h, F.xxhash64(F.col(text)))
    src = keyed.select(F.struct(F.col(d).alias("d"), F.col(h).alias("h")).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # only rows of components of several are sent; all others stay where they are
    roots = resemblance.rooted(src, least=least, shingle=shingle, radius=radius)
    many = roots.groupBy("root").agg(F.min("k").alias("first"), F.count("*").alias("c")).where("c > 1")
    crowd = roots.join(many, "root").select(F.col("k.d").alias(d), F.col("k.h").alias(h), (F.col("k") != F.col("first")).alias("later")).distinct().checkpoint()
    sent = among(crowd.select(d, h))
    dropped = crowd.where("later").select(d, h)
    return keyed.where(~sent).union(keyed.where(sent).join(dropped, [d, h], "left_anti").dropDuplicates([d, h]).select(*keyed.columns)).select(*docs.columns)
