"""Exact top-k search by inner product with a pivot table.

Each vector's distances to ``pivots`` + 1 fixed pivots are stored with it: the mean of a sample, and points at one distance from it along
the sample's main axes. As the pivots are at right angles, distances to them all give the greatest lower bound of the distance
of a query q and a candidate x that they imply: with y the coordinates that the distances place a vector at, and h its height
above the pivots' plane,  d(q, x)^2 >= |y(q) - y(x)|^2 + (h(q) - h(x))^2.  (A single pivot's |d(q, p) - d(x, p)| is
far weaker where vectors fill their space.) As <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, that is an upper bound of the score.
Candidates are evaluated in order of that bound until it falls below the k-th best score so far: an exact
stop. Bounds carry a slack far above rounding, and scores are integers.

Plan: a seed sample of at most ``seed_rows`` vectors (broadcast; its size is bounded) gives every query a first
k-th best score. Candidates are dealt evenly to numbered buckets of at most ``block_rows`` and packed there into blocks,
queries into blocks of ``query_rows``; each query block, vectors and ids alone, is sent to each bucket by an equi-join on the bucket's
number, and there whole blocks, then single candidates, are eliminated by bounds. Only the k best of a pair of
blocks leave it.

Vectors that are null or hold null or non-finite components take no part, nor do those whose length isn't the most common one (they have
no inner product with the others) and rows without an id. A candidate with the query's id is its own row. Equal scores rank by smaller
id; repeated rows are candidates each; a query id that has several rows asks with its smallest vector. Components of any
size are scored exactly, in wider integers where needed; one beyond a long (after scaling) counts as the
nearest long, and so does a score. No queries or no candidates, no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import prepare

#: Of bounds, relative to the squares they come from, and absolute.
SLACK = 1e-9
LONG = 2**63


class Pivots:
    """The mean of a sample and points along its main axes, all at one distance from it."""

    def __init__(self, sample: np.ndarray, n: int, dim: int):
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        axes = np.linalg.svd(sample - self.centre, full_matrices=False)[2][:n] if len(sample) else np.zeros((0, dim))
        self.far = max(1.0, float(np.sqrt(((sample - self.centre) ** 2).sum(axis=1).mean()))) if len(sample) else 1.0
        self.points = np.vstack((self.centre, self.centre + self.far * axes))

    def table(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of x to all pivots."""
        z, p = x - self.centre, self.points - self.centre
        return np.maximum(0.0, (z * z).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2.0 * (z @ p.T))

    def places(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the axes and heights above their plane, from distances alone."""
        y = (table[:, :1] - table[:, 1:] + self.far**2) / (2 * self.far)
        return y, np.sqrt(np.maximum(0.0, table[:, 0] - (y * y).sum(axis=1)))


def upper_bounds(q_place: tuple[np.ndarray, np.ndarray], q_norm: np.ndarray, place: tuple[np.ndarray, np.ndarray], norm: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of all queries (rows) with all candidates."""
    (yq, hq), (yx, hx) = q_place, place
    own_q, own_x = (yq * yq).sum(axis=1) + hq * hq, (yx * yx).sum(axis=1) + hx * hx
    slack = SLACK * (q_norm[:, None] + norm[None] + own_q[:, None] + own_x[None]) + 1e-6
    # half of |q|^2 + |x|^2 - |yq - yx|^2 - (hq - hx)^2; scores are never below a long
    half = yq @ yx.T + hq[:, None] * hx[None] + ((q_norm - own_q)[:, None] + (norm - own_x)[None]) / 2 + slack
    return np.maximum(half, -float(LONG))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of the row q with the rows of x (integers), as far as a long goes."""
    if not len(x):
        return np.empty(0, dtype=np.int64)
    most = len(q) * max(abs(int(q.max())), abs(int(q.min()))) * max(abs(int(x.max())), abs(int(x.min())))
    if most < 2**52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < LONG:
        return x.astype(np.int64) @ q.astype(np.int64)
    return np.array([min(LONG - 1, max(-LONG, v)) for v in (x.astype(object) @ q.astype(object)).tolist()], dtype=np.int64)


def best(q: np.ndarray, q_id: int, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, least: float, step: int = 128) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best of a block that could still count, given a k-th best score ``least`` from elsewhere; and how many were evaluated."""
    left = np.flatnonzero((bound >= least) & (ids != q_id))
    left = left[np.argsort(-bound[left], kind="stable")]
    got_i, got_s, done = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    for s in range(0, len(left), step):
        part = left[s : s + step]
        if bound[part[0]] < least:
            break
        part = part[bound[part] >= least]
        score = scores(q, x[part])
        done += len(part)
        keep = score >= least
        got_i, got_s = np.concatenate((got_i, ids[part][keep])), np.concatenate((got_s, score[keep]))
        if len(got_s) >= k:
            order = np.lexsort((got_i, -got_s.astype(object) if got_s.min() == -LONG else -got_s))[:k]
            got_i, got_s = got_i[order], got_s[order]
            least = max(least, got_s[-1])
    return got_i, got_s, done


def usable(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of vectors that take part, of any length."""
    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e")).where("id is not null and e is not null")
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor of a double beyond a long is the nearest long
    return src.where(fine).select("id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(b: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(b, dtype=f"i{len(b) // (rows * dim)}").reshape(rows, dim)


def top_k(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, scale: float = 64.0, pivots: int = 48, seed_rows: int = 2048, block_rows: int = 16384, query_rows: int = 256) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank from 1, vec_id, score, the k best of all other rows."""
    spark = prepare(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score long"
    whole = usable(vectors, key, vector, scale)
    lengths = whole.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None or not lengths["d"]:
        return spark.createDataFrame([], schema)
    dim, n = lengths["d"], lengths["count"]
    whole = whole.where(F.size("v") == dim)
    # pivots and first thresholds come from vectors whose products are exact in double precision
    plain = whole.where((F.array_max("v") < int((2**52 / dim) ** 0.5)) & (F.array_min("v") > -int((2**52 / dim) ** 0.5)))
    rows = plain.orderBy(F.xxhash64("id"), "id", "v").limit(seed_rows).collect()  # at most seed_rows
    seed_ids = np.array([r["id"] for r in rows], dtype=np.int64)
    seed = np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, dim)
    shared = spark.sparkContext.broadcast((seed_ids, seed, Pivots(seed, pivots, dim)))

    def packed(rows_each: int, queries: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s_ids, s, p = shared.value
            for batch in batches:
                bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
                cut = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
                for at in (i for a, b in zip(cut, cut[1:]) for i in range(a, b, rows_each)):
                    part = batch.slice(at, min(rows_each, cut[bisect_right(cut, at)] - at))
                    ids, x = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64), _matrix(part.column("v"), dim)
                    if queries:
                        extra = np.full(len(ids), -np.inf)
                        if len(s) > k:
                            # thresholds are below a true k-th best score by more than rounding
                            score = x.astype(np.float64) @ s.T
                            score[ids[:, None] == s_ids[None, :]] = -np.inf
                            extra = np.partition(score, -k, axis=1)[:, -k]
                            extra = np.clip(extra - SLACK * np.abs(x.astype(np.float64)).max(axis=1) * np.abs(s).max() * dim, -float(LONG), float(LONG - 2048))
                    else:
                        extra = p.table(x.astype(np.float64))
                    fields = [pa.array([a.tobytes()], pa.binary()) for a in (ids, _narrow(x), extra)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[at])], pa.int64()), *fields], ["bucket", "ids", "x", "extra"])

        return run

    pack = "bucket long, ids binary, x binary, extra binary"
    # fewer rows a bucket on small tables, so that all cores have some
    wide = max(1, -(-n // block_rows), min(-(-n // 2048), 2 * spark.sparkContext.defaultParallelism))
    dealt = whole.withColumn("bucket", F.monotonically_increasing_id() % wide).repartition("bucket").sortWithinPartitions("bucket")
    blocks = dealt.mapInArrow(packed(block_rows, False), pack).select("bucket", "ids", "x", F.col("extra").alias("d"))
    asked = whole.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("bucket", F.lit(0).cast("long"))
    queries = asked.mapInArrow(packed(query_rows, True), pack)
    sent = queries.select(F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("extra").alias("least"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))).alias("bucket"))
    pairs = sent.join(blocks, "bucket")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value[2]
        held: tuple[bytes, ...] = ()
        for batch in batches:
            for q_ids, q_x, least, ids, x, d in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_x", "least", "ids", "x", "d"))):
                qi, ci = np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
                q, lo = _wide(q_x, len(qi), dim), np.frombuffer(least)
                if held != (ids, x):
                    held, c = (ids, x), _wide(x, len(ci), dim)
                    place, norm = p.places(np.frombuffer(d).reshape(len(ci), -1)), (c.astype(np.float64) ** 2).sum(axis=1)
                q_norm, q_place = (q.astype(np.float64) ** 2).sum(axis=1), p.places(p.table(q.astype(np.float64)))
                bound = upper_bounds(q_place, q_norm, place, norm)
                out_q, out_i, out_s = [], [], []
                for j in np.flatnonzero(bound.max(axis=1) >= lo).tolist():
                    i, s, _ = best(q[j], int(qi[j]), bound[j], c, ci, k, float(lo[j]))
                    out_q.append(np.full(len(i), qi[j]))
                    out_i.append(i)
                    out_s.append(s)
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_s))], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
