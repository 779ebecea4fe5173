"""Exact recall in Python workers: all queries of a batch against blocks of rows, and in each task only the best rows of each query."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Scores this close may be equal on nine decimals; the ranking that follows decides between their rows.
CLOSE = 2e-9
#: Rows and queries of one product.
ROWS, QUERIES = 1024, 512
#: Entries of sparse queries of one product.
PART = 8192


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


class Best:
    """The rows that may be among the ``top_k`` of each of n queries, of all rows that a task has seen.

    What is let go has a score below a query's k-th best by more than CLOSE, or the very score of top_k rows of smaller keys.
    Not a number goes before all numbers, as it does where Spark sorts. It holds top_k rows of each query, and some 50,000 at least, twice."""

    def __init__(self, n: int, top_k: int):
        self.top_k, self.cut, self.seen = top_k, np.full(n, -np.inf), 0
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.new, self.most = 0, max(50_000, n * top_k)

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        """Ranges of n more rows: the first are short, as all rows pass until there are cuts."""
        s = 0
        while s < n:
            e = min(n, s + min(ROWS, max(32, self.seen)))
            yield s, e
            self.seen += e - s
            s = e

    def add(self, query: np.ndarray, score: np.ndarray, key: pa.Array) -> None:
        if len(query):
            self.held.append((query, score, key))
            self.new += len(query)
            if self.new > self.most:
                self.prune()

    def prune(self) -> None:
        if not self.held:
            return
        query, score = (np.concatenate(x) for x in list(zip(*self.held))[:2])
        key = pa.chunked_array([x[2] for x in self.held]).combine_chunks()
        place = pc.rank(key, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        value = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((place, -value, ~np.isnan(score), query))
        query, value = query[order], value[order]
        at = np.arange(len(order))
        fresh = np.concatenate([[True], query[1:] != query[:-1]])
        of_query = at - np.maximum.accumulate(np.where(fresh, at, 0))
        last = of_query == self.top_k - 1
        self.cut[query[last]] = value[last]
        fresh |= np.concatenate([[True], value[1:] != value[:-1]])
        of_score = at - np.maximum.accumulate(np.where(fresh, at, 0))
        kept = order[(value >= self.cut[query] - CLOSE) & (of_score < self.top_k)]
        self.held = [(np.concatenate([x[0] for x in self.held])[kept], score[kept], key.take(pa.array(kept)))]
        self.new = 0

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query_id, key, score) of what is held; ``ids`` are those of the queries."""
        self.prune()
        for query, score, key in self.held:
            for s in range(0, len(query), 10_000):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[s : s + 10_000])), key.slice(s, 10_000), pa.array(score[s : s + 10_000])], ["query_id", "key", "score"])


def one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length; vectors that are null or hold a null are left out."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten(), np.cumsum(np.maximum(sizes, 0))
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        sizes = np.where(holes[ends] > holes[ends - np.maximum(sizes, 0)], -1, sizes)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, values[(ends[at] - size)[:, None] + np.arange(size)].astype(np.float64)


def products(batches: Iterator[pa.RecordBatch], asked: tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]], top_k: int) -> Iterator[pa.RecordBatch]:
    """Best inner products of rows (key, vector) with the queries ``asked``: ids, and positions and matrix of those of each length.

    Matrix products say which pairs may be among the best; these are summed once more, in order, as a fold over the elements does."""
    ids, groups = asked
    best = Best(len(ids), top_k)
    for batch in batches:
        for rows, matrix in by_length(batch.column("vector")):
            for at, queries in groups:
                if queries.shape[1] != matrix.shape[1]:
                    continue
                dim = queries.shape[1]
                norms = np.sqrt((queries * queries).sum(axis=1))
                for s, e in best.blocks(len(matrix)):
                    v = matrix[s:e]
                    longest = np.sqrt((v * v).sum(axis=1).max())
                    for a in range(0, len(at), QUERIES):
                        q, own = queries[a : a + QUERIES], at[a : a + QUERIES]
                        with np.errstate(invalid="ignore", over="ignore"):
                            score = v @ q.T
                            slack = CLOSE + 4 * dim * 2.3e-16 * norms[a : a + QUERIES] * longest
                            # written so that what isn't a number passes
                            i, j = np.nonzero(~(score < np.maximum(best.cut[own], 0) - slack))
                            exact = np.zeros(len(i))
                            for d in range(dim):
                                exact += q[j, d] * v[i, d]
                            keep = np.isnan(exact) | ((exact > 0) & (exact >= best.cut[own[j]] - CLOSE))
                        best.add(own[j[keep]], exact[keep], batch.column("key").take(pa.array(rows[s + i[keep]])))
    yield from best.rows(ids)


def weighted(batches: Iterator[pa.RecordBatch], asked: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray], entries, top_k: int) -> Iterator[pa.RecordBatch]:
    """Best sums of products of sparse rows with sparse queries: ids of queries, and the query, feature and weight of each of their entries.

    ``entries(batch)`` gives the row, feature and weight of each entry of a batch. Only the features of a block of queries are multiplied with it."""
    ids, query, feature, weight = asked
    best, order = Best(len(ids), top_k), np.argsort(query, kind="stable")
    query, feature, weight = query[order], feature[order], weight[order]
    width, parts, s = int(feature.max(initial=-1)) + 1, [], 0
    while s < len(query):  # queries of so many entries together
        e = int(np.searchsorted(query, query[min(s + PART, len(query) - 1)], side="left"))
        e = len(query) if s + PART >= len(query) else e if e > s else int(np.searchsorted(query, query[s], side="right"))
        features, column = np.unique(feature[s:e], return_inverse=True)
        own, line = np.unique(query[s:e], return_inverse=True)
        parts.append((own, features, column, line, weight[s:e]))
        s = e
    for batch in batches:
        row, of, value = entries(batch)
        inside = of < width
        row, of, value = row[inside], of[inside], value[inside]
        order = np.argsort(row, kind="stable")
        row, of, value = row[order], of[order], value[order]
        for s, e in best.blocks(batch.num_rows):
            i, j = np.searchsorted(row, (s, e))
            for own, features, column, line, w in parts:
                place = np.full(width, -1)
                place[features] = np.arange(len(features))
                at = place[of[i:j]]
                has = at >= 0
                left, right = np.zeros((e - s, len(features))), np.zeros((len(features), len(own)))
                np.add.at(left, (row[i:j][has] - s, at[has]), value[i:j][has])
                np.add.at(right, (column, line), w)
                score = left @ right
                x, y = np.nonzero((score > 0) & (score >= best.cut[own] - CLOSE))
                best.add(own[y], score[x, y], batch.column("key").take(pa.array(s + x)))
    yield from best.rows(ids)
