"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a document's shingles (five words; a shorter text is one
shingle; no words, an empty sketch). The sketch of a union is the k smallest of both sketches, so parts merge.
Resemblance is estimated on the merged sketch, containment from the same intersection, and the number of
distinct shingles from the k-th smallest hash; below k hashes all three are exact.

Null texts count as empty. Empty sketches resemble each other fully and nothing else. Each row counts, repeated ones too; texts are read whole;
an empty table gives an empty one. Only key and text are looked at, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches, prepare

K, SHINGLE = 128, 5


class _Words(dict):
    """Hash of each word seen, up to a limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Words()
_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, in order, repeats included."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, dtype=np.uint64)
        for i in range(size):
            x = h[i : n - size + 1 + i] * _TURN[i % 8]
            out = (out ^ (x ^ (x >> np.uint64(32)))) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(33)
    return out


def sketch(text: str, k: int = K, size: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending."""
    h = shingle_hashes(text.encode("utf-8", "surrogatepass").split(), size)
    if len(h) > 4 * k:  # repeats can make the k smallest values fewer than k distinct ones
        few = np.unique(np.partition(h, 2 * k)[: 2 * k])
        if len(few) > k:
            return few[:k]
    return np.unique(h)[:k]


def merge(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of the documents."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.empty(0, dtype=np.uint64)


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimate of the distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) / ((float(s[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of |A and B| / |A or B|."""
    if not len(a) and not len(b):
        return 1.0
    both = np.unique(np.concatenate((a, b)))[:k]
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True).astype(int)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of A's shingles that B has."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k=k), k) / distinct_count(a, k))


def written(s: np.ndarray) -> str:
    """16 hex digits for each hash, ascending."""
    return s.astype(">u8").tobytes().hex()


def read(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u8").astype(np.uint64)


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """key, n_chars long, fingerprint string, n_distinct double: a row for each row of ``docs``."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("t").to_pylist()
        made = [sketch(t, k, size) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("k"), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(s) for s in made]), pa.array([distinct_count(s, k) for s in made], pa.float64())], ["k", "n_chars", "fingerprint", "n_distinct"])

    return map_batches(src, run, f"k {src.schema['k'].dataType.simpleString()}, n_chars long, fingerprint string, n_distinct double").withColumnRenamed("k", key)


def _bucket(column: F.Column, splits: list, width: int) -> F.Column:
    """How many of the ascending ``splits`` are below ``column``, in two steps of about ``width``."""
    if not splits:
        return F.lit(0)
    whole = F.array(*[F.lit(s) for s in splits])
    coarse = F.array(*[F.lit(s) for s in splits[width - 1 :: width]]) if len(splits) >= width else None
    first = F.size(F.filter(coarse, lambda s: s < column)) * width if coarse is not None else F.lit(0)
    return first + F.size(F.filter(F.slice(whole, first + 1, F.lit(width)), lambda s: s < column))


def compare_with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, size: int = SHINGLE, rows_per_range: int = 4096, most_ranges: int = 4096) -> DataFrame:
    """Each document's sketch beside that of its edited text and that of the next document.

    Documents are in descending order of key (nulls after all others, in seeded order of their texts; equal keys by descending text); the edited
    text has its last floor(n / 3) code points replaced by the first as many of the next document's text, which
    after the last document is the first's. Columns: key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The texts are shuffled once, into ranges of keys; the first document of each range goes to the range before
    it as well. At most twice ``most_ranges`` keys and range bounds reach the driver, whatever the input.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # rows without id are placed by a hash of their texts
    src = src.select("k", "t", F.coalesce("k", F.xxhash64("t", F.lit(7))).alias("o"))
    ids = src.select("k").where("k is not null")
    rows_ = src.agg(F.count("k").alias("ids"), F.count_if(F.col("k").isNull()).alias("none")).first()
    ranges = max(1, min(most_ranges, -(-rows_["ids"] // rows_per_range)))
    splits = sorted({int(x) for x in ids.approxQuantile("k", [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    loose = max(1, min(most_ranges, -(-rows_["none"] // rows_per_range)))
    # bucket 0 holds the largest keys; nulls are behind all, by descending hash
    behind = F.least(F.lit(loose - 1), F.floor((F.lit(float(2**63)) - F.col("o")) / F.lit(float(2**64) / loose)).cast("int"))
    of = F.when(F.col("k").isNull(), len(splits) + 1 + behind).otherwise(len(splits) - _bucket(F.col("k"), splits, 64))
    placed = src.select(of.alias("bucket"), "k", "o", "t")
    firsts = placed.groupBy("bucket").agg(F.max("o").alias("o"), F.max(F.col("k").isNull()).alias("none")).orderBy("bucket").collect()  # at most 2 most_ranges
    halo = [(firsts[i - 1]["bucket"], firsts[i]["o"], firsts[i]["none"]) for i in range(len(firsts))]
    small = docs.sparkSession.createDataFrame(halo, "bucket int, o long, none boolean")
    after = placed.join(F.broadcast(small), (placed["o"] == small["o"]) & (placed["k"].isNull() == small["none"])).select(small["bucket"], placed["k"], placed["o"], placed["t"])
    both = placed.select("bucket", F.lit(0).alias("halo"), "k", "o", "t").unionByName(after.select("bucket", F.lit(1).alias("halo"), "k", "o", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        bucket, held, done = None, None, False

        def out() -> pa.RecordBatch:
            names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows.clear()
            return made

        for batch in batches:
            for b, after_it, key_, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "halo", "k", "t"))):
                if b != bucket:
                    bucket, held, done = b, None, False
                if done:
                    continue
                own = sketch(t, k, size)
                if held is not None:
                    k0, t0, s0 = held
                    m = len(t0) // 3
                    edited = t0[: len(t0) - m] + t[:m]
                    s1 = sketch(edited, k, size)
                    rows.append((k0, len(t0), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), written(s0), written(s1), resemblance(s0, s1, k), resemblance(s0, own, k)))
                held, done = (key_, t, own), bool(after_it)
                if len(rows) >= 1000:
                    yield out()
        if rows:
            yield out()

    ordered = both.repartition("bucket").sortWithinPartitions("bucket", "halo", F.col("o").desc(), F.col("t").desc()).select("bucket", "halo", "k", "t")
    made = ordered.mapInArrow(run, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("k", key)
