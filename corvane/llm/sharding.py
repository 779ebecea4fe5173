"""Sharding by extendible hashing. DataFrame functions only.

The directory is indexed by the leading bits of a row's 64-bit hash. A bucket is a hash prefix; one whose bytes exceed
``limit`` splits on the next bit, and only such buckets do, until every bucket fits: each row's shard is the shortest
prefix of its hash whose bucket fits. The bytes of all prefixes come from one histogram over ``step`` more bits
at a time; only rows of buckets that are still too large take part in the next round, so a hot region costs
extra rounds for itself alone.

The hash covers key and text, so rows that merely share a key are spread. Rows that agree in both can't be told
apart by any bit: where such rows exceed the limit together, their bucket at full depth is an overflow chain, dealt
to pages of at most ``limit`` bytes (or one row, if a row alone is larger). Which of such equal rows is in
which page doesn't matter.

Null keys and texts are hashed as such (size 0 for a null text). An empty table has no shards. Extra columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import prepare

BITS = 60


def _hash(*columns: str) -> F.Column:
    """The first 60 bits of an MD5 over the columns, as a long."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: F.Column, depth: F.Column) -> F.Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int, step: int = 12) -> DataFrame:
    """(depth, bucket, bytes, n) of the buckets of rows (h, bytes): disjoint prefixes that cover every row."""
    found, done, left = None, 0, rows.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    while True:
        to = min(BITS, done + step)
        fine = left.groupBy(prefix(F.col("h"), F.lit(to)).alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        levels = F.explode(F.sequence(F.lit(done), F.lit(to))).alias("depth")
        sums = fine.select(levels, "p", "bytes", "n").select("depth", F.call_function("shiftright", F.col("p"), (F.lit(to) - F.col("depth")).cast("int")).alias("bucket"), "bytes", "n")
        sums = sums.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).checkpoint()
        fits = (F.col("bytes") <= limit) | (F.lit(to) == BITS) & (F.col("depth") == BITS)
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"), (F.col("bytes") > limit).alias("split"))
        leaf = sums.where(fits).alias("a").join(parents.alias("b"), (F.col("a.depth") == F.col("b.depth")) & (F.call_function("shiftright", F.col("a.bucket"), F.lit(1)) == F.col("b.parent")), "left")
        leaf = leaf.where((F.col("a.depth") == done) | F.col("split")).select("a.depth", "bucket", "bytes", "n")
        if done:
            leaf = leaf.where(F.col("depth") > done)  # those of the round before were too large at this depth
        found = leaf if found is None else found.unionByName(leaf)
        if to == BITS:
            return found
        large = sums.where((F.col("depth") == to) & (F.col("bytes") > limit)).select(F.col("bucket").alias("p"))
        if large.isEmpty():
            return found
        left = left.join(large, prefix(F.col("h"), F.lit(to)) == F.col("p"), "left_semi")
        done = to


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", limit: int = 64 << 20, step: int = 12) -> DataFrame:
    """key, bytes long (of the text), depth int, bucket long, page long and shard string (bucket's bits, and the page of an overflow chain), a row for each row of ``docs``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), _hash(key, text).alias("h"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes")).checkpoint()
    buckets = directory(rows.select("h", "bytes"), limit, step).checkpoint()
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # at most 61
    if not depths:
        return rows.select(F.col("k").alias(key), "bytes", F.lit(0).alias("depth"), "h", F.lit(0).cast("long").alias("page"), F.lit("").alias("shard")).withColumnRenamed("h", "bucket")
    # A row belongs to the one depth at which its prefix is a bucket.
    probes = rows.select("*", F.explode(F.array(*[F.lit(d) for d in sorted(depths)])).alias("depth")).withColumn("bucket", prefix(F.col("h"), F.col("depth")))
    placed = probes.join(buckets.select("depth", "bucket", F.col("bytes").alias("all"), "n"), ["depth", "bucket"])
    # Overflow chains: rows of one hash are dealt by row number over salts, pages are within a salt.
    chained = (F.col("depth") == BITS) & (F.col("all") > limit)
    plain = placed.where(~chained).select("k", "bytes", "depth", "bucket", F.lit(0).cast("long").alias("page"))
    salted = placed.where(chained).withColumn("salt", F.monotonically_increasing_id() % 64)
    running = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("bytes", "k")) - 1
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("bytes"))))
    chain = salted.withColumn("at", running).select("k", "bytes", "depth", "bucket", (F.col("salt") + 64 * F.floor(F.col("at") / each)).cast("long").alias("page"))
    bits = F.right(F.lpad(F.conv(F.col("bucket").cast("string"), 10, 2), 64, "0"), F.col("depth"))
    name = F.concat(F.lit("0b"), F.when(F.col("depth") == 0, F.lit("")).otherwise(bits), F.when(F.col("page") > 0, F.concat(F.lit("."), F.col("page").cast("string"))).otherwise(F.lit("")))
    return plain.unionByName(chain).select(F.col("k").alias(key), "bytes", F.col("depth").cast("int").alias("depth"), "bucket", "page", name.alias("shard"))
