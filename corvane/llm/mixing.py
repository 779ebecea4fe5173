"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

Targets: each source's weight times one common level, stopped at ``most_repeats`` times the source's size, where the
level shares out exactly the total (water filling: excess goes to the sources below their stop by
weight until none is above).

Quotas: the total is cut into blocks of ``block`` words (one, unless told otherwise), apportioned to sources by the highest
quotients target / (2 n + 1). A source's documents lie in seeded shards, and its blocks are apportioned once more, to those
shards, by the highest quotients of the source's words there; so every shard has an integer quota of each source, never above
``most_repeats`` times the words it has of it. Seats below those in doubt are a claimant's own, so only a few for
each claimant are sorted, whatever the total.

Selection, in each shard by itself: a source's documents lie in seeded order on a line of its words, cut into blocks, again and
again if the quota is above the line's length; a document is taken as often as its words are covered by the quota. No
document is ever taken more than ``most_repeats`` times.

A source with a third of all rows is spread over all shards, whose number grows with the table (``rows_per_shard``).
Order and quotas depend on ids, sizes and the seed alone: reruns agree.

Null texts have size 0 and take 0; null sources are a source of their own, last; null ids and repeated rows each count; texts of any
length are counted whole; ties are broken by id and size. Other columns play no part in ``mix``, whatever their names; ``repeat``
passes them all. An empty table gives an empty one. One window sorts a few rows for each source, never documents: the
number of sources is its bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD_SQL, fresh, prepare

ROWS_PER_SHARD = 200_000
LEAST_SHARDS = 64


def sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """(k, s, size, h): words of each row, and its seeded place."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), words.alias("size"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    return sizes.withColumn("h", F.conv(F.substring(h, 1, 15), 16, 10).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """(s, rank, w, source_size, target) from rows (s, size)."""
    per = sizes.groupBy("s").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("s").asc_nulls_last()))
    weighed = per.withColumn("rank", rank).withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn("stop", F.col("source_size") * most_repeats)
    # In ascending order of stop / weight, source i is stopped if the level that those from i on share reaches its stop.
    by_stop = Window.orderBy((F.col("stop") / F.col("w")).asc(), "rank")
    whole = Window.partitionBy()
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = weighed.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("w").over(rest))
    # the first source that isn't stopped knows the level of all that follow
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct(F.col("stop") / F.col("w"), "rank", "level"))).over(whole)["level"]
    filled = leveled.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    return filled.select("s", "rank", "w", "source_size", F.least(F.col("stop").cast("double"), F.col("w") * F.col("level")).alias("target"))


def sainte_lague(claims: DataFrame, group: list[str], by: str, weight: str, seats: Column, keep: list[str]) -> DataFrame:
    """group, by, keep and quota of each claim: of a group's ``seats`` those with the highest quotients weight / (2 n + 1), ties to the smaller ``by``.

    Seats are weights over a common divisor, rounded. Rounding moves their sum by half a seat for each claimant at most, so they
    are within share * claimants / (2 seats), and two, of the share: only those are ranked, some five for each claimant.
    """
    whole = Window.partitionBy(*group)
    shared = claims.where(F.col(weight) > 0).select(*group, by, weight, *keep, seats.cast("long").alias("seats"))
    shared = shared.withColumn("share", F.col(weight) / F.sum(weight).over(whole) * F.col("seats"))
    margin = F.col("share") * F.count("*").over(whole) / (2 * F.greatest(F.lit(1), F.col("seats"))) + 2
    bounds = shared.withColumn("margin", margin).withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("share") - F.col("margin"))).cast("long"))
    bounds = bounds.withColumn("doubtful", F.col("seats") - F.sum("sure").over(whole))
    last = F.ceil(F.col("share") + F.col("margin")).cast("long") - 1
    each = bounds.select(*group, by, weight, *keep, "sure", "doubtful", F.explode(F.sequence("sure", last)).alias("seat"))
    ranked = each.withColumn("at", F.row_number().over(whole.orderBy((F.col(weight) / (2 * F.col("seat") + 1)).desc(), by, "seat")))
    won = F.first("sure") + F.count_if(F.col("at") <= F.col("doubtful"))
    return ranked.groupBy(*group, by, *keep).agg(won.alias("quota"))


def quotas(sizes: DataFrame, shards: int, total: int, weights: tuple[int, ...], most_repeats: int, block: int) -> DataFrame:
    """(s, shard, shard_size, source_size, target, words): the words that the mix takes of each source in each shard of rows (s, size, h)."""
    # small tables, used more than once
    per = sizes.groupBy("s", F.pmod("h", F.lit(shards)).alias("shard")).agg(F.sum("size").alias("shard_size")).checkpoint()
    wanted = targets(per.select("s", F.col("shard_size").alias("size")), weights, most_repeats).checkpoint()
    won = sainte_lague(wanted, [], "rank", "target", F.lit(total // block), ["s", "source_size"]).select("s", F.least(F.col("quota"), F.floor(F.col("source_size") * most_repeats / block)).alias("blocks"))
    claims = per.alias("a").join(won.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s"))).select("a.s", "shard", "shard_size", "blocks")
    dealt = sainte_lague(claims, ["s"], "shard", "shard_size", F.col("blocks"), [])
    has = per.alias("a").join(wanted.alias("w"), F.col("a.s").eqNullSafe(F.col("w.s"))).select("a.s", "shard", "shard_size", "source_size", "target")
    both = has.alias("a").join(dealt.alias("d"), F.col("a.s").eqNullSafe(F.col("d.s")) & (F.col("a.shard") == F.col("d.shard")), "left")
    return both.select("a.s", "a.shard", "shard_size", "source_size", "target", F.least(F.coalesce("quota", F.lit(0)) * block, F.col("shard_size") * most_repeats).alias("words"))


def _taken(sizes: DataFrame, weights: tuple[int, ...], most_repeats: int, block: int, rows_per_shard: int) -> DataFrame:
    """``sizes`` (k, s, size, h) with shard, source_size, target, passes (whole passes over the shard's line) and over (words of one more)."""
    row = sizes.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()
    shards = max(LEAST_SHARDS, -(-row["n"] // rows_per_shard))
    plan = quotas(sizes, shards, row["total"] or 0, weights, most_repeats, block)
    plan = plan.withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size"))
    line = Window.partitionBy("s", "shard").orderBy("h", "k", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = sizes.withColumn("shard", F.pmod("h", F.lit(shards))).withColumn("upto", F.sum("size").over(line))
    joined = lined.alias("a").join(plan.alias("b"), F.col("a.s").eqNullSafe(F.col("b.s")) & (F.col("a.shard") == F.col("b.shard")))
    over = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    return joined.select("k", "a.s", "a.shard", "size", "source_size", "target", "passes", over.alias("over"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, block: int = 1, rows_per_shard: int = ROWS_PER_SHARD, seed: int = 17) -> DataFrame:
    """key, source, size, source_size, target, taken (words the mix takes, repeats counted), shard: a row for each row of ``docs``."""
    prepare(docs.sparkSession)
    # the texts are read once; sizes, a few bytes a row, go to the checkpoint folder
    sizes = sized(docs, key, text, source, seed).checkpoint()
    out = _taken(sizes, weights, most_repeats, block, rows_per_shard)
    return out.select(F.col("k").alias(key), F.col("s").alias(source), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("over")).cast("long").alias("taken"), "shard")


def repeat(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_repeats: int = 3, block: int = 1, rows_per_shard: int = ROWS_PER_SHARD, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    A document in which a shard's quota of its source ends is taken once more if at least half of its words are covered;
    documents without words, which cost the mix nothing, are taken once. Rows that agree in id, source and text are
    repeated alike, by the mean of what they take.
    """
    prepare(docs.sparkSession)
    k, h, n, i = fresh(docs.columns, "row_key", "row_hash", "row_copies", "row_copy")
    keyed = docs.withColumn(k, F.xxhash64(F.col(key), F.lit(1))).withColumn(h, F.xxhash64(F.col(text), F.col(source)))
    src = keyed.select(F.struct(F.col(k).alias("k"), F.col(h).alias("h")).alias("k"), F.col(source).alias("s"), F.col(text).alias("t"))
    sizes = sized(src, "k", "t", "s", seed).checkpoint()
    taken = _taken(sizes, weights, most_repeats, block, rows_per_shard)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("passes") + (2 * F.col("over") >= F.col("size")).cast("long"))
    counts = taken.select(F.col("k.k").alias(k), F.col("k.h").alias(h), copies.alias(n)).groupBy(k, h).agg(F.round(F.avg(n)).cast("int").alias(n)).where(F.col(n) > 0)
    joined = keyed.join(counts, [k, h])
    return joined.withColumn(i, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(*docs.columns)
