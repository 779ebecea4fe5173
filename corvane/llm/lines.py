"""Line dedup through a fixed-depth tree of log templates.

A line's place in the tree is its number of tokens, then its ``lead`` leading tokens with variable-looking tokens
(those with a digit, addresses, hexadecimal strings) generalised to a wildcard. Its templates are all its tokens
generalised so and, for lines of ``wild_from`` tokens or more, the three templates in which one third of the tokens
behind the leading ones is a wildcard as a whole: lines at one leaf that differ in one field region have a template
in common. A template without any constant token would stand for every row of as many numbers; in its place a line has
all its tokens as they are. All are 64-bit hashes, so a leaf is never collected: templates are counted by one aggregation.

A template recurs if lines of at least two documents have it. A line of a recurring template is dropped, unless its
document is the first (smallest id) that has the template: so one occurrence of everything stays, and a document
that shares nothing stays as it is. Lines of fewer than ``least`` tokens always stay; with ``least`` 1, as the query and
the pipeline have it, only lines without tokens do.

Documents are told apart by id; rows of one id are one document. Rows without id are documents by their texts, after all
others, in seeded order: equal ones are one. Null and empty texts stay as they are, and so does the order of lines. Texts of any length are
read whole. All columns pass, whatever their names; n_chars, if there, is set to the new length where lines went. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm.common import fresh, prepare

WILD = b"<*>"
_VARIABLE = re.compile(rb"[0-9@]|://|^[0-9A-Fa-f]{8,}$")
LAST = (1 << 63) - 1


def templates(line: bytes, lead: int = 4, least: int = 5, wild_from: int = 12) -> list[int]:
    """Hashes (signed) of the templates a line has; none for a line that is too short or blank."""
    tokens = own = line.split()
    n = len(tokens)
    if n < max(1, least):
        return []
    if _VARIABLE.search(line) or n != line.count(b" ") + 1:
        tokens = [WILD if _VARIABLE.search(t) else t for t in tokens]
    h = xxhash.xxh3_64_intdigest
    leaf = h(b"%d " % n + b" ".join(tokens[:lead]))
    rest = tokens[lead:]
    if tokens is not own and all(t == WILD for t in tokens):
        out = [h(b" ".join(own), n)]
    elif n < wild_from:
        out = [h(b" ".join(rest), leaf)]
    else:
        m = len(rest)
        a, b, c = (h(b" ".join(rest[m * i // 3 : m * (i + 1) // 3]), leaf + i & LAST) for i in range(3))
        out = [(x * 0x9E3779B97F4A7C15 ^ y * 0xC2B2AE3D27D4EB4F) % 2**64 for x, y in ((a, b), (b, c), (c + 1, a))]
        if tokens is not own and all(t == WILD for t in tokens[:lead]):
            wild = [all(t == WILD for t in rest[m * i // 3 : m * (i + 1) // 3]) for i in range(3)]
            exact = h(b" ".join(own), n)
            out = [exact if wild[i] and wild[j] else x for x, (i, j) in zip(out, ((0, 1), (1, 2), (2, 0)))]
    return [x - (1 << 64) if x > LAST else x for x in out]


def document_templates(text: str, **form: int) -> set[int]:
    return {t for line in set(text.encode("utf-8", "surrogatepass").split(b"\n")) for t in templates(line, **form)}


def keep_lines(text: str, recurring: set[int], **form: int) -> tuple[str, int]:
    """The text without the lines that have a template in ``recurring``; how many lines went."""
    kept, gone = [], 0
    for line in text.split("\n"):
        if any(t in recurring for t in templates(line.encode("utf-8", "surrogatepass"), **form)):
            gone += 1
        else:
            kept.append(line)
    return "\n".join(kept), gone


def document(key: str, text: str) -> F.Column:
    """A number for each document: its id, or one above all likely ids from its text."""
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(F.col(text), F.lit(1)), F.lit(1 << 40)))


def recurring_templates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **form: int) -> DataFrame:
    """(d, gone): each document's templates that an earlier document has; only documents with any."""
    prepare(docs.sparkSession)
    src = docs.select(document(key, text).alias("d"), F.col(text).alias("t")).where("t <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_templates, counts = batch.column("d").to_numpy(zero_copy_only=False), [], []
            for t in batch.column("t").to_pylist():
                own = document_templates(t, **form)
                all_templates.append(np.fromiter(own, np.int64, len(own)))
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(all_templates)), pa.array(np.repeat(ids, counts))], ["template", "d"])

    has = src.mapInArrow(run, "template long, d long")
    first = has.groupBy("template").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("template", "first")
    again = has.join(first, "template").where("d > first")
    return again.groupBy("d").agg(F.collect_set("template").alias("gone"))


def drop_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", count: str | None = None, **form: int) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``; with ``count``, one more column: the lines that went."""
    spark = prepare(docs.sparkSession)
    assert spark is not None
    gone = recurring_templates(docs, key=key, text=text, **form)
    d, g, n = fresh(docs.columns, "row_document", "row_gone", "row_dropped")
    joined = docs.withColumn(d, document(key, text)).join(gone.toDF(d, g), d, "left").drop(d)
    names = docs.columns
    at = names.index(text)
    size = names.index("n_chars") if "n_chars" in names and dict(docs.dtypes)["n_chars"] in ("bigint", "int") else None
    schema = StructType([*docs.schema.fields, StructField(n, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            lost = batch.column(len(names))
            dropped = np.zeros(batch.num_rows, dtype=np.int64)
            hit = np.flatnonzero(lost.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if hit:
                texts, gone_ = columns[at].to_pylist(), lost
                sizes = columns[size].to_pylist() if size is not None else None
                for i in hit:
                    if texts[i]:
                        texts[i], dropped[i] = keep_lines(texts[i], set(gone_[i].as_py()), **form)
                        if sizes is not None and dropped[i]:
                            sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if sizes is not None:
                    columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped)], [*names, n])

    out = joined.mapInArrow(run, schema)
    return out.withColumnRenamed(n, count) if count else out.drop(n)
