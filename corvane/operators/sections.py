"""Section paths: a running stack of headings through a document, in one pass over its blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from corvane.functions import blocks as B
from corvane.functions.text import contains_any, squeeze
from corvane.operators.recall import importable


def starts_section(text: Column, kind: Column, page_profile: Column) -> Column:
    h = squeeze(text)
    low = F.lower(h)
    noise = contains_any(low, ("important notice", "source:", "数据来源", "特别声明", "资料来源")) | B.period_label(h) | h.rlike(r"(?U)^\d{1,4}$")
    return F.coalesce((kind == "heading") & (h != "") & ~noise & (F.coalesce(page_profile, F.lit("")) != "label_dense") & (B.structured(h) | (F.length(h) > 4)), F.lit(False))


def level(heading: Column) -> Column:
    number = F.regexp_extract(heading, r"(?U)^(\d+(?:\.\d+)*)", 1)
    return F.when(number == "", 1).otherwise(F.least(F.size(F.split(number, r"\.")), F.lit(6)))


def section_paths(blocks: DataFrame, order: tuple[str, ...] = ("page_no", "block_ord")) -> DataFrame:
    """``blocks`` with section_path: what they have, or the stack of headings before and at them.

    One pass over the blocks of each document in their order, which holds one path: blocks are made once and sent once."""
    keep = "section_path" in blocks.columns
    importable(blocks.sparkSession)
    h = squeeze(F.col("text"))
    head = starts_section(F.col("text"), F.col("type"), F.col("page_profile"))
    marked = blocks.withColumn("_head", F.when(head, h)).withColumn("_level", F.when(F.col("_head").isNotNull(), level(h)))
    placed = marked.repartition("doc_id").sortWithinPartitions("doc_id", *order)
    schema = StructType([*placed.schema.fields, StructField("_path", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, path = None, ["Document"]
        for batch in batches:
            paths = []
            for d, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_head", "_level"))):
                if d != doc:
                    doc, path = d, ["Document"]
                if t is not None:
                    path = [*path[: n - 1], t]
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.string()))], [*batch.schema.names, "_path"])

    out = placed.mapInArrow(run, schema)
    # blocks without a document have no heads, as they are of none
    path = F.when(F.col("doc_id").isNull(), F.array(F.lit("Document"))).otherwise(F.col("_path"))
    own = F.when(F.size("section_path") > 0, F.col("section_path")) if keep else F.lit(None)
    return out.select(*[c for c in blocks.columns if c != "section_path"], F.coalesce(own, path).alias("section_path"))
