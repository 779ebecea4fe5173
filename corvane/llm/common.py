"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: The words of every contract here: runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that checkpoint() has a folder.

    ``spark.checkpoint.dir`` is the cluster's shared folder; only where it is unset and all runs in this one
    process (tests, one machine) a folder of our own is set.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-checkpoint-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with one output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that no column of a caller's table has, whatever extra columns it brings."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ordered_size(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free digest of a table of two longs; equal digests mean no change."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def among(keys: DataFrame, most: int = 1 << 25) -> Column:
    """Whether a row, by its columns of the same names and types, may be one of ``keys``: true for all that are and for some others.

    Tasks hold a bit for each hash, ``most`` bits at most, so others are one in sixteen while there are up to
    ``most`` / 16 keys, and more beyond. A join that follows decides; the rest of a table needs no shuffle.
    """
    spark = keys.sparkSession
    bits = min(most, max(1 << 15, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    placed = keys.select(F.shiftright(slot, 15).alias("block"), slot.bitwiseAND(32767).alias("at")).repartition("block")
    table_ = np.zeros(bits // 8, dtype=np.uint8)
    for r in placed.groupBy("block").agg(F.bitmap_construct_agg("at").alias("map")).collect():
        table_[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["map"], np.uint8)
    shared = spark.sparkContext.broadcast(table_)

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        return pd.Series((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool))

    return marked(slot)
