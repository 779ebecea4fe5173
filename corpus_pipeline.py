"""From raw documents to token ids: quality, repeated lines, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, lines, mixing, quality, simhash
from corvane.llm.common import fresh, prepare, table
from corvane.llm.queries import tokenizer

#: No stage but the mix can be written in SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of rows that aren't held out, doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "row_score")
    return quality.with_scores(docs, model, name=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template an earlier document has."""
    return lines.drop_lines(docs, least=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: five words, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a source's quota ends in counts if half of it is taken."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and digests of ids and decoded text."""
    return bpe.encode_documents(docs, tokenizer(), keep=("source",), digest=True)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("mix", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages is in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{prepare(spark).sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
