"""What operators leave behind on executors, whose Python workers outlive their tasks."""

import pyarrow as pa
import public_tokenizers
from corvane.llm import bpe, quality
from corvane.llm.common import map_batches


def test_workers_keep_no_memo_or_chunks_of_ended_tasks(spark):
    docs = spark.range(0, 400, 1, 8).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 50), i -> sha2(concat(id, ':', i), 256))) as text")
    assert bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).where("n_tokens > 0").count() == 400

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        import os

        from corvane.llm import bpe

        n = [sum(map(len, (c.ids, c.said, *c.old, c.parts, c.store))) + c.stored for c in bpe._CODECS.values()]
        return pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(n)]), pa.array([sum(n)])], ["pid", "codecs", "kept"])

    workers = map_batches(spark.range(0, 64, 1, 16).toDF("i"), kept, "pid long, codecs long, kept long").collect()
    assert sum(r["codecs"] for r in workers), "no worker was used again"
    assert [r for r in workers if r["kept"]] == []


def test_training_starts_no_workers_of_another_kind(spark, monkeypatch):
    """Rows from a list go through workers of their own, with a daemon of theirs, which stay beside those that read the texts."""
    rows = spark.range(0, 60, 1, 2)
    docs, labels = rows.selectExpr("id as doc_id", "concat('Some words of text, number ', id, '.') as text"), rows.selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert quality.train(docs, labels) is not None
