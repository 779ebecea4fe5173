"""Files in and artifacts out."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.identity import collection, doc_id, source_type

SPANS = "path string, page_no int, page_width double, page_height double, block_no int, line_no int, span_no int, kind int, text string, size double, flags int, x0 double, y0 double, x1 double, y1 double"
CHUNK_JSON = "doc_id string, title string, source_file string, chunk_count long, chunks array<struct<chunk_id:string,doc_id:string,text:string,page_no:int,chunk_type:string,section_path:array<string>,metadata:map<string,string>,evidence_type:string>>"


def scan(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files under a folder: path, name, sha256, content, and the document's id, collection and source type."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = Path(root).resolve().as_posix().rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    digest = F.sha2("content", 256)
    folders = F.when(F.contains(relative, F.lit("/")), F.regexp_replace(relative, "/[^/]*$", "")).otherwise("")
    return raw.select("path", name.alias("name"), digest.alias("sha256"), doc_id(name, digest).alias("doc_id"), collection(relative).alias("source_collection"), source_type(folders, stem).alias("document_source_type"), "content")


def read_pages(files: DataFrame, reader) -> DataFrame:
    """Spans of pages, through a reader: a function of (path, bytes) that yields rows of SPANS without the path.

    A file that the reader can't read gives one row whose text is null and whose _error says why; the job goes on."""

    def run(batches):
        import pandas as pd

        names = [x.split()[0] for x in SPANS.split(", ")] + ["_error"]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, *row, None) for row in reader(path, bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, *[None] * (len(names) - 2), f"ingestion_error: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SPANS + ", _error string")


def flatten_spans(spans: DataFrame) -> DataFrame:
    """Text blocks of a page's spans: spans are joined by spaces, lines by newlines; kept blocks are numbered."""
    from pyspark.sql import Window

    text = spans.where("_error is null and kind = 0").withColumn("t", F.trim("text")).where("t <> ''")
    line = text.groupBy("path", "page_no", "page_width", "page_height", "block_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "t"))), lambda x: x["t"]), " ").alias("line"), F.max("size").alias("size"), F.count("*").alias("n"), F.count_if(F.col("flags").bitwiseAND(16) != 0).alias("bold"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    block = line.groupBy("path", "page_no", "page_width", "page_height", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"), F.count("*").cast("int").alias("line_count"), F.max("size").alias("max_size"), (F.sum("bold") / F.sum("n")).alias("bold_ratio"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    number = F.row_number().over(Window.partitionBy("path", "page_no").orderBy("block_no"))
    return block.withColumn("block_ord", number).select("path", "page_no", "page_width", "page_height", "block_ord", F.concat(F.lit("b_"), F.col("page_no").cast("string"), F.lit("_"), F.col("block_ord").cast("string")).alias("block_id"), "text", "line_count", "max_size", "bold_ratio", F.struct("x0", "y0", "x1", "y1").alias("bbox"))


def ingest_summary(files: DataFrame, spans: DataFrame) -> DataFrame:
    """path, status, error, page_count for each file."""
    per = spans.groupBy("path").agg(F.max("_error").alias("error"), F.countDistinct("page_no").alias("page_count"))
    return files.select("path").join(per, "path", "left").select("path", F.when(F.col("error").isNotNull(), "failed").otherwise("success").alias("status"), F.when(F.col("error").isNotNull(), "ingestion_error").alias("error"), F.coalesce("page_count", F.lit(0)).alias("page_count"))


def read_chunk_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of JSON artifacts (one document a file); missing keys get defaults, evidence types stay."""
    docs = spark.read.schema(CHUNK_JSON).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    c = docs.select(F.col("doc_id").alias("d"), "title", "source_file", F.posexplode("chunks").alias("pos", "c"))
    return c.select("c.chunk_id", F.coalesce("c.doc_id", "d").alias("doc_id"), (F.col("pos") + 1).alias("chunk_no"), F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.page_no", F.lit(0)).alias("page_no"), F.coalesce("c.chunk_type", F.lit("paragraph")).alias("chunk_type"), F.coalesce("c.section_path", F.array().cast("array<string>")).alias("section_path"), "c.metadata", F.coalesce("c.evidence_type", F.col("c.metadata")["evidence_type"]).alias("evidence_type"), "title", "source_file")


def write_chunk_artifacts(chunks: DataFrame, path: str) -> None:
    """One JSON object a document: doc_id, title, source_file, chunk_count, chunks in order; read_chunk_artifacts reads all of it back."""
    has = set(chunks.columns)
    own = lambda c, kind: F.col(c).cast(kind).alias(c) if c in has else F.lit(None).cast(kind).alias(c)
    item = F.struct("chunk_no", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("doc_id"), "text", "page_no", "chunk_type", "section_path", own("metadata", "map<string,string>"), own("evidence_type", "string"))
    docs = chunks.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.min(own("title", "string")).alias("title"), F.min(own("source_file", "string")).alias("source_file"), F.count("*").alias("chunk_count"), F.collect_list(item).alias("chunks"))
    in_order = F.array_sort("chunks", lambda x, y: F.coalesce(F.when(x["chunk_no"] < y["chunk_no"], -1).when(x["chunk_no"] > y["chunk_no"], 1), F.lit(0)))
    docs.withColumn("chunks", in_order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_parsed(blocks: DataFrame, path: str) -> None:
    """Parsed documents, one JSON object each: doc_id, block_count, and blocks in page order."""
    item = F.struct("page_no", "block_ord", *[c for c in blocks.columns if c not in ("doc_id", "page_no", "block_ord")])
    docs = blocks.select("doc_id", item.alias("b")).groupBy("doc_id").agg(F.count("*").alias("block_count"), F.collect_list("b").alias("blocks"))
    key = lambda b: b["page_no"] * F.lit(1 << 20).cast("long") + b["block_ord"]
    docs.withColumn("blocks", F.array_sort("blocks", lambda x, y: F.coalesce(F.signum(key(x) - key(y)).cast("int"), F.lit(0)))).write.mode("overwrite").json(path)


def read_tables(files: DataFrame, reader) -> DataFrame:
    """Raw tables of files, through a finder: a function of (path, bytes) that yields (page_no, page_width, page_height, table_idx, x0, y0, x1, y1, rows).

    A file that the finder can't read has no tables; the job goes on."""
    schema = "path string, page_no int, page_width double, page_height double, table_idx int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"

    def run(batches):
        import pandas as pd

        names = ["path", "page_no", "page_width", "page_height", "table_idx", "x0", "y0", "x1", "y1", "rows"]
        for batch in batches:
            found = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found += [(path, *t) for t in reader(path, bytes(content))]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(found, columns=names)

    raw = files.select("path", "content").mapInPandas(run, schema)
    return raw.withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


TABLES = ("chunks", "postings", "terms", "stats", "model", "weights", "manifest")


def write_index(chunks: DataFrame, path: str, backend: str = "tfidf") -> None:
    """The persisted index: chunks, posting lists, document frequencies, corpus statistics, the TF-IDF model and the chunks' sparse vectors, manifest (last)."""
    from corvane.operators.indexing import corpus_stats, posting_lists, term_stats, tfidf_model, tfidf_vectors

    spark = chunks.sparkSession

    def kept(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    own = kept("chunks", chunks)
    posted = kept("postings", posting_lists(own))
    kept("terms", term_stats(posted))
    kept("stats", corpus_stats(posted))
    texts = own.select(F.col("chunk_id").alias("key"), "text")
    model = kept("model", tfidf_model(texts))
    kept("weights", tfidf_vectors(texts, model.toArrow()))
    kept("manifest", own.agg(F.count("*").alias("chunk_count"), F.lit(backend).alias("backend")))


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from corvane.sources.workspace import exists

    if not exists(spark, f"{path}/manifest"):
        raise FileNotFoundError(f"Missing manifest: {path}/manifest")
    return {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}


def load_or_build(spark: SparkSession, path: str, chunks: DataFrame) -> dict[str, DataFrame]:
    try:
        return read_index(spark, path)
    except FileNotFoundError:
        write_index(chunks, path)
        return read_index(spark, path)


@dataclass(frozen=True)
class Settings:
    """Flat configuration; the environment wins over a .env file, which wins over the defaults."""

    data_dir: str = "data"
    index_dir: str = "data/index"
    target_size: int = 800
    overlap: int = 100
    min_chunk_size: int = 120
    fusion_mode: str = "rrf"
    rrf_k: int = 60
    bm25_weight: float = 1.0
    vector_weight: float = 1.0
    reranker: str = "noop"
    prompt_family: str = "auto"
    model_name: str = ""
    rerank_top_n: int = 20
    rerank_batch: int = 8
    top_k: int = 6
    max_steps: int = 8
    max_retry: int = 2

    @classmethod
    def load(cls, env_file: str | None = None, prefix: str = "CORVANE_") -> Settings:
        said: dict[str, str] = {}
        if env_file and os.path.exists(env_file):
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    said[name.strip()] = value.strip().strip("\"'")
        said |= {k: v for k, v in os.environ.items() if k.startswith(prefix)}
        base = Path(env_file).resolve().parent if env_file else Path.cwd()
        out = {}
        for f in fields(cls):
            if (raw := said.get(prefix + f.name.upper())) is not None:
                value = {"int": int, "float": float}.get(str(f.type), str)(raw)
                out[f.name] = str(base / value) if f.name.endswith("_dir") and not os.path.isabs(str(value)) else value
        return cls(**out)
