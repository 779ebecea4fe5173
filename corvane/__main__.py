"""python -m corvane search|answer|audit|index: the plans from a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from corvane.operators import audit, presenting
from corvane.plans import search
from corvane.sources import files


def main(args: list[str] | None = None) -> list[str]:
    """Prints, and returns, what a command has to show."""
    p = argparse.ArgumentParser(prog="corvane")
    p.add_argument("command", choices=("index", "search", "answer", "audit"))
    p.add_argument("path", help="of chunk artifacts (index, audit) or of an index (search, answer)")
    p.add_argument("--out", help="where index writes")
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--tables-only", action="store_true")
    p.add_argument("--env", help="a file of settings")
    o = p.parse_args(args)
    spark, s = SparkSession.builder.getOrCreate(), files.Settings.load(o.env)
    if o.command == "index":
        files.write_index(files.read_chunk_artifacts(spark, o.path), o.out or s.index_dir)
        shown = [f"indexed {r['chunk_count']} chunks ({r['backend']})" for r in files.read_index(spark, o.out or s.index_dir)["manifest"].collect()]
    elif o.command == "audit":
        chunks = files.read_chunk_artifacts(spark, o.path)
        # what an audit reports: at most one line a document with a reason
        shown = [f"{r['doc_id']} ratio={r['chunk_page_ratio']} reasons={','.join(r['reasons'])}" for r in audit.in_order(audit.document_alerts(chunks)).collect()]
    else:
        asked = spark.createDataFrame(list(enumerate(o.query)), "query_id long, query string")
        ranked = search.indexed_search(asked, files.read_index(spark, o.path), **search.configured(s), chunk_types={"table"} if o.tables_only else None)
        if o.command == "search":
            pages = presenting.result_pages(asked, ranked, tables_only=o.tables_only)
        else:
            a = search.answer(asked, ranked)
            pages = presenting.answer_pages(a["answers"].join(asked, "query_id"), a["citations"])
        shown = [r["page"] for r in pages.orderBy("query_id").collect()]  # one page a question
    print("\n\n".join(shown))
    return shown


if __name__ == "__main__":
    main()
    if (active := SparkSession.getActiveSession()) is not None:
        active.stop()
