"""The registry, and each query that SQL can express against DuckDB on the smallest tables."""

import math
import os

import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
NAMES = ("x1_tokens", "x5_query_signature", "x8_chunk_profile", "c1_c6_block_labels", "c7_c8_clean_text", "c10_repeated_noise", "i2_bm25", "i5_vector_search", "q4_rrf_fusion", "q5_weighted_fusion", "w1_routes", "m2_m3_summaries", "a3_page_alerts", "a5_document_alerts")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "lineitem"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())
