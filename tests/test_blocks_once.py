"""Sections and cleaning read blocks once; strip() looks at ends alone; results as by plain means."""

import random
import re

from corvane.functions import blocks as B
from corvane.functions import text as T
from corvane.functions.grams import SPACES
from corvane.operators import cleaning, sections
from corvane.plans import documents
from pyspark.sql import functions as F

BLOCK = "doc_id string, page_no int, block_ord int, type string, text string, page_profile string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_by_a_plain_stack(spark):
    rng, rows = random.Random(5), []
    for d in ("a", "b", "c", None):
        for i in range(60):
            kind, text = rng.choice([("heading", f"{rng.choice(['1', '2.1', '3.4.5', '1.1.1.1'])} Part {i}"), ("heading", "Overview of it"), ("heading", "abc"), ("heading", "Source: x"), ("paragraph", "1 text")])
            rows.append((d, 1 + i // 20, i, kind, text, rng.choice([None, None, None, "label_dense"])))
    rng.shuffle(rows)
    got = {(r["doc_id"], r["block_ord"]): r["section_path"] for r in sections.section_paths(spark.createDataFrame(rows, BLOCK).repartition(3)).collect()}
    want, path = {}, {}
    for d, p, i, kind, text, profile in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        own = path.setdefault(d, ["Document"])
        number = re.match(r"(\d+(?:\.\d+)*)", text)
        if d and kind == "heading" and profile != "label_dense" and "Source" not in text and text != "abc":
            path[d] = own = own[: (number[1].count(".") + 1 if number else 1) - 1] + [text]
        want[d, i] = own
    assert got == want and len({tuple(p) for p in want.values()}) > 20


def test_blocks_are_made_once_for_sections(spark):
    """A join with the headings made all blocks twice, from the texts on."""
    blocks = spark.createDataFrame([("a", 1, 1, "heading", "1 Part", None)], BLOCK)
    assert "Join" not in plan(sections.section_paths(blocks))
    own = blocks.withColumn("section_path", F.array(F.lit("Own")))
    assert [r["section_path"] for r in sections.section_paths(own).collect()] == [["Own"]]
    assert [r["section_path"] for r in sections.section_paths(own.withColumn("section_path", F.slice("section_path", 1, 0))).collect()] == [["1 Part"]]


def test_noise_of_a_document_goes_from_it_alone(spark):
    page = lambda i: f"Confidential  note\nText number {i} of this page, a whole sentence.\n" + "\n" * 18
    docs = spark.createDataFrame([("a", "".join(map(page, range(3)))), ("b", page(7)), (None, "".join(map(page, range(2))))], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["text"]) for r in cleaning.clean(documents.text_blocks(docs)).collect())
    assert [t for d, t in got if d == "a"] == [f"Text number {i} of this page, a whole sentence." for i in range(3)]
    assert "Confidential note" in [t for d, t in got if d == "b"] and [t for d, t in got if not d].count("Confidential note") == 2
    noise = cleaning.repeated_noise(documents.text_blocks(docs))
    assert sorted((r["doc_id"] or "", r["noise"]) for r in noise.collect()) == [("", "Confidential note"), ("a", "Confidential note")]


def test_strip_and_sentence_ends_by_regular_expressions(spark):
    """As the expressions that they stand for, which went through the whole text."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(SPACES + "\x1c​᠎ab.。;é𝒳") for _ in range(n)) for n in range(1, 8) for _ in range(60)] + ["", None, *SPACES, SPACES]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    old = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    pairs = [(T.strip(c), old), (B.terminal(c), old.rlike("[.!?;:。！？；：]$")), (B.source_note(c), T.squeeze(c).rlike(B.SOURCE)), (F.array_join(T.tokens(c), " "), F.array_join(F.regexp_extract_all(T.normalized(c), F.lit("[a-z0-9][a-z0-9._/-]*"), F.lit(0)), " "))]
    assert df.select(*[F.count_if(~a.eqNullSafe(b)) for a, b in pairs]).first() == (0,) * len(pairs)
    assert "RegExpReplace" not in T.strip(c)._jc.toString() and "regexp_replace" not in plan(df.select(T.strip(c)))
