"""Operators 1, 2, 3, 5 and 10 against the library, hand-written pages and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from corvane.llm import bpe, html, quality, secrets, sketch

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "\n\n", "x" * 20000, "É́ ́a\x1cb \x1c c\xa0d e f\x85g", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ ﬁ K ſ", "it's we'll 'S don't'd 12 3a", "a\x0bb\x0cc\x1d", "日本語 テスト。", "straße Größe,", "👍🏽 é " + "ab " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t int, score string, fp string"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, "s", "f") for i, t in zip(ids, texts)], SCHEMA)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_library(spark, name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(name))
    shared = " ".join(random.Random(1).choice(["alpha", "Beta,", "gamma.", "délta"]) for _ in range(400))
    texts = [*ODD, shared, "own start " + shared + " own end", shared]
    got = bpe.encode_documents(docs(spark, texts), public_tokenizers.path(name), average_chunk=64).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)
    digest = bpe.encode_documents(docs(spark, texts), public_tokenizers.path(name), digest=True).collect()
    by = {r["doc_id"]: r for r in got}
    for r in digest:
        assert r["ids_sha256"] == hashlib.sha256(np.array(by[r["doc_id"]]["ids"], dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by[r["doc_id"]]["decoded"].encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, []), public_tokenizers.path(name)).count() == 0


def test_bpe_chunks_are_content_defined_and_reused():
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdef ghij") for _ in range(5000))
    a, b = bpe.cut_points(["something in front " + shared, "other " + shared])
    tail = lambda cuts, n: {c - n for c in cuts if c - n > 200}
    assert tail(a, 19) & tail(b, 6) and len(tail(a, 19) ^ tail(b, 6)) <= 2
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.encode("something in front " + shared, a)
    assert codec.encode("other " + shared, b)[2] > 0
    small = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"), memo_pieces=10, store_chars=100)
    assert small.encode(shared, bpe.cut_points([shared])[0])[0] == codec.encode(shared, bpe.cut_points([shared])[0])[0]


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href=/>Site</a> slogan of the site</header><nav><ul><li><a href=1>Home</a><li><a href=2>More</a></ul></nav>
<div class="cookie-notice">We use cookies and so on, and the rest of it is long enough to look like a real paragraph of text.</div>
<article><h1>The &amp; title</h1><p>First   paragraph<br>of the text,&nbsp;with <b>bold</b> words.<p>Short.</p>
<form><label>Mail</label><input name=q></form><div class="ad banner">Buy now</div>
<p>Last one &lt;here&gt; &copy 1 < 2.</p><aside>Side</aside></article>
<section id="comments"><p>A reader says that this is the best of all the articles that are on the site, and it was for him.</p></section>
<footer>Copyright</footer></body></html>"""


def test_html_rules():
    assert html.extract(PAGE) == "The & title\nFirst paragraph of the text, with bold words.\nShort.\nLast one <here> © 1 < 2."
    long = "This is the text of a page that has no article element, and it is long enough to be good by the words in it alone."
    plain = f"<div><p>{long}</p><p>It is so.</p><p>{long}</p></div><div><a href=1>one</a> <a href=2>two</a></div><p>x</p>"
    assert html.extract(plain) == f"{long}\nIt is so.\n{long}"
    assert html.extract("") == html.extract(None) == html.extract("<nav>a</nav>") == ""
    assert html.extract("<article><p>cut off &am") == "cut off &am"


def test_html_rows(spark):
    rows = [(1, "u", PAGE, 1), (None, None, None, None), (3, "v", "<p", 2), (3, "v", "<p", 2)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def base(text):
    out = []
    for kind, pattern, part, n in (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        out += [(m.start(), i, f"{kind}:{m.start()}:{m.end()}") for i, m in ((("assign", "access", "hex").index(kind), m) for m in re.finditer(pattern, text)) if len(m[part]) >= n]
    return ",".join(x for *_, x in sorted(out))


def test_secrets_base_and_links(spark):
    rng = random.Random(5)
    bits = ["token=", "secret: '", "API_KEY\" = ", "apikey:", "passwd=", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4, "0123456789abcdef" * 3, "short", "abcdefghij", " ", "\n", "\n\n", "ſecret=abcdefghij", "toKen=abcdefghi", "é", "user=bob ", "https://db.example.org:5432/x", "aB3" * 13 + "Q", "postgres://h/db "]
    texts = [None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)]]
    got = {r["doc_id"]: r for r in secrets.scan_documents(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["base_written"] == base(t or "")
        assert set(filter(None, got[i]["base_written"].split(","))) <= set(got[i]["spans_written"].split(","))
        assert got[i]["n_assign"] + got[i]["n_access"] + got[i]["n_hex"] == len(got[i]["base"])
    assert secrets.scan("see https://example.org/a and so on")[1] == []
    linked = secrets.scan("user=bob\npassword=hunter2hunter2\nhttps://db.example.org/x")
    assert [s[2] for s in linked[1]] == ["ident", "assign", "endpoint"] and len(linked[2]) == 1
    assert secrets.scan("user=bob\n\npassword=hunter2hunter2")[2] == []  # another scope


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4)))
    good = lambda: ". ".join(" ".join([word().title(), *[word() for _ in range(9)]]) for _ in range(8)) + "."
    bad = lambda: " ".join(word() + "###" for _ in range(80)) if rng.random() < 0.5 else " ".join([word().upper() + "!!" for _ in range(80)])
    truth = [int(rng.random() < 0.75) for _ in range(600)]
    texts = [good() if y else bad() for y in truth]
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(truth) if i % 2], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs(spark, [*texts, None, ""], [*range(600), None, None]), labels, most_positive=200, most_unlabelled=300).collect()
    assert len(rows) == 602
    hit = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["doc_id"] is not None and r["held_out"]]
    assert len(hit) > 60 and sum(hit) / len(hit) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    none = quality.score_documents(docs(spark, ["a b"]), labels.where("false")).collect()
    assert none[0]["predicted"] == 1


def shingles(text, k=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_sketch_estimates_and_merges():
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    sa, sb = sketch.sketch(a), sketch.sketch(b)
    x, y = shingles(a), shingles(b)
    assert abs(sketch.resemblance(sa, sb) - len(x & y) / len(x | y)) < 0.13
    assert abs(sketch.containment(sa, sb) - len(x & y) / len(x)) < 0.2
    assert abs(sketch.distinct_count(sa) / len(x) - 1) < 0.3
    parts = sketch.merge(sketch.sketch(" ".join(words[:2000])), sketch.sketch(" ".join(words[1996:3000])))
    assert np.array_equal(parts, sa)
    assert np.array_equal(sketch.read(sketch.written(sa)), sa)
    repeated = sketch.sketch("a b c d e f " * 500)
    assert len(repeated) == 6 and sketch.distinct_count(repeated) == 6
    assert sketch.resemblance(sketch.sketch(""), sketch.sketch("")) == 1 and sketch.resemblance(sketch.sketch(""), sa) == 0


@pytest.mark.parametrize("each", [1, 3, 1000])
def test_sketch_next_document(spark, each):
    rng = random.Random(11)
    texts = [None, "", "a b", *[" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(40)]]
    ids = rng.sample(range(-50, 1000), len(texts))
    got = {r["doc_id"]: r for r in sketch.compare_with_next(docs(spark, texts, ids), rows_per_range=each).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    assert len(got) == len(texts)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        x, y, z = shingles(t), shingles(edited), shingles(nxt)
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        assert got[i]["near_edited"] == pytest.approx(like(x, y)) and got[i]["near_next"] == pytest.approx(like(x, z))
    assert sketch.compare_with_next(docs(spark, [])).count() == 0
    one = sketch.compare_with_next(docs(spark, ["a b c"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert sketch.compare_with_next(docs(spark, ["a", "b", "b", None], [5, 5, None, None])).count() == 4
