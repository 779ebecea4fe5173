"""Many rows without id are many documents, spread over ranges; templates by a plain reading of the rules."""

import random
import re

from corvane.llm import lines, sketch

SCHEMA = "doc_id long, text string"


def test_sketches_of_rows_without_id(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 else i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 40)))) for i in range(90)] + [(None, "same text")] * 5
    data = spark.createDataFrame(rows, SCHEMA)
    whole, parts = (sorted(map(str, sketch.compare_with_next(data, rows_per_range=n).collect())) for n in (1000, 4))
    assert whole == parts and len(whole) == len(rows)


def plain(line):
    """The templates of a line, as tuples."""
    own = line.split()
    variable = lambda t: re.search(r"[0-9@]|://|^[0-9A-Fa-f]{8,}$", t, re.A)
    t = ["<*>" if variable(x) else x for x in own]
    rest = t[4:]
    if not own:
        return set()
    if set(t) == {"<*>"}:
        return {("own", *own)} if len(own) < 12 else {("own", *own)}
    if len(own) < 12:
        return {(len(own), *t)}
    m, out = len(rest), set()
    for i in range(3):
        keep = [x for j in range(3) for x in rest[m * j // 3 : m * (j + 1) // 3] if j != i]
        out.add(("own", *own) if set(t[:4] + keep) == {"<*>"} else (len(own), i, *t[:4], *keep))
    return out


def test_lines_by_plain_reading(spark):
    """On whole texts of the tables and on rows without id: what an earlier document has goes, nothing else does."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(5)
    shared = [" ".join(f"w{rng.choice('abcdefghij')}{rng.choice('xyz')}" for _ in range(n)) for n in (1, 3, 12, 60)]
    rows += [(10**6 + i, "\n".join(rng.sample([*shared, f"own {i}", "1 2 3", f"{i} {i}", "user 17 of host7"], 4))) for i in range(40)]
    rows += [(None, f"alone {'abc'[i]}\n{shared[3]}\n{shared[0]}") for i in range(3)] + [(None, None), (10**6, ""), (None, "alone a\n" + shared[3] + "\n" + shared[0])]
    got = sorted(((r["doc_id"], r["text"]) for r in lines.drop_lines(spark.createDataFrame(rows, SCHEMA), least=1).collect()), key=str)
    with_id = sorted({i for i, _ in rows if i is not None})
    owners = {}
    for i in with_id:
        for t in (t for j, t in rows if j == i and t):
            for line in t.split("\n"):
                for x in plain(line):
                    owners.setdefault(x, i)
    want = []
    for i, t in rows:
        if i is not None:
            want.append((i, "\n".join(x for x in t.split("\n") if all(owners[y] == i for y in plain(x))) if t else t))
    assert [x for x in got if x[0] is not None] == sorted(want, key=str)
    loose = [t for i, t in got if i is None]
    assert sorted(str(t).split("\n")[0] for t in loose) == ["None", "alone a", "alone a", "alone b", "alone c"]
    assert all(shared[3] not in t and shared[0] not in t for t in loose if t)
