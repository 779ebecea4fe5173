"""Tables of odd rows by plain means; cells are looked at few times."""

import html
import random
import re

from corvane.operators import tables
from pyspark.sql import functions as F

RAW = "doc_id int, page_no int, page_width double, page_height double, table_idx int, bbox struct<x0:double,y0:double,x1:double,y1:double>, rows array<array<string>>"


def plainly(rows):
    cells = [[re.sub(r"\s+", " ", c or "").strip(" ") for c in r] for r in rows]
    cells = [r for r in cells if any(r)]
    used = [i for i in range(max(map(len, cells), default=0)) if any(i < len(r) and r[i] for r in cells)]
    cells = [[r[i] if i < len(r) else "" for i in used] for r in cells]
    full = [[c for c in r if c] for r in cells]
    name = full[0][0] if len(full[0]) == 1 and full[0][0].startswith("Table") else None
    if name:
        cells, full = cells[1:], full[1:]
    heads = 0
    for r in full[:3]:
        digits = sum(bool(re.search(r"\d", c)) for c in r)
        if r and (digits >= max(1, len(r) // 2) or (digits >= 1 and len(r) >= 3)):
            break
        heads += bool(r)
    lines = [("表头: " if i < max(1, heads) else "数据: ") + " | ".join(r) for i, r in enumerate(full) if r]
    body = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in r) + "</tr>" for r in cells)
    return "\n".join([f"表格标题: {name}"] * bool(name) + lines), "<table>" + (f"<caption>{html.escape(name)}</caption>" if name else "") + body + "</table>"


def test_odd_rows(spark):
    rng, rows = random.Random(8), []
    for i in range(400):
        made = [[rng.choice([None, "", " ", "a  b", "x<y", 'q"&\'', "12", "1 of 3", "name", "\tlong cell here"]) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(2, 4))]
        if i % 5 == 0:
            made.insert(0, ["Table <1>", "", None])
        made.insert(1, ["wide", "enough", "to stay", "7", "z"])  # no box of contacts
        rows.append((i, 1, 600.0, 800.0, 0, (10.0, 10.0, 500.0, 90.0), made))
    got = {r["doc_id"]: (r["text"], r["table_html"]) for r in tables.table_blocks(spark.createDataFrame(rows, RAW)).collect()}
    assert got == {r[0]: plainly(r[6]) for r in rows}
    assert any("<td></td>" in h for _, h in got.values()) and any("<caption>" in h for _, h in got.values())


def test_filled_cells_are_looked_for_once(spark):
    """The text alone had nine filters."""
    made = tables.as_text(F.col("rows"), F.col("title"))._jc.toString()
    assert made.count("filter(") <= 5
