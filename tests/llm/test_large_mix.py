"""Totals of words beyond half of what an int holds."""

from corvane.llm import mixing


def test_totals_that_an_int_holds_but_not_their_double(spark):
    total = 1_500_000_000  # under 2**31, over 2**30
    rows = [(s, size // 64, shard) for s, size in (("a", total // 3), ("b", total // 3), ("c", total // 3)) for shard in range(64)]
    got = mixing.quotas(spark.createDataFrame(rows, "s string, size long, h long"), 64, sum(r[1] for r in rows), (1, 2, 3), 3, 1).collect()
    words = {s: sum(r["words"] for r in got if r["s"] == s) for s in "abc"}
    targets = {r["s"]: r["target"] for r in got}
    assert len(got) == 192 and all(abs(words[s] - targets[s]) <= 64 for s in "abc") and abs(sum(words.values()) - total) < 200
