"""Scalar text functions as Columns. Lengths are code points; white space is Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.grams import SPACES

SPACE = r"(?U)\s+"
TERMINAL = ".!?;:。！？；："
STOP_TERMS = sorted("are does how is many much what which 一下 什么 哪些 多少 如何 怎么 怎样 情况 是否 请问 问题".split())
NAVIGATION = ("appendix index", "chart index", "contents", "figure index", "目录")
STRUCTURED = ("chart", "figure", "table", "trend", "图", "曲线", "表", "走势")


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def bind(df, **columns: Column):
    """``df`` with columns that filters and projections behind it can't copy into themselves: they come out of a
    generator of one row, so each is computed once."""
    gone = [c for c in df.columns if c not in columns]
    return df.select(*gone, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def squeeze(c: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    # looks at a text's ends alone; a regular expression goes through all of it
    return F.btrim(c, F.lit(SPACES))


def ends_sentence(stripped: Column) -> Column:
    """Whether a stripped text ends with a sentence mark."""
    return F.substring(stripped, -1, 1).isin(*TERMINAL)


def normalized(c: Column) -> Column:
    return squeeze(F.lower(c))


def signature(c: Column) -> Column:
    return F.sha1(normalized(c))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def contains_any(c: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return out


def starts_any(c: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.startswith(m)
    return out


def windows(s: Column, n: int) -> Column:
    """All substrings of length n, in order."""
    at = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(s, i, F.lit(n)))


def tokens(c: Column) -> Column:
    """Latin tokens first, then for each CJK run the run and its bigrams (a run of one is one token). White space is in none, so it needn't be made one kind."""
    t = F.lower(c)
    runs = found(t, "[一-鿿]+")
    cjk = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(F.array(r), windows(r, 2)))))
    return F.concat(found(t, "[a-z0-9][a-z0-9._/-]*"), cjk)


def cjk_terms(c: Column) -> Column:
    runs = found(c, "[一-鿿]{2,}")
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(windows(r, 2), windows(r, 3), F.array(r)))))


def query_signature(c: Column) -> Column:
    """struct<phrase, terms, time_terms, prefers>; both arrays are sorted and distinct."""
    t = normalized(c)
    terms = F.array_except(F.array_union(found(t, "[a-z0-9]{2,}"), cjk_terms(t)), F.array(*[F.lit(x) for x in STOP_TERMS]))
    times = F.array_distinct(found(t, r"20\d{2}(?:q[1-4]|h[12]|m\d{1,2}|年|q1-q3|1-3q)?"))
    return F.struct(F.when(F.length(t) >= 4, t).otherwise("").alias("phrase"), F.array_sort(terms).alias("terms"), F.array_sort(times).alias("time_terms"), contains_any(t, STRUCTURED).alias("prefers"))


def planner_times(c: Column) -> Column:
    """Upper-case time terms of a query, in order, repeats kept."""
    return F.transform(found(c, r"20\d{2}(?:[Qq][1-4]|[Hh][12]|[Mm]\d{1,2}|1-3[Qq])?"), F.upper)


def history_times(messages: Column) -> Column:
    """Distinct upper-case time terms of the last six messages (array of text), newest first."""
    last = F.reverse(F.slice(messages, F.greatest(F.size(messages) - 5, F.lit(1)), 6))
    return F.array_distinct(F.flatten(F.transform(last, lambda m: F.transform(found(m, r"20\d{2}(?:[Qq][1-4]|[Hh][12])?"), F.upper))))


def lines(c: Column) -> Column:
    """Stripped, non-empty lines."""
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), strip), lambda x: x != "")


def chunk_profile(text: Column, section: Column) -> Column:
    """struct of the counts and flags that ranking needs; does not depend on the query."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: let(lines(t), lambda ls: _profile(t, ls, section)))


def _profile(t: Column, ls: Column, section: Column) -> Column:
    head = normalized(F.concat_ws(" ", section, t))
    count = lambda f: F.size(F.filter(ls, f))
    digits = F.regexp_count(t, F.lit(r"(?U)\d"))
    short = count(lambda x: F.length(x) <= 20)
    dotted = count(lambda x: F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))) >= 5)
    numeric = count(lambda x: F.regexp_count(x, F.lit(r"(?U)\d")) >= 2)
    sentences = count(lambda x: x.rlike("[.:;。！？；]") | (F.length(x) >= 24))
    n = F.size(ls)
    navigational = contains_any(head, NAVIGATION) | ((dotted >= 1) & (short >= 2))
    sparse = (n > 0) & (((digits >= 12) & ((short >= 3) | ((n >= 3) & (short >= 2)))) | ((numeric >= 3) & (n >= 4)))
    narrative = (n > 0) & (sentences >= F.greatest(F.lit(1), F.floor(n / 2)))
    return F.struct(navigational.alias("navigational"), sparse.alias("sparse"), narrative.alias("narrative"), short.alias("short_lines"), digits.alias("digits"))


def normalize_query(c: Column) -> Column:
    out = squeeze(c)
    for wide, plain in (("（", "("), ("）", ")"), ("！", "!"), ("？", "?"), ("，", ", "), ("；", "; "), ("：", ": ")):
        out = F.replace(out, F.lit(wide), F.lit(plain))
    return squeeze(out)


def preview(c: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)
