"""Predicates and labels of single blocks, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import contains_any, ends_sentence, let, lines, squeeze, starts_any, strip

BULLETS = ("*", "-", "•", "◆", "◼", "➢")
_CJK_NUMBER = "[一二三四五六七八九十百千]+"
#: With a separator behind the number; and, for cleaned text, without.
HEADING_STRICT = rf"(?U)^(?:\d{{1,2}}(?:\.\d+){{0,3}}(?:[)、．.]|\s+)|[CILVX]+(?:[).]|\s+)|{_CJK_NUMBER}(?:[)、．.]|\s+))\s*[^\n]+"
HEADING_LOOSE = rf"(?U)^(?:\d{{1,2}}(?:\.\d+){{0,3}}|[CILVX]+[).]?|{_CJK_NUMBER}[)、．.]?)\s*[^\n]+"
PERIOD = r"(?U)^(?:20\d{2}(?:[-/年]\d{1,2}(?:[-/月]\d{1,2}日?)?)?|\d{4}[ehmq]\d{1,2}|\d{4}年?\d{0,2}月?\d{0,2}日?)$"
SOURCE = r"(?iU)^(?:\d{1,4}\s+)?(?:source|数据来源|资料来源)"
DISCLAIMERS = r"(?iU)\b(?:disclaimer|disclosures?|important notice|legal statement)\b|信息披露|免责说明|法律声明|重要声明"


def structured_strict(c: Column) -> Column:
    return c.rlike(HEADING_STRICT)


def structured(c: Column) -> Column:
    return strip(c).rlike(HEADING_LOOSE)


def period_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "").rlike(PERIOD)


def page_or_source(c: Column) -> Column:
    t = F.lower(strip(c))
    return contains_any(t, ("source:", "数据来源", "资料来源")) | t.rlike(r"(?U)^\d{1,4}$")


def mostly_numeric(c: Column) -> Column:
    solid = F.regexp_replace(c, r"(?U)\s+", "")
    return (F.length(solid) > 0) & (F.length(F.regexp_replace(solid, r"(?U)[^\d%+,./E-]", "")) / F.length(solid) >= 0.45)


def source_note(c: Column) -> Column:
    return strip(c).rlike(SOURCE)


def terminal(c: Column) -> Column:
    return ends_sentence(strip(c))


def block_type(text: Column, line_count: Column, size: Column, bold: Column) -> Column:
    t = strip(text)
    large = (line_count <= 2) & F.length(t).between(4, 36) & ~ends_sentence(t) & (size >= 14) & (bold >= 0.6)
    return F.when(structured_strict(t) & (line_count <= 3), "heading").when(starts_any(t, BULLETS), "list_item").when(large & ~period_label(t) & ~page_or_source(t) & ~mostly_numeric(t), "heading").otherwise("paragraph")


def parser_role(text: Column, kind: Column) -> Column:
    t = F.lower(strip(text))
    heading = F.when(starts_any(t, ("figure", "图")), "figure_caption").when(starts_any(t, ("table", "表")), "table_caption").otherwise("heading")
    return F.when(kind == "heading", heading).when(kind.isin("list_item", "table"), kind).otherwise("narrative_paragraph")


def axis_label(text: Column, width: Column, page_width: Column) -> Column:
    t = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return (F.length(t) <= 18) & (width <= page_width * 0.28) & t.rlike(r"(?U)^(?:[-+]?\d+(?:\.\d+)?%?|\d{4}[-/]\d{1,2}|[\d.+% -]+)$")


def cleaned_role(text: Column, kind: Column, label_dense: Column) -> Column:
    t = strip(text)
    label = label_dense & ((F.length(t) <= 24) | axis_label(t, F.lit(0.0), F.lit(1.0)))
    return F.when(source_note(t), "source_note").when(kind.isin("heading", "list_item", "table"), parser_role(t, kind)).when(label, "chart_label").otherwise("narrative_paragraph")


def role_confidence(kind: Column, label_dense: Column) -> Column:
    return F.when(kind == "table", 0.95).when((kind == "heading") & ~label_dense, 0.85).when(kind == "paragraph", 0.8).otherwise(0.7)


def cleaned_type(text: Column, kind: Column, label_dense: Column) -> Column:
    t = squeeze(text)
    weak = source_note(t) | (label_dense & (F.length(t) <= 40)) | (F.length(t) <= 4)
    return F.when((kind == "heading") & ~structured(text) & weak, "paragraph").otherwise(kind)


def demoted(text: Column, kind: Column) -> Column:
    """A long heading without a number is a paragraph."""
    return F.when((kind == "heading") & ~structured(text) & (F.length(strip(text)) > 20), "paragraph").otherwise(kind)


def zone(box: Column, page_height: Column) -> Column:
    h = F.greatest(page_height, F.lit(1.0))
    return F.when(box.isNull() | page_height.isNull() | (page_height == 0), F.lit(None).cast("string")).when(box["y0"] / h <= 0.12, "header").when(box["y1"] / h >= 0.88, "footer")


def visual_noise(text: Column, kind: Column, box: Column, page_width: Column, page_height: Column) -> Column:
    t, w, h = strip(text), box["x1"] - box["x0"], box["y1"] - box["y0"]
    pw = F.when(F.coalesce(page_width, F.lit(0.0)) == 0, 1.0).otherwise(page_width)
    has_w, has_h = F.coalesce(page_width, F.lit(0.0)) != 0, F.coalesce(page_height, F.lit(0.0)) != 0
    flat = F.replace(t, F.lit("\n"), F.lit(""))
    broken = t.contains("\n")
    legend = has_w & (box["x0"] / pw <= 0.35) & (w <= pw * 0.25) & (F.length(flat) <= 24) & broken & (kind == "paragraph")
    cover = (F.length(strip(flat)) >= 4) & ~((w > 25) & (h < 60)) & broken & (h > w * 3)
    strip_ = (kind == "table") & has_w & has_h & (w <= pw * 0.08) & (h >= page_height * 0.25)
    line = strip(F.replace(t, F.lit("\n"), F.lit(" ")))
    footer = has_h & (box["y0"] / page_height >= 0.82) & (line.rlike(r"(?U)\b\d+\s*/\s*\d+\b") | line.contains("请仔细阅读在本报告尾部的重要法律声明") | line.rlike(DISCLAIMERS))
    return box.isNotNull() & F.coalesce(axis_label(t, w, pw) | legend | cover | strip_ | footer, F.lit(False))


def inline_layout(text: Column, kind: Column) -> Column:
    """Joins a block's lines as its type asks; short-lined paragraphs keep them."""
    def joined(ls: Column) -> Column:
        one = F.array_join(ls, " ")
        short = F.size(F.filter(ls, lambda x: F.length(x) <= 10)) / F.size(ls)
        tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(one, r"(?U)\s+([!,.:;?！，。：；？])", "$1"), r"(?U)([‘“【（])\s+", "$1"), r"(?U)\s+([’”】）])", "$1")
        return F.when((F.size(ls) <= 1) | kind.isin("heading", "list_item"), one).when((short >= 0.7) & (F.size(ls) >= 4), F.array_join(ls, "\n")).otherwise(tidy)

    return let(text, lambda t: F.when(~t.contains("\n") | (kind == "table"), t).otherwise(let(lines(t), joined)))


def clean_text(text: Column, kind: Column) -> Column:
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    for sign in ("", ""):
        t = F.replace(t, F.lit(sign), F.lit("• "))
    t = F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n")
    return strip(inline_layout(t, kind))
