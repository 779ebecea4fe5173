"""Document identity, collection, source type and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import contains_any

SOURCE_TYPES = (
    ("research_report", ("report", "research", "研报", "证券")),
    ("company_announcement", ("announcement", "公告", "通告")),
    ("presentation", ("deck", "presentation", "演示", "路演")),
    ("manual", ("manual", "手册", "指南")),
)


def doc_id(name: Column, digest: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha1(F.concat_ws(":", name, digest)), 1, 12))


def collection(path: Column) -> Column:
    """The first folder of a relative path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("default")


def source_type(folders: Column, title: Column) -> Column:
    text = F.lower(F.concat_ws(" ", folders, title))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, markers in SOURCE_TYPES:
        out = out.when(contains_any(text, markers), name)
    return out.otherwise("pdf_corpus")


def is_finance(text: Column) -> Column:
    return contains_any(F.lower(text), ("analyst", "ticker"))


class Profile:
    """A domain's hooks; the generic one takes every document and changes nothing."""

    name = "generic"

    def detect(self, text: Column) -> Column:
        return F.lit(True)

    def expand_query(self, query: Column) -> Column:
        return query


class FinanceProfile(Profile):
    name = "finance"

    def detect(self, text: Column) -> Column:
        return is_finance(text)
