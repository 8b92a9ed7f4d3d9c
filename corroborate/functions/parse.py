"""Column functions that take fields out of running text, table cells and model answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = "array<struct<start:bigint,hit:string,window:string>>"


def text_windows(pattern: str, before: int = 60, after: int = 30):
    """A function of a text column: one window per match, in order.

    A window starts ``before`` characters ahead of its match, or where the match before it
    ends if that is later, and ends ``after`` characters behind it.  Null: no windows."""
    compiled = re.compile(pattern)

    def cut(text: str | None) -> list[dict]:
        found, last = [], 0
        for m in compiled.finditer(text or ""):
            found.append({"start": m.start() + 1, "hit": m.group(), "window": text[max(last, m.start() - before) : m.end() + after]})
            last = m.end()
        return found

    @F.pandas_udf(WINDOW)
    def windows(texts: pd.Series) -> pd.Series:
        return texts.map(cut)

    return windows


def json_rows(answer: Column, schema: str) -> Column:
    """The widest ``[ ... ]`` of a model's answer, read as an array of ``schema``; null if there is none or it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.lit("")), f"array<{schema}>")


def json_object(answer: Column, schema: str) -> Column:
    """The widest ``{ ... }`` of a model's answer."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")), schema)


def vision_answer(answer: Column) -> Column:
    """struct(damage_type, facility, confidence) of a model's answer about a picture, null without an object in it; a confidence that is no number is 0."""
    read = json_object(answer, "damageType string, facility string, confidence double")
    sure = F.when(F.isnan(read["confidence"]), 0.0).otherwise(F.coalesce(read["confidence"], F.lit(0.0)))
    return F.when(answer.rlike(r"(?s)\{.*\}"), F.struct(read["damageType"].alias("damage_type"), read["facility"].alias("facility"), sure.alias("confidence")))


def keyword_hits(cells: Column, keywords: list[str]) -> Column:
    """How many cells contain one of the keywords."""
    hit = lambda c: F.coalesce(F.greatest(*[F.contains(c, F.lit(k)).cast("int") for k in keywords], F.lit(0)), F.lit(0))
    return F.aggregate(cells, F.lit(0), lambda n, c: n + hit(c))


def synonym(c: Column, groups: dict[str, list[str]]) -> Column:
    """The head of the group that lists the value, else the value."""
    return F.coalesce(*[F.when(c.isin(words), F.lit(head)) for head, words in groups.items()], c)


def composite_key(*parts: Column) -> Column:
    """Parts joined by ``||``; a null part is empty, so that places do not shift."""
    return F.concat_ws("||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def rule_label(c: Column, rules: list[tuple[list[str], str]], other: str) -> Column:
    """Label of the first rule one of whose keywords the text contains."""
    hits = [F.when(F.coalesce(F.greatest(*[F.contains(c, F.lit(k)) for k in words], F.lit(False)), F.lit(False)), F.lit(label)) for words, label in rules]
    return F.coalesce(*hits, F.lit(other))


def data_url(c: Column) -> Column:
    """struct(media_type, data) of a base64 data URL; null where it is none."""
    pattern = r"(?s)^data:([^;,]+);base64,(.*)$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("media_type"), F.unbase64(F.regexp_extract(c, pattern, 2)).alias("data")))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey values of three arrays of channel values."""
    weighted = F.zip_with(red, green, lambda r, g: 0.299 * r + 0.587 * g)
    return F.zip_with(weighted, blue, lambda x, b: x + 0.114 * b)


def page_prompt(page: Column, text: Column) -> Column:
    """A page's text under a line with its number."""
    return F.concat(F.lit("--- 페이지 "), page.cast("string"), F.lit(" ---\n"), F.coalesce(text, F.lit("")))


def header_field(cell: Column, keywords: dict[str, str]) -> Column:
    """The field of the longest keyword that a header cell contains; null if none."""
    longest = sorted(keywords, key=lambda k: (-len(k), k))
    return F.coalesce(*[F.when(F.contains(cell, F.lit(k)), F.lit(keywords[k])) for k in longest])
