"""Column functions for free-text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every space that counts as white space in a field.
WHITE = " \t\n\x0b\f\r" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
NUMBER = r"\d+(?:\.\d+)?"


def norm(c: Column) -> Column:
    """Null to empty, all white space gone."""
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), WHITE, "")


def normalize_location(c: Column) -> Column:
    """Stationing such as ``STA. 165.0 m`` or ``K165`` in one form; blank: null."""
    x = F.regexp_replace(norm(c), r"(?i)^STA\.?", "")
    x = F.regexp_replace(x, r"(?i)^K(?=\d)", "")
    x = F.regexp_replace(x, r"^(.*?\d)\.0(?=(?:km|m|㎡|㎥))", "$1")
    return F.nullif(F.regexp_replace(x, rf"^({NUMBER}(?:~{NUMBER})?)$", "$1m"), F.lit(""))


def parse_range(c: Column) -> Column:
    """struct(start, end, unit) of a location ``a~b unit``; null where it is no such range."""
    x, pattern = normalize_location(c), rf"^({NUMBER})~({NUMBER})(m|km|㎡|㎥)$"
    start, end = (F.regexp_extract(x, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), F.regexp_extract(x, pattern, 3).alias("unit")))


def within_range(point: Column, span: Column) -> Column:
    """Whether a location lies in a range of the same unit, both ends counted; a single place is no range."""
    x, s, pattern = normalize_location(point), parse_range(span), rf"^({NUMBER})(m|km|㎡|㎥)$"
    at = F.regexp_extract(x, pattern, 1).try_cast("double")
    inside = (F.regexp_extract(x, pattern, 2) == s["unit"]) & (at >= s["start"]) & (at <= s["end"])
    return F.coalesce(inside, F.lit(False))


def split_list(c: Column) -> Column:
    """``165, 187, 188m`` to its parts, each with the trailing unit unless it has letters of its own."""
    unit = F.regexp_extract(F.trim(c), r"(km|m|㎡|㎥)$", 1)
    body = F.regexp_replace(F.trim(c), r"(km|m|㎡|㎥)$", "")
    parts = F.filter(F.transform(F.split(body, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.when(p.rlike("[A-Za-z㎡㎥]"), p).otherwise(F.concat(p, unit)))


def first_keyword(c: Column, keywords: list[str]) -> Column:
    """The first keyword, in the list's order, that the text contains."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(k)), F.lit(k)) for k in keywords])


def first_pattern(c: Column, patterns: list[str]) -> Column:
    """The whole match of the first pattern that matches."""
    return F.coalesce(*[F.regexp_substr(c, F.lit(p)) for p in patterns])


def tri_state(c: Column, yes: list[str], no: list[str]) -> Column:
    """'true' on a keyword of ``yes``, else 'false' on one of ``no``, else 'unknown'."""
    return F.when(first_keyword(c, yes).isNotNull(), F.lit("true")).when(first_keyword(c, no).isNotNull(), F.lit("false")).otherwise(F.lit("unknown"))


def classify_source(name: Column, content: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """struct(type, confidence) by the first rule (keyword, type) that name or content hits."""
    out = F.struct(F.lit(other).alias("type"), F.lit(0.2).alias("confidence"))
    for keyword, kind in reversed(rules):
        by_name, by_content = (F.coalesce(F.contains(x, F.lit(keyword)), F.lit(False)) for x in (name, content))
        sure = F.when(by_name & by_content, 0.9).when(by_name, 0.7).otherwise(0.55)
        out = F.when(by_name | by_content, F.struct(F.lit(kind).alias("type"), sure.alias("confidence"))).otherwise(out)
    return out


def file_type(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def embedded_number(c: Column) -> Column:
    """First number in a text; none: null, which sorts last."""
    return F.regexp_substr(c, F.lit(NUMBER)).try_cast("double")


def percent_text(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f%%", x * 100))


def safe_file_name(name: Column, kind: str, extension: str, as_of: Column) -> Column:
    base = F.coalesce(F.nullif(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|]', "")), F.lit("")), F.lit("report"))
    return F.concat(base, F.lit(f"_{kind}_"), F.date_format(as_of, "yyyyMMdd"), F.lit(f".{extension}"))


def source_label(pages: Column) -> Column:
    """``p.1, p.2``; null when there are none."""
    return F.nullif(F.array_join(F.transform(pages, lambda p: F.concat(F.lit("p."), p.cast("string"))), ", "), F.lit(""))
