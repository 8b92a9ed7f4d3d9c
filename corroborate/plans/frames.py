"""Inspection-like tables over the driver's tables, as one list of expressions that Spark and the checking SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _case(k: str, *values: str | None) -> str:
    """One of the values by the remainder of k; a value that starts with = is an expression."""
    shown = ["NULL" if v is None else v[1:] if v.startswith("=") else f"'{v}'" for v in values]
    return f"CASE ({k}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


_K = "o_orderkey"
_NAME = lambda k: _case(k, "균열", " 누수", "누수", "", "파손", "균열")
_SUB = lambda k: _case(k, "도수로", "소단측구", "-", "도수 로", "도수로")
_PLACE = lambda k: _case(k, "100m", "STA.100.0m", "50~150m", "120 m", "", "K100", "100m")
_REPAIR = lambda k: _case(k, "표면처리", "", "표면 처리", "그라우팅")
_TEXT = f"CAST({_K} AS STRING)"

RECORDS = {
    "report_id": "o_custkey", "id": f"CASE WHEN {_K} % 13 = 0 THEN 'NEW-' ELSE 'R' END || {_TEXT}", "n": _K,
    "group_no": f"CASE WHEN {_K} % 3 = 0 THEN ' G' ELSE 'G ' END || CAST({_K} % 4 AS STRING)", "group_index": f"CAST({_K} % 5 AS INT)",
    "section": _case(f"{_K} * 3", "1구간", "1 구간", "2구간", ""), "damage_name": _NAME(f"{_K} * 7"), "part": _case(_K, "사면", "배수시설"), "sub_part": _SUB(f"{_K} * 11"),
    "location": _PLACE(f"{_K} * 13"), "repair_method": _REPAIR(f"{_K} * 17"), "quantity": _case(f"{_K} * 19", "3m", None, "", "3 m", "5m"),
    "quantity_group": _case(f"{_K} * 23", "그룹 합계 9m에 포함", None, None, None, "3m"),
    "status": f"CASE WHEN {_K} % 11 = 0 THEN 'conflict' WHEN o_orderstatus = 'F' THEN 'confirmed' WHEN o_orderstatus = 'P' THEN 'excluded' ELSE 'review' END",
    "no_photo": f"{_K} % 29 = 0", "p1": f"CAST({_K} % 7 AS INT)", "p2": f"CAST({_K} % 5 + 7 AS INT)", "notes": _case(f"{_K} * 5", None, "", "a", "b"),
    "o1": _case(f"{_K} * 3", None, "location", "section"), "at": "o_orderdate",
}
PHOTOS = {
    "report_id": "o_custkey", "photo_id": f"'P' || {_TEXT}", "photo_no": f"CASE {_K} % 4 WHEN 0 THEN 'R' || {_TEXT} WHEN 1 THEN 'G' || CAST({_K} % 4 AS STRING) WHEN 2 THEN '' END",
    "page": f"CAST({_K} % 9 AS INT)", "damage_name": _NAME(f"{_K} * 7 + {_K} % 2"), "caption": _case(f"{_K} * 5", None, "사진 균열 도수로", "누수", "파손 소단측구"),
    "part": _case(_K, "사면", "배수시설", "사면", None), "sub_part": _SUB(f"{_K} * 11 + {_K} % 3"), "location": _PLACE(f"{_K} * 13 + {_K} % 2"), "section": _case(f"{_K} * 3", "1구간", "1구간", None, "2구간"),
    "ocr_text": _case(f"{_K} * 29", None, "위치 100m", "도수로 옆"), "nearby_text": _case(f"{_K} * 31", None, "소단측구 부근", "없음"), "vision_type": _case(f"{_K} * 37", None, "균열 의심", ""),
    "manual": f"{_K} % 17 = 0", "match_status": f"CASE WHEN {_K} % 17 = 0 THEN 'confirmed' END", "confidence": "CAST(NULL AS DOUBLE)", "l1": f"CASE WHEN {_K} % 17 = 0 THEN 'R' || {_TEXT} END",
    "extraction_status": _case(_K, "failed", "ok", "ok", "ok", None), "related": _case(f"{_K} * 5", "false", "true", None, "unknown"), "match_source": _case(f"{_K} * 7", "auto", "manual", None),
    "status": _case(f"{_K} * 3", "failed", "review", None, "confirmed"), "c1": f"CASE WHEN {_K} % 17 = 0 THEN 'NEW-' || {_TEXT} END", "c_score": f"CASE WHEN {_K} % 3 = 0 THEN 10 ELSE 80 END", "c_conflict": f"{_K} % 2 = 0",
}
EVIDENCE = {
    "report_id": "o_custkey", "document_no": f"CAST({_K} % 3 AS INT)", "seq": _K, "source_type": _case(f"{_K} * 3", "map", "table"), "section": _case(f"{_K} * 3", "1구간", "1 구간", "2구간", None),
    "damage_name": _NAME(f"{_K} * 7 + {_K} % 2"), "part": _case(_K, "사면", "배수시설", None), "sub_part": _SUB(f"{_K} * 11 + {_K} % 2"), "location": _PLACE(f"{_K} * 13 + {_K} % 3"),
    "repair_method": _REPAIR(f"{_K} * 17 + {_K} % 2"), "quantity": _case(f"{_K} * 19", "3m", None, "5m", "", "7m"), "photo_no": f"CASE {_K} % 5 WHEN 0 THEN 'R' || {_TEXT} WHEN 1 THEN 'G1' WHEN 2 THEN 'X' || {_TEXT} END",
}


def select(exprs: dict[str, str]) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in exprs.items()) + " FROM orders"


def _texts(*columns: str):
    """The given ones of the columns as an array."""
    return F.array_compact(F.array(*columns))


def records(t) -> DataFrame:
    out = t("orders").selectExpr(*[f"{e} AS {n}" for n, e in RECORDS.items()])
    ref = F.struct(F.col("p1").alias("page"), F.lit("table").alias("type"), F.col("damage_name").alias("excerpt"))
    return out.withColumns({"pages": F.array("p1", "p2"), "refs": F.array(ref), "locked": _texts("o1"), "overrides": _texts("o1"), "history": F.array().cast("array<string>")})


def photos(t) -> DataFrame:
    before = F.struct(F.col("c1").alias("id"), F.col("c_score").alias("score"), F.col("c_conflict").alias("conflict"))
    rows = t("orders").selectExpr(*[f"{e} AS {n}" for n, e in PHOTOS.items()])
    return rows.withColumns({"linked": _texts("l1"), "candidates": F.array_compact(F.array(F.when(F.col("c1").isNotNull(), before)))})


def evidence(t) -> DataFrame:
    return t("orders").selectExpr(*[f"{e} AS {n}" for n, e in EVIDENCE.items()])


# the checking SQL's own words for the rules

def nrm(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '\s', '', 'g')"


def loc(x: str) -> str:
    y = rf"regexp_replace(regexp_replace(regexp_replace({nrm(x)}, '(?i)^STA\.?', ''), '(?i)^K(\d)', '\1'), '(\d)\.0(m|km)', '\1\2')"
    return rf"nullif(CASE WHEN regexp_full_match({y}, '\d+(\.\d+)?(~\d+(\.\d+)?)?') THEN {y} || 'm' ELSE {y} END, '')"


def within(point: str, span: str) -> str:
    """Of two normal locations."""
    number = lambda x, k: rf"try_cast(regexp_extract({x}, '^(\d+(?:\.\d+)?)(?:~(\d+(?:\.\d+)?))?(m|km)$', {k}) AS DOUBLE)"
    unit = lambda x: f"regexp_extract({x}, '(m|km)$', 1)"
    return f"coalesce(NOT contains({point}, '~') AND contains({span}, '~') AND {unit(point)} = {unit(span)} AND {number(point, 1)} BETWEEN {number(span, 1)} AND {number(span, 2)}, false)"


def same(a: str, b: str) -> str:
    return f"(coalesce({a}, '') <> '' AND {nrm(a)} = {nrm(b)})"


def given(a: str) -> str:
    return f"(coalesce({a}, '') <> '')"


def numbered(number: str) -> str:
    return f"({given(number)} AND {nrm(number)} IN ({nrm('r.id')}, {nrm('r.group_no')}))"


def names(which: dict[str, str]) -> str:
    """A text of the names whose condition holds."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in which.items()) + ")"


R_SQL = f"r AS (SELECT *, {loc('location')} AS nl FROM ({select(RECORDS)}))"
P_SQL = f"p AS (SELECT *, {loc('location')} AS nl FROM ({select(PHOTOS)}))"
E_SQL = f"e AS (SELECT *, {loc('location')} AS nl FROM ({select(EVIDENCE)}))"
