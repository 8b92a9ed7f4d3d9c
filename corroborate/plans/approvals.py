"""Queries of approvals in turn, with SQL that walks through them one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.operators import approvals as A

from . import frames as T
from .registry import query

_K = "o_orderkey"
_CANDIDATES = {
    "report_id": "o_custkey", "candidate_id": f"'C' || CAST({_K} AS STRING)", "turn": f"{_K} * 7919 % 100003", "section": T._case(f"{_K} * 3", "1구간", "1 구간", None), "damage_name": T._case(f"{_K} * 7", "균열", "누수", None),
    "part": T._case(f"{_K} * 5", "사면", None, "배수시설", "기타"), "sub_part": T._case(f"{_K} * 11", "도수로", None, "-", ""), "location": T._case(f"{_K} * 13", "100m", "STA.100.0m", "", None), "repair_method": T._REPAIR(f"{_K} * 17"),
    "quantity": T._case(f"{_K} * 19", "3m", None), "source_type": T._case(_K, "map", "table"), "file": f"'f' || CAST({_K} % 3 AS STRING)", "page": T._case(f"{_K} * 2", "=1", "=2", "=NULL", "=0"), "quote": f"'q' || CAST({_K} AS STRING)",
}
_RECORDS = {
    "report_id": "o_custkey", "ordinal": _K, "id": f"'R' || CAST({_K} AS STRING)", "section": "'1구간'", "damage_name": T._case(_K, "균열", "누수"), "part": T._case(f"{_K} * 3", "사면", "기타"), "sub_part": T._case(f"{_K} * 5", "도수로", "-", ""),
    "location": T._case(f"{_K} * 3", "100m", ""), "repair_method": "''", "quantity": "CAST(NULL AS STRING)", "group_no": "'G'", "group_index": "1", "status": "'review'", "notes": "CAST(NULL AS STRING)",
}


def _tables(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    show = lambda exprs, kept: t("orders").where(kept).selectExpr(*[f"{e} AS {n}" for n, e in exprs.items()])
    ref = F.struct(F.lit(1).alias("page"), F.lit("table").alias("type"), F.col("id").alias("excerpt"))
    records = show(_RECORDS, f"{_K} % 9 = 0").withColumns({"pages": F.array(F.lit(1)), "refs": F.array(ref)})
    candidates = show(_CANDIDATES, f"{_K} % 9 > 0")
    return records, candidates.drop("turn"), candidates.where("turn % 5 > 0").select("report_id", "candidate_id", "turn")


_AS_KEY = lambda sub: f"{T.nrm('section')} || '|' || {T.nrm('damage_name')} || '|' || {T.nrm(sub)} || '|' || coalesce({T.loc('location')}, '')"
_WALK = f"""cd AS (SELECT *, {_AS_KEY('sub_part')} AS look, {_AS_KEY("coalesce(sub_part, '-')")} AS stand FROM ({T.select(_CANDIDATES)} WHERE {_K} % 9 > 0)),
ap AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY turn) AS k FROM cd WHERE turn % 5 > 0),
rc AS (SELECT *, {_AS_KEY('sub_part')} AS stand FROM ({T.select(_RECORDS)} WHERE {_K} % 9 = 0)),
st AS (SELECT a.report_id, 0::BIGINT AS k, coalesce(b.recs, []) AS recs, NULL::VARCHAR AS candidate_id, NULL::VARCHAR AS target FROM (SELECT DISTINCT report_id FROM ap) a LEFT JOIN (SELECT report_id, list({{'key': stand, 'part': part, 'id': id}} ORDER BY ordinal) AS recs FROM rc GROUP BY 1) b USING (report_id)
  UNION ALL SELECT s.report_id, a.k, CASE WHEN h.hit IS NULL THEN list_append(s.recs, {{'key': a.stand, 'part': coalesce(a.part, '기타'), 'id': a.candidate_id}}) ELSE s.recs END, a.candidate_id, h.hit
  FROM st s JOIN ap a ON a.report_id = s.report_id AND a.k = s.k + 1, LATERAL (SELECT list_filter(s.recs, lambda r: r.key = a.look AND (a.part IS NULL OR r.part = a.part))[1].id AS hit) h)"""


@query(f"WITH RECURSIVE {_WALK} SELECT candidate_id, target, CASE WHEN target IS NULL THEN 'new' ELSE 'duplicate' END AS outcome FROM st WHERE k > 0")
def approvals_in_turn(t) -> DataFrame:
    return A.outcomes(*_tables(t)).select("candidate_id", "target", "outcome")


@query(f"""WITH RECURSIVE {_WALK}, more AS (SELECT st.report_id, target AS id, string_agg(coalesce(page, 0) || ':' || source_type || ':' || quote, ',' ORDER BY turn) AS refs FROM st JOIN ap USING (report_id, candidate_id) WHERE target IS NOT NULL GROUP BY ALL)
SELECT x.id, section, damage_name, part, sub_part, location, group_no, notes, concat_ws(',', own, refs) AS refs FROM (
  SELECT report_id, id, section, damage_name, part, sub_part, location, group_no, notes, '1:table:' || id AS own FROM rc
  UNION ALL SELECT ap.report_id, ap.candidate_id, coalesce(section, ''), coalesce(damage_name, ''), coalesce(part, '기타'), coalesce(sub_part, '-'), coalesce(location, ''), '-', '추가자료(' || file || ')에서 발견되어 사용자가 승인한 손상', coalesce(page, 0) || ':' || source_type || ':' || quote
  FROM st JOIN ap USING (report_id, candidate_id) WHERE target IS NULL) x LEFT JOIN more ON more.report_id = x.report_id AND more.id = x.id""")
def approved_records(t) -> DataFrame:
    refs = F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["page"].cast("string"), r["type"], r["excerpt"])), ",")
    return A.approve(*_tables(t))[0].select("id", "section", "damage_name", "part", "sub_part", "location", "group_no", "notes", refs.alias("refs"))


@query(f"SELECT candidate_id FROM ({T.select(_CANDIDATES)} WHERE {_K} % 9 > 0) WHERE turn % 5 = 0")
def candidates_left(t) -> DataFrame:
    return A.approve(*_tables(t))[1].select("candidate_id")
