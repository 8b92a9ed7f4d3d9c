"""Queries of summaries over measured runs, each with the SQL that checks it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.operators import evaluation as E
from corroborate.operators import rollups as U
from corroborate.operators import state as S
from corroborate.operators import truth as G

from . import frames as T
from . import truth as Q
from .registry import query

_C, _K = "c_custkey", "o_orderkey"
CASES = {
    "case_id": _C, "facility_type": T._case(f"{_C} * 3", "사면", "옹벽", "", None, "교량"), "vendor_type": T._case(f"{_C} * 5", "A사", "", None), "report_format": T._case(f"{_C} * 7", "양식1", "양식2", "", None),
    "difficulty": T._case(_C, "easy", "hard", "normal"), "locked": T._case(f"{_C} * 11", "=true", "=false", "=NULL"),
}
# shares of a power of two, so that sums of any order are the same
RUNS = {"case_id": "o_custkey", "run_number": f"{_K} % 97", "ordinal": _K, "f1": f"({_K} % 17) / 16.0", "location_accuracy": f"CASE WHEN {_K} % 5 > 0 THEN ({_K} % 9) / 8.0 END", "photo_f1": f"({_K} % 5) / 4.0", "link_f1": f"({_K} % 3) / 2.0"}


def _frames(t) -> tuple[DataFrame, DataFrame]:
    cases = t("customer").selectExpr(*[f"{e} AS {n}" for n, e in CASES.items()])
    runs = t("orders").selectExpr(*[f"CAST({e} AS {'DOUBLE' if n not in ('case_id', 'run_number', 'ordinal') else 'BIGINT'}) AS {n}" for n, e in RUNS.items()])
    latest = E.latest_runs(runs).withColumnRenamed("f1", "overall_f1")
    return cases, latest.withColumn("status", S.grade(F.col("overall_f1")))


_SQL = f"""c AS (SELECT *, coalesce(nullif(vendor_type, ''), nullif(report_format, '')) AS form FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in CASES.items())} FROM customer)),
r AS (SELECT * FROM ({T.select(RUNS)}) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY run_number DESC, ordinal) = 1),
p AS (SELECT c.*, r.f1, coalesce(r.location_accuracy, 0) AS loc, r.photo_f1, r.link_f1 FROM c JOIN r USING (case_id))"""
_MEANS = "count(*) AS test_count, avg(f1)::DOUBLE AS avg_f1, avg(loc)::DOUBLE AS avg_location, avg(link_f1)::DOUBLE AS avg_link_f1 FROM p GROUP BY 2"


@query(f"""WITH {_SQL} SELECT 'facility' AS "grouping", facility_type AS key, {_MEANS} UNION ALL SELECT 'format', coalesce(form, '미분류'), {_MEANS} UNION ALL SELECT 'difficulty', difficulty, {_MEANS}""")
def run_rollups(t) -> DataFrame:
    return U.grouped_metrics(*_frames(t))


@query(f"""WITH {_SQL} SELECT (SELECT count(*) FROM c) AS total, count(*) AS completed, count_if(f1 >= 0.9) AS good, count_if(f1 < 0.9 AND f1 >= 0.75) AS warning, count_if(f1 < 0.75) AS fail,
  coalesce(avg(f1), 0)::DOUBLE AS damage_f1, coalesce(avg(loc), 0)::DOUBLE AS location_accuracy, coalesce(avg(photo_f1), 0)::DOUBLE AS photo_f1, coalesce(avg(link_f1), 0)::DOUBLE AS link_f1 FROM p""")
def run_overall(t) -> DataFrame:
    return U.overall_summary(*_frames(t))


@query(f"""WITH {_SQL}, x AS (SELECT c_.case_id % 3 AS part, count(p.case_id) AS pairs, count(*) AS cases, count(DISTINCT p.form) AS formats, count(DISTINCT CASE WHEN p.case_id IS NOT NULL THEN coalesce(p.facility_type, '') END) AS facilities, count_if(c_.locked IS DISTINCT FROM true) AS unlocked
  FROM c c_ LEFT JOIN p ON p.case_id = c_.case_id GROUP BY 1)
SELECT part, pairs, formats, facilities, unlocked, concat_ws(',', CASE WHEN pairs < 10 THEN 'pairs' END, CASE WHEN formats < 2 THEN 'formats' END, CASE WHEN facilities < 2 THEN 'facilities' END, CASE WHEN unlocked > 0 AND pairs < cases THEN 'unlocked' END) AS reasons,
  pairs >= 10 AND formats >= 2 AND facilities >= 2 AND (unlocked = 0 OR pairs = cases) AS ok FROM x""")
def run_universality(t) -> DataFrame:
    cases, runs = _frames(t)
    parts = [U.universality(cases.where(F.col("case_id") % 3 == k), runs).select(F.lit(k).cast("bigint").alias("part"), "*") for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("reasons", F.array_join("reasons", ","))


_EDITS = {"report_id": "o_custkey % 7", "status": T._case(_K, "confirmed", "review", "excluded"), "e1": T._case(f"{_K} * 3", "location", None), "e2": T._case(f"{_K} * 5", "quantity", "section", None, "quantity"), "e3": T._case(f"{_K} * 7", None, "damage_name", None)}


@query(f"""WITH x AS (SELECT report_id, [e1, e2, e3] AS e FROM ({T.select(_EDITS)}) WHERE status <> 'review' OR coalesce(e1, e2, e3) IS NOT NULL),
f AS (SELECT report_id, unnest(['section', 'damage_name', 'part', 'sub_part', 'location', 'repair_method', 'quantity']) AS field, unnest(['구간', '손상명', '부위', '세부부위', '위치', '보수방안', '규모/물량']) AS label, unnest(range(7)) AS o, e FROM x),
g AS (SELECT report_id, field, label, o, count(*) AS sample_size, 1 - count_if(NOT coalesce(list_contains(e, field), false)) / count(*) AS modified_rate FROM f GROUP BY ALL)
SELECT report_id, field, label, modified_rate, sample_size, printf('"%s" 항목이 검토 대상 중 %d%%에서 수정됨 (표본 %d건) — 관련 프롬프트/규칙 검토 권장.', label, floor(modified_rate * 100 + 0.5)::BIGINT, sample_size) AS message, row_number() OVER (PARTITION BY report_id ORDER BY modified_rate DESC, o)::INT AS place
FROM g WHERE sample_size >= 5 AND 1 - modified_rate < 0.8""")
def retention_improvements(t) -> DataFrame:
    rows = t("orders").selectExpr(*[f"{e} AS {n}" for n, e in _EDITS.items()]).withColumns({"overrides": T._texts("e1", "e2", "e3"), "history": F.array().cast("array<string>")})
    return U.improvement_candidates(E.field_retention(rows, ["report_id"]), ["report_id"])


_ONE = "CASE WHEN {0} IS NULL THEN 'N/A' ELSE printf('%.1f%%', {0} * 100) END"


@query(f"""WITH {Q._TRUTH_SQL}, c AS (SELECT DISTINCT o_custkey % 40 AS case_id FROM orders), n AS (SELECT case_id, count_if(side = 'matched') AS tp, count_if(side = 'extra') AS fp, count_if(side = 'missed') AS fn FROM m GROUP BY 1),
v AS (SELECT case_id, tp, fp, fn, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c LEFT JOIN n USING (case_id)),
w AS (SELECT 'Test Cases' AS sheet, case_id, concat_ws('|', CASE case_id % 3 WHEN 0 THEN '확정' WHEN 1 THEN '작성중' ELSE '미작성' END, {_ONE.format('f1')}, CASE WHEN f1 >= 0.9 THEN 'GOOD' WHEN f1 >= 0.75 THEN 'WARNING' ELSE 'FAIL' END) AS line FROM v
UNION ALL SELECT 'Damage Metrics', case_id, concat_ws('|', tp, fp, fn, {_ONE.format('f1')}) FROM v
UNION ALL SELECT 'Processing Time', case_id, CASE WHEN case_id % 2 = 0 THEN '10' ELSE '미제공' END FROM v
UNION ALL SELECT 'Field Metrics', case_id, concat_ws('|', 'part', a, b, CASE WHEN b > 0 THEN printf('%.1f%%', a / b * 100) ELSE 'N/A' END) FROM (SELECT o_custkey % 40 AS case_id, count_if(o_orderkey % 4 = 0) AS a, count_if(o_orderkey % 4 < 2) AS b FROM orders GROUP BY 1)
UNION ALL SELECT 'Error Summary', NULL, {T._case('k', 'LOST', 'NAME', 'PLACE')} || '|' || count(*) FROM (SELECT o_orderkey % 3 AS k FROM orders WHERE o_orderkey % 7 = 0) GROUP BY k
UNION ALL SELECT '난이도별', NULL, concat_ws('|', difficulty, count(*), printf('%.1f%%', avg(f1) * 100)) FROM (SELECT *, CASE case_id % 2 WHEN 0 THEN 'easy' ELSE 'hard' END AS difficulty FROM v) GROUP BY difficulty)
SELECT * FROM w""")
def validation_workbook_sheets(t) -> DataFrame:
    truth, found, truth_photos, found_photos = Q._tables(t)
    k = F.col("case_id")
    cases = t("orders").select((F.col("o_custkey") % 40).alias("case_id")).distinct()
    named = cases.select("case_id", F.lit("r").alias("report_name"), F.lit("사면").alias("facility_type"), F.lit("A").alias("vendor_type"), F.lit("").alias("report_format"), F.when(k % 2 == 0, "easy").otherwise("hard").alias("difficulty"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("locked"), F.lit("done").alias("status"))
    # one row a case, which every sheet reads
    bundles = U.of_bundles(G.validation_bundle(cases, truth, found, truth_photos, found_photos)).persist()
    runs = bundles.select("*", F.when(k % 2 == 0, 10).alias("processing_ms"), *[F.lit(None).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")], F.lit("N/A").alias("estimated_cost"))
    shown = {"step": "'step'", "field": "CASE WHEN o_orderkey % 2 = 0 THEN 'part' END", "category": T._case("o_orderkey", "LOST", "NAME", "PLACE"), "truth_value": "o_orderstatus", "found_value": "CAST(NULL AS STRING)", "truth_source": "'p.1'", "found_source": "CAST(NULL AS STRING)"}
    errors = t("orders").where("o_orderkey % 7 = 0").selectExpr("o_custkey % 40 AS case_id", *[f"{e} AS {n}" for n, e in shown.items()])
    fields = t("orders").groupBy((F.col("o_custkey") % 40).alias("case_id")).agg(F.count_if(F.col("o_orderkey") % 4 == 0).alias("matched"), F.count_if(F.col("o_orderkey") % 4 < 2).alias("total")).select("*", F.lit("part").alias("field"), F.try_divide("matched", "total").alias("match_rate"))
    revisions = cases.select("case_id", F.lit("t").alias("at"), F.lit("n").alias("note"))
    sheets = U.validation_workbook(named, runs, fields, errors, revisions)
    lines = {"Test Cases": ["Ground Truth", "종합 F1", "결과"], "Damage Metrics": ["TP", "FP", "FN", "F1"], "Processing Time": ["처리시간(ms)"], "Field Metrics": ["필드", "일치", "전체", "정확도"], "Error Summary": ["유형", "건수"], "난이도별": ["구분", "테스트수", "F1"]}
    out = [sheets[n].select(F.lit(n).alias("sheet"), (F.col("ID") if "ID" in sheets[n].columns else F.lit(None)).cast("bigint").alias("case_id"), F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in columns]).alias("line")) for n, columns in lines.items()]
    return functools.reduce(DataFrame.unionByName, out)
