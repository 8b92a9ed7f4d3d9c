"""Measured runs over all cases: means by kind of case, the overall summary, whether enough kinds were tested, the workbook's sheets.

``cases`` is one row per case: case_id, report_name, facility_type, vendor_type, report_format, difficulty, locked (whether
its truth is settled, null without a truth) and status.  ``runs`` is at most one row per case, its latest: case_id,
overall_f1, location_accuracy, photo_f1, link_f1 and status (``of_bundles`` makes them of ``truth.validation_bundle``).
A run without a case takes no part; a case without a run counts as a case alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.operators import truth as G

#: The format of a case that names none, and labels of the tracked fields.
NO_FORMAT = "미분류"
FIELD_LABEL = {"section": "구간", "damage_name": "손상명", "part": "부위", "sub_part": "세부부위", "location": "위치", "repair_method": "보수방안", "quantity": "규모/물량"}
#: The workbook's sheets of means, by what they group.
GROUP_SHEETS = {"facility": "시설물별", "format": "양식별", "difficulty": "난이도별"}
ONE_PROVIDER = "이 배포에서는 단일 AI Provider만 사용하므로 Provider 간 비교 데이터가 없습니다."


def of_bundles(bundles: DataFrame) -> DataFrame:
    """Runs of the bundles' own columns and the four numbers the summaries use."""
    return bundles.select("*", F.col("fields")["location"].alias("location_accuracy"), F.col("photo_extraction.f1").alias("photo_f1"), F.col("photo_link.f1").alias("link_f1"))


def _format() -> Column:
    """The vendor, else the format; null where neither is given."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(given("vendor_type"), given("report_format"))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def grouped_metrics(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """grouping (facility, format, difficulty), key, test_count and the means of f1, location accuracy and link f1.

    A measure that a run lacks counts as 0; a group without a run has no row."""
    keys = F.array(*[F.struct(F.lit(n).alias("grouping"), k.alias("key")) for n, k in (("facility", F.col("facility_type")), ("format", F.coalesce(_format(), F.lit(NO_FORMAT))), ("difficulty", F.col("difficulty")))])
    pairs = runs.select("case_id", "overall_f1", "location_accuracy", "link_f1").join(cases.select("case_id", keys.alias("keys")), "case_id")
    means = [F.avg(_zero(c)).alias(n) for c, n in (("overall_f1", "avg_f1"), ("location_accuracy", "avg_location"), ("link_f1", "avg_link_f1"))]
    return pairs.select("*", F.explode("keys").alias("g")).groupBy("g.grouping", "g.key").agg(F.count("*").alias("test_count"), *means)


def _tested(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Every case with its run, ``_run`` where it has one."""
    measured = runs.select("case_id", "overall_f1", "location_accuracy", "photo_f1", "link_f1", F.col("status").alias("run_status"), F.lit(True).alias("_run"))
    return cases.join(measured, "case_id", "left")


def overall_summary(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: total, completed, good, warning, fail and four means over the completed, 0 where there are none."""
    graded = [F.count_if(F.col("run_status") == s.upper()).alias(s) for s in ("good", "warning", "fail")]
    means = {"damage_f1": "overall_f1", "location_accuracy": "location_accuracy", "photo_f1": "photo_f1", "link_f1": "link_f1"}
    return _tested(cases, runs).agg(F.count("*").alias("total"), F.count("_run").alias("completed"), *graded, *[F.coalesce(F.avg(F.when(F.col("_run"), _zero(c))), F.lit(0.0)).alias(n) for n, c in means.items()])


def universality(cases: DataFrame, runs: DataFrame, least_pairs: int = 10, least_kinds: int = 2) -> DataFrame:
    """One row: pairs, formats and facilities tested, unlocked cases, the reasons why they do not do, and ``ok``.

    Cases without a settled truth are a reason only while some case has no run."""
    run = F.col("_run")
    counts = {"pairs": F.count("_run"), "formats": F.count_distinct(F.when(run, _format())), "facilities": F.count_distinct(F.when(run, F.coalesce("facility_type", F.lit("")))),
              "unlocked": F.count_if(~F.coalesce("locked", F.lit(False))), "_total": F.count("*")}
    found = _tested(cases, runs).agg(*[c.alias(n) for n, c in counts.items()])
    short = {"pairs": F.col("pairs") < least_pairs, "formats": F.col("formats") < least_kinds, "facilities": F.col("facilities") < least_kinds, "unlocked": (F.col("unlocked") > 0) & (F.col("pairs") < F.col("_total"))}
    reasons = F.array_compact(F.array(*[F.when(c, n) for n, c in short.items()]))
    return found.select("pairs", "formats", "facilities", "unlocked", reasons.alias("reasons"), (F.size(reasons) == 0).alias("ok"))


def improvement_candidates(retention: DataFrame, by: list[str] | None = None, threshold: float = 0.2) -> DataFrame:
    """Fields edited in more than ``threshold`` of a sufficient sample: label, modified_rate, sample_size, message and their place by falling rate.

    ``retention`` is what ``evaluation.field_retention`` gives, so that a group has at most as many rows as there are
    fields; of equal rates the earlier field of ``FIELD_LABEL`` leads."""
    from corroborate.operators import report as R

    by = by or []
    labels = F.create_map(*[F.lit(x) for f, label in FIELD_LABEL.items() for x in (f, label)])
    rate, sample = 1 - F.col("value"), F.col("sample").cast("string")
    message = F.concat(F.lit('"'), "label", F.lit('" 항목이 검토 대상 중 '), F.floor(F.col("modified_rate") * 100 + 0.5).cast("string"), F.lit("%에서 수정됨 (표본 "), sample, F.lit("건) — 관련 프롬프트/규칙 검토 권장."))
    low = retention.where(F.col("sufficient") & (F.col("value") < 1 - threshold)).select(*by, "field", F.coalesce(labels[F.col("field")], F.col("field")).alias("label"), rate.alias("modified_rate"), F.col("sample").alias("sample_size"), "sample")
    tracked = F.array_position(F.array(*[F.lit(f) for f in FIELD_LABEL]), F.col("field"))
    made = low.withColumn("message", message).drop("sample").withColumn("_all", F.lit(0))
    return R.in_turn(made, [*by, "_all"], [F.desc("modified_rate"), tracked], "place").drop("_all")


def validation_workbook(cases: DataFrame, runs: DataFrame, fields: DataFrame, errors: DataFrame, revisions: DataFrame) -> dict[str, DataFrame]:
    """The validation workbook as named sheets for ``sources.sheets.write_sheets``.

    ``runs`` are bundles by ``of_bundles`` with processing_ms, input_tokens, output_tokens, total_tokens and
    estimated_cost; ``fields`` is ``truth.field_accuracy`` by case, ``errors`` is ``truth.error_entries``, ``revisions``
    has case_id, at and note.  Shares are percentages of one decimal; what was not measured says so."""
    percent = lambda c: T.percent_text(F.col(c))
    lacking = lambda c, x="미제공": F.coalesce(F.col(c).cast("string"), F.lit(x))
    id_ = F.col("case_id").alias("ID")
    total = overall_summary(cases, runs)
    shown = {"총 테스트": "total", "완료": "completed", "GOOD": "good", "WARNING": "warning", "FAIL": "fail", "전체 Damage F1": "damage_f1", "위치 정확도": "location_accuracy", "사진 추출 F1": "photo_f1", "사진 연결 F1": "link_f1"}
    items = [F.struct(F.lit(n).alias("항목"), (percent(c) if c.endswith(("f1", "accuracy")) else F.col(c).cast("string")).alias("값")) for n, c in shown.items()]
    tested = _tested(cases, runs)
    truth = F.when(F.col("locked"), "확정").when(~F.col("locked"), "작성중").otherwise("미작성")
    one = runs.join(cases.select("case_id"), "case_id", "left_semi")
    part = lambda kind, *names: [percent(f"{kind}.{n}") for n in names]
    extraction, links = part("photo_extraction", "precision", "recall"), part("photo_link", "precision", "recall", "f1")
    name = lambda columns, names: [c.alias(n) for c, n in zip(columns, names)]
    dealt = errors.join(one.select("case_id"), "case_id", "left_semi")
    known = {"Ground Truth": "truth_value", "AI": "found_value", "GT 출처": "truth_source", "AI 출처": "found_source"}
    groups = grouped_metrics(cases, runs)
    sheets = {
        "Summary": total.select(F.explode(F.array(*items)).alias("x")).select("x.*"),
        "Test Cases": tested.select(id_, F.col("report_name").alias("보고서명"), F.col("facility_type").alias("시설물"), _format().alias("회사/양식"), F.col("difficulty").alias("난이도"), truth.alias("Ground Truth"), F.col("status").alias("분석상태"), percent("overall_f1").alias("종합 F1"), lacking("run_status", "N/A").alias("결과")),
        "Damage Metrics": one.select(id_, *[F.col(f"detection.{n}").alias(n.upper()) for n in ("tp", "fp", "fn")], *name(part("detection", "precision", "recall", "f1"), ("Precision", "Recall", "F1"))),
        "Field Metrics": fields.join(one.select("case_id"), "case_id", "left_semi").select(id_, F.col("field").alias("필드"), F.col("matched").alias("일치"), F.col("total").alias("전체"), T.percent_text(F.when(F.col("total") > 0, F.col("match_rate"))).alias("정확도")),
        "Photo Metrics": one.select(id_, *name([*extraction, *links], ("사진추출 Precision", "사진추출 Recall", "사진연결 Precision", "사진연결 Recall", "사진연결 F1"))),
        "Cross Validation": one.select(id_, *[F.col(n).alias(n.capitalize()) for n in ("matched", "conflict", "candidate")], F.coalesce(F.when(F.col("accuracy").isNotNull(), percent("accuracy")), F.lit("N/A (GT 기대값 미지정)")).alias("정확도")),
        "Error Analysis": dealt.select(id_, F.col("step").alias("단계"), lacking("field", "-").alias("필드"), F.col("category").alias("유형"), *[lacking(c, "-").alias(n) for n, c in known.items()]),
        "Error Summary": G.errors_by_category(dealt).select(F.col("category").alias("유형"), F.col("n").alias("건수")).orderBy(F.desc("건수"), "유형"),
        "Provider Comparison": total.select(F.lit(ONE_PROVIDER).alias("안내")),
        "Processing Time": one.select(id_, lacking("processing_ms").alias("처리시간(ms)")),
        "Token-Cost": one.select(id_, *[lacking(c).alias(n) for n, c in (("입력토큰", "input_tokens"), ("출력토큰", "output_tokens"), ("총토큰", "total_tokens"))], F.col("estimated_cost").alias("추정비용")),
        "Ground Truth Changes": revisions.join(cases.select("case_id"), "case_id", "left_semi").select(id_, F.col("at").alias("시각"), F.col("note").alias("내용")),
    }
    for grouping, sheet in GROUP_SHEETS.items():
        sheets[sheet] = groups.where(F.col("grouping") == grouping).select(F.col("key").alias("구분"), F.col("test_count").alias("테스트수"), percent("avg_f1").alias("F1"), percent("avg_location").alias("위치정확도"))
    return sheets
