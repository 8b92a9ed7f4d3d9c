"""Summaries over measured runs on hand-made rows: blanks, nulls, ties, no runs, no cases; the validation workbook."""

from pyspark.sql import functions as F

from corroborate.functions import parse as P
from corroborate.operators import report as R
from corroborate.operators import rollups as U
from corroborate.operators import truth as G
from corroborate.sources import sheets

CASE = "case_id int, report_name string, facility_type string, vendor_type string, report_format string, difficulty string, locked boolean, status string"
RUN = "case_id int, overall_f1 double, location_accuracy double, photo_f1 double, link_f1 double, status string"
KEPT = "field string, value double, sample long, sufficient boolean"


def case(id_, facility="사면", vendor="A", form="f", difficulty="easy", locked=True):
    return (id_, f"r{id_}", facility, vendor, form, difficulty, locked, "done")


def test_groups_by_vendor_then_format(spark):
    cases = spark.createDataFrame([case(1), case(2, None, ""), case(3, "", None, None), case(4, vendor="B", difficulty=None)], CASE)
    runs = spark.createDataFrame([(1, 1.0, None, 1.0, 0.5, "GOOD"), (2, 0.5, 1.0, None, None, "FAIL"), (3, 0.25, 0.5, 0.0, 1.0, "FAIL"), (9, 1.0, 1.0, 1.0, 1.0, "GOOD")], RUN)
    got = {(r["grouping"], r["key"]): tuple(r)[2:] for r in U.grouped_metrics(cases, runs).collect()}
    assert got == {
        ("format", "A"): (1, 1.0, 0.0, 0.5), ("format", "f"): (1, 0.5, 1.0, 0.0), ("format", "미분류"): (1, 0.25, 0.5, 1.0),
        ("facility", "사면"): (1, 1.0, 0.0, 0.5), ("facility", None): (1, 0.5, 1.0, 0.0), ("facility", ""): (1, 0.25, 0.5, 1.0), ("difficulty", "easy"): (3, 1.75 / 3, 0.5, 0.5),
    }
    assert tuple(U.overall_summary(cases, runs).first()) == (4, 3, 1, 0, 2, 1.75 / 3, 0.5, 1 / 3, 0.5)
    assert tuple(U.overall_summary(cases, runs.limit(0)).first()) == (4, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(U.overall_summary(cases.limit(0), runs).first())[:2] == (0, 0) and U.grouped_metrics(cases.limit(0), runs).count() == 0


def test_what_universality_lacks(spark):
    ran = lambda ids: spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0, "GOOD") for i in ids], RUN)
    of = lambda rows, ids: U.universality(spark.createDataFrame(rows, CASE), ran(ids)).first()
    mixed = [case(k, ("사면", None)[k % 2], ("A", "")[k % 2], "f") for k in range(10)]
    assert tuple(of(mixed, range(10))) == (10, 2, 2, 0, [], True)
    # a format that no one names is none, a facility that no one names is one
    assert of([case(k, vendor="", form=None) for k in range(10)], range(10))["reasons"] == ["formats", "facilities"]
    # an unsettled truth does not matter once every case has run
    assert of([*mixed, case(10, locked=None)], range(11))["ok"]
    assert of([*mixed, case(10, locked=False)], range(10))["reasons"] == ["unlocked"]
    assert of([], [])["reasons"] == ["pairs", "formats", "facilities"]


def test_most_edited_fields_first(spark):
    rows = [("quantity", 0.5, 8, True), ("section", 0.5, 8, True), ("location", 0.8, 10, True), ("part", 0.125, 8, True), ("sub_part", 0.0, 4, False), ("other", 0.75, 8, True), ("repair_method", None, 0, False)]
    got = sorted((r["place"], r["field"], r["label"], r["modified_rate"], r["message"]) for r in U.improvement_candidates(spark.createDataFrame(rows, KEPT)).collect())
    assert [(p, f) for p, f, *_ in got] == [(1, "part"), (2, "section"), (3, "quantity"), (4, "other")] and got[0][3] == 0.875 and got[3][2] == "other"
    assert got[0][4] == '"부위" 항목이 검토 대상 중 88%에서 수정됨 (표본 8건) — 관련 프롬프트/규칙 검토 권장.'


def test_the_workbook_is_written_and_read_back(spark, tmp_path):
    one = "struct<tp:bigint,fp:bigint,fn:bigint,precision:double,recall:double,f1:double>"
    run = f"case_id int, detection {one}, photo_extraction {one}, photo_link {one}, fields map<string,double>, matched bigint, conflict bigint, candidate bigint, accuracy double, overall_f1 double, status string, processing_ms int, input_tokens long, output_tokens long, total_tokens long, estimated_cost string"
    numbers = (1, 1, 0, 0.5, 1.0, 2 / 3)
    cases = spark.createDataFrame([case(1, vendor=""), case(2, locked=None)], CASE)
    runs = U.of_bundles(spark.createDataFrame([(k, numbers, numbers, numbers, {"location": 0.25}, 1, 0, 2, None, 2 / 3, "FAIL", None, 5, None, None, "N/A") for k in (1, 7)], run))
    fields = spark.createDataFrame([(1, "location", 1, 4, 0.25), (1, "part", 0, 0, 0.0), (7, "part", 0, 1, 0.0)], "case_id int, field string, matched long, total long, match_rate double")
    errors = spark.createDataFrame([(1, "ERR-0001", "s", None, "c", "x", None, None, "p.1", None), (7, "ERR-0001", "s", None, "c", "x", None, None, None, None)], "case_id int, error_id string, step string, field string, category string, truth_value string, found_value string, truth_source string, found_source string, damage_id string")
    revisions = spark.createDataFrame([(1, "t", "n")], "case_id int, at string, note string")
    book = U.validation_workbook(cases, runs, fields, errors, revisions)
    written = dict(zip(book, sheets.write_sheets(book, str(tmp_path / "book"))))
    read = {n: sorted(tuple(r) for r in spark.read.option("header", True).csv(p).collect()) for n, p in written.items()}
    assert len(read) == 15 and ("위치 정확도", "25.0%") in read["Summary"] and ("총 테스트", "2") in read["Summary"]
    assert read["Test Cases"] == [("1", "r1", "사면", "f", "easy", "확정", "done", "66.7%", "FAIL"), ("2", "r2", "사면", "A", "easy", "미작성", "done", "N/A", "N/A")]
    assert read["Field Metrics"] == [("1", "location", "1", "4", "25.0%"), ("1", "part", "0", "0", "N/A")] and read["Cross Validation"] == [("1", "1", "0", "2", "N/A (GT 기대값 미지정)")]
    assert read["Error Analysis"] == [("1", "s", "-", "c", "x", "-", "-", "p.1")] and read["Error Summary"] == [("c", "1")] and read["Processing Time"] == [("1", "미제공")]
    assert read["Token-Cost"] == [("1", "5", "미제공", "미제공", "N/A")] and read["양식별"] == [("f", "1", "66.7%", "25.0%")] and len(read["Provider Comparison"]) == 1
    empty = U.validation_workbook(cases.limit(0), runs.limit(0), fields.limit(0), errors.limit(0), revisions.limit(0))
    assert {n: s.count() for n, s in empty.items() if s.count()} == {"Summary": 9, "Provider Comparison": 1}
    assert G.errors_by_category(errors.limit(0)).count() == 0


def test_answers_about_pictures(spark):
    answers = ['x {"damageType": "균열", "confidence": 0.5} y', '{"confidence": "0.9", "facility": "f"}', '{"confidence": "NaN"}', '{"confidence": null}', "none", "{broken", "{broken}", None, ""]
    rows = spark.createDataFrame(list(enumerate(answers)), "k int, a string").select("k", P.vision_answer(F.col("a")).alias("v")).orderBy("k").collect()
    assert [r["v"] and tuple(r["v"]) for r in rows] == [("균열", None, 0.5), (None, "f", 0.0), (None, None, 0.0), (None, None, 0.0), None, None, (None, None, 0.0), None, None]


def test_export_log_goes_on(spark):
    log = spark.createDataFrame([(1, "EXP-001", "a", "success"), (1, "EXP-1200", "b", "failed"), (2, None, "c", "success")], "report_id int, export_id string, file string, status string")
    new = spark.createDataFrame([(1, 2, "d", None), (1, 1, "e", "x"), (2, 1, "f", ""), (3, 1, "g", None)], "report_id int, at int, file string, error string")
    got = {r["file"]: (r["export_id"], r["status"]) for r in R.append_exports(log, new).collect()}
    assert got == {"a": ("EXP-001", "success"), "b": ("EXP-1200", "failed"), "c": (None, "success"), "e": ("EXP-1201", "failed"), "d": ("EXP-1202", "success"), "f": ("EXP-001", "success"), "g": ("EXP-001", "success")}
    assert R.append_exports(log.limit(0), new.limit(0)).count() == 0
