"""Inspection operators and document sources on small cases: nulls, blanks, ties, repeats, empty tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corroborate.functions import domain as D
from corroborate.functions import parse as P
from corroborate.functions import text as T
from corroborate.operators import evaluation as E
from corroborate.operators import linkage as L
from corroborate.operators import matching as M
from corroborate.operators import merging as G
from corroborate.operators import report as R
from corroborate.sources import documents, sheets

RECORD = "report_id int, id string, group_no string, group_index int, section string, damage_name string, part string, sub_part string, location string, repair_method string, quantity string, quantity_group string, status string, pages array<int>, refs array<struct<page:int,type:string,excerpt:string>>, notes string, locked array<string>, no_photo boolean"
EVIDENCE = "report_id int, document_no int, seq int, source_type string, section string, damage_name string, part string, sub_part string, location string, repair_method string, quantity string, photo_no string"


def record(id_="1", place="10m", pages=(1,), **more):
    row = dict(report_id=1, id=id_, group_no="G", group_index=1, section="s", damage_name="균열", part="사면", sub_part="도수로", location=place, repair_method="", quantity=None, quantity_group=None, status="review", pages=list(pages), refs=[(pages[0], "table", None)], notes=None, locked=None, no_photo=False)
    return tuple((row | more).values())


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_a_place_lies_in_a_range_only(spark):
    inside = T.within_range(F.col("p"), F.col("r"))
    cases = {("STA.165m", "100~200m"): True, ("165m", "165m"): False, ("165 m", "100 ~ 165m"): True, ("165km", "100~200m"): False, ("", "1~2m"): False}
    assert all(one(spark, inside, p=p, r=r) is want for (p, r), want in cases.items())


def test_merging_ignores_blanks_and_white_space(spark):
    rows = spark.createDataFrame([("k", "a b", 2), ("k", " ", 1), ("k", "ab ", 3), ("k", None, 0), ("m", "a", 1), ("m", "b", 2)], "k string, v string, n int")
    got = {r["k"]: (r["v"], r["conflict"]) for r in L.merge_duplicates(rows, ["k"], ["v"], ["n"], ["n"]).collect()}
    assert got == {"k": ("a b", False), "m": ("REVIEW", True)}


def test_records_merge_in_two_stages(spark):
    rows = [record("1", repair_method="x"), record("2", repair_method=" x ", pages=(2,), group_index=2), record("3", "99m", (5,), group_index=3), record("4", "7m", (1,), section="t"), record("5", "8m", (1,), section="t")]
    got = {r["id"]: r for r in G.merge_records(spark.createDataFrame(rows, RECORD)).collect()}
    assert set(got) == {"1", "4", "5"}
    assert got["1"]["location"] == "검토필요" and got["1"]["pages"] == [1, 2, 5] and got["1"]["conflicts"] == ["location"] and got["1"]["status"] == "conflict" and got["1"]["repair_method"] == "x"
    assert not got["4"]["merged"] and got["4"]["location"] == "7m"
    assert G.merge_records(spark.createDataFrame([], RECORD)).count() == 0


def test_a_filled_blank_is_seen_by_the_next_document(spark):
    records = spark.createDataFrame([record("1", damage_name="", repair_method=""), record("2", "77m", sub_part="-")], RECORD)
    full = ("s", "균열", "사면", "도수로", "10m", "표면처리", None, "1")
    rows = [(1, 1, 1, "t", *full), (1, 2, 1, "t", *full[:5], "그라우팅", None, "1"), (1, 2, 0, "t", None, None, None, None, None, None, None, None)]
    got = {r["id"]: r for r in M.cross_check(records, spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert got["1"]["damage_name"] == "균열" and got["1"]["repair_method"] == "표면처리" and got["1"]["filled"] == ["damage_name", "repair_method"]
    assert got["1"]["cv_result"] == "conflict" and got["1"]["cv_conflicts"] == ["repair_method"]
    assert got["2"]["cv_result"] == "missingInAdditional"
    lone = M.cross_check(records, spark.createDataFrame([], EVIDENCE))
    assert {r["cv_result"] for r in lone.collect()} == {"unsupported"}
    locked = records.withColumn("locked", F.array(F.lit("damage_name")))
    assert {r["damage_name"] for r in M.cross_check(locked, spark.createDataFrame(rows, EVIDENCE)).where("id = '1'").collect()} == {""}
    fixed = M.resolve_conflict(M.cross_check(records, spark.createDataFrame(rows, EVIDENCE)), spark.createDataFrame([(1, "1", "repair_method", "x")], "report_id int, id string, field string, value string"))
    assert {(r["id"], r["cv_result"], r["repair_method"]) for r in fixed.collect()} == {("1", "matched", "x"), ("2", "missingInAdditional", "")}


def test_full_match_is_confirmed_and_another_place_is_a_conflict(spark):
    photo = "report_id int, photo_id string, photo_no string, damage_name string, caption string, part string, sub_part string, location string, section string, ocr_text string, nearby_text string, vision_type string, manual boolean, match_status string, confidence double, linked array<string>"
    same = (1, "P1", "1", "균열", "균열", "사면", "도수로", "10 m", "s", None, None, None, False, None, None, None)
    rows = [same, (*same[:1], "P2", *same[2:7], "99m", *same[8:]), (*same[:1], "P3", *same[2:12], True, "confirmed", 1.0, ["2"])]
    photos, records = spark.createDataFrame(rows, photo), spark.createDataFrame([record("1"), record("2", "55m", sub_part="-", part="기타", section="q", damage_name="누수"), record("3", no_photo=True, report_id=2)], RECORD)
    pairs = M.photo_pairs(photos, records)
    got = {(r["photo_id"], r["id"]): (r["score"], r["conflict"], r["status"]) for r in pairs.collect()}
    assert got["P1", "1"] == (105, False, "confirmed") and got["P2", "1"] == (85, True, "review")
    done = M.photo_results(photos, pairs)
    assert {r["photo_id"]: r["match_status"] for r in done.collect()} == {"P1": "confirmed", "P2": "review", "P3": "confirmed"}
    assert {r["id"]: r["photo_status"] for r in M.record_links(records, done, pairs).collect()} == {"1": "confirmed", "2": "confirmed", "3": "noPhoto"}


def test_prefixes_count_items_of_one_owner(spark):
    rows = [(k, f"own{k}_{i}") for k in range(30) for i in range(9)] + [(k, "shared") for k in range(30)]
    items = spark.createDataFrame(rows + [(100, "a"), (100, "b"), (101, "a"), (101, "b"), (101, "c")], "o int, i string")
    assert {(r["a"], r["b"], r["shared"]) for r in L.overlap_pairs(items, "o", "i", 0.8).collect()} == {(100, 101, 2)}


def test_answers_and_grey_values(spark):
    rows = spark.createDataFrame([('so {"a": 1, "c": null} ok',), ("none",), (None,)], "t string")
    got = [r.v and (r.v.a, r.v.c) for r in rows.select(P.json_object(F.col("t"), "struct<a:int,c:double>").alias("v")).collect()]
    assert got == [(1, None), None, None]
    assert one(spark, F.transform(P.luma(F.array(F.lit(10.0)), F.array(F.lit(20.0)), F.array(F.lit(30.0))), lambda x: F.round(x, 6))) == [18.15]


def test_photos_meet_by_number_or_page(spark):
    rows = lambda *r: spark.createDataFrame([(1, n, p) for n, p in r], "case_id int, photo_no string, page int")
    got = E.case_metrics(E.match_photos(rows(("1", 1), (None, 2), ("3", 3)), rows((" 1", 9), ("", 2), (None, 3)))).first()
    assert (got["tp"], got["fp"], got["fn"]) == (2, 1, 1)


def test_latest_run_of_equals_is_the_first(spark):
    runs = spark.createDataFrame([(1, 2, 0, 0.5), (1, 2, 1, 0.9), (1, 1, 2, 0.1)], "case_id int, run_number int, ordinal int, f1 double")
    assert E.latest_runs(runs).first()["f1"] == 0.5


def test_review_predicates_of_nothing(spark):
    rows = spark.createDataFrame([(None,) * 5, ("NEW-1", "검토필요", "", "", "review")], "id string, location string, quantity string, quantity_group string, status string")
    got = rows.select(R.position_problem().alias("p"), R.scale_problem().alias("s")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True)]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    s, w = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    book = {
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{s}"><sheets><sheet name="A" r:id="x9"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x9" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>균열</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>12</v></c><c r="D2" t="inlineStr"><is><t>7m</t></is></c></row></sheetData></worksheet>',
    }
    text = {"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>누수 도수로</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'}
    (tmp_path / "in").mkdir()
    for name, raw in {"map.xlsx": _zip(book), "note.docx": _zip(text), "bad.xlsx": b"no zip", "old.doc": b"x", "what.bin": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(raw)
    return tmp_path


def test_documents_and_what_cannot_be_read(spark, folder):
    rows = documents.load_documents(spark, str(folder / "in"))
    got = {(r["file"].rsplit("/", 1)[-1], r["part"], r["row_no"], tuple(r["cells"] or ()), r["error"] is None) for r in rows.collect()}
    assert got == {("map.xlsx", "A", 2, ("균열", "", "12", "7m"), True), ("note.docx", "body", 1, ("누수 도수로",), True), ("note.docx", "table 1", 1, ("a", "b"), True), ("bad.xlsx", None, None, (), False), ("old.doc", None, None, (), False), ("what.bin", None, None, (), False)}
    files = documents.registered(rows, [("map", "plan")]).orderBy("id").collect()
    assert [(r["id"], r["status"], r["source_type"]) for r in files] == [("AD001", "failed", "other"), ("AD002", "ok", "plan"), ("AD003", "ok", "other"), ("AD004", "failed", "other"), ("AD005", "failed", "other")]
    found = documents.candidates(rows, documents.registered(rows, []))
    assert {(r["damage_name"], r["sub_part"], r["location"], r["document_id"]) for r in found.collect()} == {("균열", None, "7m", "AD002"), ("누수", "도수로", None, "AD003")}


def _book(sheets, names):
    """A workbook whose sheets lie in files of another order than they are named."""
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    tags = "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(names))
    links = "".join(f'<Relationship Id="r{k}" Target="/xl/worksheets/sheet{len(names) - k}.xml"/>' for k in range(len(names)))
    out = {"xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{ns}"><sheets>{tags}</sheets></workbook>', "xl/_rels/workbook.xml.rels": f"<Relationships>{links}</Relationships>"}
    for k, rows in enumerate(sheets):
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in row) + "</row>" for row in rows)
        out[f"xl/worksheets/sheet{len(names) - k}.xml"] = f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>'
    return _zip(out)


def test_every_file_has_a_row_and_tables_become_candidates(spark, tmp_path):
    first = [["점검표"], ["구 간", "손상명", "세부 부위", "위치", "물량", "수량"], ["1구간", " 균열 ", "도수로", "10m", "3m", ""], ["", "", "", "", "", ""], ["2구간", "누수", "", "", "5m", "7m"]]
    second = [["x", "균열 도수로 12 m"], ["y", "양호"]]
    files = {"a.xlsx": _book([first, second], ["첫", "둘"]), "empty.xlsx": _book([[]], ["빈"]), "t.csv": "손상명,위치\n균열,\"9,5m\"\n".encode(), "g.json": b"[]", "old.xls": b"x", "none.csv": b"\n", "noext": b"?", "bad.csv": b"\xff\xfe\x00"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = documents.load_documents(spark, str(tmp_path))
    short = lambda f: f.rsplit("/", 1)[-1]
    assert {short(r["file"]) for r in rows.collect()} == set(files)
    assert {short(r["file"]) for r in rows.where("error is not null").collect()} == {"g.json", "old.xls", "noext", "bad.csv"}
    listed, found = documents.documents_to_candidates(spark, str(tmp_path), [("도수로", "plan")])
    assert {short(r["file"]): r["source_type"] for r in listed.collect()}["a.xlsx"] == "plan" and listed.count() == len(files)
    shown = [(short(r["file"]), r["place"], r["row_no"], r["section"], r["damage_name"], r["sub_part"], r["location"], r["quantity"], r["seq"]) for r in found.orderBy("file", "seq").collect()]
    assert shown == [("a.xlsx", "첫", 3, "1구간", "균열", "도수로", "10m", "3m", 1), ("a.xlsx", "첫", 5, "2구간", "누수", None, None, "7m", 2), ("a.xlsx", "둘", 1, None, "균열", "도수로", "12m", None, 3), ("t.csv", "csv", 2, None, "균열", None, "9,5m", None, 1)]


def test_the_sample_sees_as_many_rows_as_it_needs(spark):
    rows = spark.createDataFrame([("f", "csv", "csv", 0, k, 2 * k, ["m" if k == 1400 else "x"], None) for k in range(2000)], documents.ROWS).repartition(3)
    assert documents.registered(rows, [("m", "late")]).first()["source_type"] == "late"
    assert documents.registered(rows.where("row_no <> 1400"), [("m", "late")]).first()["source_type"] == "other"


def test_body_text_gives_a_candidate_for_each_place(spark):
    rows = spark.createDataFrame([("f", "word", "body", 0, 1, 0, ["균열 도수로 10 m 구간"], None), ("f", "word", "body", 0, 2, 20, [" 누수 20~30m"], None), ("g", "word", "body", 0, 1, 0, ["침하만 보임"], None), ("h", "word", "body", 0, 1, 0, ["없음"], None)], documents.ROWS)
    got = {(r["file"], r["row_no"], r["location"], r["damage_name"]) for r in documents.body_candidates(rows).collect()}
    assert got == {("f", 1, "10m", "균열"), ("f", 2, "20~30m", "누수"), ("g", 1, None, "침하")}


def test_documents_with_the_same_candidates_of_one_type_are_duplicates(spark):
    rows = [(d, t, n, p) for d, t in (("A", "x"), ("B", "x"), ("C", "y")) for n, p in (("균열", "1m"), ("누수", None), (None, "3m"))] + [("D", "x", "균열", "9m")]
    got = documents.duplicate_documents(spark.createDataFrame(rows, "document_id string, source_type string, damage_name string, location string"))
    assert {r["document_id"]: r["duplicate_of"] for r in got.collect()} == {"A": ["B"], "B": ["A"]}


def test_json_groups_become_records(spark, folder):
    (folder / "g.json").write_text(json.dumps([{"report_id": "r", "group_no": "1", "part": "사면", "locations": [{"location": "1m"}]}]))
    groups = documents.json_groups(spark, str(folder / "g.json"), documents.sample_groups(spark).schema)
    assert [r["id"] for r in R.group_records(groups).collect()] == ["1"]
    assert {r["id"]: (r["part"], r["quantity"], r["quantity_group"]) for r in R.group_records(documents.sample_groups(spark)).collect()} == {"1-01": ("배수시설", None, "그룹 합계 9m에 포함"), "1-02": ("배수시설", "3m", None), "2": ("사면", None, None)}


def test_reports_are_deleted_and_cleared(spark, tmp_path):
    path = str(tmp_path / "store")
    sheets.save_reports(spark.createDataFrame([(1, "a"), (2, "b")], "report_id int, v string"), path)
    sheets.delete_reports(spark, path, [1])
    assert [r["report_id"] for r in spark.read.parquet(path).collect()] == [2]
    sheets.clear_reports(spark, path)
    assert spark.read.parquet(path).count() == 0
    (folder,) = sheets.write_sheets({}, str(tmp_path / "sheets"))
    assert spark.read.option("header", True).csv(folder).count() == 1


def test_block_keeps_its_label(spark):
    got = one(spark, D.location_block(F.col("a"), F.lit("x")), a="165, 187m\n도수로 208m\n\n 7~9m")
    assert [(r["sub_part"], r["location"]) for r in got] == [("x", "165m"), ("x", "187m"), ("도수로", "208m"), ("도수로", "7~9m")]


def test_a_stream_counts_what_a_table_counts(spark, tmp_path):
    from corroborate.streaming import events as V

    rows = spark.createDataFrame([(k, k % 3) for k in range(60)], "k int, c int").withColumn("ts", F.timestamp_seconds(F.lit(1700000000) + F.col("k") * 300))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    V.append_events(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    counted = V.windowed_counts(stream, "ts", "c", "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    counted.awaitTermination()
    want = {tuple(r) for r in V.windowed_counts(spark.read.parquet(str(tmp_path / "out")), "ts", "c", "1 hour").collect()}
    assert want == {tuple(r) for r in spark.table("counted").collect()} and len(want) > 9


def test_cross_checking_deals_thin_rows_by_report(spark):
    """Texts are not held in the pairs, repeats and reports without candidates keep their rows, and what is sorted is sorted once."""
    full = ("s", "균열", "사면", "도수로", "10m", "표면처리", "3m", "1")
    records = [record("1"), record("1"), record("2", "77m", sub_part="-", damage_name="x"), record("3", sub_part="-", damage_name="", repair_method=" "), (2, *record("4")[1:]), (None, *record("5")[1:])]
    evidence = [(1, 1, 1, "t", *full)] * 2 + [(1, 2, 1, "t", *full[:3], "소단측구", *full[4:7], None), (1, 3, 5, "t", None, None, None, "-", None, None, None, None), (3, 1, 1, "t", *full)]
    frames = spark.createDataFrame(records, RECORD), spark.createDataFrame(evidence, EVIDENCE)
    got = sorted((r["id"], r["cv_result"], r["n_evidence"], tuple(r["filled"]), len(r["cv_evidence"])) for r in M.cross_check(*frames).collect())
    assert got == [("1", "matched", 2, ("quantity", "repair_method"), 2)] * 2 + [("2", "missingInAdditional", 0, (), 0), ("3", "missingInAdditional", 0, (), 0), ("4", "unsupported", 0, (), 0), ("5", "unsupported", 0, (), 0)]
    plan = M._winners(*frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 3 and plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan
