"""Review-state operators on hand-made rows: nulls, repeats and empty tables."""

from pyspark.sql import functions as F

from corroborate.functions import parse as P
from corroborate.operators import state as S
from corroborate.sources import sheets


def test_original_value_stays_and_no_op_edits_leave_no_trace(spark):
    records = spark.createDataFrame([("a", "208m"), ("b", None)], "id string, location string")
    edits = spark.createDataFrame([("a", "location", "211m", 1), ("a", "location", "211m", 2), ("a", "location", "215m", 3), ("b", "location", None, 4), ("x", "location", "1m", 5)], "id string, field string, to string, at int")
    history = S.edit_history(records, edits, "id", ["location"], "at")
    assert [tuple(r) for r in history.orderBy("at").collect()] == [("a", "location", "208m", "211m", 1, "208m"), ("a", "location", "211m", "215m", 3, "208m")]
    now = S.apply_edits(records, history, "id", ["location"], "at")
    assert {tuple(r) for r in now.collect()} == {("a", "215m", 1), ("b", None, 0)}
    assert S.apply_edits(records.limit(0), history.limit(0), "id", ["location"], "at").count() == 0


def test_windows_do_not_reach_behind_the_match_before(spark):
    rows = spark.createDataFrame([("ab 12 cd 34 ef",), (None,), ("",)], "t string")
    found = rows.select(P.text_windows(r"\d+", before=4, after=2)("t").alias("w")).collect()
    assert [[(w.start, w.hit, w.window) for w in r.w] for r in found] == [[(4, "12", "ab 12 c"), (10, "34", " cd 34 e")], [], []]


def test_answers_without_a_list_are_null(spark):
    rows = spark.createDataFrame([('x [{"a": 1}] y',), ("none",), (None,), ("[broken",)], "t string")
    assert [r.v and [x.a for x in r.v] for r in rows.select(P.json_rows(F.col("t"), "struct<a:int>").alias("v")).collect()] == [[1], None, None, None]


def test_sheets_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "report_id int, v string")
    (folder,) = sheets.write_sheets({"damages": rows}, str(tmp_path))
    assert {tuple(r) for r in spark.read.option("header", True).csv(folder).collect()} == {("1", "a"), ("2", "b")}
    sheets.save_reports(rows, str(tmp_path / "r"))
    sheets.save_reports(rows.where("report_id = 2").withColumn("v", F.lit("c")), str(tmp_path / "r"))
    assert {(r.report_id, r.v) for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {(1, "a"), (2, "c")}


def test_hashes_meet_within_eight_bits_only(spark):
    from corroborate.operators import linkage as L

    base = [0, 0, (1 << 8) - 1, (1 << 9) - 1, -1, -1 ^ (0x0101010101010101), 0x0123456789ABCDEF, None]
    rows = spark.createDataFrame(list(enumerate(base)), "k long, h long")
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(0, 1, 0)} | {(a, b, near(base[a], base[b])) for a in (0, 2, 3, 4, 5, 6) for b in (0, 2, 3, 4, 5, 6) if a < b and near(base[a], base[b]) <= 8}
    assert {tuple(r) for r in L.hamming_pairs(rows, "k", "h").collect()} == want
    assert L.hamming_pairs(rows.limit(0), "k", "h").count() == 0
