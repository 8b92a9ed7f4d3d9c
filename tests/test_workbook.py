"""Workbooks written and read back: order, blanks, many sheets, broken files, failed tasks."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corroborate.sources import documents
from corroborate.sources import workbook as W

ROW = "report string, sheet_no int, sheet string, row int, cells array<string>"


def put(path, sheets, shared=()):
    """A workbook of (name, state, file, rows of cells); its first cells are shared strings if there are any."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns:r='x'><sheets>" + "".join(f"<sheet name='{n}' state='{s}' r:id='i{f}'/>" for n, s, f, _ in sheets) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f"<L Id='i{f}' Target='worksheets/{f}.xml'/>" for _, _, f, _ in sheets) + "</R>")
        if shared:
            z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for _, _, f, rows in sheets:
            z.writestr(f"xl/worksheets/{f}.xml", "<w><sheetData>" + "".join(f"<row r='{k}'>" + "".join(f"<c t='s'><v>{c}</v></c>" for c in cells) + "</row>" for k, cells in rows) + "</sheetData></w>")


def test_written_books_read_back(spark, tmp_path):
    odd = ["a < b & c", "", None, " two  spaces ", "line\nbreak\r\nand\ttab", '"quoted"', "균열", "x\x01y", "z" * 40_000]
    rows = [("r1", 2, "second", 1, odd), ("r1", 1, "first", 2, ["b"]), ("r1", 1, "first", 1, ["a", None]), ("r1", 1, "first", 1, ["a", None]), ("r1", 3, "with/slash", 1, None), ("r1", 3, "FIRST", 1, [str(k) for k in range(60)]), ("a/b", 1, None, 1, ["q"]), (None, 1, "s", 7, ["none"])]
    path = str(tmp_path / "books")
    W.write_workbooks(spark.createDataFrame(rows, ROW).repartition(5), path)
    got = W.read_workbooks(spark, path)
    assert got.schema.simpleString() == "struct<" + W.READ.replace(" ", ":").replace(",:", ",") + ">"
    found = {(os.path.basename(r["file"]), r["sheet"], r["row"]): (r["sheet_no"], r["hidden"], r["cells"], r["error"]) for r in got.collect()}
    shown = [(x or "").replace("\x01", "") for x in odd]
    other = W.file_name("a/b")
    assert other.startswith("a_b-") and found == {
        ("r1.xlsx", "first", 1): (0, False, ["a", ""], None), ("r1.xlsx", "first", 2): (0, False, ["a", ""], None), ("r1.xlsx", "first", 3): (0, False, ["b"], None), ("r1.xlsx", "second", 1): (1, False, shown, None),
        ("r1.xlsx", "FIRST (2)", 1): (2, False, [str(k) for k in range(60)], None), ("r1.xlsx", "with_slash", 1): (3, False, [], None), (other, "sheet", 1): (0, False, ["q"], None), ("report.xlsx", "s", 1): (0, False, ["none"], None),
    }
    assert sorted(os.listdir(path)) == sorted([other, "r1.xlsx", "report.xlsx"])
    assert {r["sheet"] for r in W.read_workbooks(spark, path, sheet="first").collect()} == {"first"}
    # large files are read sheet by sheet, with the same rows
    split = W.read_workbooks(spark, f"file://{path}", splitBytes="1")
    assert split.rdd.getNumPartitions() == 6 and sorted(map(str, split.drop("file").collect())) == sorted(map(str, got.drop("file").collect()))
    # the plain reader sees the same
    assert [(s, k) for s, k, _ in documents.xlsx_rows((tmp_path / "books" / "r1.xlsx").read_bytes())] == [("first", 1), ("first", 2), ("first", 3), ("second", 1), ("FIRST (2)", 1), ("with_slash", 1)]


def test_more_rows_than_a_sheet_holds(spark, tmp_path):
    path = str(tmp_path / "long")
    W.write_workbooks(spark.range(25).select(F.lit("r").alias("report"), F.lit(1).alias("sheet_no"), F.lit("s").alias("sheet"), F.col("id").cast("int").alias("row"), F.array(F.col("id").cast("string")).alias("cells")), path, rowLimit="10")
    got = W.read_workbooks(spark, path).orderBy("sheet_no", "row").collect()
    assert [r["cells"][0] for r in got] == [str(k) for k in range(25)] and [r["sheet"] for r in got[::10]] == ["s", "s (2)", "s (3)"]


def test_reordered_hidden_and_broken(spark, tmp_path):
    put(tmp_path / "a.xlsx", [("z", "visible", "sheet2", [(1, [0]), (5, [1, 0])]), ("y", "hidden", "sheet1", [(2, [1])]), ("none", "visible", "sheet3", [])], ["one", "two"])
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"not read")
    for options in ({}, {"splitBytes": "1"}):
        rows = W.read_workbooks(spark, str(tmp_path), **options).collect()
        assert sorted((r["sheet"], r["sheet_no"], r["hidden"], r["row"], tuple(r["cells"])) for r in rows if r["error"] is None) == [("y", 1, True, 2, ("two",)), ("z", 0, False, 1, ("one",)), ("z", 0, False, 5, ("two", "one"))]
        assert [(os.path.basename(r["file"]), r["sheet"], r["cells"]) for r in rows if r["error"]] == [("b.xlsx", None, None)]
    (tmp_path / "empty").mkdir()
    assert W.read_workbooks(spark, str(tmp_path / "empty")).count() == 0


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "books")
    one = lambda name, *cells: spark.createDataFrame([(name, 1, "s", k, [c]) for k, c in enumerate(cells)], ROW)
    read = lambda: sorted((os.path.basename(r["file"]), r["cells"][0]) for r in W.read_workbooks(spark, path).collect())
    W.write_workbooks(one("a", "1"), path)
    W.write_workbooks(one("b", "2"), path, "append")
    assert read() == [("a.xlsx", "1"), ("b.xlsx", "2")]
    broken = one("c", "3", "4").withColumn("cells", F.when(F.col("row") == 1, F.raise_error(F.lit("broken")).cast("array<string>")).otherwise(F.col("cells")))
    with pytest.raises(Exception, match="broken"):
        W.write_workbooks(broken, path)
    scattered = one("d", "5").union(one("d", "6")).select(*W.WRITE)
    with pytest.raises(Exception, match="several tasks"):
        scattered.write.format("workbook").mode("append").save(path)
    assert read() == [("a.xlsx", "1"), ("b.xlsx", "2")] and sorted(os.listdir(path)) == ["a.xlsx", "b.xlsx"]
    W.write_workbooks(one("b", "7"), path)
    assert read() == [("b.xlsx", "7")]
    W.write_workbooks(one("b").limit(0), path)
    assert read() == []
