"""Documents of an inspection as rows: spreadsheets, text documents and CSV files, and failed rows for the rest; and the candidates read from them.

A spreadsheet or text document is a zip of XML files; each is read by one task from the binary file source, which bounds
it to the 2 GB of a row, and its sheets are parsed as streams.  A file that cannot be read is a row with its reason, and
stops nothing; every file has one row at least."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corroborate.functions import domain as D
from corroborate.functions import parse as P
from corroborate.functions import text as T
from corroborate.operators import linkage as L
from corroborate.operators import scan
from corroborate.operators import state as S

#: part_no: the part's place in the file; at_char: how many characters of text the file has before the row.
ROWS = "file string, kind string, part string, part_no int, row_no int, at_char long, cells array<string>, error string"
SAMPLE_CHARS = 3000
BODY = "body"
#: By extension, what reads a file.
KINDS = {"xlsx": "excel", "docx": "word", "json": "json", "csv": "csv", "pdf": "pdf", "doc": "old word", "xls": "old excel"}
#: The field that a table's column holds, by a word of its header.
HEADERS = {
    "구간": "section", "부위": "part", "세부부위": "sub_part", "손상명": "damage_name", "손상내용": "damage_name", "손상종류": "damage_name", "위치": "location", "보수공법": "repair_method",
    "보수방안": "repair_method", "보강방안": "repair_method", "규모/물량": "quantity", "수량": "quantity", "규모": "quantity", "물량": "quantity", "사진번호": "photo_no",
}
FIELDS = ["section", "damage_name", "part", "sub_part", "location", "repair_method", "quantity", "photo_no"]


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    return "".join(x.text or "" for x in node.iter() if _name(x.tag) == "t")


def _stream(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one tag as they are read, each forgotten afterwards."""
    with z.open(name) as f:
        root = None
        for event, x in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = x
            if event == "end" and _name(x.tag) == tag:
                yield x
                x.clear()
                root.clear()


def worksheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str, bool]]:
    """(name, file, whether it is hidden) of the worksheets in the workbook's order, by the ids of its relations."""
    targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _name(x.tag) == "sheet":
            target = targets[next(v for k, v in x.attrib.items() if _name(k) == "id")]
            file = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if file.startswith("xl/worksheets/"):  # a chart has no rows
                yield x.get("name"), file, x.get("state", "visible") != "visible"


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    return [_texts(x) for x in _stream(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []


def sheet_rows(z: zipfile.ZipFile, file: str, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(row number, cells as text) of a worksheet as it is read; cells left out are empty."""
    at_row = 0
    for row in _stream(z, file, "row"):
        at_row = int(row.get("r") or at_row + 1)
        cells: list[str] = []
        for c in row:
            at = len(cells)
            if letters := re.match(r"[A-Z]*", c.get("r") or "").group():
                at = 0
                for ch in letters:
                    at = 26 * at + ord(ch) - 64
                at -= 1
            value = next((x.text or "" for x in c if _name(x.tag) == "v"), None)
            shown = shared[int(value)] if c.get("t") == "s" and value else _texts(c) if c.get("t") == "inlineStr" else value or ""
            cells += [""] * (at + 1 - len(cells))
            cells[at] = shown
        yield at_row, cells


def xlsx_rows(raw: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells as text) of every worksheet in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = shared_strings(z)
        for sheet, file, _ in worksheets(z):
            for at_row, cells in sheet_rows(z, file, shared):
                yield sheet, at_row, cells


def csv_rows(raw: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """("csv", line, cells) of a file in UTF-8."""
    for k, cells in enumerate(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")), 1):
        yield "csv", k, cells


def docx_rows(raw: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """("table k", row, cells) of each table and ("body", paragraph, [text]) of the text outside them."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")).iter() if _name(x.tag) == "body")
    tables = paragraphs = 0
    for block in body:
        if _name(block.tag) == "tbl":
            tables += 1
            for k, row in enumerate((x for x in block if _name(x.tag) == "tr"), 1):
                yield f"table {tables}", k, [" ".join(_texts(p) for p in c.iter() if _name(p.tag) == "p").strip() for c in row if _name(c.tag) == "tc"]
        elif _name(block.tag) == "p" and (text := _texts(block).strip()):
            paragraphs += 1
            yield "body", paragraphs, [text]


_READERS = {"excel": xlsx_rows, "word": docx_rows, "csv": csv_rows}
_BATCH = 5000


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ROWS.split(", ")]
    for batch in batches:
        for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
            out, parts, chars, any_ = [], {}, 0, False
            try:
                for part, row, cells in _READERS[kind](bytes(content)):
                    out.append((path, kind, part, parts.setdefault(part, len(parts)), row, chars, cells, None))
                    chars, any_ = chars + sum(map(len, cells)) + len(cells), True
                    if len(out) == _BATCH:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                error = None
            except Exception as e:  # noqa: BLE001 - one bad file is a row, whatever is wrong with it
                error = f"cannot be read: {type(e).__name__}"
            if error or not any_:
                out.append((path, kind, None, None, None, None, None, error))
            yield pd.DataFrame(out, columns=columns)


def kind_of(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), T.file_type(name))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """``ROWS`` of all files below ``path``, one at least of each; a file that cannot be read, or of a kind without a reader, has one failed row.

    Rows of a file that breaks off in the middle stay, beside its failed row.  Spark's file source leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("kind", kind_of(F.col("path")))
    read = F.coalesce(F.col("kind").isin(*_READERS), F.lit(False))
    known = files.where(read).select("path", "kind", "content").mapInPandas(_read, ROWS)
    reasons = {"old word": "an old format: save it as docx", "old excel": "an old format: save it as xlsx", "pdf": "give its pages as a table", "json": "groups: read it by json_groups"}
    reason = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv]), "kind"), F.lit("an unknown kind of file"))
    made = {"file": F.col("path"), "kind": F.coalesce("kind", F.lit("unknown")), "error": reason}
    failed = files.where(~read).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in known.schema])
    return known.unionByName(failed)


def registered(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """A row per file: its id AD001 and on by name, source type by name and the first ``SAMPLE_CHARS`` characters, status and reason."""
    text = F.struct("part_no", "row_no", F.array_join("cells", " ").alias("x"))
    near = F.when(F.col("at_char") < SAMPLE_CHARS, text)  # each row has a character at least
    by = rows.groupBy("file", "kind").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(near)).alias("_t"))
    sample = F.substring(F.array_join(F.transform("_t", lambda t: t["x"]), " "), 1, SAMPLE_CHARS)
    source = T.classify_source(F.element_at(F.split("file", "/"), -1), sample, rules)
    out = by.select("file", "kind", "error", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), source["type"].alias("source_type"), F.lit(0).alias("_all"))
    return S.numbered(out, "_all", ["file"], "AD", 3).drop("_all")


def table_candidates(rows: DataFrame, headers: dict[str, str] = HEADERS) -> DataFrame:
    """file, place, row_no, the candidate's fields and quote of table rows.

    A table's header is the first of its five first rows that names two columns; a row below it is a candidate if it has a
    field, of two columns of one field the later one that is filled counts.  Without a header each row is read as text."""
    tables = rows.where("error is null and cells is not null and part <> 'body'").withColumn("_names", F.transform("cells", lambda c: P.header_field(T.norm(c), headers)))
    named = F.size(F.filter("_names", lambda n: n.isNotNull()))
    heads = tables.where((F.col("row_no") <= 5) & (named >= 2)).groupBy("file", "part_no").agg(F.min(F.struct("row_no", "_names")).alias("_h"))
    met = tables.drop("_names").join(heads, ["file", "part_no"], "left").where("_h is null or row_no > _h.row_no")
    given = F.filter(F.zip_with("_h._names", "cells", lambda n, c: F.struct(n.alias("n"), F.trim(c).alias("v"))), lambda x: x["n"].isNotNull() & D.given(x["v"]))
    value = lambda f: F.try_element_at(F.filter("_given", lambda x: x["n"] == f), F.lit(-1))["v"]
    known = met.where("_h is not null").withColumn("_given", given).where(F.size("_given") > 0)
    known = known.withColumns({f"_{f}": value(f) for f in FIELDS}).withColumn("_part", F.when(F.col("_part").isNotNull(), D.standard_part(F.col("_part"))["part"]))
    table = known.select("file", F.col("part").alias("place"), "part_no", "row_no", *[F.col(f"_{f}").alias(f) for f in FIELDS], F.substring(F.array_join("cells", " | "), 1, 200).alias("quote"))
    loose = met.where("_h is null").withColumn("c", D.candidate(F.trim(F.array_join("cells", " ")), F.lit(None).cast("string"))).where("c is not null")
    return table.unionByName(loose.select("file", F.col("part").alias("place"), "part_no", "row_no", *[F.col(f"c.{f}").alias(f) for f in [*FIELDS, "quote"]]))


def body_candidates(rows: DataFrame) -> DataFrame:
    """Candidates of the text outside tables: one for each place that it names, read from the text around it; of a text without one, at most one in all."""
    texts = rows.where("error is null and part = 'body'").groupBy("file", "part_no").agg(F.array_sort(F.collect_list(F.struct("row_no", F.array_join("cells", " ").alias("x")))).alias("t"))
    texts = texts.select("file", "part_no", F.trim(F.array_join(F.transform("t", lambda t: t["x"]), "")).alias("text")).where("text <> ''")
    found = texts.withColumn("w", P.text_windows(D.LOCATION)("text"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(None).cast("string").alias("hit"), F.col("text").alias("window")))
    each = found.select("file", "part_no", F.posexplode(F.when(F.size("w") > 0, F.col("w")).otherwise(whole)).alias("at", "w"))
    read = each.withColumn("c", D.candidate(F.col("w.window"), F.regexp_replace("w.hit", r"\s+", ""))).where("c is not null")
    return read.select("file", F.lit(BODY).alias("place"), "part_no", (F.col("at") + 1).cast("int").alias("row_no"), *[F.col(f"c.{f}").alias(f) for f in [*FIELDS, "quote"]])


def candidates(rows: DataFrame, files: DataFrame) -> DataFrame:
    """All candidates of loaded rows with the id and source type of their file, in tables before text, and seq, their place in the file."""
    every = table_candidates(rows).unionByName(body_candidates(rows)).join(files.select("file", F.col("id").alias("document_id"), "source_type"), "file")
    turn = F.when(F.col("place") == BODY, 1 << 62).otherwise(F.col("part_no").cast("long") * (1 << 32)) + F.col("row_no")
    return scan.numbered(every.withColumn("_turn", turn), ["file"], ["_turn"], "seq").drop("_turn", "part_no")


def documents_to_candidates(spark: SparkSession, path: str, rules: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(files, candidates) of all documents below ``path``."""
    rows = load_documents(spark, path)
    files = registered(rows, rules)
    return files, candidates(rows, files)


def duplicate_documents(found: DataFrame) -> DataFrame:
    """document_id and duplicate_of, sorted, of documents of one source type whose candidates' names and places overlap by 0.8 of the smaller set."""
    key = F.concat_ws("|", "source_type", F.coalesce("damage_name", F.lit("")), F.coalesce("location", F.lit("")))
    pairs = L.overlap_pairs(found.select("document_id", key.alias("k")), "document_id", "k")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("document_id")).agg(F.array_sort(F.collect_set("b")).alias("duplicate_of"))


def json_groups(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Groups of JSON files that hold one array each; what does not fit the schema is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def sample_groups(spark: SparkSession) -> DataFrame:
    """A few groups of one report to try the operators on."""
    place = "array<struct<sub_part:string,location:string,quantity:string>>"
    rows = [
        ("S", "1", "1구간", "균열", "배수시설", "표면처리", "9m", [("소단측구", "165m", None), ("도수로", "208m", "3m")]),
        ("S", "2", "1구간", "누수", "사면", "방수처리", None, [("-", "50~150m", None)]), ("S", "3", "2구간", "침하", "옹벽", "주의관찰", None, []),
    ]
    return spark.createDataFrame(rows, f"report_id string, group_no string, section string, damage_name string, part string, repair_method string, total string, locations {place}")
