"""Workbooks (xlsx) as a Spark data source: ``spark.read.format("workbook")`` and a sink with one file per report.

Reading: a file of ``splitBytes`` (8 MB) or more is a partition per worksheet, smaller files share partitions of about
that size, and every sheet is parsed as a stream; only a file's shared strings are held, its different texts.  The option
``sheet`` reads the sheets of one name alone.  Columns: ``READ``; hidden sheets have rows too, cells are text and those
left out are empty.  A file that cannot be read is one row with ``error``; a sheet without rows has none.

Writing: ``write_workbooks`` sorts rows (report, sheet_no, sheet, row, cells) and each report is streamed to a file by one
task, a sheet's rows beyond ``LIMIT`` going on in "name (2)".  Files are written below ``_writing-…`` and moved to their
places by the commit, so that a failed task or job leaves nothing behind; of tasks that ran twice one counts.  Overwriting
replaces all workbooks of the folder, appending those of the same reports.  Null cells are empty ones, characters that XML
cannot hold are left out, rows without a report go to ``report``; a report without rows has no file.

Paths are those of pyarrow's file systems: local or shared folders, ``hdfs://`` and object stores."""

from __future__ import annotations

import hashlib
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from corroborate.sources import documents

READ = "file string, sheet string, sheet_no int, hidden boolean, row int, cells array<string>, error string"
WRITE = ["report", "sheet_no", "sheet", "row", "cells"]
#: Fixed value: the rows a worksheet can hold.
LIMIT = 1_048_576
SPLIT_BYTES, BATCH = 8 << 20, 4_096
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("hidden", pa.bool_()), ("row", pa.int32()), ("cells", pa.list_(pa.string())), ("error", pa.string())])
_TEMPORARY = "_writing-"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class Part(InputPartition):
    """Files to read, and of a single one the number of its sheet."""

    files: list[str]
    sheet_no: int | None = None


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.only, self.split = options["path"], options.get("sheet"), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        where, path = _at(self.path)
        info = where.get_file_info(path)
        every = [info] if info.is_file else where.get_file_info(fs.FileSelector(path, recursive=True))
        books = sorted((f.path, f.size or 0) for f in every if f.is_file and f.extension == "xlsx" and f"/{_TEMPORARY}" not in f.path)
        parts, held, size = [], [], 0
        for file, n in books:
            if n >= self.split:
                parts += [Part([file], k) for k in self._numbers(where, file)] or [Part([file])]
                continue
            if held and size + n > self.split:
                parts.append(Part(held))
                held, size = [], 0
            held, size = [*held, file], size + n
        return parts + [Part(held)] * bool(held) or [Part([])]

    def _numbers(self, where: fs.FileSystem, file: str) -> list[int]:
        try:
            with where.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                return [k for k, _ in enumerate(documents.worksheets(z))]
        except Exception:  # the task that reads it says why
            return []

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        where, rows = _at(self.path)[0], []
        for file in partition.files:
            for row in self._rows(where, file, partition.sheet_no):
                rows.append(row)
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _rows(self, where: fs.FileSystem, file: str, number: int | None) -> Iterator[tuple]:
        try:
            with where.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                wanted = [(k, *s) for k, s in enumerate(documents.worksheets(z)) if number in (None, k) and self.only in (None, s[0])]
                shared = documents.shared_strings(z) if wanted else []
                for k, name, part, hidden in wanted:
                    for row, cells in documents.sheet_rows(z, part, shared):
                        yield file, name, k, hidden, row, cells, None
        except Exception as e:  # whatever a broken file does is its row, and stops no other
            yield file, None, number, None, None, None, f"{type(e).__name__}: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _text(x: str) -> str:
    held = re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", x)
    return escape(held, {"\r": "&#13;"})


def _column(k: int) -> str:
    """A, B, …, Z, AA, … of 0, 1, …"""
    return (_column(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


class Book:
    """A workbook written as a stream, sheet after sheet."""

    def __init__(self, out) -> None:
        self.zip, self.sheets, self.open, self.last = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [], None, 0

    def _name(self, wanted: str) -> str:
        """A name that a sheet may have and no other of the book has."""
        base, used = re.sub(r"[\[\]:*?/\\]", "_", wanted)[:31] or "sheet", {s.lower() for s in self.sheets}
        name, k = base, 1
        while name.lower() in used:
            k += 1
            name = f"{base[: 31 - len(f' ({k})')]} ({k})"
        return name

    def sheet(self, wanted: str) -> None:
        self.end()
        self.sheets.append(self._name(wanted))
        self.open, self.last = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True), 0
        self.open.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')

    def row(self, cells: list[str | None]) -> None:
        self.last += 1
        shown = "".join(f'<c r="{_column(k)}{self.last}"' + ("/>" if c is None else f' t="inlineStr"><is><t xml:space="preserve">{_text(c)}</t></is></c>') for k, c in enumerate(cells))
        self.open.write(f'<row r="{self.last}">{shown}</row>'.encode())

    def end(self) -> None:
        if self.open is not None:
            self.open.write(b"</sheetData></worksheet>")
            self.open.close()
            self.open = None

    def close(self) -> None:
        self.end()
        head, kinds = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        numbers = range(1, len(self.sheets) + 1)
        sheets = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(self.sheets, 1))
        self.zip.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        self.zip.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}.worksheet+xml"/>' for k in numbers)
        rest = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        self.zip.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types">{rest}<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}</Types>')
        self.zip.close()


def file_name(report: str | None) -> str:
    """A report's file; names that no file may have are told apart by a digest."""
    plain = re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", report or "report").strip(". ")
    return f"{plain or 'report'}{'' if plain == (report or 'report') else '-' + hashlib.sha1(report.encode()).hexdigest()[:8]}.xlsx"


@dataclass
class Written(WriterCommitMessage):
    """(where a file was written, its name) of a task."""

    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, limit: int) -> None:
        self.path, self.overwrite, self.limit, self.job = path, overwrite, limit, uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return f"{root.rstrip('/')}/{_TEMPORARY}{self.job}"

    def write(self, iterator: Iterator) -> Written:
        where, root = _at(self.path)
        task = TaskContext.get()
        folder = f"{self._temporary(root)}/{task.partitionId()}-{task.taskAttemptId()}"
        where.create_dir(folder, recursive=True)
        files, book, out, now = [], None, None, (None, None)
        for row in iterator:
            name = file_name(row.report)
            if not files or files[-1][1] != name:
                if book is not None:
                    book.close()
                    out.close()
                files.append((f"{folder}/{len(files)}.xlsx", name))
                out = where.open_output_stream(files[-1][0])
                book, now = Book(out), None
            if now != (row.sheet_no, row.sheet) or book.last == self.limit:
                now = (row.sheet_no, row.sheet)
                book.sheet(row.sheet or "sheet")
            book.row(row.cells or [])
        if book is not None:
            book.close()
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        where, root = _at(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = {n for _, n in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError("rows of one report lie in several tasks or apart: write them by write_workbooks")
        for at, name in files:
            where.move(at, f"{root.rstrip('/')}/{name}")
        if self.overwrite:
            for f in where.get_file_info(fs.FileSelector(root)):
                if f.is_file and f.extension == "xlsx" and f.base_name not in names:
                    where.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        where, root = _at(self.path)
        if where.get_file_info(self._temporary(root)).type == fs.FileType.Directory:
            where.delete_dir(self._temporary(root))


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("rowlimit", LIMIT)))


def read_workbooks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``READ`` of the workbooks at or below ``path``."""
    spark.dataSource.register(Workbook)
    return spark.read.format("workbook").options(**options).load(path)


def write_workbooks(rows: DataFrame, path: str, mode: str = "overwrite", **options: str) -> None:
    """One workbook per report of rows (report, sheet_no, sheet, row, cells), in the order of sheet_no, sheet and row."""
    rows.sparkSession.dataSource.register(Workbook)
    dealt = rows.select(*WRITE).repartition("report").sortWithinPartitions("report", "sheet_no", "sheet", "row", "cells")
    dealt.write.format("workbook").mode(mode).options(**options).save(path)
