"""Sheets of XLSX workbooks as a Spark data source.

    spark.dataSource.register(XlsxSource)
    spark.read.format("xlsx").schema("OCC_CODE STRING, TOT_EMP DOUBLE").load("…/national.xlsx")

Options: sheet (name; the first by default), header (number of the row with the names, 1 by default), rows (rows of a task, 50,000 by default). path is a
file, or a folder whose .xlsx files are all read. Columns are taken by the header's names; those that a file lacks are null, and without a schema all
columns of the first file are strings. A column `_row` gives the row's number in the sheet, `_file` the file. A cell that does not fit its column's type is
null, as are empty cells and error values. Each task streams through the sheet's XML up to its last row, and holds one row and the shared strings.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, at = _system(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        head = path.rstrip("/")[: -len(at.rstrip("/"))]
        return sorted(head + f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.path.lower().endswith(".xlsx"))
    return [path]


def _opened(path: str) -> zipfile.ZipFile:
    system, at = _system(path)
    return zipfile.ZipFile(io.BufferedReader(system.open_input_file(at)))


def _sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    targets = {e.get("Id"): e.get("Target") for _, e in iterparse(book.open("xl/_rels/workbook.xml.rels")) if e.tag.endswith("}Relationship")}
    sheets = [(e.get("name"), targets[e.get(_LINK)]) for _, e in iterparse(book.open("xl/workbook.xml")) if e.tag == f"{_MAIN}sheet"]
    for name, target in sheets:
        if sheet is None or name == sheet:
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, e in iterparse(book.open("xl/sharedStrings.xml")):
        if e.tag == f"{_MAIN}si":
            out.append(_text(e))
            e.clear()
    return out


def _text(e) -> str:
    """The text of a string item: its own, and that of its runs; not how it is read aloud."""
    parts = e.findall(f"{_MAIN}t") + e.findall(f"{_MAIN}r/{_MAIN}t")
    return "".join(t.text or "" for t in parts)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _rows(book: zipfile.ZipFile, sheet: str, first: int, last: int) -> Iterator[tuple[int, dict[int, str | None]]]:
    """(number, column -> text) of the rows with numbers in first ... last."""
    strings, number = _shared(book), 0
    for _, e in iterparse(book.open(sheet)):
        if e.tag != f"{_MAIN}row":
            continue
        number = int(e.get("r", number + 1))
        if number > last:
            return
        if number >= first:
            cells, at = {}, -1
            for c in e.findall(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else at + 1
                kind, value = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    cells[at] = _text(c.find(f"{_MAIN}is"))
                elif value is not None and kind != "e":
                    cells[at] = strings[int(value.text)] if kind == "s" else value.text
            yield number, cells
        e.clear()


def _last_row(book: zipfile.ZipFile, sheet: str) -> int:
    """The number of the last row, if the sheet states its size; else the most that a sheet can have."""
    for _, e in iterparse(book.open(sheet), ("start",)):
        if e.tag == f"{_MAIN}dimension":
            found = re.search(r":[A-Z]+(\d+)$", e.get("ref", ""))
            return int(found[1]) if found else 1 << 20
        if e.tag == f"{_MAIN}row":
            break
    return 1 << 20


def _fitted(text: str | None, kind: DataType):
    if text is None or isinstance(kind, StringType):
        return text
    try:
        if isinstance(kind, (DoubleType, FloatType)):
            return float(text)
        if isinstance(kind, (LongType, IntegerType)):
            return int(text) if re.fullmatch(r"-?\d+", text) else int(float(text)) if float(text).is_integer() else None
        if isinstance(kind, BooleanType):
            return {"1": True, "0": False, "true": True, "false": False}.get(text.lower())
    except (ValueError, OverflowError):
        return None
    raise TypeError(f"no column of type {kind.simpleString()} in a sheet")


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.sheet, self.schema = options["path"], options.get("sheet"), schema
        self.header, self.size = int(options.get("header", 1)), int(options.get("rows", 50_000))

    def partitions(self) -> list[_Part]:
        parts = []
        for path in _files(self.path):
            with _opened(path) as book:
                last = _last_row(book, _sheet_path(book, self.sheet))
            size = self.size if last < 1 << 20 else 1 << 20
            parts += [_Part(path, first, min(first + size - 1, last)) for first in range(self.header + 1, last + 1, size)]
        return parts

    def read(self, part: _Part):
        with _opened(part.path) as book:
            sheet = _sheet_path(book, self.sheet)
            names = {name: i for _, cells in _rows(book, sheet, self.header, self.header) for i, name in cells.items()}
            places = [(names.get(f.name), f.dataType, f.name) for f in self.schema.fields]
            for number, cells in _rows(book, sheet, part.first, part.last):
                own = {"_row": number, "_file": part.path}
                if any(v not in (None, "") for v in cells.values()):
                    yield tuple(own[name] if name in own else _fitted(cells.get(at), kind) for at, kind, name in places)


class XlsxSource(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        with _opened(_files(self.options["path"])[0]) as book:
            header = int(self.options.get("header", 1))
            rows = list(_rows(book, _sheet_path(book, self.options.get("sheet")), header, header))
        return StructType([StructField(name, StringType()) for _, name in sorted(rows[0][1].items())] if rows else [])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)
