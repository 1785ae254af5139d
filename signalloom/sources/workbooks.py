"""Workbooks (zipped sheets of XML) as a Spark source and sink, by the standard library's zip and XML readers.

``scan`` gives a row for each row of each sheet of each file; a file is read in its own task, its sheets one row at a time, so that a
task holds a workbook's shared strings and no sheet. ``read_workbook`` takes the first of some candidate files, or a folder of files with
one header, and gives text columns with tidy headers, as case sheets in CSV have. ``write_workbooks`` writes a file for each partition.

Edge cases: empty cells and rows that aren't stored are null; rows without any cell are left out. Text of several runs is joined, line ends
and control characters come back as they were stored. A file that is no workbook gives one row with its ``error``; ``read_workbook``
refuses it. The format holds at most 1,048,576 rows a sheet, and the sink begins another file there.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.sources.ranges import located, opened
from signalloom.sources.sheets import tidy_columns

# Fixed names of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS = 1 << 20
ROWS = "path string, sheet string, row int, cells array<string>, error string"


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                # Phonetic hints stand beside the text, not in it.
                out.append("".join(t.text or "" for part in node if part.tag in (f"{MAIN}t", f"{MAIN}r") for t in part.iter(f"{MAIN}t")))
                node.clear()
    return out


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    member = lambda target: target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return [(s.get("name", ""), member(links[s.get(LINK)])) for s in found]


def column_of(reference: str) -> int:
    """Place of a cell such as AB12 in its row, from 0."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows_of(book: zipfile.ZipFile, member: str, strings: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of the rows of a sheet, one at a time."""
    with book.open(member) as f:
        number = 0
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{MAIN}row":
                continue
            number = int(node.get("r", number + 1))
            cells: list[str | None] = []
            for c in node.iter(f"{MAIN}c"):
                at = column_of(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t", "n"), c.findtext(f"{MAIN}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif value is not None:
                    cells[at] = strings[int(value)] if kind == "s" else {"1": "true", "0": "false"}.get(value, value) if kind == "b" else value
            node.clear()
            if any(c is not None for c in cells):
                yield number, cells


def _scan(sheet: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "sheet", "row", "cells", "error"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple] = []
                try:
                    with opened(path) as source, zipfile.ZipFile(source) as book:
                        strings = shared_strings(book)
                        for name, member in sheets(book):
                            for number, cells in rows_of(book, member, strings) if sheet in (None, name) else ():
                                held.append((path, name, number, cells, None))
                                if len(held) == 4096:
                                    yield batch_of(held)
                                    held = []
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as e:
                    held.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                yield batch_of(held)

    return run


def scan(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(path, sheet, row, cells, error) of a file's or a folder's workbooks, of all sheets or of one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xlsx,XLSX,xlsm}").load(path)
    return files.select("path").mapInArrow(_scan(sheet), ROWS)


def read_workbook(spark: SparkSession, paths: list[str], sheet: str | None = None, header: int = 1) -> DataFrame:
    """Text columns of the first of the paths that is there, under the tidy headers of row ``header``; by default of the first sheet."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            continue
        found = scan(spark, path, sheet)
        heads = found.where((F.col("row") == header) | F.col("error").isNotNull()).orderBy(F.col("error").isNull(), "path").limit(64).collect()
        if not heads or heads[0].error:
            raise ValueError(f"{heads[0].path}: {heads[0].error}" if heads else f"{path}: no row {header}")
        first = heads[0]
        rows = found.where((F.col("row") > header) & (F.col("sheet") == first.sheet))
        plain = rows.select(*(F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(first.cells))))
        return tidy_columns(plain, list(first.cells))
    raise FileNotFoundError(", ".join(paths))


def serial_date(cell: Column) -> Column:
    """The date of a day number as workbooks store them; null where it is none."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(cell.try_cast("double")).cast("int"))


def workbook(headers: list[str], rows: list[list]) -> bytes:
    """A workbook of one sheet, its text in shared strings, numbers as numbers."""
    strings: dict[str, int] = {}

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    space, rel = MAIN[1:-1], LINK[1:-3]
    lines = "".join(f'<row r="{i}">{"".join(map(cell, row))}</row>' for i, row in enumerate([headers, *rows], 1))
    texts = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    members = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="{kind}.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData>{lines}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{space}">{texts}</sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, f"{head}{body}")
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, most: int = 100_000) -> DataFrame:
    """Writes each partition's rows as workbooks of at most ``most`` rows, and gives (path, n_rows) of each once it is run."""
    names, most = df.columns, min(most, MOST_ROWS - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, []

        def done(rows: list[list], k: int) -> pa.RecordBatch:
            path = f"{folder.rstrip('/')}/part-{part:05d}-{k:03d}.xlsx"
            fs, at = located(path)
            fs.create_dir(at.rsplit("/", 1)[0])
            with fs.open_output_stream(at) as sink:
                sink.write(workbook(names, rows))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(rows)], pa.int64())], names=["path", "n_rows"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(list(row))
                if len(held) == most:
                    yield done(held, k)
                    held, k = [], k + 1
        if held:
            yield done(held, k)

    return df.mapInArrow(run, "path string, n_rows long")
