"""Cells of uploaded workbooks (xlsx), as rows of a table.

A workbook is an archive of XML parts. A task unpacks its first sheet and its shared strings as streams and gives a row for
each cell and for each string; Spark joins cells with strings by file and number and puts lines together. One workbook is
one task's unpacking, as are its bytes; many workbooks are many tasks.

Texts of cells: shared and inline strings (rich text joined, phonetic notes left out), True and False, whole numbers without
a point, other numbers as Python writes them, dates (numbers whose style shows a day or an hour) as 2024-01-31 00:00:00;
errors and missing cells are empty. Defined cases: lines without text are dropped, the line numbers of the others stay; cells
without a place follow the one before; a sheet without lines gives no rows; of equal headings the first counts; columns
without a heading are dropped; a file that is no workbook raises.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in a batch.
ROWS = 20_000
PARTS = "file string, kind string, row int, col int, text string"
# Numbers of the built-in formats that show dates or times.
DATES = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def column_number(place: str) -> int:
    """The column of a place such as AB12, from 0."""
    n = 0
    for c in re.match("[A-Z]*", place)[0]:
        n = n * 26 + ord(c) - ord("A") + 1
    return n - 1


def joined_text(e: ET.Element) -> str:
    """The text of a string, without phonetic notes."""
    return "".join("".join(p.text or "" for p in ([x] if local(x.tag) == "t" else x) if local(p.tag) == "t") for x in e if local(x.tag) in ("t", "r"))


def shows_date(code: str) -> bool:
    """Whether a format's code, without its quoted, escaped and bracketed parts, shows a day or an hour."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())
    return bare != "general" and re.search("[dmyhs]", bare) is not None


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): shows_date(e.get("formatCode", "")) for e in root.iter() if local(e.tag) == "numFmt"}
    cells = next((e for e in root if local(e.tag) == "cellXfs"), ())
    ids = [int(x.get("numFmtId", 0)) for x in cells]
    return {k for k, n in enumerate(ids) if own.get(n, n in DATES)}


def first_sheet(z: zipfile.ZipFile) -> tuple[str, bool]:
    """The part that holds the first sheet, and whether days count from 1904."""
    book = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = next(e for e in book.iter() if local(e.tag) == "sheet")
    key = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    target = next(e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if e.get("Id") == key)
    late = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"), late


def number_text(value: str, dated: bool, late: bool) -> str:
    n = float(value)
    if dated:
        start = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30) if n >= 60 else dt.datetime(1899, 12, 31)
        return str(start + dt.timedelta(seconds=round(n * 86_400)))
    return str(int(n)) if n.is_integer() else repr(n)


def cell_text(e: ET.Element, dates: set[int], late: bool) -> tuple[str, str]:
    """What a cell is ("shared" or "cell") and its text: of a shared string its number."""
    kind, value = e.get("t", "n"), next((x.text or "" for x in e if local(x.tag) == "v"), "")
    if kind == "inlineStr":
        return "cell", next((joined_text(x) for x in e if local(x.tag) == "is"), "")
    if kind == "e" or not value:
        return "cell", ""
    if kind == "b":
        return "cell", str(value == "1")
    if kind == "n":
        return "cell", number_text(value, int(e.get("s", 0)) in dates, late)
    return ("shared" if kind == "s" else "cell"), value


def parts_of(z: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    """(kind, row, col, text): the first sheet's cells with text, and the shared strings by their number in row."""
    sheet, late = first_sheet(z)
    dates, row, col, n = date_styles(z), 0, -1, 0
    with z.open(sheet) as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start" and local(e.tag) == "row":
                row, col = int(e.get("r", row + 1)), -1
            elif event == "end" and local(e.tag) == "c":
                col = column_number(e.get("r", "")) if e.get("r") else col + 1
                kind, text = cell_text(e, dates, late)
                if text:
                    yield kind, row, col, text
            elif event == "end" and local(e.tag) == "row":
                e.clear()
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, e in ET.iterparse(f):
                if local(e.tag) == "si":
                    yield "string", n, 0, joined_text(e)
                    n += 1
                    e.clear()


def of_uploads(uploads: DataFrame) -> DataFrame:
    """file, row, col, text: the cells with text of each workbook's first sheet. uploads: file, content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            held = []
            with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
                for part in parts_of(z):
                    held.append((r["file"], *part))
                    if len(held) == ROWS:
                        yield batch(held)
                        held = []
            yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True) if held else [[]] * 5, types, strict=True)], ["file", "kind", "row", "col", "text"])

    parts = uploads.select("file", "content").mapInArrow(read, PARTS)
    strings = parts.filter("kind = 'string'").select("file", F.col("row").cast("string").alias("number"), F.col("text").alias("shared"))
    cells = parts.filter("kind <> 'string'").withColumn("number", F.when(F.col("kind") == "shared", F.col("text")))
    text = F.when(F.col("kind") == "shared", F.col("shared")).otherwise(F.col("text"))
    return cells.join(strings, ["file", "number"], "left").select("file", "row", "col", text.alias("text")).filter("text <> ''")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file, row, col, text of all workbooks at a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path)
    return of_uploads(files.select(F.col("path").alias("file"), "content"))


def lines(cells: DataFrame) -> DataFrame:
    """file, row, fields (heading to text): the lines below each workbook's heading, its first line with text."""
    top = cells.withColumn("first", F.min("row").over(Window.partitionBy("file")))
    heads = top.filter("row = first").select("file", "col", F.trim("text").alias("heading"), F.row_number().over(Window.partitionBy("file", F.trim("text")).orderBy("col")).alias("k")).filter("k = 1 AND heading <> ''").drop("k")
    below = top.filter("row > first").select("file", "row", "col", "text").join(heads, ["file", "col"])
    return below.groupBy("file", "row").agg(F.map_from_entries(F.collect_list(F.struct("heading", "text"))).alias("fields"))


def as_table(cells: DataFrame) -> DataFrame:
    """The lines of one workbook's cells as text columns in the order of its heading, with row; missing cells are empty texts.

    row counts the lines with text, the heading being the first, as for other uploads; a sheet has at most 1,048,576 of them."""
    first = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.trim("text").alias("heading")))).alias("cells")).orderBy("row").limit(1).collect()
    heading = list(dict.fromkeys(c["heading"] for r in first for c in r["cells"] if c["heading"]))
    return lines(cells).withColumn("row", F.row_number().over(Window.orderBy("row")) + 1).select("row", *[F.coalesce(F.col("fields")[h], F.lit("")).alias(h) for h in heading])
