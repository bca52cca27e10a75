"""XML records in zip archives, each member read by a task of its own.

The first pass reads only the directory at an archive's end and gives a row for each member: where its bytes begin, how
many they are and how they are packed. These rows are dealt out, and a task reads its member's bytes as a stream, unpacks
and parses them piece by piece; it holds one piece and one record, whatever the size of archive or member. Archives are
opened by pyarrow's file systems (local and mounted paths, HDFS, S3), which read ranges.

Defined cases: members are chosen by the end of their names, in any case; folders and empty members have no records; an
archive without such members has no rows; broken archives or members, and ways of packing other than stored and deflated,
raise; a member that stands twice in a directory is read twice; a path without archives gives an empty result.
"""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.functions.lineage import settled

#: Bytes of a member that are read at once, and records in a batch.
PIECE, RECORDS = 1 << 20, 500
#: A member's local header: its length and where the lengths of name and extra field stand.
LOCAL, LENGTHS = 30, 26
MEMBERS = "path string, member string, at long, packed long, method int"


def opened(path: str) -> BinaryIO:
    """A file that can be read anywhere. Paths come as Spark lists them, so nothing in them is escaped."""
    scheme, _, rest = path.partition(":") if re.match(r"[a-z][a-z0-9+.-]+:/", path) else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if rest.startswith("/") else rest)
    host, _, inside = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return system.open_input_file(f"{base.rstrip('/')}/{inside}")


def members(spark: SparkSession, path: str, ends: str = ".xml", glob: str = "*.zip") -> DataFrame:
    """path, member, at (byte of its local header), packed (bytes), method: one row for each member of the archives at a path."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in (p for b in batches for p in b.column("path").to_pylist()):
            with opened(p) as f, zipfile.ZipFile(f) as z:
                own = [m for m in z.infolist() if m.filename.lower().endswith(ends) and m.file_size]
            columns = [[p] * len(own), [m.filename for m in own], [m.header_offset for m in own], [m.compress_size for m in own], [m.compress_type for m in own]]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "member", "at", "packed", "method"])

    archives = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")  # the content isn't read
    return archives.mapInArrow(listed, MEMBERS)


def unpacked(f: BinaryIO, at: int, packed: int, method: int) -> Iterator[bytes]:
    """A member's bytes in pieces."""
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"members packed by method {method} can't be read")
    f.seek(at)
    name, extra = struct.unpack_from("<HH", f.read(LOCAL), LENGTHS)
    f.seek(at + LOCAL + name + extra)
    inflate = zlib.decompressobj(-zlib.MAX_WBITS) if method == zipfile.ZIP_DEFLATED else None
    while packed:
        piece = f.read(min(PIECE, packed))
        if not piece:
            raise ValueError("a member ends before its bytes do")
        packed -= len(piece)
        if inflate is None:
            yield piece
            continue
        while piece:  # highly packed pieces are unpacked bit by bit
            yield inflate.decompress(piece, PIECE)
            piece = inflate.unconsumed_tail
    if inflate is not None:
        yield inflate.flush()
        if not inflate.eof:
            raise ValueError("a member ends before its text does")


def elements(pieces: Iterator[bytes], tag: str) -> Iterator[str]:
    """The elements of a tag as texts, each as soon as it ends; what was read is let go."""
    parser, root = ET.XMLPullParser(("start", "end")), None

    def ended() -> Iterator[str]:
        nonlocal root
        for event, e in parser.read_events():
            root = e if root is None else root
            if event == "end" and e.tag == tag:
                e.tail = None
                yield ET.tostring(e, "unicode")
                root.clear()

    for piece in pieces:
        parser.feed(piece)
        yield from ended()
    parser.close()
    yield from ended()


def records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """path, member, record: the elements of a tag in all XML members of the archives at a path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            with opened(row["path"]) as f:
                held = []
                for e in elements(unpacked(f, row["at"], row["packed"], row["method"]), tag):
                    held.append(e)
                    if len(held) == RECORDS:
                        yield batch(row, held)
                        held = []
                yield batch(row, held)

    def batch(row: dict, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([row["path"]] * n, [row["member"]] * n, held)], ["path", "member", "record"])

    # Members are numbered in one task, which sees a line for each; a task a member then reads their bytes.
    found = settled(members(spark, path).withColumn("n", F.row_number().over(Window.orderBy("path", "at")) - 1))
    return found.repartitionById(max(1, found.count()), "n").drop("n").mapInArrow(read, "path string, member string, record string")
