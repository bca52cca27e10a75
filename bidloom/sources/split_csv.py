"""Quoted separated text read by many tasks, line breaks inside quotes included.

A reader that allows line breaks in fields takes each file as one task. Here a file's byte ranges are read as lines by tasks
of their own, twice. The first pass counts the quotes of each range; their sums before a range say whether it begins inside a
quoted field. The second joins lines to records: one ends with the first line after which the quotes are even. What stands
before the first and after the last end of a range's records are pieces, at most two a range, which are joined in order of the ranges.
Records are then parsed one by one, as the lines of any separated text.

Defined cases: quotes inside a field are doubled (two quotes count as none open); a file without a line break at its end
ends its last record; a record over many ranges is joined from all of them; lines may end with a carriage return; blank
lines between records are no records; an empty file has no rows. Fields that hold single quotes without being quoted are
read wrongly, as there is no way to tell where they end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.functions.lineage import settled

RANGE = ["file", "start"]
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range that a task reads), line, quotes: in order within each range."""
    rows = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return rows.select("file", "start", F.col("value").alias("line"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))


def opened(rows: DataFrame) -> DataFrame:
    """file, start, inside: whether a range begins inside a quoted field; one row for each range."""
    sums = settled(rows.groupBy(*RANGE).agg(F.sum("quotes").alias("quotes")))
    before = F.coalesce(F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*RANGE, (before % 2 == 1).alias("inside"))


def records(spark: SparkSession, path: str, broadcast_ranges: int = 100_000) -> DataFrame:
    """file, start, record: the text of each record, line breaks inside it kept."""
    rows = lines(spark, path)
    ranges = settled(opened(rows))
    if ranges.limit(broadcast_ranges + 1).count() <= broadcast_ranges:
        marked = rows.join(F.broadcast(ranges), RANGE)
    else:  # a range's lines stay in order only while they aren't shuffled
        numbered = rows.withColumn("n", F.monotonically_increasing_id()).join(ranges, RANGE)
        marked = numbered.repartition(*RANGE).sortWithinPartitions(*RANGE, "n").drop("n")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, odd, head = None, [], False, False
        out: list[tuple[str, int, int, str]] = []

        def end() -> None:
            if place is not None and held:
                out.append((*place, MIDDLE if head else TAIL, "\n".join(held)))

        for b in batches:
            for file, start, line, quotes, inside in zip(*(b.column(c).to_pylist() for c in ("file", "start", "line", "quotes", "inside")), strict=True):
                if (file, start) != place:
                    end()
                    place, held, odd, head = (file, start), [], inside, inside
                held.append(line)
                odd ^= quotes % 2 == 1
                if not odd:
                    out.append((*place, HEAD if head else WHOLE, "\n".join(held)))
                    held, head = [], False
            yield batch(out)
            out = []
        end()
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], ["file", "start", "kind", "record"])

    found = settled(marked.mapInArrow(join, "file string, start long, kind int, record string"))
    pieces = found.filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", F.col("kind") == TAIL)
    begun = pieces.withColumn("n", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    joined = begun.groupBy("file", "n").agg(F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", (F.col("kind") == TAIL).alias("late"), "record"))), lambda x: x["record"]), "\n").alias("record"))
    return found.filter(F.col("kind") == WHOLE).select(*RANGE, "record").unionByName(joined.select(*RANGE, "record"))


def read_split(spark: SparkSession, path: str, columns: list[str], sep: str = ";") -> DataFrame:
    """The columns of a separated text with a heading, all as text. Files of one path share their heading."""
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    header = spark.read.options(sep=sep, quote='"', escape='"', header=True).csv(path).limit(0).columns
    schema = ", ".join(f"`{c}` STRING" for c in header)
    rows = records(spark, path).select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record != ''")
    parsed = rows.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
    heading = F.lit(True)
    for c in header:
        heading = heading & F.coalesce(F.col(f"`{c}`") == c, F.lit(False))
    return parsed.filter(~heading).select(*[f"`{c}`" for c in columns])
