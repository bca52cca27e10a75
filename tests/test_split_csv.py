import csv
import random

import pytest

from bidloom.sources import extracts
from bidloom.sources.split_csv import lines, read_split

COLUMNS = ["lot_id", "subject", "note"]


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, delimiter=";", lineterminator=end).writerows([COLUMNS, *rows])


def made(seed, n):
    rng = random.Random(seed)
    parts = ["text", '"quoted"', "a;b", "line\nbreak", "\n\n", "é ю", '""', "  ", 'end"', "long " * 40]
    return [[str(k), "".join(rng.choice(parts) for _ in range(rng.randint(1, 6))), rng.choice(["x", "y\nz", "1;2"])] for k in range(n)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["500", "3k", "128m"])
def test_equals_the_reader_of_whole_files(spark, tmp_path, size, end):
    rows = made(len(size), 400)
    rows[7][1] = "one record over many ranges\n" * 300
    for k in range(2):
        written(f"{tmp_path}/{k}.csv", rows[k::2], end)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        if size != "128m":
            assert lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = found(read_split(spark, str(tmp_path), COLUMNS))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == sorted(map(tuple, rows))
    assert got == found(extracts.read_extract(spark, str(tmp_path), COLUMNS))


def test_defined_cases(spark, tmp_path):
    (tmp_path / "a.csv").write_text('lot_id;subject;note\n1;"open\nto the end";x', encoding="utf-8")
    (tmp_path / "b.csv").write_text("lot_id;subject;note\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("lot_id;subject;note\n\n2;;\n\n", encoding="utf-8")
    got = {r["lot_id"]: r["subject"] for r in read_split(spark, str(tmp_path), ["subject", "lot_id"]).collect()}
    assert got == {"1": "open\nto the end", "2": None}
