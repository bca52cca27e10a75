"""Mixing where rows share ids, hashes and sources."""

from collections import Counter

import pytest

from bidloom.llm import mixing


def mixed(spark, made):
    return mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string, hash string, edge int, salt string")).collect()


def plain(rows):
    return [(i, t, s, None, None, None) for i, t, s in rows]


@pytest.mark.parametrize("other", [None, "s"])
def test_null_ids_go_one_by_one(spark, other):
    """A source without ids whose target is a third of its words, and one to give the rest to."""
    made = plain([(None, f"a b c d e f g x{i}", other) for i in range(500)] + [(1000 + i, f"w{i} " * 2, "a") for i in range(700)])
    rows = mixed(spark, made)
    taken = sum(r.size * r.copies for r in rows if r.source == other)
    target = next(r.target for r in rows if r.source == other)
    assert 0 < target < 4000 and abs(taken - target) <= 8


def test_equal_rows_are_split(spark):
    made = plain([(7, "one two three four five", "a")] * 300 + [(i, "x y", "b") for i in range(1000)])
    rows = mixed(spark, made)
    for source, size in (("a", 5), ("b", 2)):
        taken = sum(r.size * r.copies for r in rows if r.source == source)
        assert abs(taken - next(r.target for r in rows if r.source == source)) <= size
    again = mixed(spark, made)
    assert Counter((r.doc_id, r.size, r.source, r.copies) for r in rows) == Counter((r.doc_id, r.size, r.source, r.copies) for r in again)


def test_columns_of_any_name_pass(spark):
    df = spark.createDataFrame([(i, "a b", "s", i, "k", 1.5, "r") for i in range(20)], "doc_id long, text string, source string, __times int, key string, `whole.x` double, row string")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and got.count() == 20 and {r["__times"] for r in got.collect()} == set(range(20))
