"""Spelling variants: words one inserted, deleted or replaced character apart, by merging the light subtrees of a trie.

The trie of all words has a node for each beginning. At every node the child with most words below is heavy, the others
and a word that ends there are light; a word passes at most a logarithm of light children. Merging the light subtrees into
what lies beside them, small to large, compares a word at each of its light places only:

* with its character replaced by the heavy one: coincides with a word of the heavy subtree;
* with its character open: coincides with words of other light subtrees (a group of at most as many words as letters);
* with its character skipped, where it is the last of its run: coincides with the shorter word, wherever it is;
* with the heavy character put before it: coincides with the longer word of the heavy subtree.

A pair is found by exactly one of these, so near words are counted without listing pairs of a group. Spark counts the
nodes' children by hash of the beginning (where two nodes share a hash, both take one heavy child, which changes the work
and not the result), sends the places that are light back to their words, and finds coinciding terminals by joins and
groupings on the whole strings. Nodes under which a 1/TOP_SHARE of all places lies are at most TOP_SHARE, and joined by
broadcast; all others are small keys. Words are counted per task before they are shuffled.

Defined cases: null texts have no words and null ids read as empty; texts and words of any length are read whole; words
alike up to A-Z count as one, other capitals stay; repeated rows count as often as they stand; ties of n go to the word
that is first in code points; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, settle, table, tidy, written

LETTERS = "A-Za-zÀ-ÿ"
#: Least length and occurrences of a word, and how much more frequent its form must be.
SHORTEST, LEAST, RATIO = 6, 5, 5
#: Distinct words that a task holds before it passes their counts on.
HELD = 400_000
#: Nodes with more than this share of all places below are joined by broadcast, and so many at most.
TOP_SHARE = 20_000
#: Where a word ends, in place of a letter.
END = -1


def slip(doc_id: str, run: str) -> str:
    """Deletes one letter of a run, by a hash of document and run, in one of 199 cases."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 199 else run[:at] + run[at + 1 :]


def counted(docs: DataFrame, change: Callable[[str, str], str] | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """docs: doc_id, text. word, n of the runs of letters with at least so many letters and occurrences, A-Z in lower case. change: what becomes of a document's run."""
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                found = Counter(runs.findall(text.lower().decode()))  # of bytes: only A-Z
                if change is None:
                    held.update(found)
                else:
                    for run, n in found.items():
                        word = change(doc_id or "", run)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(tidy(count), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def places(words: DataFrame) -> DataFrame:
    """words: id, word. A row for each character of a word and its end: node (hash of what stands before), place, letter, id."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts, start, size = whole.column("word").to_pylist(), 0, 0
            for k, t in enumerate(texts):
                size += len(t) + 1
                if size > 1 << 18 or k + 1 == len(texts):
                    yield of(texts[start : k + 1], whole.column("id").slice(start, k + 1 - start))
                    start, size = k + 1, 0

    def of(texts: list[str], ids: pa.Array) -> pa.RecordBatch:
        sizes = np.array([len(t) + 1 for t in texts])
        letters = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        at = np.arange(len(letters)) - np.repeat(begins, sizes)
        each = mix64((at.astype(np.uint64) << np.uint64(32)) + letters.astype(np.uint64) + np.uint64(1))
        passed = np.bitwise_xor.accumulate(each) ^ each  # of all that stands before, in earlier words too
        node = passed ^ np.repeat(passed[begins], sizes)
        letters[begins + sizes - 1] = END
        columns = [pa.array(node.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(letters.astype(np.int32)), ids.take(pa.array(np.repeat(np.arange(len(texts)), sizes)))]
        return pa.RecordBatch.from_arrays(columns, ["node", "place", "letter", "id"])

    return words.select("id", "word").mapInArrow(tidy(spread), "node long, place int, letter int, id long")


def light_places(words: DataFrame) -> DataFrame:
    """word, n, place, letter, heavy: the places at which a word leaves the heavy path, and the letter by which that goes on."""
    every = written(places(words), "zstd")
    children = every.groupBy("node", "letter").agg(F.count("*").alias("n"))
    heavy = F.max_by("letter", F.when(F.col("letter") != END, F.struct(F.col("n"), -F.col("letter"))))
    nodes = settle(children.groupBy("node").agg(heavy.alias("heavy"), F.count("*").alias("children"), F.sum("n").alias("below")).filter("children > 1").drop("children"))
    top = F.col("below") >= F.lit(every.count() / TOP_SHARE)
    large, small = nodes.filter(top).drop("below"), nodes.filter(~top).drop("below")
    light = every.join(F.broadcast(large), "node").unionByName(every.join(small, "node")).filter("letter != heavy")
    return light.join(words, "id").select("word", "n", "place", "letter", F.expr("char(heavy)").alias("heavy"))


def near(words: DataFrame) -> DataFrame:
    """words: word, n. word, n_near and its best near word (form, form_n) for every word that has near words; ties to the first in code points."""
    words = written(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "zstd")
    light = written(light_places(words), "zstd")
    before, own, after = F.substring("word", 1, F.col("place")), F.substring("word", F.col("place") + 1, F.lit(1)), F.expr("substring(word, place + 2)")
    inner = F.col("letter") != END
    last_of_run = own != F.substring("word", F.col("place") + 2, F.lit(1))
    probes = F.array(F.when(inner, F.concat(before, "heavy", after)), F.when(inner & last_of_run, F.concat(before, after)), F.concat(before, "heavy", own, after))
    asked = light.select("word", "n", F.explode(probes).alias("other")).filter("other is not null")
    pairs = asked.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = lambda n, word: F.struct((-n).alias("less"), word.alias("word"))
    ways = F.array(F.struct(F.col("word"), best(F.col("other_n"), F.col("other")).alias("best")), F.struct(F.col("other").alias("word"), best(F.col("n"), F.col("word")).alias("best")))
    single = pairs.select(F.explode(ways).alias("way")).select("way.word", F.lit(1).cast("long").alias("n_near"), "way.best")
    groups = light.filter(inner).groupBy(before.alias("before"), after.alias("after")).agg(F.sort_array(F.collect_list(best(F.col("n"), F.col("word")))).alias("members"))
    member = groups.filter(F.size("members") > 1).select("members", F.posexplode("members").alias("at", "own"))
    grouped = member.select("own.word", (F.size("members") - 1).cast("long").alias("n_near"), F.when(F.col("at") == 0, F.col("members")[1]).otherwise(F.col("members")[0]).alias("best"))
    found = single.unionByName(grouped).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (not null). word, root: the last word that forms lead to. A form is RATIO times as frequent, so the ways are short; each round doubles what is followed."""
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = settle(state.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not state.filter("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: word, n. Adds n_near (words one edit away), form (its near word of largest n, where that is `ratio` times its own), form_n and root."""
    taken = F.col("form_n") >= ratio * F.col("n")
    all_near = settle(near(words).withColumn("form", F.when(taken, F.col("form"))).withColumn("form_n", F.when(taken, F.col("form_n"))))
    return all_near.join(roots(all_near.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(table(spark, sf_dir, "documents"), slip))


#: The CRC-32 of a list of bytes, as SQL: a table of 256 entries and one step for each byte.
CRC32_SQL = """
crc_table AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS crc_list FROM range(256) AS t(n))
"""


def crc32_sql(blob: str) -> str:
    """SQL for the CRC-32 of a blob, in a query that has crc_table in its FROM."""
    codes = f"list_transform(range(octet_length({blob})), lambda i: CAST('0x' || substr(hex({blob}), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc_list[(xor(c, b) & 255) + 1])), 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE {CRC32_SQL.strip()},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{{6,}}')) AS run FROM documents),
by_doc AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM by_doc, crc_table),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gaps AS (SELECT word, n, k, left(word, k - 1) AS a, substr(word, k + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word != y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM pairs GROUP BY word),
first AS (SELECT p.word, min(other) AS other FROM pairs p JOIN best b ON p.word = b.word AND p.other_n = b.most GROUP BY p.word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word) LEFT JOIN first USING (word)),
ways AS (SELECT word, word AS at FROM formed UNION ALL SELECT ways.word, form FROM ways JOIN formed ON formed.word = ways.at WHERE form IS NOT NULL)
SELECT f.word, f.form, ways.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN ways ON ways.word = f.word JOIN formed last ON last.word = ways.at AND last.form IS NULL
"""
