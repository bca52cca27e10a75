"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is a line or sentence, or a sentence that runs over several lines of a paragraph (notices are often wrapped); of
the latter, words count that stand within twice a template's length, since unrelated lines meet there. A template is the
word set of one license notice; templates of several sentences, such as a license's whole grant or disclaimer, are
compared with whole paragraphs. Words of the templates are counted over
the whole corpus and ordered from rare to frequent. A block that holds at least THRESHOLD of a template's words must
hold one of the template's first n - need + 1 words in that order (prefix filter), must have `need` words (length
filter), and from the meeting point on both must have `need` words left (positional filter). What passes is verified.
The filters lose nothing, so every block at or above the threshold is found. Only the template index (its size is fixed
by TEMPLATES) is broadcast; texts are never shuffled.

Defined cases: null text counts as empty (no words, no labels, score 0); empty table gives an empty result; repeated
rows give repeated results; blocks of any length are compared whole; only doc_id and text are read, so columns with
clashing names do no harm.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

#: What stands between words, once A-Z are lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts lines and sentences, and what parts sentences whatever lines they run over.
LINE, SENTENCE, PARAGRAPH = r"[\n\r]+|[.!?]+(?=\s)", r"(?:\r\n?+|\n)[^\S\r\n]*[\r\n]\s*|[.!?]+(?=\s)", r"[\r\n][ \t\f]*[\r\n]\s*"
#: Phrases looked up as consecutive words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
#: Notices of common licenses, by label; sentences end in a full stop and a space. Words in capitals and numbers after
#: "version" must stand in a block.
TEMPLATES = {
    "agpl-3.0": "licensed under the gnu AFFERO general public license version 3",
    "agpl-3.0-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu AFFERO general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "apache-2.0": "licensed under the APACHE license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages. ",
    "bsl-1.0": "distributed under the BOOST software license version 1 0",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under CC BY NC 4 0",
    "cc-by-nc-4.0-text": "licensed under a creative commons attribution NONCOMMERCIAL 4 0 international license",
    "cc-by-sa-4.0": "licensed under CC BY SA 4 0",
    "cc-by-sa-4.0-text": "licensed under a creative commons attribution SHAREALIKE 4 0 international license",
    "cc0-1.0": "dedicated to the public domain under the creative commons cc0 1 0 universal waiver",
    "epl-2.0": "made available under the terms of the ECLIPSE public license 2 0",
    "gnu-disclaimer": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-2.0": "licensed under the gnu general public license version 2",
    "gpl-2.0-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "gpl-3.0-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-2.1": "licensed under the gnu LESSER general public license version 2 1",
    "lgpl-2.1-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu LESSER general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3.0": "licensed under the gnu LESSER general public license version 3",
    "lgpl-3.0-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu LESSER general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mit": "released under the MIT license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software. ",
    "mpl-2.0": "subject to the terms of the MOZILLA public license v 2 0",
    "unlicense": "this is free and UNENCUMBERED software released into the public domain",
}


def template_words(text: str) -> list[str]:
    return re.sub(GAP, " ", text.lower()).split()


def marked_words(text: str) -> list[str]:
    """The words that a block must hold: those in capitals, and the number after "version"."""
    return [w.lower() for w in re.findall(r"\b[A-Z][A-Z0-9]*\b|(?<=\bversion )\d+", text)]


def wider(templates: dict[str, str]) -> dict[str, list[str]]:
    """The templates, for each one, that hold all its words and more."""
    words = {label: set(template_words(text)) for label, text in templates.items()}
    return {a: [b for b in sorted(words) if words[a] < words[b]] for a in words}


def of_sentences(text: str) -> bool:
    return ". " in text


def spaced(text: Column) -> Column:
    """The words of a text, each once per occurrence, parted by single spaces."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, " "))


def spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base (array of labels) and words (spaced) to doc_id and mark."""
    any_phrase = "|".join(PHRASES)
    framed = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    hit = reduce(lambda a, b: a | b, [F.contains("framed", F.lit(f" {p} ")) for p in PHRASES])
    return (
        docs.withColumn("words", spaced(F.col("text")))
        .withColumn("framed", framed)
        .withColumn("hit", hit)
        .withColumn("n_words", F.when(F.col("words") == "", F.lit(0)).otherwise(spaces(F.col("words")) + 1).cast("long"))
        .withColumn("n_base", F.when(F.col("hit"), F.regexp_count("framed", F.lit(f" (?:{any_phrase})(?= )"))).otherwise(0).cast("long"))
        .withColumn("first_word", F.when(F.col("hit"), spaces(F.regexp_extract("framed", f"(?s)^(.*?) (?:{any_phrase}) ", 1))))
        .withColumn("last_word", F.when(F.col("hit"), spaces(F.regexp_extract("framed", f"(?s)^(.*) (?:{any_phrase}) ", 1))))
        .withColumn("base", F.array_compact(F.array(*[F.when(F.contains("framed", F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()])))
        .drop("framed", "hit")
    )


def template_index(spark: SparkSession, counts: DataFrame, templates: dict[str, str], threshold: float) -> tuple[DataFrame, dict[str, int]]:
    """(rank, at, label, n, need, long, wider, must, ranks) for the prefix words of each template, and the rank of every template word.

    counts: word, n over the corpus. Its rows, and so what comes to the driver, are at most the words of the templates."""
    seen = {r["word"]: r["n"] for r in counts.collect()}
    words = sorted({w for t in templates.values() for w in template_words(t)}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(words)}
    rows, over = [], wider(templates)
    listed = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    for label, text in sorted(templates.items()):
        ranks = sorted({rank[w] for w in template_words(text)})
        need = -int(-threshold * len(ranks) // 1)
        rows += [F.struct(F.lit(r).alias("rank"), F.lit(at).alias("at"), F.lit(label).alias("label"), F.lit(len(ranks)).alias("n"), F.lit(need).alias("need"), F.lit(of_sentences(text)).alias("long"), listed(over[label], "string").alias("wider"), listed([rank[w] for w in marked_words(text)], "int").alias("must"), listed(ranks, "int").alias("ranks")) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    return spark.range(1).select(F.inline(F.array(*rows))), rank


def contained_templates(docs: DataFrame, index: DataFrame, rank: dict[str, int], prefix: list[str]) -> DataFrame:
    """doc_id, mark, labels and best containment of the documents that hold a template."""
    by_rank = [w for w, _ in sorted(rank.items(), key=lambda x: x[1])]
    vocabulary = F.array(*map(F.lit, by_rank))
    to_rank = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    part = lambda c, wrapped, whole: F.transform(c, lambda x: F.struct(x.alias("block"), F.lit(wrapped).alias("wrapped"), F.lit(whole).alias("whole")))
    blocks = (
        docs.withColumn("low", ascii_lower(F.col("text")))
        .filter(F.col("low").rlike(rf"(?:^|{GAP[:-1]})(?:{'|'.join(prefix)})(?:$|{GAP[:-1]})"))
        .select("doc_id", "mark", F.posexplode(F.concat(part(F.split("low", LINE), False, False), part(F.filter(F.split("low", SENTENCE), lambda x: x.rlike(r"[\n\r]")), True, False), part(F.split(F.replace("low", F.lit("\r\n"), F.lit("\n")), PARAGRAPH), False, True))))
        .select("doc_id", "mark", F.col("pos").alias("k"), "col.*")
        .filter(F.col("block").rlike("|".join(prefix)))
        .withColumn("words", F.split(spaced(F.col("block")), " "))
        .withColumn("known", F.array_intersect("words", vocabulary))
        .withColumn("held", F.array_sort(F.transform("known", lambda w: F.element_at(to_rank, w))))
        .withColumn("ordered", F.when(F.col("wrapped"), F.transform("words", lambda w: F.coalesce(F.element_at(to_rank, w), F.lit(-1)))))
        .select("doc_id", "mark", "k", "whole", "held", "ordered", F.posexplode("held").alias("place", "rank"))
    )
    need_left = F.least(F.col("n") - F.col("at"), F.size("held") - F.col("place")) >= F.col("need")
    overlap = F.size(F.array_intersect("ranks", "held"))
    marked = lambda c: F.size(F.array_except("must", c)) == 0
    near = lambda w: F.when(marked(w), F.size(F.array_intersect("ranks", w))).otherwise(0)
    close = F.array_max(F.transform(F.sequence(F.lit(1), F.size("ordered")), lambda i: near(F.slice("ordered", i, F.col("n") * 2))))
    matches = (
        blocks.join(F.broadcast(index), "rank")
        .filter((F.col("whole") == F.col("long")) & (F.size("held") >= F.col("need")) & need_left & marked(F.col("held")))
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("need"))
        .withColumn("overlap", F.when(F.col("ordered").isNull(), F.col("overlap")).otherwise(close))
        .filter(F.col("overlap") >= F.col("need"))
    )
    # A block has at most as many matches as there are templates; only matches are shuffled.
    return (
        matches.groupBy("doc_id", "mark", "k")
        .agg(F.collect_set(F.struct("label", "wider", (F.col("overlap") / F.col("n")).alias("share"))).alias("found"))
        .withColumn("own", F.filter("found", lambda x: ~F.arrays_overlap(x["wider"], F.transform("found", lambda y: y["label"]))))
        .select("doc_id", "mark", F.inline("own"))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("label").alias("added"), F.max("share").alias("containment"))
    )


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a phrase stands, else the largest containment of a template that meets the threshold, else 0."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates.values() for w in template_words(t)})])
    digest = written(phrase_places(docs).withColumn("present", F.array_intersect(F.split("words", " "), vocabulary)).drop("text", "words"))
    counts = digest.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    index, rank = template_index(docs.sparkSession, counts, templates, threshold)
    by_rank = {r: w for w, r in rank.items()}
    prefix = sorted({by_rank[r["rank"]] for r in index.select("rank").collect()})
    found = written(contained_templates(docs, index, rank, prefix)).withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
    joined = digest.join(found, digest["doc_id"].eqNullSafe(found["found_id"]) & digest["mark"].eqNullSafe(found["found_mark"]), "left")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = lambda words: f"CAST({words} AS VARCHAR[])"
    values = ", ".join(f"('{label}', {listed(template_words(text))}, {listed(marked_words(text))}, {str(of_sentences(text)).lower()})" for label, text in TEMPLATES.items())
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH t AS (SELECT label, list_distinct(w) AS w, must, long FROM (VALUES {values}) v(label, w, must, long)),
over AS (SELECT a.label, b.label AS wider FROM t a JOIN t b ON len(b.w) > len(a.w) AND len(list_intersect(a.w, b.w)) = len(a.w)),
p AS (SELECT * FROM (VALUES {phrases}) v(phrase, label)),
d AS (SELECT row_number() OVER () AS uid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
n AS (SELECT uid, doc_id, low, list_filter(regexp_split_to_array(low, '{gap}'), lambda x: x <> '') AS w FROM d),
pos AS (SELECT uid, unnest(range(len(w))) AS i, w FROM n),
hits AS (SELECT uid, i, p.label FROM pos, p WHERE list_slice(w, i + 1, i + len(string_split(p.phrase, ' '))) = string_split(p.phrase, ' ')),
base AS (SELECT uid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY uid),
lf AS (SELECT uid, low, replace(low, chr(13) || chr(10), chr(10)) AS text FROM d),
b AS (SELECT row_number() OVER () AS k, uid, kind, list_filter(regexp_split_to_array(blk, '{gap}'), lambda x: x <> '') AS words
      FROM (SELECT uid, 'line' AS kind, unnest(regexp_split_to_array(low, '[\n\r]+|[.!?]+\s')) AS blk FROM lf
            UNION ALL SELECT uid, 'wrapped', unnest(regexp_split_to_array(text, '[\n\r][ \t\x0B\f]*[\n\r][ \t\n\x0B\f\r]*|[.!?]+[ \t\n\x0B\f\r]')) FROM lf
            UNION ALL SELECT uid, 'whole', unnest(regexp_split_to_array(text, '{PARAGRAPH}')) FROM lf)),
c AS (SELECT b.k, uid, kind, t.label, t.w, must, words, len(list_intersect(t.w, list_distinct(words))) AS o, len(t.w) AS n
      FROM b JOIN t ON (kind = 'whole') = t.long WHERE len(list_intersect(must, words)) = len(must)),
e AS (SELECT k, uid, label, n, CASE WHEN kind = 'wrapped' THEN list_max(list_transform(range(1, len(words) + 1), lambda i:
        CASE WHEN len(list_intersect(must, words[i:i + 2 * n - 1])) = len(must) THEN len(list_intersect(w, list_distinct(words[i:i + 2 * n - 1]))) ELSE 0 END)) ELSE o END AS o
      FROM c WHERE o >= ceil({THRESHOLD} * n)),
f AS (SELECT * FROM e WHERE o >= ceil({THRESHOLD} * n)),
m AS (SELECT uid, list(DISTINCT label) AS added, max(o / n) AS containment FROM f
      WHERE NOT EXISTS (SELECT 1 FROM over JOIN f AS g ON g.label = over.wider WHERE over.label = f.label AND g.k = f.k) GROUP BY uid)
SELECT n.doc_id, CAST(len(n.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(added, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(CAST(containment AS DOUBLE), 0.0::DOUBLE) END AS score
FROM n LEFT JOIN base USING (uid) LEFT JOIN m USING (uid)
"""


OP10_SQL = _oracle()
