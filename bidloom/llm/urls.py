"""URL filter: a tree of path templates per host, rejected by smoothed labelled purity.

Labels are the verdicts of the rule list, which cover part of the urls. A host's tree is opened from the root on wherever
the labels under a node disagree, at the first level that tells them apart. Segments that are numbers, ids or dates, and
those with less than RARE of a node's urls or fewer than LEAST of them, are variable: a wildcard. The others are at most
1 / RARE of a node; those with LEAST labels are ordered by their share of blocked ones and part where neighbours in that
order differ by APART standard errors or more; what lies between two such places is one branch, named by its segments, and
those of which too little is known are another. A node that no level tells apart stays one: on levels passed over, and
below the last, its fixed segments are alike and merge into one name. Every round of the loop parts labels, so there is no
limit of depth and no round for levels that tell nothing.

A node's purity is its blocked share, shrunk towards its parent's, a host's towards the share of all labelled urls; a url
that no rule judges is blocked where the purity of its template reaches LIMIT. All stages are DataFrame operations over
counts of distinct shaped paths, so a host with a third of all urls is as many rows as it has shapes.

Defined cases: null urls and urls without "://" have empty host and path and are judged like any other host's; an empty
table gives an empty result; repeated rows count as often as they stand; only page_id and url are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, attach, settle, table

#: (host, path prefix, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Branches stay apart from this difference on, in standard errors; labels that a branch needs to be compared, and urls that a segment needs to be told from a variable one.
APART, LEAST = 2.58, 5
#: Of a node's urls, what a segment needs to be a fixed part of it.
RARE = 0.01
#: Pseudo-counts of the parent's purity, and the purity from which a template is rejected.
SMOOTHING, LIMIT = 8.0, 0.5
WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain and begins the path; else null."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest]
    return F.coalesce(*fits)


def shaped(path: Column) -> Column:
    """The path's segments, those that hold numbers or ids as shapes."""
    shape = lambda s: reduce(lambda c, x: F.regexp_replace(c, *x), ((r"^[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*(?=\.|$)", "<id>"), (r"\d+", "<n>")), s)
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)


def variable(part: Column) -> Column:
    return part.contains("<n>") | part.contains("<id>")


def shrunk(b: Column, n: Column, parent: Column) -> Column:
    return (b + F.lit(SMOOTHING) * parent) / (n + F.lit(SMOOTHING))


def rest() -> Column:
    return F.slice("parts", F.col("level") + 1, F.greatest(F.size("parts") - F.col("level"), F.lit(0)))


def fixed_parts(rows: DataFrame, parts: Column) -> DataFrame:
    """template, at, part, n, b (blocked), l (labelled), mixed: segments that are fixed parts of their node."""
    sums = [F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l")]
    nodes = rows.groupBy("template").agg(*sums).select("template", F.col("n").alias("all_n"), ((F.col("b") > 0) & (F.col("b") < F.col("l"))).alias("mixed"))
    seen = rows.select("template", "n", "blocked", "labelled", F.posexplode(parts).alias("at", "part")).filter(~variable(F.col("part"))).groupBy("template", "at", "part").agg(*sums)
    return seen.filter(F.col("n") >= LEAST).join(nodes, "template").filter(F.col("n") >= F.lit(RARE) * F.col("all_n")).drop("all_n")


def branches(rows: DataFrame) -> DataFrame:
    """template, at, part, name: where a node's rest tells its labels apart, and the branch of each fixed segment there."""
    fixed = fixed_parts(rows, rest()).filter("mixed").withColumn("known", F.col("l") >= LEAST)
    order = Window.partitionBy("template", "at", "known").orderBy("share", "part")  # at most 1 / RARE rows
    pooled = F.try_divide(F.col("b") + F.col("b0"), F.col("l") + F.col("l0"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "l") + F.try_divide(F.lit(1), "l0")))
    parted = F.coalesce(F.col("share") - F.try_divide("b0", "l0") > F.lit(APART) * error, F.lit(False))
    placed = (
        fixed.withColumn("share", F.when(F.col("known"), F.try_divide("b", "l"))).withColumn("b0", F.lag("b").over(order)).withColumn("l0", F.lag("l").over(order))
        .withColumn("place", F.when(F.col("known"), F.sum(parted.cast("int")).over(order)).otherwise(-1))
    )
    found = placed.groupBy("template", "at", "place").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    first = placed.filter("place > 0").groupBy("template").agg(F.min("at").alias("at"))
    return found.join(first, ["template", "at"]).select("template", "at", F.explode("parts").alias("part"), F.array_join("parts", "|").alias("name"))


def extended(rows: DataFrame, upto: Column) -> DataFrame:
    """Adds to each template the next `upto` segments of its rows: the merged fixed ones of the node, else a wildcard."""
    rows = rows.withColumn("next", F.slice(rest(), F.lit(1), upto))
    merged = fixed_parts(rows, F.col("next")).groupBy("template", "at").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    fixed = merged.groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("at", "parts"))).alias("fixed"))
    named = attach(rows, settle(fixed), "template", "left")
    names = F.transform("next", lambda s, i: F.when(F.array_contains(F.try_element_at("fixed", i), s), F.array_join(F.try_element_at("fixed", i), "|")).otherwise(WILD))
    return named.withColumn("template", F.concat_ws("/", "template", F.when(F.col("fixed").isNull(), F.transform("next", lambda s: F.lit(WILD))).otherwise(names))).drop("next", "fixed")


def templates(counts: DataFrame) -> DataFrame:
    """counts: host, parts, n, labelled, blocked. Returns host, parts, template, purity for each of them."""
    start = counts.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    overall = (start["b"] or 0) / start["l"] if start["l"] else 0.0
    hosts = counts.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).select("host", shrunk(F.col("b"), F.col("l"), F.lit(overall)).alias("purity"))
    live = settle(attach(counts, hosts, "host", "inner").withColumn("template", F.col("host")).withColumn("level", F.lit(0)))
    done = None
    while True:
        named = settle(branches(live))
        nodes = settle(named.groupBy("template").agg(F.first("at").alias("at")))
        closed = attach(live, nodes.select("template"), "template", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        if not nodes.limit(1).count():
            break
        moved = attach(live, nodes, "template", "inner").withColumn("part", F.try_element_at(rest(), F.col("at") + 1))
        moved = extended(attach(moved, named.drop("at"), ["template", "part"], "left"), F.col("at"))
        moved = moved.withColumn("template", F.when(F.col("part").isNull(), F.concat("template", F.lit("/"))).otherwise(F.concat_ws("/", "template", F.coalesce("name", F.lit(WILD)))))
        moved = settle(moved.withColumn("level", F.col("level") + F.col("at") + 1))
        found = moved.groupBy("template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.max("purity").alias("parent"))
        found = settle(found.select("template", shrunk(F.col("b"), F.col("l"), F.col("parent")).alias("purity")))
        live = settle(attach(moved.drop("purity"), found, "template", "inner").select(*live.columns))
    return extended(settle(done), F.size(rest())).select("host", "parts", "template", "purity")


def judge(pages: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per page."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by_rule", ruled(F.col("host"), F.col("path"), rules)).withColumn("parts", shaped(F.col("path")))
    counts = settle(
        urls.groupBy("host", "parts").agg(
            F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.count_if(F.col("by_rule.verdict") == "block").alias("blocked")
        )
    )
    judged = attach(urls, settle(templates(counts)), ["host", "parts"], "inner")
    return judged.select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce("by_rule.verdict", F.when(F.col("purity") >= limit, "block").otherwise("allow")).alias("verdict"), "template", "purity",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
