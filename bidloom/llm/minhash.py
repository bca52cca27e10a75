"""Near-duplicate documents: MinHash bands for candidates, sequential Bayesian verification, exact check of survivors.

1. One pass over the texts makes, per document, the number of distinct five-word shingles, a hash of that set (its
   class: documents with equal sets, told apart by 128 bits), BANDS band hashes and a signature of one byte per hash.
2. Bands that hold two classes or more give candidates without listing pairs: each band has a hub (random per band), and
   every class of it is compared with the hub. Signatures are compared a batch of hashes at a time; a pair goes on
   while the posterior probability that its similarity reaches the threshold (uniform prior) is at least MISS.
3. Each class's most similar surviving hub is checked on the full sets, and components are formed.
4. Bands (of two classes too) that still hold several components are compared in blocks of bounded size, only across components. In rounds,
   each component of a block has its most similar surviving pairs checked on the full sets, more of them each time;
   between rounds components merge, and blocks with one component or no unchecked pair drop out. What is left then is
   few blocks with many pairs that survive by signature but not by set: these get the sets themselves and check every
   surviving pair inside the task. Pairs inside a component are never needed, so a group of copies costs about as many
   checks as it has members, and no link is lost.

Only the texts of classes in shared bands are read a second time. Defined cases: null and empty texts and texts without
words have an empty set, link with nothing and are kept; shorter texts than five words are one shingle; documents with
equal sets are one class whatever their order or case; rows that repeat belong to one component; null ids are the last
to be chosen; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, attach, binary_list, mix64, rekeyed, settle, slices, table, tidy, written
from .graph import components

WIDTH = 5
#: A document pair of the threshold similarity shares no band with a probability of about 4e-6.
BANDS, ROWS = 32, 7
#: Hashes compared at a time, and the posterior probability of missing below which a pair is dropped.
BATCH, MISS = 32, 1e-6
#: Links need 100 * intersection >= PERCENT * union, unless the caller names another threshold (with bands to suit it).
PERCENT = 85
#: Members of a band that are compared in one block.
BLOCK = 1024
#: Pairs that each component of a block sends to the exact check, by round; after these, blocks with more check them all on the spot.
ROUNDS = (2, 8)

_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Scheme(NamedTuple):
    """The threshold in per cent, and the bands by which pairs of that similarity meet."""

    percent: int = PERCENT
    bands: int = BANDS
    rows: int = ROWS

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def fits(self, both, a, b):
        """Whether sets of sizes a and b with so many common members are linked."""
        return 100 * both >= self.percent * (a + b - both)


@cache
def factors(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors of the hashes, and of the values in each band."""
    rng = np.random.default_rng(20240229)
    rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64)
    turn = rng.integers(1, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return turn, rng.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The text's set of shingles as sorted 64-bit hashes. bytes.split parts at ASCII white space and bytes.lower changes A-Z only."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(words) < WIDTH:
            s = (h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h))
        else:
            s = sum(h[k : len(h) - WIDTH + 1 + k] * _PLACE[k] for k in range(WIDTH))
        return np.unique(mix64(s))


def names(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit hashes of each set; null for empty ones."""
    whole = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
    empty = np.array([not len(s) for s in sets], bool)
    return [pa.array(np.array([(x >> shift) & 0xFFFFFFFFFFFFFFFF for x in whole], np.uint64).view(np.int64), mask=empty) for shift in (0, 64)]


def signatures(sets: list[np.ndarray], turn: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets, a row for each."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(turn), len(sets)), np.uint32)
    turned = np.empty_like(flat)
    for k, a in enumerate(turn):
        np.multiply(flat, a, out=turned)
        np.minimum.reduceat(turned, starts, out=out[k])
    return out.T


def _digest(scheme: Scheme, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn, band = factors(scheme.bands, scheme.rows)
    for whole in batches:
        ids, marks, texts = whole.column("doc_id"), whole.column("mark"), whole.column("text")
        at = 0
        while at < whole.num_rows:
            sets, n, size = [], 0, 0
            while at + n < whole.num_rows and n < 1000 and size < 100_000:
                sets.append(shingle_hashes(texts[at + n].as_buffer().to_pybytes() if texts[at + n].is_valid else None))
                size, n = size + len(sets[-1]), n + 1
            full = [s for s in sets if len(s)]
            sig = np.zeros((n, scheme.hashes), np.uint8)
            bands = np.zeros((n, scheme.bands), np.int64)
            some = np.array([len(s) > 0 for s in sets])
            if full:
                values = signatures(full, turn)
                with np.errstate(over="ignore"):
                    bands[some] = mix64((values.reshape(-1, scheme.bands, scheme.rows).astype(np.uint64) * band).sum(2) + np.arange(scheme.bands, dtype=np.uint64)).view(np.int64)
                    sig[some] = ((values ^ (values >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(24)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, n), marks.slice(at, n), pa.array([len(s) for s in sets], pa.int64()),
                    *names(sets),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * scheme.bands), pa.array(bands.reshape(-1))),
                ],
                ["doc_id", "mark", "n", "node", "high", "sig", "bands"],
            )
            at += n


def needed_matches(percent: int = PERCENT, miss: float = MISS, hashes: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on). With a uniform prior, the posterior probability of a match rate of at
    least p after m matches in n is P(Binomial(n + 1, p) <= m); a byte also matches by chance, one time in 256."""
    p = percent / 100
    p += (1 - p) / 256
    out = []
    for n in [*range(BATCH, hashes, BATCH), hashes]:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return out


def going_on(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the signature pairs that survive every batch, and their matches."""
    alive, matches, before = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, need in steps:
        matches = matches + (a[alive, before:n] == b[alive, before:n]).sum(1)
        keep = matches >= need
        alive, matches, before = alive[keep], matches[keep], n
    return alive, matches


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _bayes(scheme: Scheme, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = needed_matches(scheme.percent, hashes=scheme.hashes)
    for b in batches:
        alive, matches = going_on(_matrix(b.column("sig_a")), _matrix(b.column("sig_b")), steps)
        pick = pa.array(alive)
        yield pa.RecordBatch.from_arrays([b.column("a").take(pick), b.column("b").take(pick), pa.array(matches)], ["a", "b", "matches"])


def _survivors(scheme: Scheme, t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of a block pair: its place, the places of the later rows of other components whose signatures go on with its own, and their matches."""
    steps = needed_matches(scheme.percent, hashes=scheme.hashes)
    sig, comp, n, block = _matrix(t.column("sig")), *(t.column(c).to_numpy() for c in ("comp", "n", "block"))
    apart = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    for k in range(t.num_rows - 1):
        other = np.arange(k + 1, t.num_rows)
        fit = (comp[other] != comp[k]) & (100 * np.minimum(n[other], n[k]) >= scheme.percent * np.maximum(n[other], n[k]))
        if apart:
            fit &= block[other] != block[k]
        other = other[fit]
        alive, matches = going_on(np.broadcast_to(sig[k], (len(other), sig.shape[1])), sig[other], steps)
        yield k, other[alive], matches


def _block(scheme: Scheme, most: int):
    """Surviving pairs of one block pair across components: the `most` most similar ones of each component; cut: whether there are more."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        found = [(np.full(len(o), k), o, m) for k, o, m in _survivors(scheme, t)]
        a, b, m = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        kept = np.zeros(len(a), bool)
        if len(a):
            order = np.argsort(-m, kind="stable")
            a, b = a[order], b[order]
            for side in (comp[a], comp[b]):
                by = np.argsort(side, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], side[by][1:] != side[by][:-1]]))
                place = np.arange(len(by)) - np.repeat(first, np.diff(np.concatenate([first, [len(by)]])))
                kept[by[place < most]] = True
        cut, a, b = not kept.all(), a[kept], b[kept]
        key = {c: pa.array([t.column(c)[0].as_py()] * len(a), pa.int64()) for c in ("band", "i", "j")}
        return pa.table(key | {"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b]), "cut": np.full(len(a), cut)})

    return run


def _exact_block(scheme: Scheme):
    """Links between components of one block pair, checked on the sets; pairs whose components have met meanwhile are skipped."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in binary_list(t.column("set").combine_chunks())]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        links = []
        for k, other, matches in _survivors(scheme, t):
            for j in other[np.argsort(-matches, kind="stable")].tolist():
                if (p := find(comp[k])) != (q := find(comp[j])):
                    both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if scheme.fits(both, len(sets[k]), len(sets[j])):
                        root[p] = q
                        links.append((int(node[k]), int(node[j])))
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return run


def _exact(scheme: Scheme, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(binary_list(b.column("set_a")), binary_list(b.column("set_b")), strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(scheme.fits(both, len(s), len(t)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole, 1000)):
        sets = [s for s in map(shingle_hashes, binary_list(b.column("text"))) if len(s)]
        yield pa.RecordBatch.from_arrays([*names(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "high", "set"])


def ends(pairs: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    """Attaches columns of both ends (a and b) of the pairs; a hub's many pairs are a skewed join, which AQE splits."""
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def digests(docs: DataFrame, scheme: Scheme = Scheme()) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, mark, n, node, sig, bands of each document, written to the shared folder; and what rekeyed needs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = written(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(tidy(partial(_digest, scheme)), f"doc_id {kind}, mark long, n long, node long, high long, sig binary, bands array<long>"))
    clash = apart(out.select("node", "high"))
    return rekeyed(out, clash), clash


def linked_classes(docs: DataFrame, digest: DataFrame, clash: DataFrame | None = None, scheme: Scheme = Scheme()) -> DataFrame:
    """node, component for the classes that are linked with another."""
    rows = digest.filter(F.col("node").isNotNull()).select("node", F.explode("bands").alias("band"))
    ranked = F.col("node").bitwiseXOR(F.col("band"))
    shared = rows.groupBy("band").agg(F.min(ranked).alias("low"), F.max(ranked).alias("high")).filter("low != high")
    shared = settle(shared.select("band", F.col("low").bitwiseXOR(F.col("band")).alias("hub")))
    members = settle(attach(rows, shared, "band", "inner", 500_000).select("band", "hub", "node").distinct())
    # What is needed of the classes in shared bands: size, signature, set.
    involved = settle(members.select("node").distinct())
    row = lambda mark: F.xxhash64("doc_id", mark).alias("row")  # noqa: E731 - null ids have one too; rows that share it are only read besides
    some = attach(digest.select(row("mark"), "n", "node", "sig"), involved, "node", "inner", 500_000)
    classes = settle(some.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    texts = attach(docs.select(row(F.xxhash64("text")), "text"), settle(classes.select("row").distinct()), "row", "inner", 2_000_000)
    sets = rekeyed(texts.mapInArrow(tidy(_sets), "node long, high long, set binary"), clash).groupBy("node").agg(F.first("set").alias("set"))
    sets = written(sets)
    fits = F.lit(100) * F.least("n_a", "n_b") >= F.lit(scheme.percent) * F.greatest("n_a", "n_b")
    check = lambda pairs: settle(ends(pairs, sets, ["set"]).mapInArrow(tidy(partial(_exact, scheme)), "a long, b long, linked boolean"))

    stars = members.filter("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = settle(ends(stars, classes, ["n", "sig"]).filter(fits).mapInArrow(tidy(partial(_bayes, scheme)), "a long, b long, matches long"))
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "matches"))
    best = both.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b")).distinct()
    tested = check(best)
    links = tested.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = components(links)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    sizes = settle(members.groupBy("band").agg(F.count("*").alias("m")))
    left = None  # the blocks that may hold unchecked pairs

    def dealt(columns: DataFrame) -> DataFrame:
        member = attach(members, comps, "node", "left", 500_000).withColumn("comp", F.coalesce("component", "node"))
        open_bands = settle(member.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("band").join(sizes, "band"))
        rows = (
            attach(member, open_bands, "band", "inner", 500_000)
            .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .select("band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "comp")
        )
        return (rows if left is None else attach(rows, left, ["band", "i", "j"], "left_semi")).join(columns, "node")

    signed = classes.select("node", "n", "sig")
    for most in ROUNDS:
        across = settle(dealt(signed).groupBy("band", "i", "j").applyInArrow(_block(scheme, most), "band long, i long, j long, a long, b long, cut boolean"))
        rest = check(settle(across.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")))
        links = links.union(rest.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
        comps = components(links)
        tested = tested.union(rest)
        left = settle(across.filter("cut").select("band", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).distinct())
        if not left.limit(1).count():
            return comps
    last = settle(dealt(signed.join(sets, "node")).groupBy("band", "i", "j").applyInArrow(_exact_block(scheme), "u long, v long"))
    return components(links.union(last))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark, n_shingles, component_id, kept: one row per input row."""
    scheme = Scheme(percent, bands, rows)
    digest, clash = digests(docs, scheme)
    classes = digest.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("members"))
    joined = settle(classes.join(linked_classes(docs, digest, clash, scheme), "node", "left").filter("members > 1 or component is not null").withColumn("component", F.coalesce("component", "node")))
    found = settle(joined.groupBy("component").agg(F.min("least").alias("component_id")))
    by_node = settle(attach(joined, found, "component", "inner", 500_000).select("node", "component_id"))
    out = attach(digest.select("doc_id", "mark", "n", "node"), by_node, "node", "left", 500_000).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The documents without those that another of their component stands for; of rows with one id and text, one stays."""
    found = settle(near_duplicates(docs, percent, bands, rows))
    gone = settle(found.filter(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("mark").alias("its_mark")).distinct())
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("mark").eqNullSafe(F.col("its_mark"))
    left = marked.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, same, "left_anti")
    again = settle(found.filter("kept and n_shingles > 0").groupBy("doc_id", "mark").count().filter("count > 1").select(F.col("doc_id").alias("id"), F.col("mark").alias("its_mark")))
    if again.limit(1).count():
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "mark"]))
    return left.select("row.*")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


OP7_SQL = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i : i + {WIDTH} - 1], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""
