"""Language-model scores: interpolated modified Kneser-Ney over trigrams, counted in Spark, stored as sorted hash arrays.

Counting. All words of the training texts take part, by hash (48 bits; n-grams have 64). Tasks count the trigrams of some
millions of tokens at a time and send them to shards, which are ranges of the hash space of the last two words: a shard
has all trigrams that end in a pair, and so the pair's continuation count. From there go sums for words (how often, after
how many others, with what mass left) and for the two words before a trigram to shards of their own. The number of shards
follows the amount of text, so that a shard's size doesn't; the driver gets counts of counts only. Shards are counted
in rounds, and a round's messages go before the next one's are written.

Pruning. Trigrams that occur once, and pairs after one word only, are not stored: their discount is their whole count, so
their mass goes to the shorter history, in contexts that are seen as well (LEAST; all counts of words stay).

Scoring. Words, pairs, contexts and trigrams are sorted arrays of hashes with their values, a file for each shard in the
shared folder, which workers memory-map where that folder is mounted; else each executor fetches the tables once and maps
its own files. A text's tokens are looked up in sorted batches; nothing is shuffled and no table is in memory as a whole.
p(w|uv) = a(uvw) + g(uv) (a(vw) + g(v) p(w)), p(w) interpolated with the uniform distribution over all words and one
unknown word, so that the probabilities of all words sum to one in every context.

Defined cases: null and empty texts hold only the end token; without training rows the counts are zero and the formulas
still hold; every row is scored by itself, whatever its id, and counts in training as often as it stands; texts of any
length are read whole; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import fcntl
import mmap
import os
import sys
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LARGE_ROWS, binary_list, dropped, few_rows_at_once, fresh_path, mix64, released, table, tidy, trimmed

#: Least continuation count of a stored pair and least count of a stored trigram.
LEAST = (1, 1)
#: Bytes of text that one shard answers for; tokens that a task counts or looks up at a time; words whose hash a worker remembers.
SHARD_BYTES, COUNTED, LOOKED_UP, REMEMBERED = 4 << 20, 1_000_000, 200_000, 200_000
#: The texts are counted so many times, each time for a part of the shards, so that no more messages than theirs stand on disk at once.
ROUNDS = 2
#: Sums of words and of contexts are merged in so many parts, whose messages go as each becomes files; in one where there is little text.
MERGES = 4
#: Files that a worker maps at a time; before Python 3.13 each map holds a descriptor.
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}
MAPPED = 30_000 if UNTRACKED else 400
#: Hashes of what no word is: the end of a text and what stands before it.
END, BEGIN = (xxhash.xxh3_64_intdigest(x) >> 16 for x in (b" ", b"  "))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
PAIRS, TRIPLES, CONTEXTS, WORDS, STATS = range(5)
PACKED = "kind int, shard int, keys binary, sums binary"
#: Columns of sums: of words (words before, occurrences, trigrams after, those of stored pairs, stored pairs by count 1, 2, more), of contexts (occurrences, those in stored trigrams, stored trigrams by count).
WIDTHS = {WORDS: 7, CONTEXTS: 5}


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.split parts at ASCII white space; bytes.lower changes A-Z only."""
    return text.lower().split() if text else []


class Hashes(dict):
    """48-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word) >> 16
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


class Tokens(NamedTuple):
    """Texts as hashes, each with what stands before it twice and its end; where the tokens stand; and how many each text has (the end is one)."""

    x: np.ndarray
    at: np.ndarray
    sizes: np.ndarray

    @property
    def u(self) -> np.ndarray:
        return self.x[self.at - 2]

    @property
    def v(self) -> np.ndarray:
        return self.x[self.at - 1]

    @property
    def w(self) -> np.ndarray:
        return self.x[self.at]


def tokens_of(texts: list[bytes | None], hashes: Hashes) -> Tokens:
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        words = words_of(t)
        sizes[k] = len(words) + 1
        parts.append(np.fromiter((BEGIN, BEGIN, *map(hashes.__getitem__, words), END), np.uint64, len(words) + 3))
    at = np.arange(int(sizes.sum())) + 2 * np.repeat(np.arange(1, len(texts) + 1), sizes)
    return Tokens(np.concatenate(parts) if parts else np.zeros(0, np.uint64), at, sizes)


def batches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of the batches with about `size` tokens each, by the bytes of their texts."""
    for b in batches:
        texts, start, held = binary_list(b.column("text")), 0, 0
        for k, t in enumerate(texts):
            held += len(t or b"")
            if held > 6 * size:
                yield b.slice(start, k + 1 - start), texts[start : k + 1]
                start, held = k + 1, 0
        if start < len(texts):
            yield b.slice(start), texts[start:]


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v * _A + w)


def triple_keys(pairs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """u: 32 bits. The upper half is that of the pair, which keeps both in one shard."""
    return pairs >> np.uint64(32) << np.uint64(32) | mix64(pairs + u.astype(np.uint64) * _B) >> np.uint64(32)


def context_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(v * _C + (u >> np.uint64(16)))


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def short(x: np.ndarray) -> bytes:
    """48-bit integers as six bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def shard_of(keys: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def edges(keys: np.ndarray, shards: int, bits: int = 64) -> list[tuple[int, slice]]:
    """The shards of sorted keys, and where each one's are."""
    at = np.searchsorted(shard_of(keys, shards, bits), np.arange(shards + 1))
    return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]


def count_triples(docs: DataFrame, shards: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """Messages to the shards of this round: pairs (v, w) with how many u come before them, and each u (32 bits) with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = Hashes(), [], 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate([t.x for t in held])
            where = np.concatenate([t.at.astype(np.int32) + k for t, k in zip(held, np.cumsum([0, *(len(t.x) for t in held)]), strict=False)])
            held.clear()
            pairs = pair_keys(x[where - 1], x[where])
            if rounds > 1:
                mine = shard_of(pairs, shards) % rounds == turn
                pairs, where = pairs[mine], where[mine]
            _, first, counts = np.unique(triple_keys(pairs, x[where - 2] >> np.uint64(16)), return_index=True, return_counts=True)
            pairs, at = pairs[first], where[first]
            order = np.argsort(pairs, kind="stable")
            pairs, at, counts = pairs[order], at[order], counts[order].astype(np.uint32)
            del where, first, order
            starts = firsts(pairs)
            n = np.diff(np.concatenate([starts, [len(pairs)]])).astype(np.uint32)
            rows, ends = [], np.concatenate([starts, [len(pairs)]])
            for s, part in edges(pairs[starts], shards):
                own, inner = at[starts[part]], slice(ends[part.start], ends[part.stop])
                rows.append((s, short(x[own - 1]), short(x[own]), n[part].tobytes(), (x[at[inner] - 2] >> np.uint64(16)).astype(np.uint32).tobytes(), counts[inner].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], ["shard", "v", "w", "n", "u", "counts"])

        for _, texts in batches_of(batches, LOOKED_UP):
            held.append(tokens_of(texts, hashes))
            size += len(held[-1].at)
            if size >= COUNTED:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(tidy(run), "shard int, v binary, w binary, n binary, u binary, counts binary")


def planes(x: np.ndarray) -> bytes:
    """64-bit integers, along the last axis their lowest bytes first, then the next ones."""
    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(*x.shape, 8).swapaxes(-1, -2)).tobytes()


def unplaned(data: bytes, kind: type, *shape: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(*shape[:-1], 8, shape[-1]).swapaxes(-1, -2)).view(kind).reshape(shape)


def packed(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Sorted keys as differences, and sums, one column after the other, both byte by byte of their integers, so that the upper bytes, nearly all zeros, compress to little."""
    columns = [[r[0] for r in rows], [r[1] for r in rows], [planes(np.diff(r[2], prepend=np.uint64(0))) for r in rows], [planes(r[3].T) for r in rows]]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "shard", "keys", "sums"), columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def unpacked(kind: int, keys: bytes, sums: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.cumsum(unplaned(keys, np.uint64, len(keys) // 8), dtype=np.uint64)
    return k, unplaned(sums, np.int64, len(sums) // 8 // len(k), len(k)).T if len(k) else np.zeros((0, WIDTHS.get(kind, 1)), np.int64)


def summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = firsts(keys)
    return keys[at], np.add.reduceat(sums[order], at, axis=0) if len(at) else sums


def by_count(counts: np.ndarray, least: int) -> np.ndarray:
    """Four columns: the count where it is stored, and whether that is 1, 2 or more."""
    kept = np.where(counts >= least, counts, 0)
    return np.stack([kept, kept == 1, kept == 2, kept > 2], 1).astype(np.int64)


def learn_shard(least: tuple[int, int], shards: int, folder: str | None):
    """Pairs and trigrams need nothing from other shards: where there is a mounted folder they become files at once, and only sums go on."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in t.column("n").to_pylist()])
        pv, pw = (np.concatenate([long(x) for x in t.column(c).to_pylist()]) for c in ("v", "w"))
        u, counts = (np.concatenate([np.frombuffer(x, np.uint32) for x in t.column(c).to_pylist()]) for c in ("u", "counts"))
        trimmed()
        pair = pair_keys(pv, pw)
        whose = np.repeat(np.arange(len(n), dtype=np.uint32), n)
        key = triple_keys(pair[whose], u)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = firsts(key)  # distinct trigrams, in order of their keys
        key, counts, order = key[at], np.add.reduceat(counts[order].astype(np.int64), at), order[at]
        whose, u = whose[order], u[order]
        order = np.argsort(pair[whose], kind="stable")
        ordered = pair[whose[order]]
        starts = firsts(ordered)
        own = whose[order[starts]]
        pairs, v, w = ordered[starts], pv[own], pw[own]
        before, occurred = np.diff(np.concatenate([starts, [len(ordered)]])), np.add.reduceat(counts[order], starts)
        stored, kept = before >= least[0], counts >= least[1]
        ready = [(PAIRS, shard, pairs[stored], before[stored][:, None]), (TRIPLES, shard, key[kept], counts[kept][:, None])]
        rows = ready if folder is None else []
        for kind, _, keys, sums in ready if folder is not None else []:
            store(folder, kind, shard, file_of(kind, keys, sums))
        one = np.ones((len(v), 1), np.int64)
        of_last = np.hstack([one, occurred[:, None], np.zeros((len(v), 5), np.int64)])
        of_first = np.hstack([np.zeros((len(v), 2), np.int64), before[:, None], by_count(before, least[0])])
        keys, sums = summed(np.concatenate([w, v]), np.vstack([of_last, of_first]))
        rows += [(WORDS, s, keys[part], sums[part]) for s, part in edges(keys, shards, 48)]
        often = occurred >= least[1]  # what may come before a stored trigram
        mine = np.hstack([occurred[often][:, None], np.zeros((int(often.sum()), 4), np.int64)])
        theirs = np.hstack([np.zeros((int(kept.sum()), 1), np.int64), by_count(counts[kept], least[1])])
        heads = mix64(pv[whose[kept]] * _C + u[kept].astype(np.uint64))
        first = v == BEGIN  # before the first word stand two of these, which are no pair
        texts = np.hstack([occurred[first][:, None], np.zeros((int(first.sum()), 4), np.int64)])
        keys, sums = summed(np.concatenate([context_keys(v[often], w[often]), heads, context_keys(v[first], v[first])]), np.vstack([mine, theirs, texts]))
        rows += [(CONTEXTS, s, keys[part], sums[part]) for s, part in edges(keys, shards)]
        some = [np.bincount(np.minimum(x, 5), minlength=6)[1:5] for x in (before, counts)]
        rows.append((STATS, shard, np.arange(4, dtype=np.uint64), np.stack(some, 1).astype(np.int64)))
        del key, whose, u, counts, order, ordered, pair, pv, pw
        trimmed()
        return packed(rows)

    return run


def merge_shard(kind: int):
    """Sums of the rows of a shard; contexts without a stored trigram go. For words, also a row of counts."""

    def run(t: pa.Table) -> pa.Table:
        parts = [unpacked(kind, *x) for x in zip(t.column("keys").to_pylist(), t.column("sums").to_pylist(), strict=True)]
        keys, sums = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        shard = t.column("shard")[0].as_py()
        if kind == CONTEXTS:
            keys, sums = keys[sums[:, 1] > 0], sums[sums[:, 1] > 0]
            return packed([(kind, shard, keys, sums)])
        some = np.bincount(np.minimum(sums[:, 0], 5), minlength=6)[1:5]
        stats = np.array([*some, sums[:, 0].sum(), sums[:, 1].sum(), (sums[:, 1] > 0).sum(), (sums[:, 0] > 2).sum()], np.int64)
        return packed([(kind, shard, keys, sums), (STATS, shard, np.arange(len(stats), dtype=np.uint64), stats[:, None])])

    return run


def discounts(some: np.ndarray, least: int) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and more, by the counts of counts 1 to 4; fixed fallbacks where one is zero. Counts that aren't stored lose all."""
    ones, twos, threes, fours = (int(x) for x in some)
    take = np.array([0.0, 0.5, 0.75, 0.9])
    if ones and twos and threes and fours:
        y = ones / (ones + 2 * twos)
        take = np.clip([0.0, 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])
    take[1:least] = np.arange(1, least)[:3]
    return take


class Model(NamedTuple):
    """What the tables are read with: a handful of numbers and the names of their files."""

    tokens: int
    distinct: int
    pairs: int
    of_words: np.ndarray
    of_pairs: np.ndarray
    of_triples: np.ndarray
    shards: int
    folder: str | None
    fetched: tuple[str, ...]

    spread: float

    @property
    def uniform(self) -> float:
        return 1 / (self.distinct + 1)


VALUES = {WORDS: (np.uint64, np.uint64, np.uint64, np.float64), PAIRS: (np.uint64, np.uint32), CONTEXTS: (np.uint64, np.uint32, np.float32), TRIPLES: (np.uint64, np.uint32)}


def file_of(kind: int, keys: np.ndarray, sums: np.ndarray, of_pairs: np.ndarray | None = None, of_triples: np.ndarray | None = None) -> bytes:
    """What a file of the table holds, column by column: keys, then values. Words and contexts need the discounts."""
    if kind == WORDS:  # words before, occurrences and what is left for the shorter history, per trigram after
        after, stored, *by = sums[:, 2:].T
        left = (after - stored + np.stack(by, 1) @ of_pairs[1:]) / np.maximum(after, 1)
        out = [keys, sums[:, 1] << 32 | np.minimum(sums[:, 0], 0xFFFFFFFF), after, np.where(after > 0, left, 1.0)]
    elif kind == CONTEXTS:
        occurred, stored, *by = sums.T
        out = [keys, occurred, (occurred - stored + np.stack(by, 1) @ of_triples[1:]) / np.maximum(occurred, 1)]
    else:
        out = [keys, sums[:, 0]]
    return b"".join((np.minimum(x, np.iinfo(t).max) if np.issubdtype(t, np.integer) and t != np.uint64 else x).astype(t).tobytes() for x, t in zip(out, VALUES[kind], strict=True))


def store(folder: str, kind: int, shard: int, data: bytes) -> None:
    """A file appears as a whole or not at all, and alike whoever writes it."""
    own = f"{folder}/{kind}-{shard}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, f"{folder}/{kind}-{shard}")


def model_folder(spark: SparkSession) -> tuple[str, str | None]:
    """Where the model's files go, and the same as a mounted path if it is one."""
    base = fresh_path(spark)
    at = urlparse(base)
    if at.scheme not in ("", "file"):
        return base, None
    os.makedirs(at.path)
    return base, at.path


def publish(rows: DataFrame, of_pairs: np.ndarray, of_triples: np.ndarray, base: str, folder: str | None, names: list[str]) -> list[tuple[bytes, bytes]]:
    """Makes the files of a table: in the folder if there is a mounted one, else as Parquet that every executor fetches, whose names are added. Returns the rows of counts among the table's."""
    spark = rows.sparkSession

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, shard, keys, sums in zip(*(b.column(c) for c in ("kind", "shard", "keys", "sums")), strict=True):
                kind, shard, keys, sums = kind.as_py(), shard.as_py(), keys.as_py(), sums.as_py()
                data = None
                if kind != STATS:
                    data, keys, sums = file_of(kind, *unpacked(kind, keys, sums), of_pairs, of_triples), None, None
                    if folder is not None:
                        store(folder, kind, shard, data)
                        data = None
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (data, keys, sums))], ["kind", "shard", "data", "keys", "sums"])

    rows = rows.mapInArrow(tidy(lay), "kind int, shard int, data binary, keys binary, sums binary")
    if folder is None:
        rows.write.options(**LARGE_ROWS).parquet(base)
        rows = spark.read.schema(rows.schema).parquet(base)
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        for f in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place):
            if (name := f.getPath().getName()).startswith("part-"):
                spark.sparkContext.addFile(f.getPath().toString())
                names.append(name)
    return [(r["keys"], r["sums"]) for r in rows.filter(F.col("kind") == STATS).select("keys", "sums").collect()]


def local_folder(names: tuple[str, ...]) -> str:
    """The tables' files in the executor's Spark folder; the first worker that needs them makes them, the others wait."""
    import pyarrow.parquet as pq

    folder = os.path.join(SparkFiles.getRootDirectory(), f"bidloom-lm-{xxhash.xxh3_64_hexdigest(' '.join(names))}")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        if not os.path.exists(f"{folder}/done"):
            for n in names:
                f = pq.ParquetFile(SparkFiles.get(n))
                for b in f.iter_batches(1):
                    for kind, shard, data in zip(*(b.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True):
                        if data is not None:
                            store(folder, kind, shard, data)
            open(f"{folder}/done", "w").close()
    return folder


class Tables:
    """The memory-mapped arrays of all shards."""

    def __init__(self, m: Model):
        self.folder, self.shards, self.open = m.folder or local_folder(m.fetched), m.shards, {}

    def shard(self, kind: int, s: int) -> list[np.ndarray]:
        if (kind, s) not in self.open:
            if len(self.open) >= MAPPED:
                self.open.clear()
            path, types = f"{self.folder}/{kind}-{s}", VALUES[kind]
            size = os.path.getsize(path) if os.path.exists(path) else 0
            n, at, out, data = size // sum(np.dtype(t).itemsize for t in types), 0, [], b""
            if n:
                with open(path, "rb") as f:
                    data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
            for t in types:
                out.append(np.frombuffer(data, t, n, at) if n else np.zeros(0, t))
                at += n * np.dtype(t).itemsize
            self.open[kind, s] = out
        return self.open[kind, s]

    def find(self, kind: int, keys: np.ndarray) -> list[np.ndarray]:
        """The values of each key; zeros for those that aren't there. Sorted look-ups touch the mapped pages in order."""
        distinct, inverse = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(distinct), t) for t in VALUES[kind][1:]]
        for s, part in edges(distinct, self.shards, 48 if kind == WORDS else 64):
            held, *values = self.shard(kind, s)
            if len(held):
                at = np.minimum(np.searchsorted(held, distinct[part]), len(held) - 1)
                there = held[at] == distinct[part]
                for o, x in zip(out, values, strict=True):
                    o[part] = np.where(there, x[at], 0)
        return [o[inverse] for o in out]


def probabilities(t: Tokens, m: Model, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """p(w|uv) of every token, and how often it occurs in training."""
    both, after, left = tables.find(WORDS, t.x)
    count, before = (both[t.at] >> np.uint64(32)).astype(np.int64), (both[t.at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    after, left = after[t.at - 1].astype(np.float64), left[t.at - 1]
    known = after > 0
    taken = m.of_words[np.minimum(before, 3)]
    p = (before - taken) / max(m.pairs, 1) + m.spread * m.uniform
    pairs = pair_keys(t.v, t.w)
    (seen,) = tables.find(PAIRS, pairs)
    seen = seen.astype(np.int64)
    p = np.where(known, (seen - m.of_pairs[np.minimum(seen, 3)]) / np.maximum(after, 1) + left * p, p)
    occurred, rest = tables.find(CONTEXTS, context_keys(t.u, t.v))
    (times,) = tables.find(TRIPLES, triple_keys(pairs, t.u >> np.uint64(16)))
    times = times.astype(np.int64)
    p = np.where(occurred > 0, (times - m.of_triples[np.minimum(times, 3)]) / np.maximum(occurred, 1) + rest * p, p)
    return p, count


def learn(docs: DataFrame, least: tuple[int, int] = LEAST, shard_bytes: int = SHARD_BYTES) -> Model:
    """docs: text."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    shards = max(8, size // shard_bytes)
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession)
    base, folder = model_folder(spark)
    merges = MERGES if shards > 8 else 1
    part = F.pmod("shard", F.lit(merges))
    for turn in range(ROUNDS):
        rows = count_triples(docs, shards, turn, ROUNDS).groupBy("shard").applyInArrow(learn_shard(least, shards, folder), PACKED)
        rows.withColumn("part", part).write.options(**LARGE_ROWS).option("compression", "zstd").partitionBy("kind", "part").parquet(f"{path}/round={turn}")
        released(spark)

    def counted(kind: int, turn: int | None = None) -> DataFrame:
        """What was counted and still stands: read anew, since parts go meanwhile."""
        rows = spark.read.schema(f"{PACKED}, round int, part int").parquet(path).filter(F.col("kind") == kind)
        return (rows if turn is None else rows.filter(F.col("part") == turn)).select("kind", "shard", "keys", "sums")

    sums_of = lambda rows, like: sum((unpacked(STATS, *r)[1] for r in rows), np.zeros(like, np.int64))
    some = sums_of([(r["keys"], r["sums"]) for r in counted(STATS).collect()], (4, 2))
    of_pairs, of_triples = discounts(some[:, 0], least[0]), discounts(some[:, 1], least[1])
    merged, names = [], []
    with few_rows_at_once(spark):
        for kind, turn in [(k, t) for k in (WORDS, CONTEXTS) for t in range(merges)]:
            rows = counted(kind, turn).groupBy("shard").applyInArrow(merge_shard(kind), PACKED)
            merged += publish(rows, of_pairs, of_triples, f"{base}/{kind}-{turn}" if folder is None else base, folder, names)
            for r in range(ROUNDS):
                dropped(spark, f"{path}/round={r}/kind={kind}/part={turn}")
            released(spark)
        if folder is None:
            for kind in (PAIRS, TRIPLES):
                publish(counted(kind), of_pairs, of_triples, f"{base}/{kind}", folder, names)
    words = sums_of(merged, (8, 1))[:, 0]
    dropped(spark, path)  # the tables' files are all that is needed from here on
    released(spark)
    of_words = discounts(words[:4], 1)
    spread = float(of_words[1:] @ words[[0, 1, 7]]) / int(words[4]) if words[4] else 1.0
    return Model(int(words[5]), int(words[6]), int(words[4]), of_words, of_pairs, of_triples, int(shards), folder, tuple(sorted(names)), spread)


def score(docs: DataFrame, training: Column, least: tuple[int, int] = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row per document; learns from the rows that `training` marks."""
    docs = docs.select("doc_id", "text")
    model = learn(docs.filter(training), least, shard_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = shared.value, Hashes()
        tables = Tables(m)
        log_total = np.log10(m.tokens + 0.5 * (m.distinct + 1))
        for b, texts in batches_of(batches, LOOKED_UP):
            t = tokens_of(texts, hashes)
            p, count = probabilities(t, m, tables)
            begins = np.cumsum(t.sizes) - t.sizes
            add = lambda x: np.add.reduceat(x, begins)
            logs = add(np.log10(p))
            columns = [pa.array(t.sizes), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(texts), m.tokens)), pa.array(add(np.log10(count + 0.5)) - t.sizes * log_total), pa.array(logs), pa.array(10 ** np.minimum(-logs / t.sizes, 300))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 1
    return score(table(spark, sf_dir, "documents"), ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
