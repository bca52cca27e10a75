"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

The pieces come from a model file whose path is a parameter; it is read once on the driver and its arrays (their size is
that of the vocabulary) are broadcast. Log scores follow Zipf's law over the pieces' ranks, since the file's own scores
are merge ranks, not log probabilities; ``scores="file"`` takes those of the file.

No piece holds a white-space marker after another character, so the best path of a text is that of its words side by
side: words are cut at the markers, and a bounded table remembers the paths of short words. Characters without a piece
become their UTF-8 bytes, at one unknown-piece penalty a character. A literal marker in the text is written in bytes, so
that decoding gives back every text exactly.

Defined cases: null and empty texts have no pieces and decode to the empty string; texts of any length are encoded
whole; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tidy

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The penalty of a character without a piece, below the worst score.
UNKNOWN_PENALTY = 10.0
#: Words up to so many characters are remembered, so many of them at a time.
REMEMBERED_LENGTH, REMEMBERED = 40, 300_000


def read_fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protocol-buffers message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, kind, value


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    with open(path, "rb") as f:
        data = f.read()
    pieces = []
    for field, _, value in read_fields(data):
        if field == 1:
            x = {k: v for k, _, v in read_fields(value)}
            pieces.append((x[1].decode(), struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0], x.get(3, NORMAL)))
    return pieces


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays of a trie over sorted, distinct byte strings.

    The child of state s by byte c is t = base[s] + c + 1 if check[t] == s; value[s] is the key's index, or -1."""
    used, base, check, value = bytearray(1 << 16), {}, {0: 0}, {}
    used[0] = 1
    crowded = 1  # before it, hardly a slot is free; branching states search from here
    free = 1
    stack = [(0, 0, len(keys), 0)]
    while stack:
        state, lo, hi, depth = stack.pop()
        if lo < hi and len(keys[lo]) == depth:
            value[state] = lo
            lo += 1
        groups, k = [], lo
        while k < hi:
            c, start = keys[k][depth], k
            while k < hi and keys[k][depth] == c:
                k += 1
            groups.append((c + 1, start, k))
        if not groups:
            continue
        first = groups[0][0]
        free = used.find(0, free)
        slot = max(free if len(groups) == 1 else max(free, crowded), first + 1)
        tried = 0
        while True:
            slot = used.find(0, slot)
            if slot < 0 or slot + 600 > len(used):
                used.extend(bytes(1 << 16))
                slot = slot if slot >= 0 else len(used) - (1 << 16)
                continue
            if not any(used[slot - first + c] for c, _, _ in groups):
                break
            slot += 1
            tried += 1
        if tried > 200:
            crowded = max(crowded, slot - 100)
        at = slot - first
        base[state] = at
        for c, start, end in groups:
            used[at + c] = 1
            check[at + c] = state
            stack.append((at + c, start, end, depth + 1))
    size = max(check) + 300
    filled = lambda d, rest: np.array([d.get(i, rest) for i in range(size)], np.int32)
    return filled(base, 0), filled(check, -1), filled(value, -1)


class Vocabulary:
    """Pieces, their log scores and the trie over them; small enough to broadcast."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: str = "zipf"):
        self.pieces = pieces
        usable = [i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        if scores == "zipf":
            harmonic = float(np.log((1 / np.arange(1, len(usable) + 1)).sum()))
            score = {i: -float(np.log(k + 1)) - harmonic for k, i in enumerate(usable)}
        else:
            score = {i: pieces[i][1] for i in usable}
        ordered = sorted((pieces[i][0].encode(), i) for i in usable)
        self.base, self.check, at = double_array([k for k, _ in ordered])
        ids = np.array([i for _, i in ordered] + [-1], np.int32)
        self.value = ids[at]
        self.score = np.zeros(len(pieces))
        for i, s in score.items():
            self.score[i] = s
        self.unknown = min(score.values()) - UNKNOWN_PENALTY
        self.bytes = [0] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        inner = any(MARK in p.lstrip(MARK) for p, _, kind in pieces if kind in (NORMAL, USER))
        #: A line feed that shares no piece with other characters parts words too.
        self.alone = "" if any("\n" in p and len(p) > 1 for p, _, kind in pieces if kind in (NORMAL, USER)) else "\n"
        if inner:
            raise ValueError("a piece holds a marker after another character; words can't be encoded apart")


class Encoder:
    """Encodes and decodes with a Vocabulary in one process."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.base, self.check, self.value, self.score = v.base.tolist(), v.check.tolist(), v.value.tolist(), v.score.tolist()
        self.words = re.compile(f"{MARK}*[^{MARK}{v.alone}]+|{MARK}+" + (f"|{v.alone}+" if v.alone else ""))
        self.table: dict[str, bytes] = {}
        texts = [b"" if kind in (UNKNOWN, CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in v.pieces]
        self.texts = texts
        self.byte_ids = np.zeros(len(texts), bool)
        self.byte_ids[[i for i, (_, _, kind) in enumerate(v.pieces) if kind == BYTE]] = True

    def path(self, word: str) -> list[int]:
        """Ids of the best path; of equal ones, that whose last piece begins first."""
        data = word.encode()
        n = len(data)
        base, check, value, score, unknown = self.base, self.check, self.value, self.score, self.v.unknown
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = data[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, single, s = best[i], False, 0
            for j in range(i, n):
                t = base[s] + data[j] + 1
                if check[t] != s:
                    break
                s = t
                p = value[s]
                if p >= 0:
                    total = here + score[p]
                    old = best[j + 1]
                    if old is None or total > old:
                        best[j + 1], back[j + 1] = total, (i, p)
                    single |= j + 1 == i + width
            if not single:
                total, old = here + unknown, best[i + width]
                if old is None or total > old:
                    best[i + width], back[i + width] = total, (i, -1)
            i += width
        out, j = [], n
        while j:
            i, p = back[j]
            if p >= 0:
                out.append(p)
            else:
                out += [self.v.bytes[c] for c in reversed(data[i:j])]
            j = i
        return out[::-1]

    #: Stands for a marker that the text itself holds; a private character, itself written in bytes.
    literal = "".encode()

    def word(self, w: str) -> bytes:
        ids = np.array(self.path(w), np.int32).tobytes()
        if len(w) <= REMEMBERED_LENGTH:
            if len(self.table) >= REMEMBERED:
                self.table.clear()
            self.table[w] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if MARK in text:
            return self.encode_apart(text)
        return self.joined(self.words.findall(MARK + text.replace(" ", MARK)))

    def joined(self, words: list[str]) -> np.ndarray:
        known, word = self.table.get, self.word
        return np.frombuffer(b"".join([known(w) or word(w) for w in words]), np.int32)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """encode() of each text; words that are new to the table are searched side by side."""
        cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t and MARK not in t else None for t in texts]
        new = {w for words in cut if words for w in words if len(w) <= REMEMBERED_LENGTH} - self.table.keys()
        if len(self.table) + len(new) > REMEMBERED:
            self.table.clear()
            new = {w for words in cut if words for w in words if len(w) <= REMEMBERED_LENGTH}
        self.paths(new)
        return [self.encode(t) if words is None else self.joined(words) for t, words in zip(texts, cut, strict=True)]

    def paths(self, words: set[str]) -> None:
        """Puts the best paths of many words into the table: path() over arrays, for words of one length in bytes at a time."""
        base, check, value, score = self.v.base, self.v.check, self.v.value, self.v.score
        by_length: dict[int, list[tuple[bytes, str]]] = {}
        for w in words:
            by_length.setdefault(len(d := w.encode()), []).append((d, w))
        width_of = np.ones(256, np.int64)
        width_of[0xC0:0xE0], width_of[0xE0:0xF0], width_of[0xF0:] = 2, 3, 4
        for n, group in by_length.items():
            data = np.frombuffer(b"".join([d for d, _ in group]), np.uint8).reshape(-1, n).astype(np.int64)
            best = np.full((len(group), n + 1), -np.inf)
            best[:, 0] = 0.0
            start, piece = np.zeros((len(group), n + 1), np.int64), np.full((len(group), n + 1), -1, np.int64)
            for i in range(n):
                live = np.flatnonzero(best[:, i] > -np.inf)
                width = width_of[data[:, i]]
                single = np.zeros(len(group), bool)
                rows, s = live, np.zeros(len(live), np.int64)
                for j in range(i, n):
                    t = base[s] + data[rows, j] + 1
                    ok = check[t] == s
                    rows, s = rows[ok], t[ok]
                    if not len(rows):
                        break
                    p = value[s]
                    r, p = rows[p >= 0], p[p >= 0]
                    total = best[r, i] + score[p]
                    won = total > best[r, j + 1]
                    best[r[won], j + 1], start[r[won], j + 1], piece[r[won], j + 1] = total[won], i, p[won]
                    single[r] |= i + width[r] == j + 1
                r = live[~single[live]]
                if len(r):
                    end = i + width[r]
                    total = best[r, i] + self.v.unknown
                    won = total > best[r, end]
                    best[r[won], end[won]], start[r[won], end[won]], piece[r[won], end[won]] = total[won], i, -1
            rows, at, steps = np.arange(len(group)), np.full(len(group), n), []
            while len(rows):
                steps.append((rows, piece[rows, at]))
                at = start[rows, at]
                rows, at = rows[at > 0], at[at > 0]
            row, ids = (np.concatenate([x[k] for x in steps[::-1]]) for k in (0, 1))
            order = np.argsort(row, kind="stable")
            ids, ends = ids[order].astype(np.int32), np.cumsum(np.bincount(row, minlength=len(group)))
            unknown = np.bincount(row[order][ids < 0], minlength=len(group))
            raw, begin = ids.tobytes(), 0
            for (_, w), end, odd in zip(group, ends.tolist(), unknown.tolist(), strict=True):
                self.table[w] = np.array(self.path(w), np.int32).tobytes() if odd else raw[4 * begin : 4 * end]
                begin = end

    def encode_apart(self, text: str) -> np.ndarray:
        """A text that holds literal markers: those are written in bytes, what stands between them is encoded as it is."""
        out = [np.array(self.path(MARK), np.int32)] if text[0] == MARK else []
        for k, part in enumerate(re.split(f"({MARK})", text)):
            if k % 2:
                out.append(np.array([self.v.bytes[c] for c in part.encode()], np.int32))
            elif part:
                lead = MARK if k == 0 else ""
                out += [np.frombuffer(self.word(w), np.int32) for w in self.words.findall(lead + part.replace(" ", MARK))]
        return np.concatenate(out)

    def decode(self, ids: list[int]) -> str:
        texts = self.texts
        return b"".join([texts[i] for i in ids])[1:].decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, scores: str = "zipf") -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces, score (log probability of the path), round_trip: one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_model(model_path), scores))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for b in batches:
            for part in slices(b, 500):
                texts = part.column("text").to_pylist()
                rows = coder.encode_all(texts)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                fallback = np.concatenate([[0], np.cumsum(coder.byte_ids[flat])])
                total = np.concatenate([[0.0], np.cumsum(np.where(coder.byte_ids[flat], 0.0, shared.value.score[flat]))])
                whole = [coder.decode(r.tolist()) == (t or "") for r, t in zip(rows, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)),
                        pa.array((fallback[ends[1:]] - fallback[ends[:-1]]).astype(np.int64)), pa.array(np.round(total[ends[1:]] - total[ends[:-1]], 6)), pa.array(whole),
                    ],
                    ["doc_id", "ids", "n_pieces", "n_byte_pieces", "score", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, n_pieces long, n_byte_pieces long, score double, round_trip boolean")


def decode_documents(coded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and the text that the ids stand for."""
    shared = coded.sparkSession.sparkContext.broadcast(Vocabulary(read_model(model_path)))
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([coder.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
