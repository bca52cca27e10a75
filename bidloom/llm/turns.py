"""Repair of conversations: the cheapest edits after which the roles read (s?(ua)+)?, by a rank-compressed dynamic programme.

Edits keep, rerole (to user or assistant) or delete a row, or insert an empty turn. A layer of the programme is one row:
inserts before it and its own edit are one macro edit, whose code (D, ID, IK, IR, K, R) is never the beginning of another.
Audits of equally many layers therefore compare by their first differing code, so a state needs no audit string: it holds
its cost, the rank of its audit among those of its layer and, as a parent pointer, the state it came from and the code.
The state (nothing yet, after s, after u, after a) follows from the audit, so ranks are never tied. At the end come no, one
or two inserts. Elsewhere one insert at most is ever cheapest: two lead back to what was possible before them.

Spark's part. Rows are sorted over the whole cluster by conversation, turn, role and text and cut into blocks of bounded
size, so that a long conversation lies in many tasks. Repeated (role, text) are found by digests, combined before they are
shuffled. A block's programme is run from each state it may be entered in: four times four costs and ranks say all that
others need. A conversation's blocks are then folded in order and decided backward, by streams that hold one block's
numbers; edits are reconstructed block by block. What hashes or joins the whole result of one conversation (its audit, its
SHA-256) is one sequence by nature: that task streams blocks and holds no texts.

Defined cases: nulls of role and text read as one space; null turns come first; rows of one turn are ordered by role and
text; a null conv_id is a conversation of its own; empty and repeated rows are blank and duplicate; roles count by their first
character, an empty one is kept nowhere; a text of any length is one row of its block; an empty table gives an
empty result; other columns are not read. Inserts must cost more than nothing, other costs may be zero.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table, tidy, written
from .variants import CRC32_SQL, crc32_sql

SPACE = " \t\n\x0b\x0c\r"
#: Rows and characters of text in a block at most; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_CHARS = 512, 16_000
#: States, and which state follows by an inserted or reroled turn, by a kept s, u, a or other role.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
KEPT = ((AFTER_S, AFTER_U, None, None), (None, AFTER_U, None, None), (None, None, AFTER_A, None), (None, AFTER_U, None, None))
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
#: Macro edits in the order of their codes.
CODES = ("D", "ID", "IK", "IR", "K", "R")
PLAIN, MUST_GO, CUT_OFF = range(3)
#: Layer transitions that a worker remembers.
REMEMBERED = 100_000


class Costs(NamedTuple):
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def kind_of(role: str, fault: int) -> int:
    """What the programme knows of a row: its role's initial and its fault."""
    return 3 * ("sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3) + fault


class Layers(dict):
    """Transitions (layer, kind of row) -> (what all costs have in common, next layer, parents), remembered.

    A layer has (cost, rank) for each state, or None where it can't be; the least cost is zero. A parent is (state, code)."""

    def __init__(self, costs: Costs):
        super().__init__()
        if costs.insert <= 0:
            raise ValueError("inserts must cost more than nothing")
        self.costs = costs

    def __missing__(self, key: tuple) -> tuple:
        layer, kind = key
        initial, fault = divmod(kind, 3)
        best: list = [None] * 4
        for state, held in enumerate(layer):
            if held is None:
                continue
            for code, name in enumerate(CODES):
                at, cost = state, held[0] + self.costs.insert * (len(name) - 1)
                if len(name) == 2:
                    at = NEXT[at]
                if name[-1] == "D":
                    cost += self.costs.delete
                elif fault == MUST_GO:
                    continue
                else:
                    cost += (self.costs.keep if name[-1] == "K" else self.costs.rerole) + (self.costs.truncated if fault == CUT_OFF else 0)
                    at = KEPT[at][initial] if name[-1] == "K" else NEXT[at]
                    if at is None:
                        continue
                found = (cost, held[1], code, state)
                if best[at] is None or found < best[at]:
                    best[at] = found
        least = min(b[0] for b in best if b is not None)
        order = sorted((b[1], b[2], at) for at, b in enumerate(best) if b is not None)
        rank = {at: k for k, (_, _, at) in enumerate(order)}
        out = (least, tuple(None if b is None else (b[0] - least, rank[at]) for at, b in enumerate(best)), tuple(None if b is None else (b[3], b[2]) for b in best))
        if len(self) >= REMEMBERED:
            self.clear()
        self[key] = out
        return out


def entered(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def run(layers: Layers, kinds: bytes, state: int) -> tuple[int, tuple, list[tuple]]:
    """The programme over a block that is entered in a state: common cost, last layer, parents."""
    total, layer, parents = 0, entered(state), []
    for kind in kinds:
        more, layer, parent = layers[layer, kind]
        total += more
        parents.append(parent)
    return total, layer, parents


def codes_of(layers: Layers, kinds: bytes, entry: int, leave: int) -> list[str]:
    """The macro edits of a block between two states."""
    _, _, parents = run(layers, kinds, entry)
    out, state = [], leave
    for parent in reversed(parents):
        state, code = parent[state]
        out.append(CODES[code])
    return out[::-1]


def inserts_at_end(state: int) -> int:
    return (0, 2, 1, 0)[state]


class Blocks:
    """Cuts sorted rows into blocks of one conversation each."""

    def __init__(self, part: int, most: int):
        self.part, self.most, self.seq, self.conv, self.opens, self.rows, self.chars, self.ready = part, most, 0, None, False, [], 0, []

    def close(self) -> None:
        if self.rows:
            turns, roles, texts, digests, faults = zip(*self.rows, strict=True)
            self.ready.append((self.conv, self.part, self.seq, self.opens, list(turns), list(roles), list(texts), list(digests), list(faults)))
            self.seq, self.rows, self.chars, self.opens = self.seq + 1, [], 0, False

    def add(self, first: bool, conv: object, row: tuple) -> None:
        if first or conv != self.conv:
            self.close()
            self.conv, self.opens = conv, not first
        elif len(self.rows) >= self.most or self.chars + len(row[2]) > BLOCK_CHARS:
            self.close()
        self.rows.append(row)
        self.chars += len(row[2])


def blocks(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """rows: conv_id, turn, role, text. Blocks in order (part, seq): conv_id, opens (surely a conversation's first), turns, roles, texts, digests, faults (blank or truncated), one element a row."""
    conv, turn = (F.col("conv_id"), F.col("turn").cast("long").alias("turn"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.select(conv, turn, role, text)
    fault = F.when(end == "", 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    marked = rows.select("*", F.md5(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text"))).alias("digest"), fault.alias("fault"))
    # the last key parts rows that are all alike, of which any order is the same
    ordered = marked.repartitionByRange("conv_id", "turn", "role", "text", F.rand(11)).sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, seq long, opens boolean, turns array<long>, roles array<string>, texts array<string>, digests array<string>, faults array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, types = Blocks(TaskContext.get().partitionId(), most), True, None
        for b in batches:
            types = b.schema.field("conv_id").type
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "digest", "fault")]
            for conv_id, *row in zip(*columns, strict=True):
                held.add(first, conv_id, tuple(row))
                first = False
            if held.ready:
                yield block_batch(held.ready, types)
                held.ready = []
        held.close()
        if held.ready:
            yield block_batch(held.ready, types)

    return written(ordered.mapInArrow(tidy(cut), schema), "zstd")


def block_batch(ready: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    text = pa.list_(pa.string())
    types = (conv, pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), text, text, text, pa.list_(pa.int32()))
    names = ["conv_id", "part", "seq", "opens", "turns", "roles", "texts", "digests", "faults"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], names)


def summaries(held: DataFrame, costs: Costs) -> DataFrame:
    """A block's programme from each state it may be entered in, with its rows' kinds and what its neighbours need to count faults."""
    rows = held.select("conv_id", "part", "seq", F.posexplode("digests").alias("at", "digest"))
    firsts = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq", "at")).alias("first")).select("first.*").groupBy("part", "seq").agg(F.collect_list("at").alias("firsts"))
    light = held.select("conv_id", "part", "seq", "opens", "turns", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "faults").join(firsts, ["part", "seq"], "left")
    kind = held.schema["conv_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = Layers(costs)
        for b in batches:
            out = []
            for part, seq, opens, turns, initials, faults, firsts in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "opens", "turns", "initials", "faults", "firsts")), strict=True):
                new = set(firsts or ())
                fault = [1 if f == 1 else 3 if k not in new else f for k, f in enumerate(faults)]  # 1 blank, 3 duplicate, 2 truncated
                kinds = bytes(kind_of(r, CUT_OFF if f == 2 else MUST_GO if f else PLAIN) for r, f in zip(initials, fault, strict=True))
                costs_of, ranks = [], []
                for state in range(4):
                    if opens and state != START:
                        costs_of += [None] * 4
                        ranks += [None] * 4
                    else:
                        total, layer, _ = run(layers, kinds, state)
                        costs_of += [None if x is None else total + x[0] for x in layer]
                        ranks += [None if x is None else x[1] for x in layer]
                known = [t for t in turns if t is not None]
                illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
                counts = [fault.count(1), fault.count(3), fault.count(2), illegal, len(set(known))]
                out.append((part, seq, kinds, costs_of, ranks, counts, known[0] if known else None, known[-1] if known else None, initials[0], initials[-1]))
            types = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *columns], ["conv_id", "part", "seq", "kinds", "costs", "ranks", "counts", "low", "high", "opening", "closing"])

    return light.mapInArrow(tidy(score), f"conv_id {kind}, part int, seq long, kinds binary, costs array<long>, ranks array<int>, counts array<long>, low long, high long, opening string, closing string")


def in_order(df: DataFrame, *more: object) -> DataFrame:
    """A conversation's blocks in one stream."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *more)


def folded(blocks_of: DataFrame, costs: Costs) -> DataFrame:
    """For each block, the state it is entered in for each state it may be left in (parents). A conversation's last block also has the state it ends in and its report."""
    kind = blocks_of.schema["conv_id"].dataType.simpleString()
    report = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, state, types = None, None, None  # the last block, not sent yet; the layer, counts and turns up to it

        def ended(row: list) -> list:
            layer, counts, low, high, _ = state
            cost, _, leave = min((x[0] + costs.insert * inserts_at_end(s), x[1], s) for s, x in enumerate(layer) if x is not None)
            blank, duplicate, truncated, illegal, turns = counts
            return [*row[:5], leave, 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost]

        for b in batches:
            types, out = b.schema.field("conv_id").type, []
            for conv, part, seq, kinds, cost, rank, counts, low, high, opening, closing in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if waiting is not None and conv != waiting[0]:
                    out.append(ended(waiting))
                    waiting = None
                if waiting is None:
                    state = (entered(START), [0] * 5, None, None, None)
                else:
                    out.append([*waiting, *[None] * 7])
                layer, sums, least, most, before = state
                best = [min(((x[0] + cost[4 * e + s], x[1], rank[4 * e + s], e) for e, x in enumerate(layer) if x is not None and cost[4 * e + s] is not None), default=None) for s in range(4)]
                order = {s: k for k, (_, _, s) in enumerate(sorted((x[1], x[2], s) for s, x in enumerate(best) if x is not None))}
                sums = [x + y for x, y in zip(sums, counts, strict=True)]
                sums[3] += before is not None and before + opening not in ("su", "ua", "au")
                sums[4] -= low is not None and low == most
                state = (tuple(None if x is None else (x[0], order[s]) for s, x in enumerate(best)), sums, low if least is None else least, high if high is not None else most, closing)
                waiting = [conv, part, seq, kinds, [None if x is None else x[3] for x in best]]
            yield fold_batch(out, types)
        if waiting is not None:
            yield fold_batch([ended(waiting)], types)

    def fold_batch(out: list[list], conv: pa.DataType) -> pa.RecordBatch:
        types = (conv, pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32(), *[pa.int64()] * 6)
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 12, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "seq", "kinds", "parents", "leave", *report])

    return in_order(blocks_of, "part", "seq").mapInArrow(tidy(fold), f"conv_id {kind}, part int, seq long, kinds binary, parents array<int>, leave int, {', '.join(f'{c} long' for c in report)}")


def decided(folds: DataFrame) -> DataFrame:
    """Each block's states, from the last block back."""
    kind = folds.schema["conv_id"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            entries, leaves, last = [], [], []
            for parents, leave in zip(b.column("parents").to_pylist(), b.column("leave").to_pylist(), strict=True):
                last.append(leave is not None)
                state = leave if leave is not None else state
                leaves.append(state)
                state = parents[state]
                entries.append(state)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "seq", "kinds")), pa.array(entries, pa.int32()), pa.array(leaves, pa.int32()), pa.array(last, pa.bool_())], ["conv_id", "part", "seq", "kinds", "entry", "leave", "last"])

    return in_order(folds.select("conv_id", "part", "seq", "kinds", "parents", "leave"), F.desc("part"), F.desc("seq")).mapInArrow(tidy(decide), f"conv_id {kind}, part int, seq long, kinds binary, entry int, leave int, last boolean")


class Repair(NamedTuple):
    #: One row an edit, those of a conversation together and in order: conv_id, step, edit (D, I, K or R), turn, role, text; role and text are the repaired ones, and those deleted.
    edits: DataFrame
    #: One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost.
    report: DataFrame


def repair(rows: DataFrame, costs: Costs = Costs(), most: int = BLOCK_ROWS) -> Repair:
    """rows: conv_id, turn, role, text. most: rows of a block."""
    held = blocks(rows, most)
    folds = settle(folded(summaries(held, costs), costs))
    kind = held.schema["conv_id"].dataType.simpleString()
    both = held.select("conv_id", "part", "seq", "turns", "roles", "texts").unionByName(decided(folds), allowMissingColumns=True).withColumn("is_text", F.col("turns").isNotNull())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, step, decision = Layers(costs), 0, None
        names = ("conv_id", "is_text", "kinds", "entry", "leave", "last", "turns", "roles", "texts")
        for b in (part for whole in batches for part in slices(whole, 64)):
            out = []
            for conv_id, is_text, *now, turns, roles, texts in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if not is_text:  # stands right before its block
                    decision = now
                    continue
                kinds, state, leave, last = decision
                for code, turn, role, text in zip(codes_of(layers, kinds, state, leave), turns, roles, texts, strict=True):
                    for edit in code:
                        if edit == "D":
                            out.append((conv_id, step, edit, turn, role, text))
                        else:
                            state = KEPT[state][kind_of(role, PLAIN) // 3] if edit == "K" else NEXT[state]
                            out.append((conv_id, step, edit, turn, role if edit == "K" else ROLE[state], "" if edit == "I" else text))
                        step += 1
                for _ in range(inserts_at_end(state) if last else 0):
                    state = NEXT[state]
                    out.append((conv_id, step, "I", None, ROLE[state], ""))
                    step += 1
                step = 0 if last else step
            types = (b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "step", "edit", "turn", "role", "text"])

    edits = in_order(both, "part", "seq", "is_text").mapInArrow(tidy(apply), f"conv_id {kind}, step long, edit string, turn long, role string, text string")
    return Repair(edits, folds.filter("leave is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"))


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit (all edits), repaired_sha256 (of the repaired `role:text`, joined by newlines). edits: as repair gives them, not dealt anew."""
    kind = edits.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, some, types = None, [], None, False, None

        def done() -> tuple:
            return (conv, "".join(audit), sha.hexdigest())

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (types, pa.string(), pa.string()), strict=True)], ["conv_id", "audit", "repaired_sha256"])

        for b in batches:
            types, out = b.schema.field("conv_id").type, []
            for conv_id, step, edit, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "step", "edit", "role", "text")), strict=True):
                if step == 0:
                    if sha is not None:
                        out.append(done())
                    conv, audit, sha, some = conv_id, [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    sha.update(("\n" if some else "").encode() + f"{role}:{text}".encode())
                    some = True
            yield batch(out)
        if sha is not None:
            yield batch([done()])

    return edits.mapInArrow(tidy(digest), f"conv_id {kind}, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with one in four damaged, by a hash of conv_id and turn: some are missing, emptied, without their ends of sentences, twice there, or the user's."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.pmod(F.crc32(F.concat(conv, F.lit(":"), turn)), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = rows.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows))
    numbers, texts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), ("audit", "repaired_sha256")
    every = rows.select("conv_id").distinct().unionByName(found.report, allowMissingColumns=True).unionByName(digests(found.edits), allowMissingColumns=True)
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return every.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers), *(F.coalesce(F.max(c), F.lit(nothing[c])).alias(c) for c in texts))


#: The same programme with whole audits: one recursive step a row, the least cost and audit for each state (0 nothing yet, 1 after s, 2 after u, 3 after a).
OP12_SQL = f"""
WITH RECURSIVE {CRC32_SQL.strip()},
hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS filled FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS times, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
rows AS (SELECT *, CASE WHEN filled = '' THEN 'b' WHEN times > 1 THEN 'd' WHEN right(filled, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
report AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS size FROM rows GROUP BY conv_id),
inserts AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'user:'), (1, 2, 5, 'I', 'user:'), (2, 3, 5, 'I', 'assistant:'), (3, 2, 5, 'I', 'user:')) AS t(old, mid, cost, code, piece)),
edits AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS t(mid, c, new)),
moves AS (
  SELECT conv_id, k, i.old, i.mid AS new, i.cost + 2 AS cost, i.code || 'D' AS code, CASE WHEN i.piece = '' THEN [] ELSE [i.piece] END AS pieces FROM rows, inserts i
  UNION ALL SELECT conv_id, k, i.old, e.new, i.cost + CASE WHEN fault = 't' THEN 5 ELSE 0 END, i.code || 'K', CASE WHEN i.piece = '' THEN [] ELSE [i.piece] END || [role || ':' || text] FROM rows r, inserts i, edits e WHERE e.mid = i.mid AND e.c = r.c AND fault IN ('', 't')
  UNION ALL SELECT conv_id, k, i.old, j.mid, i.cost + 1 + CASE WHEN fault = 't' THEN 5 ELSE 0 END, i.code || 'R', CASE WHEN i.piece = '' THEN [] ELSE [i.piece] END || [j.piece || text] FROM rows, inserts i, inserts j WHERE j.old = i.mid AND j.code = 'I' AND fault IN ('', 't')),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS pieces FROM report
  UNION ALL
  SELECT conv_id, k, state, best.cost, best.audit, best.pieces FROM (
    SELECT w.conv_id, w.k + 1 AS k, m.new AS state, min({{'cost': w.cost + m.cost, 'audit': w.audit || m.code, 'pieces': w.pieces || m.pieces}}) AS best
    FROM walk w JOIN moves m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.k = w.k + 1 AND m.old = w.state GROUP BY w.conv_id, w.k, m.new)),
ends AS (SELECT * FROM (VALUES (0, 0, '', []), (1, 10, 'II', ['user:', 'assistant:']), (2, 5, 'I', ['assistant:']), (3, 0, '', [])) AS t(state, cost, code, pieces)),
ended AS (
  SELECT w.conv_id, min({{'cost': w.cost + e.cost, 'audit': w.audit || e.code, 'pieces': w.pieces || e.pieces}}) AS best
  FROM walk w JOIN report r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.k = r.size JOIN ends e USING (state) GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.pieces, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN report r ON o.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""
