import hashlib
import random
import re
import zlib

import pytest

from bidloom.llm import turns
from bidloom.llm.turns import Costs

SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """blank, duplicate, truncated or nothing for each row."""
    out, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def walk(rows, costs):
    """All edits, whole audits compared: report, audit and repaired turns."""
    best, bad = None, faults(rows)

    def go(k, cost, audit, kept):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        so_far = "".join(r[:1] or "?" for r, _ in kept)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", so_far) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, list(kept))
        if not re.fullmatch("(s?(ua)*u?)?", so_far):
            return
        if len(audit) - len(audit.rstrip("I")) < 2:
            for role in ("user", "assistant"):
                go(k, cost + costs.insert, audit + "I", [*kept, (role, "")])
        if k < len(rows):
            _, role, text = rows[k]
            go(k + 1, cost + costs.delete, audit + "D", kept)
            if bad[k] not in ("blank", "duplicate"):
                more = costs.truncated if bad[k] else 0
                go(k + 1, cost + costs.keep + more, audit + "K", [*kept, (role, text)])
                for to in ("user", "assistant"):
                    go(k + 1, cost + costs.rerole + more, audit + "R", [*kept, (to, text)])

    go(0, 0, "", [])
    known = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    report = {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": best[0]}
    return report | {c: bad.count(c) for c in ("blank", "duplicate", "truncated")}, best[1], best[2]


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def compared(spark, rows, costs=Costs(), most=turns.BLOCK_ROWS, partitions=4):
    found = turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(partitions), costs, most)
    reports = {r["conv_id"]: r.asDict() for r in found.report.collect()}
    digests = {r["conv_id"]: r for r in turns.digests(found.edits).collect()}
    edits = {}
    for r in found.edits.collect():
        edits.setdefault(r["conv_id"], []).append(r)
    want = by_conversation(rows)
    assert set(reports) == set(digests) == set(want)
    for conv, own in want.items():
        report, audit, kept = walk(own, costs)
        assert {k: v for k, v in reports[conv].items() if k != "conv_id"} == report, (conv, own)
        assert digests[conv]["audit"] == audit, (conv, own)
        assert digests[conv]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        assert [(r["role"], r["text"]) for r in sorted(edits[conv], key=lambda r: r["step"]) if r["edit"] != "D"] == kept


def some_rows(seed, conversations, length):
    rng = random.Random(seed)
    texts = ["one.", "two!", "three", "four?", " ", "", None, "five. ", "six\n", "é."]
    return [(c, t if rng.random() < 0.9 else rng.choice([None, 0, 7]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for c in range(conversations) for t in range(rng.randint(1, length))]


@pytest.mark.parametrize("costs", [Costs(), Costs(rerole=4, delete=9, insert=1), Costs(keep=1, rerole=1, delete=1, insert=1, truncated=0), Costs(rerole=0, delete=3, insert=2, truncated=1)])
def test_equals_a_search_of_all_edits(spark, costs):
    compared(spark, some_rows(sum(costs), 60, 5), costs)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_blocks_change_nothing(spark, most):
    compared(spark, some_rows(most, 25, 6), most=most, partitions=7)


def test_defined_cases(spark):
    rows = [
        (None, 1, "user", "a."), (None, 2, "assistant", "b."),
        (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 5, None, None), (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "assistant", "same."),
        (4, 0, "system", "s."), (5, 0, "system", "s."), (5, 1, "user", "x" * 50_000 + "."), (5, 2, "assistant", "y" * 50_000),
    ]
    compared(spark, rows)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS part", "2 AS seq", "3 AS cost", "4 AS audit", "5 AS digest", "6 AS fault")
    assert turns.repair(wide).report.count() == 6
    nothing = turns.repair(wide.limit(0))
    assert nothing.report.count() == 0 and turns.digests(nothing.edits).count() == 0
    with pytest.raises(ValueError):
        turns.Layers(Costs(insert=0))


def test_a_long_conversation_of_many_blocks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {rng.randint(0, 2000)}{rng.choice('.!?, ')}") for t in range(3000)]
    few, many = (turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(6), most=most) for most in (10_000, 40))
    assert few.report.collect() == many.report.collect()
    assert turns.digests(few.edits).collect() == turns.digests(many.edits).collect()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind:
            left += [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    want = by_conversation(left)
    found = {r["conv_id"]: r.asDict() for r in turns.op12_conversation_repair(spark, sf).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, row in found.items():
        if conv not in want:
            assert row == {"conv_id": conv, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
            continue
        report, audit, kept = walk(want[conv], Costs())
        assert row == {"conv_id": conv, **report, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()}
