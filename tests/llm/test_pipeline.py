"""The toxicity matcher and all stages of the pipeline against slow versions."""

import random
import re
from collections import Counter, defaultdict

from bidloom.llm import pieces, toxicity
from bidloom.llm.common import table, written

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def slow_weight(lexicon, exceptions, text):
    """Every word against every entry, without the words that an exception phrase covers."""
    words = toxicity.fold(text).split()
    spared = set()
    for phrase in exceptions:
        parts = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(parts)] == parts:
                spared |= set(range(k, k + len(parts)))
    total = 0.0
    for k, w in enumerate(words):
        if k not in spared:
            total += max((v for e, v in lexicon if f"{w} ".startswith(e)), default=0.0)
    return total, len(words)


def test_automaton_equals_a_walk_over_words():
    rng = random.Random(2)
    stems = ["idio", "trash", "scum", "moro", "fine", "pon", "pond", "can"]
    for _ in range(200):
        lexicon = sorted({rng.choice(stems) + rng.choice(["", "t", "s", " ", "t ", "ing "]): rng.choice([2.0, 2.5, 3.0, 4.0]) for _ in range(rng.randint(0, 8))}.items())
        text = " ".join(rng.choice(["Idiot", "1d10t", "trash", "can", "trash can", "pond scum", "POND", "scums", "mоrоn", "fine,", "tr@sh", "-", ""]) for _ in range(rng.randint(0, 15)))
        total, words = toxicity.weigh(toxicity.automaton(lexicon), text)
        want = slow_weight(lexicon, toxicity.EXCEPTIONS, text)
        assert words == max(want[1], 1) and abs(total - want[0]) < 1e-9, (lexicon, text)


def shingles(text):
    words = [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_groups(rows):
    """Rows by the groups that similarity 0.8 links them to; empty ones stand alone."""
    sets, group = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    by_shingle = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by_shingle[x].append(k)

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in by_shingle[x] if j < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = root(k), root(j)
                group[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(rows))]


def test_stages_against_slow_versions(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    more = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "src0", 0), (9002, "a b", None, None, 3), (9002, "a b", None, None, 3), (9003, "long word " * 3000, "en", "src1", 30000)], docs.schema)
    docs = written(docs.unionByName(more))
    before, stages = docs.collect(), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_dedup", "mixing", "sentencepiece"]

    clean = written(stages["toxicity"](spark, docs, SF))
    assert clean.columns == docs.columns
    model = toxicity.learn(docs, table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    kept = clean.collect()
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in before if scores[r["doc_id"]] < toxicity.LIMIT)

    single = written(stages["minhash_dedup"](spark, clean, SF))
    left, groups = single.collect(), slow_groups(kept)
    assert single.columns == docs.columns and Counter(map(tuple, left)) <= Counter(map(tuple, kept))
    own = defaultdict(set)
    for r, g in zip(kept, groups, strict=True):
        own[tuple(r)].add(g)
    empty = sum(1 for r in kept if not shingles(r["text"]))
    texts = [g for g in set(groups) if shingles(kept[g]["text"])]
    assert sorted(min(own[tuple(r)]) for r in left if shingles(r["text"])) == sorted(texts)
    assert sum(1 for r in left if not shingles(r["text"])) == empty

    mixed = written(stages["mixing"](spark, single, SF))
    taken = Counter(map(tuple, mixed.collect()))
    there = Counter(map(tuple, left))
    assert mixed.columns == docs.columns and set(taken) <= set(there)
    assert all(n <= 3 * there[r] for r, n in taken.items() if shingles(r[docs.columns.index("text")]))  # those without words weigh nothing

    coded = stages["sentencepiece"](spark, mixed, SF)
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode_documents(coded).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in mixed.collect())


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
    assert docs.count() == 0
