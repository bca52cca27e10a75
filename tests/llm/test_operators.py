"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.llm import ann, embdups, html_text, licenses, lm, minhash, mixing, pieces, toxicity, urls
from bidloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, source string, node long, sig string, bands int, hash long, size long, rank int, key string, word string, mark long, n int, label string, words string"
VEC = "vec_id long, embedding array<float>, label int, node string, key int, vector string, m int, parts int, members int"


def texts(n=60, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 80))) for _ in range(n)]


def rows(spark, triples):
    return spark.createDataFrame([(i, t, s, *[None] * 12) for i, t, s in triples], ODD)


@pytest.fixture(scope="module")
def documents(spark):
    base = texts()
    made = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    words = base[0].split()
    made += [(100, base[0], "s0"), (101, base[0].upper(), "s1"), (102, " ".join(words[:-1]), "s1"), (103, None, "s2"), (104, "", None), (105, "  \n ", None), (106, "one two", "s2"), (107, "ONE  two", "s3")]
    made += [(108, base[3], "s3"), (108, base[3], "s3"), (None, base[5], "s0"), (109, "wort " * 30_000, "s0"), (110, base[7] + " " + "é▁日🎉\t%%", "s1")]
    return made


def brute_components(made):
    def shingles(t):
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t, _ in made]
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _, _) in enumerate(made):
        groups[find(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _, _) in enumerate(made)), key=str)


def test_minhash_equals_brute_force(spark, documents):
    got = minhash.near_duplicates(rows(spark, documents)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(documents)


def test_minhash_finds_links_through_large_groups(spark, monkeypatch):
    """Chains of copies that drift apart, in blocks smaller than the group."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, made = random.Random(1), []
    for g in range(2):
        words = [f"w{g}_{rng.randint(0, 10**6)}" for _ in range(120)]
        for i in range(40):
            made.append((g * 100 + i, " ".join(words), "s"))
            words = list(words)
            words[rng.randrange(120)] = f"x{g}_{i}"
    got = minhash.near_duplicates(rows(spark, made)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(made)


def test_minhash_links_rows_without_ids(spark):
    """The classes of g and h have null ids only; an id has one of k's."""
    made = []
    for g in "ghk":
        words = [f"{g}{i}" for i in range(120)]
        made += [(None, " ".join(words), "s"), (7 if g == "k" else None, " ".join([*words[:-1], "x"]), "s")]
    classes = minhash.linked_classes(df := rows(spark, made), *minhash.digests(df)).collect()
    assert len({r.node for r in classes}) == 6 and len({r.component for r in classes}) == 3
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()), key=str) == brute_components(made)


def test_one_document_of_each_group_stays(spark, documents):
    left = minhash.without_near_duplicates(rows(spark, documents))
    assert left.columns == rows(spark, documents).columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    want = brute_components(documents)
    assert len(got) == len(set(got))
    assert {d for d, _ in got} == {c if c is not None else d for d, _, c in want}


def test_minhash_checks_pairs_that_are_the_best_of_neither_end(spark):
    """Chains C-A-B-D whose ends lie nearer to A and B than these to each other; few bands, so that A and B often share only bands of two."""
    made = []
    for g in range(150):
        a = [f"w{g}x{i}" for i in range(124)]
        b = [*[f"b{g}x{i}" for i in range(9)], *a[9:]]
        c = [*a[:-4], *[f"c{g}x{i}" for i in range(4)]]
        d = [*b[:60], f"d{g}", *b[61:]]
        made += [(4 * g + k, " ".join(w), "s") for k, w in enumerate((a, b, c, d))]
    bands = {r.doc_id: set(r.bands) for r in minhash.digests(rows(spark, made), minhash.Scheme(85, 6, 4))[0].collect()}
    words = {d: t.split() for d, t, _ in made}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in words.items()}
    want = {d: d for d in sets}
    for _ in range(3):
        for d in sets:
            for e in range(d // 4 * 4, d // 4 * 4 + 4):
                if bands[d] & bands[e] and 100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e]):
                    want[d] = want[e] = min(want[d], want[e])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows(spark, made), 85, 6, 4).collect()}
    assert got == want


def test_pipeline_drops_copies_from_eighty_per_cent_on(spark):
    """Copies with changed first words, at similarities of 0.79 to 0.86."""
    import corpus_pipeline

    made, want = [], set()
    for g, changed in enumerate((10, 11, 13, 14, 15, 16)):
        words = [f"w{g}x{i}" for i in range(144)]
        made += [(10 * g, " ".join(words), "s"), (10 * g + 1, " ".join([f"v{g}x{i}" for i in range(changed)] + words[changed:]), "s")]
        want |= {10 * g} | ({10 * g + 1} if 100 * (140 - changed) < 80 * (140 + changed) else set())
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, rows(spark, made), "").collect()}
    assert left == want and {30, 31} - left == {31} and {50, 51} <= left
    linked = minhash.near_duplicates(rows(spark, made)).filter("not kept").collect()
    assert {r.doc_id for r in linked} == {1, 11}


def test_needed_matches_rise_with_the_hashes_compared():
    steps = minhash.needed_matches()
    assert [n for n, _ in steps][-1] == minhash.BANDS * minhash.ROWS
    assert all(0 < m < n for n, m in steps) and all(a[1] < b[1] for a, b in zip(steps, steps[1:], strict=False))
    assert steps[-1][1] / steps[-1][0] > 0.7


def brute_mix(made):
    size = [(d, s, len(WORD.findall(t or ""))) for d, t, s in made]
    total, by = sum(n for *_, n in size), Counter()
    for _, s, n in size:
        by[s] += n
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        open_ = [s for s in order if s not in capped]
        level = (total - sum(3 * by[s] for s in capped)) / (sum(weight[s] for s in open_) or 1)
        over = {s for s in open_ if weight[s] * level > 3 * by[s]}
        if not over:
            return by, {s: 3.0 * by[s] if s in capped else weight[s] * level for s in order} | target
        capped |= over


def test_mixing_comes_near_its_targets(spark, documents):
    got = mixing.mix(rows(spark, documents)).collect()
    by, target = brute_mix(documents)
    assert len(got) == len(documents)
    taken = Counter()
    for r in got:
        assert r.source_size == by[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
    largest = defaultdict(int)
    for r in got:
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in by)


def test_mixed_documents_repeat_as_often_as_the_mix_says(spark, documents):
    df = rows(spark, documents)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == +want


def test_html_drops_boilerplate_and_keeps_short_blocks(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies.</div>
      <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="sidebar"><p>Side text, quite long. More, more, more text here.</p></div>
      <div id="content"><h1>Title</h1><p>Hello <b>wor</b>ld &amp; all,<br>there. It is a text,\n a good one.</p><ul><li>item one</li></ul><form><p>Your name</p></form><p>Short.</p></div>
      <div class="comments"><p>Nice, really nice post. Very much, thanks.</p></div><footer>foot</footer></body></html>"""
    made = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "plain  text"), (5, "u", "<article><p>un<b>closed<p>two &am"), (6, "u", "<p>" + "long, text. " * 50_000), (6, "u", "<a <b"), (7, "u", "<script>if (a</b) x</script><p>y</p>")]
    got = html_text.extract(spark.createDataFrame([(*m, None) for m in made], "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in got] == ["Title Hello world & all, there. It is a text, a good one. item one Short.", "", "", "plain text", "unclosed two &am", ("long, text. " * 50_000).strip(), "", "y"]
    assert all(r.n_chars == len(r.text) for r in got)


LONG = "It is a text, a good one, and it goes on. There is more of it, as one sees."


@pytest.mark.parametrize("before, after", [('<div class="has-sidebar">', "</div>"), ('<div class="page-header-fixed no-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<form><div class="header">', "</div></form>"), ('<div class="sidebar"><main>', "</main></div>")])
def test_html_reads_wrappers_with_names_of_boilerplate(before, after):
    page = f'<body><nav><a href="/">Home</a></nav>{before}<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>{after}<div class="comments"><p>{LONG * 9}</p></div><footer>foot</footer></body>'
    assert html_text.main_text(page) == f"Title {LONG} {LONG}"


@pytest.mark.parametrize("name", ["ad", "widget", "site-header"])
def test_html_drops_boilerplate_longer_than_the_article(name):
    assert html_text.main_text(f'<body><div class="{name}"><p>{LONG}</p></div><article><p>Short.</p></article></body>') == "Short."


def test_html_keeps_the_header_of_an_article():
    page = f'<body><header><h1>Site</h1></header><div class="site-header">Name</div><article><header><h1>Title</h1></header><p>{LONG}</p><footer>foot</footer></article></body>'
    assert html_text.main_text(page) == f"Title {LONG}"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article><h2>One</h2><p>{LONG}</p><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article></body>",
        f'<body><div class="entry-content"><h2>One</h2><p>{LONG}</p><p>{LONG}</p></div><div class="entry-content"><h2>Two</h2><p>{LONG}</p></div></body>',
        f'<body><div><h2>One</h2><p class="text">{LONG} {LONG}</p><h2>Two</h2><p>{LONG}</p></div></body>',
        f"<body><div><h2>One</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><h2>Two</h2><div><p>{LONG}</p></div></body>",
        f'<body><div><h2>One</h2><p class="entry">{LONG} {LONG}</p></div><section><h2>Two</h2><p>{LONG}</p></section></body>',
    ],
)
def test_html_keeps_all_parts_of_the_text(page):
    got = html_text.main_text(page)
    assert got.count(LONG) == page.count(LONG) and got.startswith("One It is")


def test_urls_follow_rules_then_templates(spark):
    made = [(1, "http://A.example.org/es/5?x"), (2, "https://example.org/en/12"), (3, "https://notexample.org/es/1"), (4, "http://x.com/fr/1#a"), (5, "http://x.com/de/1"), (6, "http://net"), (7, None), (8, "nothing"), (9, "http://h.com?/fr/")]
    made += [(100 + i, f"http://bad.com/de/{i}") for i in range(30)] + [(200 + i, f"http://bad.com/de{'x' * (i % 2)}/a/{i}") for i in range(4)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([(*m, 1, "x") for m in made], "page_id long, url string, n int, parts string")).collect()}
    assert len(got) == len(made)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4, 5)] == [
        ("a.example.org", "/es/5", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/1", "org/", "allow"), ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de/1", "com/de/", "block")
    ]
    assert (got[6].host, got[6].path, got[6].rule) == ("net", "", None) and (got[7].host, got[7].path) == ("", "") == (got[8].host, got[8].path) and (got[9].host, got[9].path) == ("h.com", "")
    assert all(r.verdict in ("allow", "block") and 0 <= r.purity <= 1 for r in got.values())


def brute_vectors(made):
    ok = [(v is not None and None not in v and np.isfinite(v).all() and any(v)) and lab is not None for _, v, lab in made]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None for (_, v, _), good in zip(made, ok, strict=True)]
    link = [[i != j and ok[i] and ok[j] and made[i][2] == made[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.98 for j in range(len(made))] for i in range(len(made))]
    seen, out = {}, []
    for i in range(len(made)):
        if i not in seen:
            stack, group = [i], {i}
            while stack:
                x = stack.pop()
                for j, yes in enumerate(link[x]):
                    if yes and j not in group:
                        group.add(j)
                        stack.append(j)
            for x in group:
                seen[x] = min((made[y][0] for y in group if made[y][0] is not None), default=None)
        out.append((made[i][0], sum(link[i]), seen[i]))
    return sorted(out, key=str)


def test_embedding_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embdups, "BLOCK", 8)
    rng = np.random.default_rng(3)
    made = [(i, rng.normal(size=16).astype(np.float32).tolist(), i % 3) for i in range(60)]
    for i in range(60):
        made.append((1000 + i, (np.array(made[i % 5][1]) + rng.normal(size=16) * 0.08).astype(np.float32).tolist(), (i % 5) % 3))
    made += [(1, made[0][1], 0), (2000, made[0][1], 0), (2001, made[0][1], 1), (2002, made[0][1], None), (2003, None, 1), (2004, [0.0] * 16, 1), (2005, [float("nan")] * 16, 1), (2006, [None] * 16, 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1), (None, made[1][1], 1), (2009, [], 1)]
    df = spark.createDataFrame([(*m, *[None] * 6) for m in made], VEC)
    got = embdups.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_vectors(made)


def test_nearest_neighbours_reach_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12))
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 12)) * 0.3).astype(np.float32)
    made = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 12, 0), (5200, [1.0], 0), (5202, [3.0], 0), (5300, [float("inf")] * 12, 0), (100, x[100].tolist(), 0)]
    df = spark.createDataFrame([(*m, *[None] * 6) for m in made], VEC)
    got = ann.search(df, F.col("vec_id") % 100 == 0, sample=512, parts=8).collect()
    hits = 0
    for q in range(0, 3000, 100):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = 0.0 if q == 100 else np.inf  # another row has this id and vector
        best = np.lexsort((np.arange(3000), d))[:10]
        assert [r.rank for r in mine] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(best.tolist()))
    assert hits >= 0.9 * 300 and {r.query_id for r in got} == {*range(0, 3000, 100), 5200}
    assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 5200] == [(1, 5202, 2.0)] and [r.vec_id for r in got if r.query_id == 100 and r.rank == 1] == [100]


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0, *[None] * 6) for i in range(4)], VEC)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_toxicity_learns_folds_and_excepts(spark):
    rng = random.Random(2)
    base = texts(400, 9)
    made, labels = [], []
    for i, t in enumerate(base):
        toxic = i % 4 == 0
        w = t.split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["blarghead", "zonkface", "trash"]))
        made.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (3, 1, None), (5, 1, 0)]
    df, lab = rows(spark, made), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, lab, F.col("doc_id") % 3 != 1)
    extra = [(1000, "mere words and bl4rgh3ad zоnkface here", "s"), (1001, "put it in the trash can and the trash bin", "s"), (1002, None, "s"), (1003, "", "s"), (1003, "", "s"), (1004, "fine words " * 40_000 + "nothing", "s")]
    got = {r.doc_id: r.score for r in toxicity.score(rows(spark, made + extra), model).collect()}
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == (i % 4 == 0) for i in held]) > 0.97
    assert got[1000] >= 0.7 and all(got[i] < 0.7 for i in (1001, 1002, 1003, 1004))
    left = toxicity.clean_documents(rows(spark, made + extra), model)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, s in got.items() if s < 0.7}


def test_toxicity_without_labels_uses_the_seed(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = rows(spark, [(1, "you id1ot, worthless", "s"), (2, "hello there", "s")])
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.learn(df, empty)).collect()}
    assert got[1] > 0.7 > got[2]


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(pieces.Vocabulary(pieces.read_model(pieces.MODEL_PATH)))


def test_pieces_give_back_every_text(spark, documents):
    df = rows(spark, documents)
    coded = pieces.encode_documents(df)
    got = coded.collect()
    assert len(got) == len(documents) and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    back = sorted(((r.doc_id, r.text) for r in pieces.decode_documents(coded).collect()), key=str)
    assert back == sorted(((d, t or "") for d, t, _ in documents), key=str)


@pytest.mark.parametrize("text", ["a▁b", "▁", "q", "日本語 テスト 🎉", "  two  spaces ", "\n\n x", " ", "\t", "é▁▁ z", "\x00\x7f", "x" * 500])
def test_pieces_round_trip(coder, text):
    ids = coder.encode(text).tolist()
    assert coder.decode(ids) == text and coder.encode_all([text])[0].tolist() == ids


def library_of(v, path):
    """The library's own unigram encoder with the same pieces and scores."""
    import struct

    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(f, kind, value):
        return varint(f << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value if kind == 2 else value)

    def changed(message, change):
        return b"".join(field(f, k, change(f, x)) for f, k, x in pieces.read_fields(message))

    out, i = b"", 0
    with open(path, "rb") as f:
        data = f.read()
    for f, kind, value in pieces.read_fields(data):
        if f == 1:
            score, i = struct.pack("<f", v.score[i]), i + 1
            value = changed(value, lambda g, x, score=score: score if g == 2 else x)
        elif f == 2:
            value = changed(value, lambda g, x: 1 if g == 3 else x)
        out += field(f, kind, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_pieces_are_as_likely_as_the_library_s(coder, documents):
    lib = library_of(coder.v, pieces.MODEL_PATH)
    total = lambda ids: sum(coder.v.score[i] for i in ids)
    for _, t, _ in documents:
        if t and len(t) < 5000 and "▁" not in t:
            for w in t.split():
                ours, theirs = coder.encode(w).tolist(), lib.encode(w)
                assert ours == theirs or total(ours) == pytest.approx(total(theirs), abs=1e-4)


def test_licenses_find_phrases_and_templates(spark):
    made = [
        (1, "x CC BY y\nAll rights reserved. General  public-license!", "s"), (2, "Released under the MIT License.", "s"), (3, "Licensed under the Apache License, Version 2.0.", "s"), (4, None, "s"), (5, "", "s"),
        (6, "cc by cc by", "s"), (6, "cc by cc by", "s"), (7, "éall rights reserved", "s"), (8, "word " * 20_000 + ". this work is licensed under the GNU General Public License, version 3.", "s"), (9, "mit license", "s"),
    ]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(rows(spark, made)).collect()), key=str)
    want = [
        (1, 10, 3, 1, 7, "cc-by,gpl,reserved", "cc-by,gpl,reserved", 1.0), (2, 5, 0, None, None, "", "mit", 1.0), (3, 8, 0, None, None, "", "apache-2.0", 1.0), (4, 0, 0, None, None, "", "", 0.0), (5, 0, 0, None, None, "", "", 0.0),
        (6, 4, 2, 0, 2, "cc-by", "cc-by", 1.0), (6, 4, 2, 0, 2, "cc-by", "cc-by", 1.0), (7, 3, 0, None, None, "", "", 0.0), (9, 2, 0, None, None, "", "", 0.0),
    ]
    assert [g for g in got if g[0] != 8] == want
    (long,) = [g for g in got if g[0] == 8]
    assert long[1:6] == (20_012, 1, 20_007, 20_007, "gpl") and "gpl-3.0" in long[6]


def test_licenses_find_wrapped_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy%sof this software and associated documentation files (the \"Software\"), to deal%sin the Software without restriction."
    bsd = "Redistribution and use in source and binary forms, with or without%smodification, are permitted provided that the following conditions are met:"
    isc = "Permission to use, copy, modify, and/or distribute this software for any%spurpose with or without fee is hereby granted, provided that it stays."
    made = [(1, "x = 1\n\n" + mit % ("\n", "\n"), "s"), (2, bsd % "\n# ", "s"), (3, isc % "\r\n * ", "s"), (4, bsd % "\n\n", "s"), (5, isc % " \n \t\r\n", "s"), (6, isc % ". ", "s"), (7, mit % (" ", " "), "s"), (8, "Ge mit " + "den der " * 10 + "\nLicensed under the Apache License, Version 2.0.", "s")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(rows(spark, made)).collect()}
    assert got == {1: ("mit-text", 1.0), 2: ("bsd", 1.0), 3: ("isc", 1.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("", 0.0), 7: ("mit-text", 1.0), 8: ("apache-2.0", 1.0)}


@pytest.mark.parametrize("name", ["mix", "mixed", "lm", "toxicity", "minhash", "without", "pieces", "licenses"])
def test_empty_documents_give_empty_results(spark, name):
    df = rows(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {
        "mix": lambda: mixing.mix(df), "mixed": lambda: mixing.mixed_documents(df), "lm": lambda: lm.score(df, F.lit(True)), "toxicity": lambda: toxicity.score(df, toxicity.learn(df, labels)),
        "minhash": lambda: minhash.near_duplicates(df), "without": lambda: minhash.without_near_duplicates(df), "pieces": lambda: pieces.encode_documents(df), "licenses": lambda: licenses.scan(df),
    }[name]()
    assert out.collect() == []


def test_empty_pages_and_vectors_give_empty_results(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert html_text.extract(pages).collect() == urls.judge(pages).collect() == embdups.near_duplicates(vectors).collect() == ann.search(vectors, F.lit(True)).collect() == []


def test_components_by_star_operations(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500, 500 + i) for i in range(60)] + [(700 + i, 701 + i) for i in range(50)] + [(None, 3), (5, None)]
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and find(u) != find(v):
            root[max(find(u), find(v))] = min(find(u), find(v))
    df = spark.createDataFrame(edges, "u long, v long")
    for limit in (10, 10_000):
        assert {(r.node, r.component) for r in components(df, limit).collect()} == {(x, find(x)) for x in root}
