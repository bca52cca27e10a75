"""The tag-path ratios against a slow version of their definition, and what depends on them."""

import math
import random

import pytest

from bidloom.llm import html_text as H

LONG = "It is a text, a good one, and it goes on. There is more of it, as one sees."


def random_page(seed):
    rng = random.Random(seed)
    words = lambda: " ".join(rng.choice(["wort,", "ding", "so.", "mehr", "und", "aber!"]) for _ in range(rng.randint(1, 40)))

    def part(depth):
        tag = rng.choice(["div", "section", "p", "ul", "h2", "article", "aside", "nav", "blockquote"])
        name = rng.choice(["", "", ' class="ad"', ' class="entry"', ' id="sidebar"'])
        inner = "".join(part(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 and tag not in ("p", "h2") else ""
        link = f'<a href="/">{words()}</a>' if rng.random() < 0.3 else ""
        return f"<{tag}{name}>{words() if rng.random() < 0.6 else ''}{link}{inner}</{tag}>"

    return "<body>" + "".join(part(0) for _ in range(rng.randint(1, 6))) + "</body>"


def slow_ratios(blocks, names):
    def path(e):
        return path(e.parent) + [e.step] if e.parent is not None else []

    paths = [path(e) for e, _, _ in blocks]
    own, n = [], len(blocks)
    total = lambda p, f: sum(f(b) for q, b in zip(paths, blocks) if q == p)
    dots = lambda t: sum(c in ".,;:!?…。、，！？" for c in t)
    length, marks, links = ([total(p, f) for p in paths] for f in (lambda b: len(b[1]), lambda b: dots(b[1]), lambda b: min(b[2], len(b[1]))))
    for k in range(n):
        fused = length[k] / max(length) * (H.PLAIN + (1 - H.PLAIN) * (marks[k] / max(marks) if max(marks) else 0))
        own.append(fused**0.5 * (1 - links[k] / length[k]))

    def like(a, b):
        a, b = a[:-1], b[:-1]
        common = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        return (1 + common) / max(len(a) + 1, len(b) + 1)

    fused = []
    for k in range(n):
        near = [(math.exp(-((j - k) ** 2) / 2) * like(paths[k], paths[j]) ** 2, own[j]) for j in range(n) if abs(j - k) <= H.WINDOW]
        fused.append((own[k] + sum(w * x for w, x in near) / sum(w for w, _ in near)) / 2)
    return [names[k] * sum(f for q, f in zip(paths, fused) if q == p) / sum(q == p for q in paths) for k, p in enumerate(paths)]


def test_ratios_equal_their_definition():
    seen = 0
    for seed in range(60):
        blocks = H.blocks_of(random_page(seed))
        if blocks:
            names = H.evidence(blocks)
            assert H.ratios(blocks, names) == pytest.approx(slow_ratios(blocks, names), abs=1e-12)
            seen += len(blocks)
    assert seen > 300


def test_the_ratios_decide(monkeypatch):
    page = f'<body><div><a href="/">One</a> <a href="/">Two</a></div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div>Imprint</div></body>'
    assert H.main_text(page) == f"Title {LONG} {LONG}"
    monkeypatch.setattr(H, "ratios", lambda blocks, names: [1.0] * len(blocks))
    assert H.main_text(page) == f"One Two Title {LONG} {LONG} Imprint"


def test_paths_are_told_apart_without_names(monkeypatch):
    monkeypatch.setattr(H, "evidence", lambda blocks: [1.0] * len(blocks))
    story = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} {LONG}</p><p>Short.</p>"
    want = f"Title {LONG} {LONG} {LONG} Short."
    menu, foot = '<ul><li><a href="/">One</a></li><li><a href="/">Two</a></li></ul>', "<footer>&copy; A firm. All of it.</footer>"
    for page in (f'<body>{menu}<div class="ad">Buy now, the best.</div><article>{story}</article>{foot}</body>', f'<body>{menu}<div class="x"><section>{story}</section></div><div class="y"><p>Other, and so on.</p></div>{foot}</body>'):
        assert H.main_text(page) == want


def test_headlines_stay_and_adverts_go():
    assert H.main_text(f'<div id="story"><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class="more-stories"><p>Other story, read it.</p></div>') == f"T {LONG} {LONG}"
    assert H.main_text(f'<body><div class="top-ad-slot"><p>Buy now, the best offer.</p></div><article><h1>T</h1><p>{LONG}</p></article>') == f"T {LONG}"
    assert H.main_text(f"<article><h1>T</h1><p><b>{LONG} {LONG}<br><p>Short.</p></article><footer>A firm.</footer>") == f"T {LONG} {LONG} Short."


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-header main", "page with-sidebar", "content no-sidebar", "post tags-news", "footer-widgets-on"])
def test_names_never_empty_a_wrapper(name):
    page = f'<body><div class="{name}"><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article></div><div class="sidebar"><p>{LONG}</p></div></body>'
    assert H.main_text(page) == f"Title {LONG} Short."


@pytest.mark.parametrize("page, text", [("<ul><li><a href='/'>a</a></li></ul><p><a href='/'>b</a></p>", "b"), ("<p>a</p><p>b</p>", "a b"), ("<div hidden>x</div>", ""), (None, ""), ("<p>&lt;b&gt; &#8364;&nbsp;5</p>", "<b> € 5")])
def test_odd_pages(page, text):
    assert H.main_text(page) == text
