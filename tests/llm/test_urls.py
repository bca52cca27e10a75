"""The template tree against a walk over Python dictionaries."""

import math
import random
import re
from collections import defaultdict

from bidloom.llm import urls as U


def parts_of(path):
    out = []
    for s in path.split("/"):
        if s:
            out.append(re.sub(r"\d+", "<n>", re.sub(r"^[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*(?=\.|$)", "<id>", s)))
    return tuple(out)


def slow_templates(pages, rules):
    rows = []
    for i, url in pages:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        rows.append((i, host, parts_of(path), rule and rule[2]))
    share = lambda rs: (sum(r[3] == "block" for r in rs), sum(r[3] is not None for r in rs))
    b, n = share(rows)
    overall, out = b / n if n else 0.0, {}

    def fixed(level, rs):
        groups = defaultdict(list)
        for r in rs:
            if len(r[2]) > level:
                groups[r[2][level]].append(r)
        return {s: g for s, g in sorted(groups.items()) if "<" not in s and len(g) >= U.LEAST and len(g) >= U.RARE * len(rs)}

    def extend(template, level, upto, rs):
        merged = [fixed(k, rs) for k in range(level, level + upto)]
        return ["/".join([template, *("|".join(f) if s in f else "*" for f, s in zip(merged, r[2][level : level + upto]))]) for r in rs]

    def names_at(level, rs):
        groups = fixed(level, rs)
        known = sorted((share(g)[0] / share(g)[1], s) for s, g in groups.items() if share(g)[1] >= U.LEAST)
        few = [s for s, g in groups.items() if share(g)[1] < U.LEAST]
        clusters = []
        for q, s in known:
            if clusters:
                (b0, n0), (b1, n1) = share(groups[clusters[-1][-1]]), share(groups[s])
                p = (b0 + b1) / (n0 + n1)
                if b1 / n1 - b0 / n0 > U.APART * math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)):
                    clusters.append([])
            else:
                clusters.append([])
            clusters[-1].append(s)
        return {s: "|".join(sorted(c)) for c in [*clusters, few] for s in c} if len(clusters) > 1 else None

    def walk(template, level, rs, parent):
        b, n = share(rs)
        purity = (b + U.SMOOTHING * parent) / (n + U.SMOOTHING)
        deepest = max(len(r[2]) for r in rs)
        at = next((k for k in range(level, deepest) if 0 < b < n and names_at(k, rs)), None)
        if at is None:
            for r, t in zip(rs, extend(template, level, deepest, rs)):
                out[r[0]] = t, purity
            return
        name, held = names_at(at, rs), defaultdict(list)
        for r, t in zip(rs, extend(template, level, at - level, rs)):
            held[f"{t}/{name.get(r[2][at], '*')}" if len(r[2]) > at else f"{t}/"].append(r)
        for t, g in held.items():
            walk(t, at + 1, g, purity)

    for host in {r[1] for r in rows}:
        walk(host, 0, [r for r in rows if r[1] == host], overall)
    return out


RULES = (("a.com", "/de/", "block"), ("a.com", "/fr/", "allow"), ("a.com", "/nl/", "allow"), ("a.com", "/it/x/", "block"), ("a.com", "/it/y/", "allow"), ("b.org", "/", "allow"), ("c.net", "/p/q/r/s/t/u/", "block"), ("c.net", "/p/q/r/s/t/v/", "allow"))


def test_templates_equal_a_walk(spark):
    rng, made = random.Random(3), [(1, None), (2, "x"), (3, "http://a.com"), (4, "http://a.com/"), (5, "http://a.com/de"), (6, "http://a.com/it/zz/9")]
    for i in range(900):
        first = rng.choice(["de", "fr", "nl", "en", "it", "it", f"page{rng.randint(0, 9)}", f"s{'x' * rng.randint(0, 30)}"])
        made.append((100 + i, f"https://{rng.choice(['a.com', 'www.a.com', 'b.org'])}/{first}/{rng.choice(['x', 'y', str(i)])}/{rng.choice([str(i), 'a1b2c3d4e5', 'end'])}"))
    made += [(2000 + i, f"http://c.net/p/q/r/s/t/{'uv'[i % 2]}/{i % 7}/{i}") for i in range(60)]
    got = {r.page_id: (r.template, r.purity) for r in U.judge(spark.createDataFrame(made, "page_id long, url string"), RULES).collect()}
    want = slow_templates(made, RULES)
    assert got.keys() == want.keys()
    for k, (t, p) in want.items():
        assert got[k][0] == t and abs(got[k][1] - p) < 1e-12, (k, got[k], t, p)
    names = {t for t, _ in got.values()}
    assert {"a.com/de/*/*", "c.net/p/q/r/s/t/u/*/*", "c.net/p/q/r/s/t/v/*/*"} <= names and any(re.match(r"a.com/[^/]*en[^/]*/", t) for t in names) and any(t.startswith("a.com/it/x/") for t in names)


def test_fixed_segments_decide(spark):
    made = [(i, f"http://h.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(40)] + [(100 + i, f"http://h.com/{x}") for i, x in enumerate(["de", "fr", "en/5"])]
    got = {r.page_id: (r.template, r.verdict) for r in U.judge(spark.createDataFrame(made, "page_id long, url string")).collect()}
    assert got[100] == ("h.com/de", "block") and got[101] == ("h.com/fr", "allow") and got[102][0] == "h.com/*/*"
