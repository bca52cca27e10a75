"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf tag path (tags with their class names). Per path, text
length, punctuation and link text are summed over the page; the ratio of a path is the square root of its text times its
punctuation, both relative to the page's best path, times the share that is no link text. Ratios are smoothed in page
order by a Gaussian window that weighs neighbours by how much of their path they share; the mean over a path's blocks is
its value. What the names on the path say (menu, footer, advert, comments ...: a factor below one; article, main: above)
weighs this value once. Paths half a standard deviation above the mean of all paths are content, wherever they stand, as
are those that reach half of the best.
A short block of another path (headings, list items) is kept where its names are as good as the content's and it lies
between content blocks of one element, or in the smallest element around nearly all content; where only the page holds
nearly all of it, also as the heading of an element that holds content. Lists of links aren't.

Names never empty a wrapper: an element that holds the main element or most of the text that is no link, on pages without
an article outside of it, is not judged by its name. A class or id counts as a whole: "site-header" is boilerplate,
"has-sidebar" and "entry-header" are not. Only elements that hold no text of the page (scripts, styles, templates, form
controls, the head) are left out before ratios are taken, and what is hidden.

Inside a block white space becomes one space; blocks are joined in page order by one space; character references are
decoded. Broken markup is read as browsers do: unclosed paragraphs end at the next block, a tag cut off by the end of
the page is dropped. Defined cases: null and empty html give an empty text; a page without markup is one block; a page
all of links gives the blocks outside of lists; rows that repeat give repeated results; an empty table gives an empty
result; only page_id, url and html are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[a-zA-Z/][^>]*+\Z|([^<]++|<)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that end a block of text; the rest are inline.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("br caption dd dt html body head li option optgroup tbody td tfoot th thead title tr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements that hold no text of the page.
CUT = frozenset("script style noscript template iframe svg math canvas object head title textarea button select audio video map datalist xmp noembed noframes applet".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip note advertisement".split())
CUT_WORDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|adbox|adslot|banners?|sponsor\w*|promo\w*|sidebars?|side|aside|menus?|nav|navbar|navigation|navs|footers?|headers?|masthead|topbar|cookies?|notices?|alerts?|consent|gdpr|disclaimer|newsletter|subscribe|subscription|popup|modal|overlay|comments?|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommended|breadcrumbs?|widgets?|login|signup|signin|search|searchbox|pagination|pager|toolbar|tags|tagcloud|hidden)"
)
#: What a boilerplate name may hold besides its words.
QUALIFIERS = frozenset("site main page left right top bottom primary secondary global block box area section container wrapper wrap list bar link links inner outer post item title text".split())
#: Boilerplate by tag that may be a wrapper; names that are never one.
WRAPPERS = frozenset("nav header footer aside form dialog menu".split())
NEVER_WRAPPERS = re.compile(r"ads?|adv|advert\w*|adsense|adbox|adslot|banners?|sponsor\w*|promo\w*|newsletter|share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|related|recommended|cookies?|consent|gdpr|popup|modal|overlay|hidden")
#: Elements that hold a single paragraph or heading.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote caption figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_CUT = frozenset(("html", "body", "main", "article"))
CONTENT = frozenset(("article", "main"))
#: Of the best path's value, the most that content needs; and the share of all content that the smallest element around it holds.
MOST, NEARLY_ALL = 0.5, 0.9
#: Factors for names on a path: boilerplate that a wrapper may be named, boilerplate that none is, and the main element.
NAMED, NEVER, MAIN = 0.1, 0.02, 2.0
#: What a path without punctuation keeps of its ratio; blocks on either side that the window reaches.
PLAIN, WINDOW = 0.1, 2
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


class Element:
    __slots__ = ("tag", "parent", "step", "cut", "soft", "firm", "inside", "link", "listed", "mass", "first", "last")

    def __init__(self, tag: str, parent: Element | None, attributes: str = ""):
        self.tag, self.parent, self.mass = tag, parent, 0.0
        whole, role, hidden = [], "", False
        if attributes:
            for m in ATTRIBUTE.finditer(attributes):
                key = (m[1] or m[5] or "").lower()
                value = m[2] or m[3] or m[4] or ""
                if key in ("class", "id"):
                    whole += [[x for x in re.split(r"[^a-z0-9]+", w) if x] for w in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split()]
                elif key == "role":
                    role = value.lower()
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = True
        self.step = ".".join([tag, *sorted({x for w in whole for x in w if not x.isdigit()})])
        named = [w for w in whole if any(map(CUT_WORDS.fullmatch, w)) and all(CUT_WORDS.fullmatch(x) or x in QUALIFIERS or x.isdigit() for x in w)] if tag not in NEVER_CUT else []
        self.inside = tag in CONTENT or role in ("main", "article") or (parent.inside if parent else False)
        own = tag in WRAPPERS and not (tag == "header" and self.inside) or role in CUT_ROLES or bool(named)
        #: The innermost boilerplate element around (or this one), and whether that can't be a wrapper.
        self.soft = self if own else parent.soft if parent else None
        self.firm = own and (tag in ("nav", "footer", "aside") or any(NEVER_WRAPPERS.fullmatch(x) for w in named for x in w))
        self.cut = hidden or tag in CUT or (parent.cut if parent else False)
        self.link = tag == "a" or (parent.link if parent else False)
        self.listed = tag in ("ul", "ol", "dl", "table") or (parent.listed if parent else False)

    def path(self) -> tuple[str, ...]:
        steps, up = [], self
        while up.parent is not None:
            steps.append(up.step)
            up = up.parent
        return tuple(reversed(steps))


class Block:
    """Text of one block, the element it stands in, and how much of it is link text."""

    __slots__ = ("element", "parts", "link_chars")

    def __init__(self, element: Element):
        self.element, self.parts, self.link_chars = element, [], 0


def blocks_of(page: str) -> list[tuple[Element, str, int]]:
    """(element, text, link characters) of each block, in page order."""
    root = Element("", None)
    stack, out, open_block = [root], [], None
    at, n = 0, len(page)

    def end_block() -> None:
        nonlocal open_block
        if open_block is not None:
            text = " ".join(html.unescape("".join(open_block.parts)).split())
            if text:
                out.append((open_block.element, text, open_block.link_chars))
            open_block = None

    def pop_to(k: int) -> None:
        if any(e.tag in BLOCK for e in stack[k:]):
            end_block()
        del stack[k:]

    while at < n:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        if m[7] is not None:
            top = stack[-1]
            if not top.cut:
                if open_block is None:
                    host = top
                    while host.tag not in BLOCK and host.parent is not None:
                        host = host.parent
                    open_block = Block(host)
                open_block.parts.append(m[7])
                if top.link:
                    open_block.link_chars += len(m[7].strip())
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:  # an inline end tag doesn't close blocks
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag in CLOSES:
            like, within = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in within:
                    break
                if stack[k].tag in like.split():
                    pop_to(k)
                    if tag != "tr":
                        break
        if tag in BLOCK:
            end_block()
        elif open_block is not None and tag == "img":
            open_block.parts.append(" ")
        if tag in VOID:
            continue
        element = Element(tag, stack[-1], m[3] or m[6] or "")
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else n
        if not (m[3] or m[6] or "").endswith("/") or tag not in ("svg", "math"):
            stack.append(element)
    end_block()
    return out


def wrappers(blocks: list[tuple[Element, str, int]]) -> set[Element]:
    """Boilerplate elements by name that hold the page's text."""
    plain: dict[Element | None, int] = defaultdict(int)
    read: set[Element | None] = set()
    for e, t, links in blocks:
        plain[e.soft] += max(0, len(t) - links)
        if e.soft is not None:
            up = e
            while up is not e.soft and up.tag != "main":
                up = up.parent
            if up is not e.soft:
                read.add(e.soft)
    firm = {}
    for e in plain:
        up, firm[e] = e, False
        while up is not None:
            firm[e] |= up.firm
            up = up.parent.soft if up.parent else None
    if not any(e.inside and e.soft is None for e, _, _ in blocks):
        total = sum(n for e, n in plain.items() if not firm[e])
        read |= {e for e, n in plain.items() if not firm[e] and 2 * n > total}
    for e in list(read):
        while e is not None:
            read.add(e)
            e = e.parent.soft if e.parent else None
    return read - {None}


def evidence(blocks: list[tuple[Element, str, int]]) -> list[float]:
    """What the names around each block say of it."""
    read = wrappers(blocks)
    out = []
    for e, _, _ in blocks:
        factor, soft = MAIN if e.inside else 1.0, e.soft
        while soft is not None:
            if soft not in read:
                factor *= NEVER if soft.firm else NAMED
            soft = soft.parent.soft if soft.parent else None
        out.append(factor)
    return out


def likeness(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Share of the elements around two blocks that they have in common, from the root; the leaves themselves don't count."""
    k, n = 0, max(len(a), len(b))
    while k < min(len(a), len(b)) - 1 and a[k] == b[k]:
        k += 1
    return (1 + k) / max(n, 1)


def ratios(blocks: list[tuple[Element, str, int]], names: list[float]) -> list[float]:
    """The value of each block's tag path: text and punctuation of the whole path, fused, smoothed over the page and averaged
    over the path's blocks; names weigh the result once."""
    paths = [e.path() for e, _, _ in blocks]
    sums: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0, 0])
    for p, (_, text, links) in zip(paths, blocks, strict=True):
        for k, v in enumerate((len(text), len(PUNCTUATION.findall(text)), min(links, len(text)))):
            sums[p][k] += v
    longest, most = max(c for c, _, _ in sums.values()), max(d for _, d, _ in sums.values()) or 1
    own = {p: math.sqrt(c / longest * (PLAIN + (1 - PLAIN) * d / most)) * (1 - links / c) for p, (c, d, links) in sums.items()}
    values: dict[tuple[str, ...], list[float]] = defaultdict(list)
    for k, p in enumerate(paths):
        total = weight = 0.0
        for j in range(max(0, k - WINDOW), min(len(paths), k + WINDOW + 1)):
            w = math.exp(-((j - k) ** 2) / 2) * likeness(p, paths[j]) ** 2
            total, weight = total + w * own[paths[j]], weight + w
        values[p].append(0.5 * own[p] + 0.5 * total / weight)
    mean = {p: sum(v) / len(v) for p, v in values.items()}
    return [mean[p] * n for p, n in zip(paths, names, strict=True)]


def limit(blocks: list[tuple[Element, str, int]], scores: list[float]) -> float:
    """What content needs: half a standard deviation above the mean of all paths' values, at most half the best value."""
    values = list({(e.path(), s) for (e, _, _), s in zip(blocks, scores, strict=True)})
    mean = math.fsum(v for _, v in values) / len(values)
    spread = math.sqrt(math.fsum((v - mean) ** 2 for _, v in values) / len(values))
    return min(mean + 0.5 * spread, MOST * max(scores))


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    names = evidence(blocks)
    scores = ratios(blocks, names)
    least = limit(blocks, scores)
    passes = [s >= least for s in scores] if least > 0 else [n >= 1 and not e.listed for n, (e, _, _) in zip(names, blocks, strict=True)]
    total = 0
    for k, (yes, (e, t, _)) in enumerate(zip(passes, blocks, strict=True)):
        if yes:
            total += len(t)
            while e is not None:
                if not e.mass:
                    e.first = k
                e.mass, e.last = e.mass + len(t), k
                e = e.parent
    clean = max((n for n, yes in zip(names, passes, strict=True) if yes), default=0.0)
    up = next((e for yes, (e, _, _) in zip(passes, blocks, strict=True) if yes), None)
    while up is not None and (up.mass < NEARLY_ALL * total or up.tag in LEAVES or up.tag not in BLOCK):
        up = up.parent
    root = up if up is not None and up.tag not in ("", "html", "body") else None
    kept = []
    for k, (yes, name, (e, t, links)) in enumerate(zip(passes, names, blocks, strict=True)):
        if not yes and (2 * name < clean or e.listed and links >= 0.8 * len(t)):
            continue
        up = e
        while up is not None and not up.mass:
            up = up.parent
        around, up = up, e
        while up is not None and up is not root:
            up = up.parent
        leads = root is None and around is not None and around.tag not in ("", "html", "body") and e.tag in HEADINGS and k < around.first
        if yes or leads or around is not None and around.first < k < around.last or up is not None:
            kept.append(t)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
