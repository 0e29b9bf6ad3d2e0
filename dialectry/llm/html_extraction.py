"""Main text of HTML pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. A token's kind is a word's context (plain, in a link, in an
element that is or may be boilerplate) or a tag's name; each kind has a weight, the log ratio of its
frequency inside and outside the marked content of labelled pages. Word weights may have any sign,
tag weights are negative. One linear scan finds the contiguous region with the largest sum; if it
lies within one article or main element, the region takes in the rest of that element. The text
blocks of the region outside boilerplate elements are the page's main text.

Boilerplate is what an element's name, role or a word of its class or id says of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments; headers and footers inside an article
belong to it. Names mislead: an element is kept after all if it holds the page's largest main or article
element (``Page.spared``), or if without it less than a tenth of the page's words outside links would be left; an
element for reader comments only if nothing would be. A menu that is never closed ends at the next heading,
paragraph, article or main element. Names that only often stand for boilerplate (``SOFT``: related, share, tags, ...) lower
the weight of their words, so the scan may leave them out at either end, but nothing inside the region
is dropped for them.

The tables have no labelled pages: ``labelled_pages`` makes ``PAGES`` of them by rule, with the content
between two marks, in layouts with and without article elements.

Text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by two newlines. Defined results: a null or empty page, or one without a
positive region, has an empty text; of several articles the best region's one counts; unclosed
comments, scripts and elements run to the end of the page; repeated rows give repeated results. Only
the named columns are read. Time is linear in tokens, whatever is left open or closed twice.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|iframe|title)\b[^>]*(?:/>|>(?:.*?</(?P=raw)\s*>|.*\Z))"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*)>"""
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text; all others, and br, are inside one.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are followed as containers; the rest is often left open.
CONTAINER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav ol section table ul button a".split())
BOILERPLATE = frozenset("nav footer aside form head menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that name boilerplate, and those that do so outside an article only.
HINTS = frozenset(
    "ad ads adslot advert adverts advertisement advertising adsense sponsored breadcrumb breadcrumbs menu nav navbar navigation sidebar sidenav comment comments commentlist disqus replies respond "
    "cookie cookies consent gdpr notice notices notification newsletter signup login subscribe search hidden".split()
)
EDGES = frozenset("header masthead banner topbar footer footnav toolbar".split())
#: Words that often, but not always, stand for boilerplate.
SOFT = frozenset("byline disclaimer modal overlay pager pagination paywall popup promo promoted promotion recommended related reply share sharing skip social sponsor subscription tags teaser widget widgets".split())
HINT_CUT = re.compile(r"[^a-z]+")
DROPPED, MAYBE = 2, 1
#: Words that name reader comments; the share of a page's words that must be left when elements are dropped, and the words when comments are.
READERS = frozenset("comment comments commentlist disqus replies respond".split())
LEFT, FEW = 0.1, 10
#: Elements that a menu left open ends at.
STARTS_CONTENT = frozenset("article main h1 h2 h3 h4 h5 h6 p".split())


def _named_boilerplate(attrs: str, inside: bool) -> int:
    """What attributes say: ``DROPPED``, ``MAYBE`` or 0."""
    found = 0
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            words = HINT_CUT.split(value)
            if not HINTS.isdisjoint(words) or not inside and not EDGES.isdisjoint(words):
                return DROPPED
            if not SOFT.isdisjoint(words) or not EDGES.isdisjoint(words):
                found = MAYBE
        if key == "role" and value in ROLES:
            return DROPPED
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return DROPPED
    return found


class Page:
    """Tokens of a page: kinds with counts, and the text runs behind them."""

    def __init__(self, source: str):
        self.kinds: list[tuple[str, int]] = []
        self.runs: list[tuple[int, str, int, int]] = []  # token, text, block, innermost dropped element or -1
        self.mains: list[list[int]] = []  # first and last token of outermost article and main elements, the dropped element around, whether a main
        self.block = 0
        self._within: list[int] = []  # of each token the innermost dropped element or -1
        self._parent: list[int] = []  # of each dropped element the one around it or -1
        self._readers: list[bool] = []  # whether it is for reader comments
        self._words: list[int] = []  # its own words outside links
        self._open: list[tuple[str, int, int]] = []  # name, what it says, number of the main element or -1
        self._drops: list[int] = []  # open dropped elements
        self._count: Counter = Counter()  # open elements by name, by what they say, and "main"
        tags = [(m, m["name"].lower() if m["name"] else "") for m in TOKEN.finditer(source)]
        menus = Counter((name, bool(m["end"])) for m, name in tags if name in ("nav", "menu"))
        self._loose = {name for name in ("nav", "menu") if menus[name, False] > menus[name, True]}
        at = self._plain = 0
        for m, name in tags:
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if name:
                self._tag(name, bool(m["end"]), m["attrs"])
        if at < len(source):
            self._text(source[at:])
        while self._open:
            self._close()
        self._settle()

    def _text(self, text: str) -> None:
        words = len(text.split())
        if not text:
            return
        within = self._drops[-1] if self._drops else -1
        self.runs.append((len(self.kinds), text, self.block, within))
        if words:
            self._within.append(within)
            self.kinds.append(("word:link" if self._count["a"] else "word:maybe" if self._count[MAYBE] else "word", words))
            if not self._count["a"]:
                if within < 0:
                    self._plain += words
                else:
                    self._words[within] += words

    def _push(self, name: str, says: int, main: int, attrs: str = "") -> None:
        self._open.append((name, says, main))
        self._count.update((name, says) if main < 0 else (name, says, "main"))
        if says == DROPPED:
            named = {w for m in ATTR.finditer(attrs or "") if m[1].lower() in ("class", "id") for w in HINT_CUT.split((m[2] or m[3] or m[4] or "").lower())}
            self._parent.append(self._drops[-1] if self._drops else -1)
            self._readers.append(not READERS.isdisjoint(named))
            self._drops.append(len(self._words))
            self._words.append(0)

    def _close(self) -> str:
        name, says, main = self._open.pop()
        self._count.subtract((name, says) if main < 0 else (name, says, "main"))
        if main >= 0:
            self.mains[main][1] = len(self.kinds)
        if says == DROPPED:
            self._drops.pop()
        return name

    def _tag(self, name: str, end: bool, attrs: str) -> None:
        if name in STARTS_CONTENT and not end and self._loose:
            for menu in self._loose:
                while self._count[menu] > 0:
                    self._close()
        if name in BLOCK:
            self.block += 1
        inside = self._count["main"] > 0
        if name in CONTAINER:
            if not end:
                main = -1
                if name in ("article", "main") and not inside:
                    main = len(self.mains)
                    self.mains.append([len(self.kinds), len(self.kinds), self._drops[-1] if self._drops else -1, name == "main"])
                says = _named_boilerplate(attrs, inside) if attrs and name not in ("html", "body", "article", "main") else 0
                if name in BOILERPLATE and not (inside and name == "footer") or name == "header" and not inside:
                    says = DROPPED
                self._push(name, says, main, attrs)
            elif self._count[name]:
                while self._close() != name:
                    pass
        elif not end and name not in VOID and name not in ("p", "span", "b", "i", "em", "strong") and attrs and _named_boilerplate(attrs, inside) == DROPPED:
            # other named elements hold no containers of their own that matter: followed until they close
            self._push(name, DROPPED, -1, attrs)
        elif end and self._open and self._open[-1][0] == name:
            self._close()
        elif name == "br":
            self.runs.append((len(self.kinds), " ", self.block, self._drops[-1] if self._drops else -1))
        self._within.append(-1)
        self.kinds.append((("/" if end else "") + name, 1))

    def _settle(self) -> None:
        """Decide what stays dropped, and name the words there ``word:off``."""
        spared = self.spared()
        off = []
        for e, parent in enumerate(self._parent):  # parents come first
            off.append(e not in spared or parent >= 0 and off[parent])
        gone = [*off, False]  # the last entry is that of -1
        self.runs = [(token, text, block, gone[e]) for token, text, block, e in self.runs]
        self.kinds = [("word:off", n) if gone[e] else (kind, n) for (kind, n), e in zip(self.kinds, self._within)]
        self.mains = [[a, b] for a, b, e, _ in self.mains if not gone[e]]

    def spared(self) -> set[int]:
        """The elements that are kept though their names say boilerplate."""
        if not self._words:
            return set()
        total = list(self._words)
        readers = list(self._readers)
        for e in range(len(total) - 1, -1, -1):
            if self._parent[e] >= 0:
                total[self._parent[e]] += total[e]
        for e, parent in enumerate(self._parent):
            readers[e] |= parent >= 0 and readers[parent]
        spared, kept = set(), self._plain
        words, up = [0], 0
        for kind, n in self.kinds:
            words.append(words[-1] + (n if kind in ("word", "word:maybe") else 0))
        # the largest main, else the largest article outside comments, else one in what is called comments
        known = [(words[b] - words[a], e, is_main) for a, b, e, is_main in self.mains]
        for chosen in ([x for x in known if x[2]], [x for x in known if x[1] < 0 or not readers[x[1]]], known if kept < FEW else []):
            if chosen:
                size, up, _ = max(chosen, key=lambda x: x[0])
                if 2 * size >= size + kept:
                    while up >= 0:
                        spared.add(up)
                        kept += self._words[up]
                        up = self._parent[up]
                break
        whole = self._plain + sum(self._words)
        below: dict[int, list[int]] = {}
        for e, parent in enumerate(self._parent):
            below.setdefault(parent, []).append(e)
        outer = [e for at in (-1, *spared) for e in below.get(at, []) if e not in spared]
        while outer and kept < LEFT * whole:
            able = [e for e in outer if not readers[e] or kept < FEW]
            e = max(able, key=lambda x: total[x], default=-1)
            if e < 0 or 2 * total[e] < whole - kept:
                break
            spared.add(e)
            kept += self._words[e]
            outer.remove(e)
            outer += below.get(e, [])
        return spared


MARK = "<!--|-->"
PAGES, SEED = 400, 11
_SYLLABLES = "ba co di fe gu la me ni po ra se ti vo ze".split()


class PageMaker:
    """Pages by rule: an article between ``MARK``s, and what surrounds articles."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randrange(999)}">{self.words(low, high)}</a>'

    def links(self, low: int, high: int) -> str:
        items = [self.link() for _ in range(self.r.randint(low, high))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items), "<p>" + " ".join(items) + "</p>"])

    def named(self, *names: str) -> str:
        """The start of a div that says what it is, or does not."""
        return f'<div class="{self.r.choice(names)}">' if self.r.random() < 0.5 else f'<div class="c{self.r.randrange(99)}">'

    def content(self) -> str:
        r, parts = self.r, [f"<h1>{self.words(1, 8)}</h1>"]
        for _ in range(r.randint(2, 14)):
            kind = r.random()
            text = self.words(4, 60)
            if kind < 0.12:
                parts.append(r.choice([f"<div>{text}</div>", f"<section><h2>{self.words(1, 5)}</h2><p>{text}</p></section>", f"<figure><img src='x'><figcaption>{self.words(3, 12)}</figcaption></figure>", f"<div><div><p>{text}</p></div></div>"]))
            elif kind < 0.6:
                if r.random() < 0.4:
                    cut = len(text) // 2
                    text = text[:cut] + " " + r.choice([self.link(), f"<b>{self.words(1, 3)}</b>", f"<i>{self.words(1, 3)}</i>", "<br>"]) + " " + text[cut:]
                parts.append(f"<p>{text}</p>")
            elif kind < 0.7:
                parts.append(f"<h2>{self.words(1, 6)}</h2><p>{text}</p>")
            elif kind < 0.8:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.87:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>")
            else:
                parts.append(f"<pre>{text}</pre>")
        return "".join(parts)

    def before(self) -> list[str]:
        parts = [f"<header><div>{self.words(1, 4)}</div><nav>{self.links(2, 9)}</nav></header>", self.named("top header", "masthead") + self.link() + self.links(3, 8) + "</div>", self.named("cookie-notice", "consent") + f"<p>{self.words(6, 20)}</p>{self.link()}</div>", f"<nav>{self.links(2, 12)}</nav>", self.named("breadcrumbs") + self.links(2, 4) + "</div>", self.named("ad", "advert") + self.words(3, 12) + "</div>", f"<form>{self.words(1, 3)}<button>{self.words(1, 1)}</button></form>"]
        return self.r.sample(parts, self.r.randint(1, 4))

    def after(self) -> list[str]:
        comments = "".join(f"<div><span>{self.words(1, 2)}</span><p>{self.words(3, 30)}</p>{self.link(1, 1)}</div>" for _ in range(self.r.randint(1, 6)))
        parts = [self.named("related", "recommended") + f"<h3>{self.words(1, 3)}</h3>{self.links(3, 8)}</div>", f'<section id="comments">{comments}</section>', f"<aside><h3>{self.words(1, 2)}</h3>{self.links(2, 8)}</aside>", self.named("share", "social") + self.links(2, 5) + "</div>", self.named("footer") + f"<p>{self.words(2, 8)}</p>{self.links(2, 8)}</div>", f"<footer>{self.words(2, 10)} {self.links(2, 6)}</footer>", self.named("newsletter") + self.words(4, 12) + "</div>"]
        return self.r.sample(parts, self.r.randint(1, 5))

    def page(self) -> str:
        start, stop = self.r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ('<div id="content"><div>', "</div></div>"), ("", "")])
        return f"<html><head><title>{self.words(1, 4)}</title></head><body>{''.join(self.before())}{start}{MARK}{self.content()}{MARK}{stop}{''.join(self.after())}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]


@lru_cache(maxsize=1)
def learned_weights() -> dict[str, float]:
    """Weight by kind from the labelled pages, add-one smoothed; tags are held below zero."""
    inside, outside = Counter(), Counter()
    for page in labelled_pages():
        before, content, after = page.split(MARK)
        head, middle, whole = (Page(x) for x in (before, before + content, before + content + after))
        a, b = len(head.kinds), len(middle.kinds)
        for k, (kind, n) in enumerate(whole.kinds):
            (inside if a <= k < b else outside)[kind] += n
    total_in, total_out, kinds = sum(inside.values()), sum(outside.values()), len({*inside, *outside})
    ratio = {k: math.log((inside[k] + 1) / (total_in + kinds)) - math.log((outside[k] + 1) / (total_out + kinds)) for k in {*inside, *outside}}
    plain = ratio["word"]
    return {k: v / plain if k.startswith("word") else min(-0.02, v / plain) for k, v in ratio.items()}


def best_region(kinds: list[tuple[str, int]], weights: dict[str, float]) -> tuple[int, int]:
    """First and past-last token of the contiguous region with the largest sum; (0, 0) if none is positive."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for k, (kind, n) in enumerate(kinds):
        if run <= 0:
            run, start = 0.0, k
        run += n * weights.get(kind, -0.05)
        if run > best:
            best, found = run, (start, k + 1)
    return found


def main_text(source: str | None, weights: dict[str, float] | None = None, whole_element: bool = True) -> str:
    if not source:
        return ""
    page = Page(source)
    first, last = best_region(page.kinds, weights or learned_weights())
    if first == last:
        return ""
    if whole_element:
        first, last = next(((a, b) for a, b in page.mains if a <= first and last <= b), (first, last))
    blocks: list[str] = []
    number, parts = None, []
    for token, text, block, off in page.runs:
        if off or not first <= token < last:
            continue
        if block != number:
            if parts:
                blocks.append(" ".join("".join(parts).split()))
            number, parts = block, []
        parts.append(entities.unescape(text) if "&" in text else text)
    if parts:
        blocks.append(" ".join("".join(parts).split()))
    return "\n\n".join(b for b in blocks if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page. The weights are learned once, and sent along."""
    weights = learned_weights()

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                few = batch.slice(lo, 500)
                text = [main_text(x.as_py(), weights) for x in few.column(2)]
                yield pa.record_batch([few.column(0), few.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return named.mapInArrow(run, "page_id long, url string, text string, n_chars long")
