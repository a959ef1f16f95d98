"""Main text of web pages: the maximum-scoring contiguous run of tokens, words positive and tags negative.

Weights are learned from pages whose markup names the content (an ``article`` or ``main`` element): how much likelier a word of some
context, or a tag, is inside the content than outside. A linear scan then finds the best run in every page, also in pages that name
nothing. Elements that never hold an article's words by their HTML name (scripts, menus, buttons, ...) leave no tokens.

An element whose class, id or role has a word of ``BOILERPLATE`` is only suspected: its words weigh ``SUSPECT`` of theirs in a first scan. It is a
wrapper, and no longer suspected, if it holds the page's article or heading or if the best run lies inside it; the other suspects are
cut out before the second scan. Words of ``FIRM`` (comments, adverts, menus, ...) are believed unless an article lies inside.

Reading a page takes time in proportion to its length: places only move on, and no stack is searched.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_sample, map_arrow

#: Pages learned from, about: drawn by a threshold on their hash from those that name their content.
LEARN_PAGES = 5_000
#: Weight of a suspected element's words in the first scan.
SUSPECT = 0.25

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object audio video".split())
CUT = frozenset("nav aside footer button select option menu dialog head fieldset label".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img input ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset(("article", "main"))
#: An article that begins inside one of these ends it: its end tag was forgotten.
LEFT_OPEN = frozenset("nav header head menu button select option label".split())
#: Words of class, id or role that make an element suspected.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget related recommended recommendations share sharing social footer header masthead comment comments commentlist reply replies respond responses "
    "discussion disqus pagination pager toolbar skip search complementary contentinfo".split()
)
#: Those that are believed.
FIRM = frozenset(
    "ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo "
    "comment comments commentlist reply replies respond responses disqus pagination pager".split()
)
#: Last words of a name that tell the place or the form, not the kind.
FORMS = frozenset("left right top bottom inner outer wrapper wrap container box block area section list item items links buttons bar main body thread form primary secondary".split())
#: First words of a name that tell a state of what is around.
STATES = frozenset("has no with without is not hide show".split())

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_END_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_CAMEL, _WORD = re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[a-z]+")


def _names(value: str, exact: bool) -> tuple[bool, bool]:
    """Whether a class, id or role makes an element suspected, and whether it is believed."""
    seen = firm = False
    for token in value.split():
        words = _WORD.findall(_CAMEL.sub(" ", token).lower())
        if not words or words[0] in STATES and len(words) > 1:
            continue
        if exact:
            hit = [words[0]] if len(words) == 1 else []
        else:
            kind = [w for w in words if w not in FORMS] or words
            hit = [kind[-1], *(w for w in kind[:1] if w in FIRM)]
        seen |= any(w in BOILERPLATE for w in hit)
        firm |= any(w in FIRM for w in hit)
    return seen, firm


def _judge(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """Of an element: whether it is hidden, suspected, and believed to be no part of the article."""
    if not attrs or attrs.isspace():
        return False, name == "form", False
    hidden, seen, firm = False, name == "form", False
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        elif key == "style":
            hidden |= bool(re.search(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", value, re.I))
        elif key in ("class", "id", "role") and name not in ("body", "html"):
            s, f = _names(value, name in CONTENT)
            seen, firm = seen or s, firm or f
    return hidden and name not in ("body", "html"), seen, firm


class Page:
    """``tokens`` (kind, context, value, in_content) of a page in order, kind ``w`` for words with their text, ``t`` for tags, ``x`` for a part
    cut out, and ``suspects`` (first token, token behind the last, believed, holds an article, holds a heading)."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, str, bool]] = []
        self.suspects: list[list] = []
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}
        self.read()

    def tag_end(self, at: int) -> int:
        """Where the tag ends that goes on at ``at``: the next > outside a quoted value, or the next one if the quote isn't closed; -1 without one."""
        if at > self.last[">"]:
            return -1
        end = self.page.find(">", at)
        first = end
        while True:
            m = _QUOTE.search(self.page, at, end)
            if m is None:
                return end
            if m.end() > self.last[m[1]]:
                return first
            at = self.page.find(m[1], m.end()) + 1
            if at > end:
                if at > self.last[">"]:
                    return first
                end = self.page.find(">", at)

    def read(self) -> None:
        page, out = self.page, self.tokens
        at, content, link = 0, 0, 0
        cuts: list[str] = []  # open elements that are cut
        stack: list[tuple[str, bool, int]] = []  # name, whether cut, number of the suspect or -1
        count: Counter = Counter()
        blocks = ["body"]
        open_suspects: list[int] = []

        def text(s: str) -> None:
            if not cuts and s and not s.isspace():
                out.append(("w", blocks[-1] + ("+a" if link else ""), s, content > 0))

        def pop() -> str:
            nonlocal content, link
            n, was_cut, suspect = stack.pop()
            count[n] -= 1
            if was_cut:
                cuts.pop()
            if suspect >= 0:
                self.suspects[suspect][1] = len(out)
                open_suspects.pop()
            if n in CONTENT and not was_cut and suspect < 0:
                content -= 1
            link -= n == "a"
            if n in BLOCK:
                blocks.pop()
            return n

        def close(name: str) -> None:
            if count[name]:
                while pop() != name:
                    pass

        while True:
            lt = page.find("<", at) if at <= self.last["<"] else -1
            if lt < 0:
                text(page[at:])
                break
            after = page[lt + 1 : lt + 2]
            if after in ("!", "?"):
                text(page[at:lt])
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 4)
                    at = len(page) if end < 0 else end + 3
                    continue
                stop = "]]>" if page.startswith("<![CDATA[", lt) else ">"
                end = page.find(stop, lt) if self.last[">"] > lt else -1
                at = len(page) if end < 0 else end + len(stop)
                continue
            ending = after == "/"
            m = _NAME.match(page, lt + 1 + ending)
            if m is None:
                text(page[at : lt + 1])
                at = lt + 1
                continue
            text(page[at:lt])
            end = self.tag_end(m.end())
            if end < 0:  # a tag that doesn't end: nothing behind it is text
                break
            at, name, attrs = end + 1, m[0].lower(), page[m.end() : end]
            if ending:
                if not cuts:
                    out.append(("t", "/" + name, "", content > 0))
                close(name)
                continue
            whole = attrs.endswith("/")
            if name in RAW and not whole:
                m = _END_RAW[name].search(page, at)
                at = m.end() if m else len(page)
                if not cuts:
                    out.append(("x", "cut", "", content > 0))
                continue
            if name in ("p", "li", "a", "option") and any(n == name for n, _, _ in stack[-3:]):  # these end an open one of their kind
                close(name)
            if name == "body":
                close("head")
            hidden, seen, firm = _judge(name, attrs)
            if name in CONTENT and not seen and not hidden:
                while cuts and cuts[-1] in LEFT_OPEN:
                    close(cuts[-1])
            drop = hidden or name in CUT or (name == "header" and not content)
            suspect = -1
            if not cuts:
                out.append(("x", "cut", "", content > 0) if drop else ("t", name, "", content > 0))
            if name in VOID or whole:
                continue
            if not cuts and not drop:
                if seen:
                    suspect = len(self.suspects)
                    self.suspects.append([len(out), len(page), firm, False, False])
                    open_suspects.append(suspect)
                elif name in CONTENT or name == "h1":
                    if open_suspects:
                        self.suspects[open_suspects[-1]][3 if name in CONTENT else 4] = True
            stack.append((name, drop, suspect))
            count[name] += 1
            if drop:
                cuts.append(name)
            content += name in CONTENT and not drop and suspect < 0
            link += name == "a"
            if name in BLOCK:
                blocks.append(name)
        while stack:
            pop()
        # what a suspect holds, the suspects around it hold too; they were opened in order of their first tokens
        around: list[list] = []
        for s in self.suspects:
            while around and around[-1][1] <= s[0] and around[-1][1] < s[1]:
                done = around.pop()
                if around:
                    around[-1][3] |= done[3]
                    around[-1][4] |= done[4]
            around.append(s)
        while len(around) > 1:
            done = around.pop()
            around[-1][3] |= done[3]
            around[-1][4] |= done[4]

    def without(self, suspects: Sequence[Sequence]) -> list[tuple[str, str, str, bool]]:
        """The tokens, each of the given suspects as one cut."""
        out, at = [], 0
        for a, b, *_ in suspects:  # in order of their beginnings, an outer one before its inner ones
            if a >= at:
                out += self.tokens[at:a]
                out.append(("x", "cut", "", False))
                at = max(b, a)
        return out + self.tokens[at:]


def best_run(scores: Sequence[float]) -> tuple[int, int]:
    """The first run of the largest sum, as short as can be: (start, end), (0, 0) if no sum is positive."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for i, w in enumerate(scores):
        run += w
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, found = run, (start, i + 1)
    return found


def _doubtful(page: Page) -> list:
    return [s for s in page.suspects if not s[3] and (s[2] or not s[4])]


def _context(kind: str, context: str) -> str:
    """Contexts are the names of HTML's elements; all others are one."""
    name = context.lstrip("/").removesuffix("+a")
    known = kind == "x" or name in BLOCK or name in INLINE or name in CUT or name in RAW or name in VOID
    return context if known else "/other" if context.startswith("/") else "other"


def _tally(batches):
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            page = Page(text or "")
            toks = page.without(_doubtful(page))
            if not any(t[3] for t in toks):
                continue
            for kind, context, value, inside in toks:
                seen[kind, _context(kind, context), inside] += len(value.split()) if kind == "w" else 1
    rows = sorted(seen.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
        ["kind", "context", "inside", "n"],
    )


def fit(pages: DataFrame) -> dict[tuple[str, str], float]:
    """Weights by kind and context, from about ``LEARN_PAGES`` of the pages that name their content. Contexts are HTML's element names."""
    named = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    n = named.count()
    some = named if n <= LEARN_PAGES else named.where(in_sample(F.col("html"), LEARN_PAGES / n))
    got = map_arrow(some, _tally, "kind string, context string, inside boolean, n long").groupBy("kind", "context", "inside").agg(F.sum("n").alias("n"))
    n = Counter({(r.kind, r.context, r.inside): r.n for r in got.toLocalIterator()})  # a few for each of HTML's names
    weights = {}
    for kind, context in {(k, c) for k, c, _ in n}:
        odds = math.log((n[kind, context, True] + 5) / (n[kind, context, False] + 5))
        # words count 0.1 to 2; tags cost 0.1 to 8
        weights[kind, context] = min(2.0, max(0.1, 1 + odds / 4)) if kind == "w" else -min(8.0, max(0.1, 1 - odds))
    return weights


#: Weights of what was never seen: the tags that running text is made of cost less.
DEFAULT = {"w": 1.0, "t": -1.0, "x": -2.0}
PROSE = INLINE - {"a"} | frozenset("p h1 h2 h3 h4 h5 h6 br blockquote".split())
PROSE_TAG = -0.25


def _score(token: tuple[str, str, str, bool], weights: dict[tuple[str, str], float]) -> float:
    kind, context, value, _ = token
    w = weights.get((kind, _context(kind, context)))
    if w is None:
        w = PROSE_TAG if kind == "t" and context.lstrip("/") in PROSE else DEFAULT[kind]
    return w * len(value.split()) if kind == "w" else w


def extract_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """The main text of a page, a line for each block."""
    read = Page(page or "")
    doubt = _doubtful(read)
    if any(not s[2] for s in doubt):
        scores, at = [_score(t, weights) for t in read.tokens], 0
        for a, b, *_ in doubt:
            for i in range(max(a, at), b):
                scores[i] *= SUSPECT if scores[i] > 0 else 1
            at = max(at, b)
        at = 0
        for a, b, *_ in (s for s in doubt if s[2]):
            for i in range(max(a, at), b):
                scores[i] = min(scores[i], 0.0)
            at = max(at, b)
        start, end = best_run(scores)
        doubt = [s for s in doubt if s[2] or end == start or not (s[0] <= start and end <= s[1])]
    toks = read.without(doubt)
    start, end = best_run([_score(t, weights) for t in toks])
    blocks, now = [], []
    for kind, context, value, _ in toks[start:end]:
        if kind == "w":
            now.append(value)
        elif kind == "x" or context.lstrip("/") in BLOCK:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    lines = (" ".join(html_module.unescape(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, weights: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null html or a page without words has an empty text. Ids and addresses pass through, null ones too; repeated rows are extracted
    alike; other columns are ignored; an empty table gives an empty result.
    """
    weights = fit(pages) if weights is None else weights

    def go(batches):
        for batch in batches:
            text = [extract_text(h, weights) for h in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_arrow(rows, go, "page_id long, url string, text string, n_chars long")
