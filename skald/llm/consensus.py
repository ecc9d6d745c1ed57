"""Main-text extraction with consensus paths per host.

Each page's containers are scored by the text they hold; a page votes for the generalised tag-class path of its best
container, Spark sums the votes per host, and every page is extracted again with its host's winning path. Two passes
over the pages, a small aggregate between them. Winners are broadcast only while they have ``BROADCAST`` bytes at most.

A container gives way to one inside it only if no good text is left outside: noise, mostly linked blocks and a div of
its own with a single word, outside all articles, sections and cells, don't count.

Pages are read as browsers read them, each character once: a tag, comment or script that isn't closed goes on to the end
of the page, and a quote that isn't closed is a character of its tag. A path is known by the chain of its labels' hashes,
at any depth. Classes that only name what isn't an article take a container out of the running; where nothing else is
left, they are ignored.

Null html is empty; null urls and urls without a host vote together as one host. A page that lacks its host's path
falls back to its own best container. Equal rows give equal rows; tied paths go to the one that sorts last. Empty
tables give empty results; other columns of the input are left alone.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from skald.llm.common import size_of

#: Bytes of winning paths that are broadcast at most.
BROADCAST = 64 << 20
#: A container competes if it holds this share of the page's good text; the innermost wins that leaves none of it outside.
SHARE = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
BARE = frozenset("nav header footer aside form button select option textarea svg iframe dialog menu head title noscript template object audio video canvas".split())
CONTAINER = frozenset("html body main article section div td center".split())
#: What is in one of these belongs to the article, however short.
PART = frozenset("main article section td".split())
HEADING = re.compile("h[1-6]")
#: What an opening tag closes if it is open, and what stops the search.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: Words in a class, id or role of what isn't the article, and words that may stand beside one without changing that.
NOISE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|comments?|commentlist|disqus|replies|reply|respond|menu|nav\w*|sidebar|side|footer|foot|header|masthead|breadcrumbs?|share|sharing|social|"
    r"related|recommend\w*|popup|modal|overlay|newsletter|subscri\w*|login|signup|search|widgets?|pagination|pager|tags|toolbar|skip|complementary|contentinfo|navigation|hidden|sr|only",
    re.I,
)
BESIDE = re.compile(
    r"\d*|[a-z]|site|page|main|global|primary|secondary|top|bottom|left|right|upper|lower|first|last|list|items?|box|block|bar|area|section|wrap|wrapper|container|inner|outer|content|row|col|column|slot|unit|space|zone|panel|card|link|links|"
    r"icons?|buttons?|form|text|title|heading|posts?|articles?|stories|thread|count|policy|message|warning|info|js|is|has|the|no|us|this",
    re.I,
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*+(?:>|\Z).*?(?:</(?P=raw)\s*+[^>]*+>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _noisy(names: str) -> bool:
    """Whether one of the names is made of words of noise, and of words beside them at most."""
    for name in names.split():
        parts = re.split(r"[_-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name))
        if any(NOISE.fullmatch(x) for x in parts) and all(NOISE.fullmatch(x) or BESIDE.fullmatch(x) for x in parts):
            return True
    return False


class Page:
    """Blocks of text with the element each is in; elements with parent, path and whether they are noise."""

    def __init__(self, source: str | None):
        self._read(source or "", True)
        if not any(not self.bare[at] and len(text) > 2 * linked for at, text, linked in self.blocks):
            self._read(source or "", False)

    def _read(self, source: str, named: bool) -> None:
        self.parent, self.label, self.chain, self.bare, self.box, self.blocks = [-1], [""], [0], [False], [False], []
        self._named = named
        self._tags, self._open = [""], [0]
        # places in _open: of each tag, and of the elements that aren't inline
        self._places: dict[str, list[int]] = {}
        self._outer: list[int] = [0]
        self._text: list[str] = []
        self._linked = 0
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            if tag := m["tag"]:
                self._close(tag.lower()) if m["end"] else self._start(tag.lower(), m["attrs"])
        self._say(source[at:])
        self._break()

    def _say(self, text: str) -> None:
        if text:
            self._text.append(text)
            if any(self._tags[i] == "a" for i in self._open[-3:]):
                self._linked += len(text)

    def _break(self) -> None:
        if self._text:
            words = html.unescape("".join(self._text)).split()
            if words:
                self.blocks.append((self._open[-1], " ".join(words), self._linked))
            self._text, self._linked = [], 0

    def _start(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._text.append(" ")
            elif tag == "hr":
                self._break()
            return
        if tag not in INLINE:
            self._break()
            inner = self._outer[-1]
            if inner and self._tags[self._open[inner]] == "p":
                self._drop(inner)
            if tag in CLOSES:
                ends, stops = (max(map(self._last, names)) for names in CLOSES[tag])
                if ends > stops:
                    self._drop(ends)
        up = self._open[-1]
        label, noisy = tag, tag in BARE
        if attrs and "=" in attrs:
            found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
            names = sorted({re.sub(r"\d+", "#", x) for x in found.get("class", "").split()})
            label = ".".join([tag, *names])
            if self._named and not noisy and tag not in ("html", "body", "article", "main"):
                noisy = _noisy(" ".join(found.get(k, "") for k in ("class", "id", "role")))
            noisy = noisy or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
        self.parent.append(up)
        self.label.append(label)
        self.chain.append(xxh64_intdigest(label.encode("utf-8", "surrogatepass"), self.chain[up]))
        self.bare.append(self.bare[up] or noisy)
        self.box.append(tag in CONTAINER)
        self._tags.append(tag)
        self._places.setdefault(tag, []).append(len(self._open))
        if tag not in INLINE:
            self._outer.append(len(self._open))
        self._open.append(len(self.parent) - 1)

    def _last(self, tag: str) -> int:
        """The place of the innermost open element of a tag; 0 if none is open."""
        places = self._places.get(tag)
        return places[-1] if places else 0

    def _drop(self, place: int) -> None:
        """Closes the element at a place and all within it."""
        while len(self._open) > place:
            tag = self._tags[self._open.pop()]
            self._places[tag].pop()
            if tag not in INLINE:
                self._outer.pop()

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._break()
        place = self._last(tag)
        # an inline element isn't closed from outside the block that it is in
        if place and (tag not in INLINE or place > self._outer[-1]):
            self._drop(place)

    def best(self) -> tuple[int, float]:
        """The best container and its score: characters of good text less linked ones."""
        held = [0.0] * len(self.parent)
        for at, text, linked in self.blocks:
            if not self.bare[at]:
                held[at] += max(0, len(text) - 2 * linked)
        for i in range(len(held) - 1, 0, -1):
            held[self.parent[i]] += held[i]
        # containers of that share are nested; elements are numbered in document order, so each holds a range of them
        fit = [0, *(i for i in range(1, len(held)) if self.box[i] and not self.bare[i] and held[i] >= SHARE * held[0])]
        end = self._ends()
        deepest = len(fit) - 1 if held[0] else 0
        labels: dict[tuple[int, int], int] = {}
        sides = self._sides(set(fit))
        for at, text, linked in self.blocks:
            if not self.bare[at] and len(text) > 2 * linked:
                level = bisect_left(fit, True, key=lambda c: not c <= at < end[c]) - 1  # noqa: B023
                if level < deepest:
                    side = sides[at]
                    if side:
                        labels[level, side] = labels.get((level, side), 0) + len(text.split())
                    if not side or labels[level, side] > 1:
                        deepest = level
        return (fit[deepest], held[fit[deepest]]) if deepest else (0, 0.0)

    def _ends(self) -> list[int]:
        """For each element the number after that of the last one in it."""
        end = [i + 1 for i in range(len(self.parent))]
        for i in range(len(end) - 1, 0, -1):
            end[self.parent[i]] = max(end[self.parent[i]], end[i])
        return end

    def _sides(self, fit: set[int]) -> list[int]:
        """For each element the outermost div around it below its innermost competing container, if that may be a mere label: no heading, and in no article, section or cell; else 0."""
        part, side = [False] * len(self.parent), [0] * len(self.parent)
        for i in range(1, len(side)):
            up, tag = self.parent[i], self._tags[i]
            part[i] = part[up] or tag in PART or bool(HEADING.fullmatch(tag))
            side[i] = 0 if i in fit else side[up] or (i if tag == "div" else 0)
        return [0 if p else s for p, s in zip(part, side, strict=True)]

    def path(self, at: int) -> str:
        """The labels from the root to an element."""
        labels = []
        while at > 0:
            labels.append(self.label[at])
            at = self.parent[at]
        return ">".join(reversed(labels))

    def text(self, chain: int | None) -> str:
        """The blocks within the elements of a chain, or within the page's own best container."""
        chosen = [bool(chain) and p == chain and not b for p, b in zip(self.chain, self.bare, strict=True)]
        if not any(chosen):
            chosen[self.best()[0]] = True
        for i in range(1, len(chosen)):
            chosen[i] = chosen[i] or chosen[self.parent[i]]
        return " ".join(text for at, text, _ in self.blocks if chosen[at] and not self.bare[at])


def _signed(h: int) -> int:
    return h - ((h >> 63) << 64)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, chain): each host's winning path, and its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, source in zip(b["host"], b["html"], strict=True):
                page = Page(source)
                at, score = page.best()
                if at:
                    out.append((h, page.path(at), _signed(page.chain[at]), score))
            yield pd.DataFrame(out, columns=["host", "path", "chain", "score"])

    each = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string")).mapInPandas(run, "host string, path string, chain long, score double")
    # a page has one vote; whole numbers of characters, so that sums don't depend on their order
    sums = each.groupBy("host", "chain", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("score")).alias("chars"))
    return sums.groupBy("host").agg(F.max(F.struct("n", "chars", "path", "chain")).alias("w")).select("host", "w.path", "w.chain")


def extract(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, host_path) for each row of ``pages``. ``winners``: votes(), kept as a table."""
    known = winners.select(F.col("host").alias("_host"), F.col("path").alias("host_path"), "chain")
    known = F.broadcast(known) if size_of(known) <= BROADCAST else known
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host(F.col("url")).alias("_h"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            chains = [None if c is None else int(c) & (2**64 - 1) for c in b["chain"]]
            texts = [Page(s).text(c) for s, c in zip(b["html"], chains, strict=True)]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "host_path": b["host_path"]})

    joined = rows.join(known, rows["_h"] == known["_host"], "left").select("page_id", "url", "html", "host_path", F.col("chain").cast("string"))
    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long, host_path string")
