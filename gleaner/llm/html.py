"""Main text of web pages by paths that the pages of a host agree on.

Every page names its best container: its article elements, if they hold at least half of the
prose outside menus, adverts, comments and the like, or else the deepest container with all of
that prose; then the least one around it that has the page's title as well. Prose are texts of
some length or with the end of a sentence, few links in them. The container's path of tags and
classes, digits generalised, is a vote for its host; the votes are counted in Spark. Then every
page is read again with the winning path of its host, and with its own container where that
path finds nothing.

A class or id made of noise words and of words for boxes marks noise wherever it stands. Other
names with a noise word in them (``no-ads``, ``alert-level``) do so only for a box without prose.

Votes are summed before they are shuffled. The winners are broadcast only if they are small,
otherwise joined, so pages are not shuffled unless there are very many hosts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.workers import ready
from gleaner.operators.bounds import is_bounded

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
#: Elements whose text is never part of an article.
NOISE_TAGS = frozenset(
    "head script style noscript template svg math canvas iframe object audio video nav footer "
    "aside form button select textarea dialog menu".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs masthead footer "
    "comment comments commentlist respond reply replies disqus cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup login share sharing "
    "social related recommended widget widgets pagination pager toolbar".split()
)
#: What a name may have beside a noise word and still be one of noise.
BOX_WORDS = frozenset(
    "site page top bottom left right main inner outer center middle global sticky fixed mobile "
    "desktop primary secondary block blocks box boxes container wrapper wrap area zone section "
    "sections slot slots unit units list lists item items link links button buttons bar bars "
    "strip icon icons group row col column panel pane card cards grid form forms field text "
    "title heading image img content article articles post posts entry entries story stories "
    "body user reader readers news email mail follow tool tools media policy message prompt "
    "cta google js module component placeholder holder feed stream thread meta info sign up".split()
)
NEGATIONS = frozenset("no not non is has with without hide".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu".split()
)
CONTENT_WORDS = frozenset("content article post entry story main body text".split())
#: A start tag of the first kind ends an open element of the second, up to the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text of their own rather than other blocks.
LEAVES = HEADINGS | frozenset("p li pre blockquote td th dt dd figcaption caption tr".split())
#: Least length of prose, and of prose that ends like a sentence.
PROSE_CHARS, SENTENCE_CHARS = 25, 12
SENTENCE_ENDS = frozenset(".!?…。！？\"”’»")
_IMPRINT = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=4096)
def judge_names(names: str) -> tuple[frozenset[str], bool, bool, bool]:
    """Words of class names; whether they mark noise, may mark it, mark a header."""
    words: set[str] = set()
    noise = maybe = header = False
    for name in names.split():
        parts = {w.lower() for w in _NAME_PARTS.findall(name)}
        words |= parts
        rest = {w for w in parts - NOISE_WORDS - BOX_WORDS if len(w) > 2 or w in NEGATIONS}
        if parts & NOISE_WORDS:
            noise, maybe = noise or rest <= {"header"}, True
        header = header or ("header" in parts and rest <= {"header"})
    return frozenset(words), noise, maybe and not noise, header


def is_prose(text: str, link_chars: int) -> bool:
    if 2 * link_chars > len(text) or _IMPRINT.search(text):
        return False
    return len(text) >= PROSE_CHARS or (len(text) >= SENTENCE_CHARS and text[-1] in SENTENCE_ENDS)


class Node:
    __slots__ = ("chars", "content", "header", "maybe", "noise", "parent", "tag", "title")

    def __init__(self, tag: str, title: str, parent: int) -> None:
        self.tag, self.title, self.parent = tag, title, parent
        self.noise = self.maybe = self.header = self.content = False
        self.chars = 0


class PageReader(HTMLParser):
    """Block elements of a page, and its texts with the element each one is in."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", "", -1)]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open = Counter()
        self.parts: list[str] = []
        self.link_chars = self.in_link = 0
        self.feed(page)
        self.close()
        self._end_block()
        self._sum_up()

    # Building -------------------------------------------------------------

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.stack[-1][1], text, min(self.link_chars, len(text))))
            self.parts = []
        self.link_chars = 0

    def _pop_to(self, size: int) -> None:
        for tag, _ in self.stack[size:]:
            self.open[tag] -= 1
        if any(tag not in INLINE for tag, _ in self.stack[size:]):
            self._end_block()
        self.in_link -= sum(tag == "a" for tag, _ in self.stack[size:])
        del self.stack[size:]

    def _end_open(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in bounds:
                return
            if tag in tags:
                self._pop_to(i)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            if tag not in INLINE:
                self._end_block()
            return
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}"
        words, noisy, maybe, header = judge_names(names)
        noisy = noisy or named.get("role") in NOISE_ROLES
        noisy = noisy or "hidden" in named or named.get("aria-hidden") == "true"
        parent = self.stack[-1][1]
        number = parent
        if tag not in INLINE or noisy:
            self._end_block()
            if tag in ENDS:
                self._end_open(*ENDS[tag])
            elif tag not in INLINE and self.open["p"]:
                self._end_open(("p",), ("td", "th", "li", "div", "section", "article", "body"))
            parent = self.stack[-1][1]
            number = len(self.nodes)
            classes = sorted(_DIGITS.sub("#", (named.get("class") or "").lower()).split())
            node = Node(tag, ".".join([tag, *classes]), parent)
            node.noise = tag in NOISE_TAGS or noisy
            node.maybe = maybe and tag not in LEAVES
            node.header = tag == "header" or header
            node.content = (
                tag in ("article", "main")
                or named.get("role") == "main"
                or named.get("itemprop") == "articleBody"
            )
            if not node.content and words & CONTENT_WORDS:
                node.title += "+"
            self.nodes.append(node)
        self.stack.append((tag, number))
        self.open[tag] += 1
        self.in_link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:
            self._end_block()
        if self.open[tag]:
            i = len(self.stack) - 1
            while self.stack[i][0] != tag:
                i -= 1
            noisy_inline = self.stack[i][1] != self.stack[i - 1][1]
            if noisy_inline:
                self._end_block()
            self._pop_to(i)

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link:
            self.link_chars += len(data)

    # Judging --------------------------------------------------------------

    def _sum_up(self) -> None:
        nodes = self.nodes
        prose = [
            nodes[number].tag not in HEADINGS and is_prose(text, links)
            for number, text, links in self.blocks
        ]
        every, proper = [0] * len(nodes), [0] * len(nodes)
        for (number, text, _), is_one in zip(self.blocks, prose, strict=True):
            every[number] += len(text)
            proper[number] += is_one
        holds = [False] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            above = nodes[i].parent
            every[above] += every[i]
            proper[above] += proper[i]
            holds[above] = holds[above] or holds[i] or (nodes[i].content and not nodes[i].noise)
        body = max((every[i] for i, n in enumerate(nodes) if n.tag == "body"), default=every[0])
        in_article = [False] * len(nodes)
        for i in range(1, len(nodes)):
            node, above = nodes[i], nodes[nodes[i].parent]
            # Names mislead: what holds most of the page's text and an article is no advert.
            wraps = holds[i] or node.tag in ("html", "body")
            if node.noise and node.tag not in NOISE_TAGS and 2 * every[i] > body and wraps:
                node.noise = False
            if node.maybe and not proper[i] and not wraps:
                node.noise = True
            if node.header and 2 * every[i] > body:
                node.header = False
            named = node.content or node.title.endswith("+")
            in_article[i] = in_article[node.parent] or named
            # A header of the page is noise, one inside an article keeps its headings.
            node.header = node.header or above.header
            node.noise = node.noise or above.noise or (node.header and not in_article[i])
        self.counted = [i for i, block in enumerate(self.blocks) if self._counts(block[0])]
        self.prose = [i for i in self.counted if prose[i]]
        for i in self.counted:
            nodes[self.blocks[i][0]].chars += len(self.blocks[i][1])
        for i in range(len(nodes) - 1, 0, -1):
            nodes[nodes[i].parent].chars += nodes[i].chars

    def _counts(self, number: int) -> bool:
        node = self.nodes[number]
        return not node.noise and (not node.header or node.tag in HEADINGS)

    def _around(self, numbers: Iterable[int]) -> int:
        """The deepest container with all these nodes in it."""
        held = [0] * len(self.nodes)
        for number in numbers:
            held[number] += 1
        for i in range(len(held) - 1, 0, -1):
            held[self.nodes[i].parent] += held[i]
        return max(i for i, n in enumerate(held) if n == held[0] and self.nodes[i].tag not in LEAVES)

    def _inside(self, containers: set[int]) -> list[bool]:
        inside = [False] * len(self.nodes)
        for i, node in enumerate(self.nodes):
            inside[i] = i in containers or (node.parent >= 0 and inside[node.parent])
        return inside

    def _articles(self, wanted: list[int], plain: bool) -> int | None:
        """The container of the article elements, if these hold half of the wanted blocks' text."""
        nodes = self.nodes
        marked = {i for i, n in enumerate(nodes) if n.content and (n.tag == "article") is plain and n.chars}
        if not marked:
            return None
        inside = self._inside(marked)
        mine = [i for i in wanted if inside[self.blocks[i][0]]]
        size, whole = (sum(len(self.blocks[i][1]) for i in some) for some in (mine, wanted))
        if not mine or 2 * size < whole:
            return None
        # Elements without any of it (teasers of links alone) are left out.
        tops = set()
        for i in mine:
            at, top = self.blocks[i][0], 0
            while at:
                top = at if at in marked else top
                at = nodes[at].parent
            tops.add(top)
        return self._around(tops)

    def best(self) -> int:
        """The container of the article; 0 is the whole page."""
        wanted = self.prose or self.counted
        if not wanted:
            return 0
        chosen = self._articles(wanted, True)
        if chosen is None:
            chosen = self._articles(wanted, False)
        if chosen is None:
            chosen = self._around(self.blocks[i][0] for i in wanted)
        return self._with_title(chosen)

    def _with_title(self, chosen: int) -> int:
        """The least container around this one with the page's title, if little else is added."""
        tag_of = {i: self.nodes[self.blocks[i][0]].tag for i in self.counted}
        level = min((t for t in tag_of.values() if t in HEADINGS), default=None)
        inside = self._inside({chosen})
        own = [i for i in self.counted if inside[self.blocks[i][0]]]
        if level is None or any(tag_of[i] == level for i in own):
            return chosen
        titles = [i for i in self.counted if tag_of[i] == level and i < own[0]]
        if not titles:
            return chosen
        wider = self._around([chosen, self.blocks[titles[-1]][0]])
        within = self._inside({wider})
        added = [
            i
            for i in self.counted
            if tag_of[i] not in HEADINGS and within[self.blocks[i][0]] and not inside[self.blocks[i][0]]
        ]
        chars, links = (sum(f(self.blocks[i]) for i in added) for f in (lambda b: len(b[1]), lambda b: b[2]))
        return chosen if 2 * links > chars or set(added) & set(self.prose) else wider

    def path(self, number: int) -> str:
        names = []
        while number:
            names.append(self.nodes[number].title)
            number = self.nodes[number].parent
        return ">".join(reversed(names))

    def text(self, containers: set[int]) -> str:
        inside = self._inside(containers)
        blocks = (self.blocks[i] for i in self.counted)
        return "\n".join(text for number, text, _ in blocks if inside[number])

    def at_path(self, path: str) -> set[int]:
        """The nodes with this path; it is compared level by level, from the root."""
        names = path.split(">")
        found = {0: 0}
        matches: set[int] = set()
        for i in range(1, len(self.nodes)):
            node = self.nodes[i]
            depth = found.get(node.parent)
            if depth is None or depth >= len(names) or node.title != names[depth]:
                continue
            found[i] = depth + 1
            if depth + 1 == len(names):
                matches.add(i)
        return matches


_HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: str = "url") -> Column:
    """Lower-case host of a URL, null if there is none."""
    host = F.lower(F.regexp_extract(F.col(url), _HOST, 1))
    return F.when(host != "", host)


_VOTES = pa.schema([("host", pa.string()), ("path", pa.string()), ("chars", pa.int64())])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, chars = [], [], []
        for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = PageReader(html)
            chosen = page.best()
            if chosen:
                hosts.append(host)
                paths.append(page.path(chosen))
                chars.append(page.nodes[chosen].chars)
        columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(chars, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=_VOTES)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        html_column, path_column = (c.to_pylist() for c in batch.columns[2:])
        for html, path in zip(html_column, path_column, strict=True):
            page = PageReader(html)
            text = page.text(page.at_path(path)) if path else ""
            texts.append(text or page.text({page.best()}))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"]
        )


WINNER_BYTES = 400


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path`` with the most votes per host; ties go to more text, then by name."""
    ready(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(host_of().alias("host"), html.alias("html")).where("host IS NOT NULL")
    votes = rows.mapInArrow(_votes, "host string, path string, chars bigint")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    order = F.struct("n", "c", "path")
    return counted.groupBy("host").agg(F.max_by("path", order).alias("path"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (page_id, url, html).

    Character references are decoded, white space inside a block is one space, blocks
    are joined by line ends in page order. Null html is empty; a page without text gives
    an empty string. Pages without a host are read by their own container. Repeated
    rows stay (and vote each); an empty table gives an empty result. Other columns are
    ignored.
    """
    winners = host_paths(pages).checkpoint()
    if is_bounded(winners.count(), WINNER_BYTES):
        winners = F.broadcast(winners)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), host_of().alias("host")
    )
    joined = rows.join(winners, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_extract, "page_id bigint, url string, text string")
