"""Main-text extraction by wrapper induction.

Each page becomes a tree of block elements (inline markup and text stay inside their block). In wrappers a run of like
siblings is one repeated node. Of each host a few pages, chosen by their hashes, are aligned with each other by
simple tree matching, and the one that matches the others best is the host's wrapper. Every page of the host is then
aligned with it: a node whose own text is the same on all pages is constant, the other nodes are varying slots, and so is
what a page has and the wrapper hasn't. Constant nodes are template; varying slots become content.

The content region goes from the body down to the lowest block that holds all varying text, or to an article or main
element that holds all text of such elements, and more than half as much text as varies. Within it constant nodes are
left out where no text beside them varies, but an article's constant parts, such as headings, are its text. What scripts,
menus, headers, footers, sidebars, adverts, forms and comments are, their elements and class, id or role words say, as all
of these vary, too; words that also name parts of articles count inside an article only if the part is mostly links. Inline
elements are judged by their words as well.

The wrapper is one page's tree, and what pages add to it are counts, smallest and largest hashes, and sums, so results do not
depend on the order of pages or on partitions, and a wrapper does not grow with its pages. Each task adds up its own pages
before anything is shuffled, so a host with a third of all pages is no larger there than any other. Pages meet their
wrapper by an equi-join on the host, by broadcast if the wrappers are proven small, else by a shuffle in which adaptive
execution can split a hot host. Nothing recurses, so any depth is read.

Defined results: null or empty html gives the empty text; a null URL is the empty host; broken markup is read as browsers
do in the main (unclosed paragraphs and items end at the next block, stray end tags are ignored); where all pages of a host
are equal, or there is one, all text varies; repeated rows each give a row; an empty table gives none; other columns are not
read.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import batches_of, rows_of, small_batches, stored, tidied
from strandloom.llm.decontaminate import bounded
from strandloom.llm.url_filter import host_of

# Fixed values of HTML: elements without content, elements whose content is not markup, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Elements that hold other blocks; the content region is one of these.
CONTAINERS = frozenset("html body main article section div center table tbody tr td dl details".split())
#: Elements that hold the main text; the search for the region ends there.
ARTICLES = frozenset(("article", "main"))
#: Elements in which a header is a part of the text.
SECTIONS = frozenset(("article", "main", "section"))
#: Elements, and class, id or role words, of what is not main text anywhere.
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input dialog menu object title noembed noframes".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored cookie cookies consent gdpr notice notices menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer masthead comment comments respond reply replies disqus newsletter subscribe subscription popup modal overlay toolbar contentinfo complementary".split()
)
#: Words of what is not main text outside an article; inside one, only where most of the text is links.
LINK_WORDS = frozenset("alert side foot promo promotion share sharing social related recommended login signup search searchbox widget pagination pager copyright legal disclaimer skip".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
#: Of unclosed elements, which ones a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LINES = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
#: An end tag of a line or item ends nothing beyond one of these.
_BARRIERS, _HELD = frozenset(("table", "article", "body")), frozenset(("p", "li", "td", "tr"))
#: Pages of a host of which the wrapper is chosen.
SEEDS = 5
#: Nodes of wrappers whose sums a task holds.
HELD_NODES = 1 << 18


class Block:
    """A block element, or an inline one that is noise: ``parts`` holds its text and its child blocks in page order."""

    __slots__ = ("inline", "label", "linked", "noise", "parts", "tag", "weighed")

    def __init__(self, tag: str, words: frozenset[str] = frozenset(), noise: bool = False, weighed: bool = False, inline: bool = False) -> None:
        self.tag, self.noise, self.weighed, self.inline = tag, noise, weighed, inline
        # numbers of more digits count or date a page's own parts, they do not name a place of the layout
        self.label = tag + "".join("." + word for word in sorted(words) if not word.isdigit() or len(word) < 3) if words else tag
        self.parts: list[str | Block] = []
        self.linked = 0

    def blocks(self) -> list[Block]:
        return [part for part in self.parts if isinstance(part, Block) and not part.inline]

    def own_text(self) -> str:
        return _clean([part for part in self.parts if isinstance(part, str)])


def _clean(parts: list[str]) -> str:
    """Text without character references, runs of white space as one space."""
    text = "".join(parts)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def in_order(root: Block) -> list[Block]:
    """A block and all below it, each before what it holds."""
    found, stack = [], [root]
    while stack:
        found.append(top := stack.pop())
        stack.extend(reversed([part for part in top.parts if isinstance(part, Block)]))
    return found


def _weigh(root: Block) -> None:
    """Decide on the parts of articles that are noise if most of their text is links."""
    held: dict[int, tuple[int, int]] = {}
    for block in reversed(in_order(root)):
        size, linked = sum(len(part.strip()) for part in block.parts if isinstance(part, str)), block.linked
        for part in block.parts:
            if isinstance(part, Block):
                size, linked = size + held[id(part)][0], linked + held[id(part)][1]
        held[id(block)] = size, linked
        if block.weighed and linked * 2 > size:
            block.noise = True


def parse(page: str) -> Block:
    """The page's tree of block elements."""
    root = Block("html")
    stack, at, size = [root], 0, len(page)
    tags = defaultdict(int, html=1)
    links, weighing = 0, False

    def close(k: int) -> None:
        while len(stack) > k:
            tags[stack.pop().tag] -= 1

    def add(text: str) -> None:
        stack[-1].parts.append(text)
        if links:
            stack[-1].linked += len(text.strip())

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if not tag:
            continue
        if tag == "a":
            links = 0 if closing else 1
        if closing:
            if tags[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and not stack[k].inline or stack[k].tag in _BARRIERS and tag in _HELD:
                        break
            continue
        words, hidden = frozenset(), False
        if attributes:
            words = frozenset(_WORD.findall(" ".join(filter(None, (m[2] or m[3] or m[4] for m in _ATTRIBUTE.finditer(attributes)))).lower())) if "=" in attributes else words
            hidden = bool(_HIDDEN.search(attributes))
        noise = tag in NOISE_TAGS or hidden or bool(words) and tag != "body" and not words.isdisjoint(NOISE_WORDS)
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                stack[-1].parts.append(" " if tag == "br" else "")
            elif noise and not attributes.endswith("/") or tags[tag]:  # within a part that is noise, so that its end tags match
                block = Block(tag, words, noise, inline=True)
                stack[-1].parts.append(block)
                stack.append(block)
                tags[tag] += 1
            continue
        if tag in ("html", "body", "head") and tags[tag]:
            continue
        if tag == "body":
            close(1)
        while len(stack) > 1 and (stack[-1].tag in _LINES or stack[-1].tag in _ENDS.get(tag, ()) or stack[-1].inline and stack[-2].tag in _LINES):
            close(len(stack) - 1)
        weighed = False
        if words and not noise and tag != "body" and not words.isdisjoint(LINK_WORDS):
            weighed = any(tags[each] for each in ARTICLES)
            noise, weighing = not weighed, weighing or weighed
        if tag == "header" and not any(tags[each] for each in SECTIONS):
            noise = True
        block = Block(tag, words, noise, weighed)
        stack[-1].parts.append(block)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(block)
            tags[tag] += 1
    if weighing:
        _weigh(root)
    return root


class Slot:
    """A node of a page's own wrapper: one block or a run of like siblings; ``same`` is a hash of its own text."""

    __slots__ = ("blocks", "kids", "label", "noise", "same", "size", "tag")

    def __init__(self, tag: str, label: str, noise: bool, same: int = 0, size: int = 0, blocks: tuple[Block, ...] = ()) -> None:
        self.tag, self.label, self.noise, self.same, self.size = tag, label, noise, same, size
        self.blocks = list(blocks)
        self.kids: list[Slot] = []


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def skeleton(root: Block) -> Slot:
    """The page's own wrapper: a run of like siblings is one node, noise has no inside."""
    made: dict[int, Slot] = {}
    order, stack = [], [root]
    while stack:
        order.append(top := stack.pop())
        if not top.noise:
            stack.extend(top.blocks())
    for block in reversed(order):
        text = "" if block.noise else block.own_text()
        slot = made[id(block)] = Slot(block.tag, block.label, block.noise, _hash(text), len(text), (block,))
        for child in () if block.noise else block.blocks():
            inner = made[id(child)]
            if slot.kids and slot.kids[-1].label == inner.label and slot.kids[-1].noise == inner.noise:
                _absorb(slot.kids[-1], inner)
            else:
                slot.kids.append(inner)
    return made[id(root)]


def _absorb(into: Slot, other: Slot) -> None:
    """Make ``other`` a part of its like neighbour ``into``."""
    stack = [(into, other)]
    while stack:
        a, b = stack.pop()
        a.same, a.size = _hash(f"{a.same} {b.same}"), a.size + b.size
        a.blocks.extend(b.blocks)
        pairs = _paired(a.kids, b.kids, lambda x, y: 1)
        stack.extend((a.kids[i], b.kids[j]) for i, j in pairs)
        at, kids, partner = 0, [], {j: i for i, j in pairs}
        for j, kid in enumerate(b.kids):
            if j in partner:
                kids.extend(a.kids[at : partner[j] + 1])
                at = partner[j] + 1
            else:
                kids.append(kid)
        a.kids = kids + a.kids[at:]


def _alike(a: Slot, b: Slot) -> bool:
    return a.label == b.label and a.noise == b.noise


def _ends(a: list[Slot], b: list[Slot]) -> tuple[int, int]:
    """How many nodes are alike at the beginning of two child lists, and at the end of the rest."""
    low, high, most = 0, 0, min(len(a), len(b))
    while low < most and _alike(a[low], b[low]):
        low += 1
    while high < most - low and _alike(a[-1 - high], b[-1 - high]):
        high += 1
    return low, high


def _paired(a: list[Slot], b: list[Slot], score) -> list[tuple[int, int]]:
    """Pairs of like nodes of two child lists, in order, with the highest sum of scores; like beginnings and ends are paired at once."""
    low, high = _ends(a, b)
    n, m = len(a) - low - high, len(b) - low - high
    pairs = [(k, k) for k in range(low)]
    if n and m:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                here = score(a[low + i], b[low + j]) + best[i + 1][j + 1] if _alike(a[low + i], b[low + j]) else 0
                best[i][j] = max(here, best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if _alike(a[low + i], b[low + j]) and best[i][j] == score(a[low + i], b[low + j]) + best[i + 1][j + 1]:
                pairs.append((low + i, low + j))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return pairs + [(len(a) - high + k, len(b) - high + k) for k in range(high)]


def aligned(a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
    """Simple tree matching: pairs of nodes with like labels and like ancestors, in order, as many as there can be.

    Each pair of nodes is scored once, bottom up, so the work is at most the product of the trees' sizes.
    """
    scores: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    score = lambda x, y: scores[id(x), id(y)] if x.kids and y.kids else 1
    stack = [(a, b, False)]
    while stack:
        x, y, ready = stack.pop()
        key = id(x), id(y)
        if key in scores:
            continue
        if not ready:
            stack.append((x, y, True))
            low, high = _ends(x.kids, y.kids)
            n, m = len(x.kids), len(y.kids)
            met = [(k, k) for k in range(low)] + [(n - 1 - k, m - 1 - k) for k in range(high)]
            met += [(i, j) for i in range(low, n - high) for j in range(low, m - high) if _alike(x.kids[i], y.kids[j])]
            stack.extend((x.kids[i], y.kids[j], False) for i, j in met if x.kids[i].kids and y.kids[j].kids)
            continue
        chosen[key] = _paired(x.kids, y.kids, score)
        scores[key] = 1 + sum(score(x.kids[i], y.kids[j]) for i, j in chosen[key])
    pairs, queue = [], [(a, b)]
    while queue:
        x, y = queue.pop()
        pairs.append((x, y))
        queue.extend((x.kids[i], y.kids[j]) for i, j in chosen.get((id(x), id(y)), ()))
    return pairs


def nodes_of(slot: Slot) -> list[Slot]:
    """A node and all below it, each before what it holds."""
    found, stack = [], [slot]
    while stack:
        found.append(top := stack.pop())
        stack.extend(reversed(top.kids))
    return found


def packed(slot: Slot) -> str:
    """A wrapper as JSON: for each of its nodes in order the parent's place, tag, label and whether it is noise."""
    order = nodes_of(slot)
    parent = {id(kid): k for k, node in enumerate(order) for kid in node.kids}
    return json.dumps([[parent.get(id(node), -1), node.tag, node.label, int(node.noise)] for node in order])


def unpacked(form: str) -> list[Slot]:
    """The nodes of a wrapper, in order."""
    order: list[Slot] = []
    for parent, tag, label, noise in json.loads(form):
        order.append(Slot(tag, label, bool(noise)))
        if parent >= 0:
            order[parent].kids.append(order[-1])
    return order


def medoid(slots: list[Slot]) -> Slot:
    """Of pages' own wrappers the one that matches all of them in the most nodes; the first of equals."""
    return max(slots, key=lambda one: sum(len(aligned(one, other)) for other in slots))


def rules(order: list[Slot], sums: dict[int, tuple[int, int, int, int]]) -> tuple[int, list[int]]:
    """The places of the content region and of its template nodes, in a wrapper's nodes ``order``.

    ``sums`` has for each place the number of pages, the smallest and the largest hash of the node's text, and its size.
    """
    place = {id(node): k for k, node in enumerate(order)}
    constant = [k in sums and sums[k][0] > 1 and sums[k][1] == sums[k][2] for k in range(len(order))]
    size = [0 if node.noise else sums.get(k, (0, 0, 0, 0))[3] for k, node in enumerate(order)]
    if not any(size[k] and not constant[k] for k in range(len(order))):
        constant = [False] * len(order)
    varying = [0 if constant[k] else size[k] for k in range(len(order))]
    whole = list(size)  # text, constant or not
    articles = [0] * len(order)  # text in article and main elements
    for k in range(len(order) - 1, -1, -1):
        for kid in order[k].kids:
            at = place[id(kid)]
            varying[k] += varying[at]
            whole[k] += whole[at]
            articles[k] += articles[at]
        if order[k].tag in ARTICLES and not order[k].noise:
            articles[k] = whole[k]
    region = 0
    while order[region].tag not in ARTICLES:
        kids = [place[id(kid)] for kid in order[region].kids if kid.tag in CONTAINERS and not kid.noise]
        inner = [k for k in kids if articles[k] and articles[k] == articles[region] and articles[k] * 2 > varying[region]]
        inner = inner or [k for k in kids if varying[k] and varying[k] == varying[region]]
        if not inner:
            break
        region = inner[0]
    template: list[int] = []
    if order[region].tag not in ARTICLES:
        stack = [order[region]]
        while stack:
            node = stack.pop()
            # a constant part beside text that varies, such as a heading, belongs to that text
            beside = any(not kid.noise and not kid.kids and varying[place[id(kid)]] for kid in node.kids) or (varying[place[id(node)]] and not constant[place[id(node)]] and size[place[id(node)]])
            for kid in node.kids:
                k = place[id(kid)]
                if not beside and whole[k] and not varying[k]:
                    template.append(k)
                else:
                    stack.append(kid)
    return region, template


def extract(page: Block, order: list[Slot], region: int, template: list[int]) -> str:
    """A parsed page's main text by its host's wrapper and rules; where the page has no such region, by its own wrapper."""
    own = skeleton(page)
    met = {id(x): y for x, y in aligned(order[0], own)}
    if id(order[region]) not in met:
        order = nodes_of(own)
        region, template = rules(order, {k: (1, node.same, node.same, node.size) for k, node in enumerate(order)})
        met = {id(node): node for node in order}
    skip = {id(block) for k in template if id(order[k]) in met for block in met[id(order[k])].blocks}
    lines: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := _clean(held):
            lines.append(text)
        held.clear()

    for block in met[id(order[region])].blocks:
        stack = [iter(block.parts)]
        inline = [False]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
                if not inline.pop():
                    flush()
            elif isinstance(part, str):
                held.append(part)
            elif not part.inline:
                flush()
                if not part.noise and id(part) not in skip:
                    stack.append(iter(part.parts))
                    inline.append(False)
            elif not part.noise:
                stack.append(iter(part.parts))
                inline.append(True)
    return "\n".join(lines)


def seeds(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper``: of each host's few pages with the smallest hashes of their class, the wrapper of the one that matches the others best."""
    own = pages.select(F.coalesce(host_of(pages[url_col]), F.lit("")).alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    # the smallest hash of each class of hashes, by partial aggregation
    mark = F.xxhash64("html")
    first = own.filter("html <> ''").groupBy("host", F.pmod(mark, F.lit(SEEDS)).alias("class")).agg(F.min(mark).alias("mark"))
    first = bounded(stored(first.select(F.col("host").alias("of_host"), F.col("mark").alias("of_mark")), "page-marks"))
    met = own.join(first, (F.col("host") == F.col("of_host")) & (F.xxhash64("html") == F.col("of_mark")), "left_semi")
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, held, last = None, [], None
            for host, page in rows_of(batches):
                if host != now:
                    if held:
                        yield now, packed(medoid(held))
                    now, held, last = host, [], None
                if page != last and len(held) < SEEDS:  # of equal pages one is held
                    held.append(skeleton(parse(page)))
                    last = page
            if held:
                yield now, packed(medoid(held))

        yield from batches_of(rows(), schema)

    dealt = met.select("host", "html").dropDuplicates(["host", "html"]).repartition("host").sortWithinPartitions("host", F.xxhash64("html"), "html")
    return stored(dealt.mapInArrow(tidied(choose), "host string, wrapper string"), "wrappers")


@functools.lru_cache(maxsize=256)
def _unpacked(form: str) -> list[Slot]:
    return unpacked(form)


def _with_wrapper(pages: DataFrame, found: DataFrame, url_col: str, html_col: str, *extra: str) -> DataFrame:
    """Pages with what their host has in ``found`` (``host, wrapper`` and more); pages without html meet nothing."""
    found = bounded(found).withColumnRenamed("host", "of_host")
    own = pages.select(*extra, F.coalesce(host_of(pages[url_col]), F.lit("")).alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    return own.join(found, F.col("host") == F.col("of_host"), "left").drop("of_host")


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper, region, template``: every host's wrapper, its content region's place and its template nodes' places."""
    small_batches(pages.sparkSession)
    found = seeds(pages, url_col, html_col)
    schema = pa.schema([("host", pa.string()), ("place", pa.int32()), ("pages", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("size", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[tuple[str, int], list[int]] = {}
            for host, page, form in rows_of(batches):
                order = _unpacked(form)
                place = {id(node): k for k, node in enumerate(order)}
                for node, other in aligned(order[0], skeleton(parse(page))):
                    if not node.noise:
                        own = held.get((host, place[id(node)]))
                        if own is None:
                            held[host, place[id(node)]] = [1, other.same, other.same, other.size]
                        else:
                            own[0] += 1
                            own[1], own[2], own[3] = min(own[1], other.same), max(own[2], other.same), own[3] + other.size
                if len(held) > HELD_NODES:
                    yield from ((*key, *sums) for key, sums in held.items())
                    held.clear()
            yield from ((*key, *sums) for key, sums in held.items())

        yield from batches_of(rows(), schema, 10_000)

    met = _with_wrapper(pages, found, url_col, html_col).filter("wrapper IS NOT NULL AND html <> ''").select("host", "html", "wrapper")
    sums = met.mapInArrow(tidied(gather), "host string, place int, pages long, low long, high long, size long")
    sums = sums.groupBy("host", "place").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"))
    # as many rows for a host as its wrapper has nodes
    sums = sums.groupBy("host").agg(F.collect_list(F.struct("place", "pages", "low", "high", "size")).alias("sums"))
    ruled = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("region", pa.int32()), ("template", pa.list_(pa.int32()))])

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((host, form, *rules(unpacked(form), {each["place"]: (each["pages"], each["low"], each["high"], each["size"]) for each in sums})) for host, form, sums in rows_of(batches))
        yield from batches_of(rows, ruled)

    joined = found.join(sums.withColumnRenamed("host", "of_host"), F.col("host") == F.col("of_host")).select("host", "wrapper", "sums")
    return joined.mapInArrow(tidied(rule), "host string, wrapper string, region int, template array<int>")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: ``page_id, url, text, n_chars``."""
    found = stored(wrappers(pages, url_col, html_col), "rules")
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    met = _with_wrapper(own, found, "url", "html", "page_id", "url").select("page_id", "url", "html", "wrapper", "region", "template")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for page_id, url, page, form, region, template in rows_of(batches):
                text = extract(parse(page), _unpacked(form), region, template) if page else ""
                yield page_id, url, text, len(text)

        yield from batches_of(rows(), schema)

    return met.mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
