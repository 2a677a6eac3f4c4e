"""HTML extraction: a wrapper per host by union-free regular-expression inference.

Pages of a host are parsed to trees of blocks and texts. The first page is the first
wrapper; each further page is aligned with it. Children are compared in order: equal keys
(tag and names) are merged in turn; where they differ, the nearer of the two next matches is
taken and what was skipped becomes optional. Runs of equal siblings, or of equal groups of up
to ``WIDEST`` siblings, become one repeated group. Texts that differ become text slots, those
that are the same on all pages stay literal.

The wrapper tells where the main text is: in ``article`` elements, else in ``main`` ones,
else in those named as content, else in the slots of the whole page. Menus, headers,
footers, sidebars, notices, adverts, forms and comments are left out by element and by whole
names; no name but ``hidden`` leaves out pages, articles or headings, nor an id a section.
All else within articles and elements named as content is kept. Literals of a ``main`` region
or of a whole page are template text and left out too, provided that at least ``SURE`` pages
with different texts were aligned. A page without the wrapper's region is
read by the same order of preference on its own.

Hosts are split into blocks by a hash of the page, of at most about ``PAGES`` pages and
``BYTES`` bytes, with a wrapper each, so that no host, however large, is one unit of work.
Null or empty pages give an empty text; pages without a host share the host "".
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import long_rows
from popatlas.llm.html_tree import HIDDEN, TEXT, Node, parse
from popatlas.llm.runs import whole_runs
from popatlas.plans.storage import stored

PAGES = 400
BYTES = 16 << 20
WIDEST = 3
SURE = 5
WHOLE = (0, 2)

LEFT_OUT_TAGS = frozenset(
    """head nav header footer aside form button select input fieldset dialog menu object embed canvas
    audio video""".split()
)
LEFT_OUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies copyright dialog disqus footer gdpr header hidden
    login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup
    promo promoted promotion related replies reply respond search share sharing sidebar signup social
    sponsor sponsored subscribe toolbar topbar widget widgets""".split()
)
LEFT_OUT_NAMES = LEFT_OUT_WORDS | {HIDDEN}
FRAME_TAGS = frozenset("article main h1 nav header footer".split())
PARTS = re.compile(r"[^a-z]+")
MAIN_WORDS = frozenset({"main"})
CONTENT_WORDS = frozenset("articlebody article content entry post story body".split())


def left_out(node: Node) -> bool:
    """By element or by a whole name. A form that holds a page's frame is no form of its own."""
    if node.names & LEFT_OUT_NAMES:
        return True
    return node.tag in LEFT_OUT_TAGS and not (node.tag == "form" and _holds(node, FRAME_TAGS))


def _holds(node: Node, tags: frozenset[str]) -> bool:
    return any(kid.tag in tags or _holds(kid, tags) for kid in node.kids)


def _named(node: Node, words: frozenset[str]) -> bool:
    """Whether a name has one of the words and none that tells of something else."""
    if not node.words & words:
        return False
    if not node.words & LEFT_OUT_WORDS:
        return True
    parts = (frozenset(PARTS.split(name)) for name in node.names)
    return any(part & words and not part & LEFT_OUT_WORDS for part in parts)


def preference(node: Node) -> int:
    """How surely an element is the main text: 0 most, 3 not at all."""
    if node.tag == "article":
        return 0
    if node.tag == "main" or _named(node, MAIN_WORDS):
        return 1
    return 2 if _named(node, CONTENT_WORDS) and node.tag not in ("body", "html") else 3


def merge(into: Node, node: Node) -> None:
    """Align ``node`` with the wrapper node ``into`` of the same key."""
    into.many |= node.many
    into.maybe |= node.maybe
    if into.key == TEXT:
        if into.text != node.text:
            into.text = None
    else:
        into.kids = fold(align(into.kids, node.kids))


def fold(nodes: list[Node]) -> list[Node]:
    """Siblings with runs of equal groups merged into one repeated group."""
    for width in range(1, WIDEST + 1):
        out: list[Node] = []
        for node in nodes:
            out.append(node)
            while len(out) >= 2 * width and all(
                a.key == b.key for a, b in zip(out[-2 * width : -width], out[-width:], strict=True)
            ):
                if width > 1 and len({n.key for n in out[-width:]}) == 1:
                    break
                again = out[-width:]
                del out[-width:]
                for a, b in zip(out[-width:], again, strict=True):
                    merge(a, b)
                    a.many = True
        nodes = out
    return nodes


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Both lists of siblings as one, what only one of them has being optional."""
    places_a, places_b = _places(a), _places(b)
    out: list[Node] = []
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i].key == b[j].key:
            merge(a[i], b[j])
            out.append(a[i])
            i, j = i + 1, j + 1
            continue
        next_i, next_j = _next(places_a, b[j].key, i), _next(places_b, a[i].key, j)
        if next_i is None and next_j is None:
            skipped = [a[i], b[j]]
            i, j = i + 1, j + 1
        elif next_j is None or (next_i is not None and next_i - i <= next_j - j):
            skipped, i = a[i:next_i], next_i
        else:
            skipped, j = b[j:next_j], next_j
        for node in skipped:
            node.maybe = True
            out.append(node)
    for node in a[i:] + b[j:]:
        node.maybe = True
        out.append(node)
    return out


def _places(nodes: list[Node]) -> dict[str, list[int]]:
    places = defaultdict(list)
    for i, node in enumerate(nodes):
        places[node.key].append(i)
    return places


def _next(places: dict[str, list[int]], key: str, start: int) -> int | None:
    found = places.get(key, ())
    k = bisect_left(found, start)
    return found[k] if k < len(found) else None


def folded(node: Node) -> Node:
    """A copy of the tree with repeated siblings folded."""
    copy = Node(node.tag, node.words, node.text)
    copy.names = node.names
    copy.kids = fold([folded(kid) for kid in node.kids])
    return copy


def infer(pages: list[Node]) -> Node:
    """The wrapper of the pages, aligned one after the other."""
    wrapper = folded(pages[0])
    for page in pages[1:]:
        merge(wrapper, folded(page))
    return wrapper


def _best(node: Node) -> int:
    """The best preference among the elements that are not left out."""
    if node.tag == TEXT or left_out(node):
        return 3
    return min([preference(node), *map(_best, node.kids)])


def _literals(node: Node, path: tuple[str, ...], into: set[tuple[tuple[str, ...], str]]) -> None:
    """Texts that are the same on all pages, by the keys above them. What is optional or
    repeated is not on all pages, nor is what lies below it."""
    for kid in node.kids:
        if kid.maybe or kid.many:
            continue
        if kid.key != TEXT:
            _literals(kid, (*path, kid.key), into)
        elif kid.text is not None:
            into.add((path, kid.text))


def _slots(node: Node) -> bool:
    return any(k.text is None if k.key == TEXT else _slots(k) for k in node.kids)


def _gather(node: Node, path: tuple[str, ...], rank: int, inside: bool, out: list[tuple[tuple[str, ...], str]]) -> None:
    """Texts of the regions of a rank, in page order, by the keys above them."""
    for kid in node.kids:
        if kid.key == TEXT:
            if inside:
                out.append((path, kid.text or ""))
        elif not left_out(kid):
            _gather(kid, (*path, kid.key), rank, inside or preference(kid) == rank, out)


def extract(htmls: list[str]) -> list[str]:
    """The main text of each page of one host."""
    pages = [parse(html, LEFT_OUT_NAMES) for html in htmls]
    wrapper = infer(pages)
    rank = _best(wrapper)
    found, ranks = [], []
    for page in pages:
        own = rank if _best(page) <= rank else _best(page)
        texts: list[tuple[tuple[str, ...], str]] = []
        _gather(page, (), own, own == 3, texts)
        if not texts and own < 3:
            own = min(own, _best(page))
            _gather(page, (), own, False, texts)
        found.append(texts)
        ranks.append(own)
    template: set[tuple[tuple[str, ...], str]] = set()
    if len({tuple(t) for t in found}) >= SURE and _slots(wrapper):
        _literals(wrapper, (), template)
    return [
        " ".join(t for p, t in texts if own in WHOLE or (p, t) not in template)
        for own, texts in zip(ranks, found, strict=True)
    ]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_runs(batches, ["host", "block"]):
        htmls = table["html"].to_pylist()
        for start, stop in zip(starts, [*starts[1:], table.num_rows], strict=True):
            texts = extract(htmls[start:stop])
            rows = table.slice(start, stop - start).select(["page_id", "url"]).combine_chunks()
            out = rows.append_column("text", pa.array(texts, pa.string()))
            yield from out.append_column("n_chars", pa.array(map(len, texts), pa.int64())).to_batches()


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    host = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = long_rows(pages).select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.lower(host).alias("host"),
    )
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / PAGES), F.ceil(F.col("size") / BYTES))
    large = sizes.select("host", blocks.alias("blocks")).where("blocks > 1")
    large = stored(large, "large-hosts")  # its size known, the pages are not dealt twice
    number = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("blocks", F.lit(1)))
    dealt = (
        rows.join(large, "host", "left")
        .select("page_id", "url", "html", "host", number.cast("int").alias("block"))
        .repartition("host", "block")
        .sortWithinPartitions("host", "block", "page_id")
    )
    return dealt.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
