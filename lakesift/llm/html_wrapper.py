"""Main text of web pages by inferring a union-free regular expression (wrapper) for each host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.bpe import slices
from lakesift.llm.common import fresh, store

# Element names by their role in HTML.
RAW = "script|style"
# Elements without article text whose content may be markup; where one isn't closed, it ends at the next tag of BLOCK.
SKIPPED = "noscript template textarea iframe title svg select object canvas annotation annotation-xml".split()
BLOCK = "p|div|section|article|main|header|footer|nav|aside|ul|ol|li|dl|dt|dd|table|tbody|thead|tfoot|tr|td|th|h[1-6]|form|fieldset|figure|figcaption|blockquote|pre|address|details|summary|hr|body|html|head"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd semantics".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption summary legend option tbody thead tfoot colgroup pre".split())
VOID = frozenset("area base br col embed hr input link meta param source track".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head fieldset".split())
# Which open elements a start tag ends, and what they must lie in.
ENDS = {
    "body": (("head",), ()), "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("datalist",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), **{x: (("thead", "tbody", "tfoot"), ("table",)) for x in ("thead", "tbody", "tfoot")},
}
# Words of class, id and role that mark what isn't the article, and words that may stand beside them.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header links login masthead menu modal nav navbar navigation newsletter notice notices pagination "
    "popup promo promotion recommended related replies reply reviews search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
BESIDE_WORDS = frozenset(
    "area articles author bar block body bottom box button buttons col column container content count date entry form global group header head holder icon icons id inline inner item items js label left link list local main meta middle "
    "news nested outer page panel parent child posts primary right row secondary section side single site slot small sticky stories story strip text thread title top unit user wrap wrapper".split()
)
MAIN_WORDS = frozenset("article content entry main post story body text".split())
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_SKIP = "|".join(rf"<{x}(?=[\s/>]){_ATTRIBUTES}>(?:(?:(?!<{x}[\s/>]).)*?</{x}\s*>|.*?(?=</?(?:{BLOCK})\b)|.*)" for x in SKIPPED)
_TOKEN = re.compile(
    rf"""<(?:{RAW}|math|{'|'.join(SKIPPED)})(?:\s{_ATTRIBUTES})?(?<![=\w-]/)(?<=/)>|<(?:{RAW}|math|{'|'.join(SKIPPED)})/>|{_SKIP}|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<({RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"""
    rf"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|([^<]+|<)""",
    re.DOTALL | re.IGNORECASE,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=>/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_MAYBE = re.compile(r"class|id=|role|hidden|display", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

ARTICLE, MARKED, CONTAINER = 2, 1, 0  # how a host's article is found


class _Labels(dict):
    """(label, marked as not the article, marked as the article) of an element's name and attributes."""

    def __missing__(self, key: tuple[str, str]) -> tuple[str, bool, bool]:
        name, attributes = key
        words: set[str] = set()
        aside = bool(_HIDDEN.search(attributes)) if attributes else False
        for m in _HINT.finditer(attributes):
            for one in (m[1] or m[2] or m[3] or "").split():
                own = set(_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", one).lower()))
                aside = aside or (bool(own & ASIDE_WORDS) and own <= ASIDE_WORDS | BESIDE_WORDS)
                words |= own
        if len(self) > 100_000:
            self.clear()
        value = self[key] = (".".join([name, *sorted(words)]) + "!" * aside, aside, bool(words & MAIN_WORDS))
        return value


class _Nodes(dict):
    """Id of an element below another, by their labels: equal for equal paths from the root."""

    def __missing__(self, key: tuple[int, str]) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[key] = xxhash.xxh3_64_intdigest(f"{key[0]} {key[1]}") - (1 << 63)
        return value


_LABELS, _NODES = _Labels(), _Nodes()


@dataclass(slots=True)
class Element:
    """An open element: its place in the wrapper, and what follows from the elements around it."""

    name: str
    node: int
    open: bool = True  # may hold article text
    inside: bool = False  # of article or main
    marked: bool = False  # as article by its words
    container: int = 0  # nearest element that isn't a leaf
    within: bool = False  # the element asked for
    inline: int = 0  # opened as an inline element, with this many of its name in it
    children: dict[int, int] | None = None


@dataclass(slots=True)
class Block:
    """A text slot's content."""

    text: str
    linked: int  # characters in links
    at: Element

    def key(self) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.at.node}\n{self.text}") - (1 << 63)


def parse(page: str | None, container: int | None = None, nodes: dict[int, list] | None = None) -> list[Block]:
    """Blocks of text of a page in order; inline elements are part of the text. Comments, scripts and styles give nothing.

    ``nodes`` collects [parent, label, most times in one parent, position] of each place in the page's tree.
    One pass over the page, whatever its length.
    """
    stack, blocks, parts = [Element("", 0, within=container == 0)], [], []
    opened: dict[str, int] = {}
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(Block(text, min(linked, len(text)), stack[-1]))
        linked = 0

    def push(name: str, attributes: str, inline: bool = False) -> None:
        label, aside, main = _LABELS[name, attributes]
        up = stack[-1]
        node = _NODES[up.node, label]
        plain = name in ("html", "body", "article", "main")
        outside = name in OUTSIDE or (name == "header" and not up.inside) or (aside and not plain)
        inside = up.inside or name in ("article", "main")
        here = Element(name, node, up.open and not outside, inside, up.marked or (main and name not in ("html", "body")), up.container if name in LEAF or inline else node, up.within or node == container, int(inline))
        if nodes is not None:
            up.children = up.children or {}
            times = up.children[node] = up.children.get(node, 0) + 1
            known = nodes.setdefault(node, [up.node, label, 1, len(nodes)])
            known[2] = max(known[2], times)
        stack.append(here)
        opened[name] = opened.get(name, 0) + 1

    def pop(name: str, barriers: tuple[str, ...] = ()) -> None:
        if not opened.get(name):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                for gone in stack[k:]:
                    opened[gone.name] -= 1
                del stack[k:]
                return
            if stack[k].name in barriers:
                return

    for m in _TOKEN.finditer(page or ""):
        text = m[8]
        if text is not None:
            parts.append(text)
            linked += len(text) if in_link else 0
            continue
        name = m[3] or m[6]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[2] or m[5], m[4] or m[7] or ""
        if name in INLINE:
            in_link = not closing if name == "a" else in_link
            top = stack[-1]
            if top.inline and top.name == name:
                top.inline += -1 if closing else 1
                if not top.inline:
                    flush()
                    pop(name)
            elif not closing and _MAYBE.search(attributes) and not attributes.endswith("/") and name != "img" and _LABELS[name, attributes][1]:
                flush()
                push(name, attributes, inline=True)
        elif name in VOID:
            if name in ("br", "hr"):
                parts.append(" ")
        else:
            flush()
            if closing:
                pop(name)
            else:
                if stack[-1].name == "p":
                    pop("p")
                ends, barriers = ENDS.get(name, ((), ()))
                for other in ends:
                    pop(other, barriers)
                if not attributes.endswith("/"):
                    push(name, attributes)
    flush()
    return blocks


def _chosen(blocks: list[Block], mode: int) -> list[Block]:
    tests = {ARTICLE: lambda e: e.inside, MARKED: lambda e: e.marked, CONTAINER: lambda e: e.within}
    return [b for b in blocks if b.at.open and tests[mode](b.at)]


def main_text(page: str | None, mode: int | None = None, container: int | None = None, constant: frozenset[int] = frozenset()) -> str:
    """Text of the slots that the host's wrapper gives to the article; without one, or where it gives none, of the page's own."""
    blocks = [b for b in parse(page, container) if not constant or b.key() not in constant]
    found = _chosen(blocks, mode) if mode is not None else []
    if not found:
        found = next((some for some in (_chosen(blocks, ARTICLE), _chosen(blocks, MARKED)) if some), [])
    if not found:
        held: dict[int, int] = {}
        for b in blocks:
            if b.at.open:
                held[b.at.container] = held.get(b.at.container, 0) + len(b.text) - 2 * b.linked
        if held:
            best = min(held, key=lambda c: (-held[c], c))
            found = [b for b in _chosen(parse(page, best), CONTAINER) if not constant or b.key() not in constant]
    return " ".join(b.text for b in found)


def host_of(url: str) -> Column:
    """Host of a url in lower case; empty without one."""
    return F.coalesce(F.lower(F.expr(f"try_parse_url(CAST(`{url}` AS STRING), 'HOST')")), F.lit(""))


_PART = (
    "host string, pages bigint, chars bigint, low bigint, high bigint, "
    "nodes array<struct<node: bigint, parent: bigint, label: string, pages: bigint, times: bigint, position: bigint, blocks: bigint, mode: int, container: bigint, chars: bigint>>, common array<struct<key: bigint, chars: bigint>>"
)


def _parts(pages: DataFrame, url: str, page: str) -> DataFrame:
    """What each task finds out about each host, in sums, extremes and intersections, so that the order doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            node = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), *((c, pa.int64()) for c in ("pages", "times", "position", "blocks")), ("mode", pa.int32()), ("container", pa.int64()), ("chars", pa.int64())])
            names = ["node", "parent", "label", "pages", "times", "position", "blocks", "mode", "container", "chars"]
            rows = [[host, *h[:4], [dict(zip(names, (k, *v))) for k, v in h[4].items()], [{"key": k, "chars": n} for k, n in h[5].items()]] for host, h in held.items()]
            columns = list(zip(*rows)) or [[]] * 7
            types = [*kinds, pa.list_(node), pa.list_(pa.struct([("key", pa.int64()), ("chars", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in ("host", "pages", "chars", "low", "high", "nodes", "common")])

        size = 0
        for batch in batches:
            for part in slices(batch, 1):
                for host, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    nodes: dict[int, list] = {}
                    blocks = parse(p, nodes=nodes)
                    if not blocks:
                        continue
                    whole = xxhash.xxh3_64_intdigest("\n".join(f"{b.at.node} {b.text}" for b in blocks)) - (1 << 63)
                    common = {b.key(): len(b.text) for b in blocks if b.at.open}
                    if host not in held:
                        held[host] = [0, 0, whole, whole, {}, common]
                    h = held[host]
                    h[0] += 1
                    h[2], h[3] = min(h[2], whole), max(h[3], whole)
                    if h[5]:
                        h[5] = {k: n for k, n in h[5].items() if k in common}
                    for node, (parent, label, times, position) in nodes.items():
                        known = h[4].get(node)
                        if known is None:
                            known = h[4][node] = [parent, label, 0, 0, 0, 0, -1, 0, 0]
                            size += 1
                        known[2] += 1
                        known[3] = max(known[3], times)
                        known[4] += position
                    for b in blocks:
                        e, n = b.at, len(b.text)
                        known = h[4].setdefault(e.node, [0, "", 1, 1, 0, 0, -1, 0, 0])
                        known[5] += 1
                        if e.open:
                            h[1] += n
                            known[6] = ARTICLE if e.inside else MARKED if e.marked else CONTAINER
                            known[7] = e.container
                            known[8] += n - 2 * b.linked
                if size > 200_000:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    return store(pages.select(host_of(url).alias("host"), F.col(page).cast("string").alias("page")).mapInArrow(run, _PART))


def infer_wrappers(pages: DataFrame, *, url: str = "url", page: str = "html", parts: DataFrame | None = None) -> DataFrame:
    """The wrapper of each host: one row for each ``node`` of its tree, with ``parent``, ``label`` and ``position``.

    Token streams of a host's pages are aligned element by element: two tokens meet if the elements around them do and
    their labels are equal, so no search is needed. What one page lacks is ``optional``, what comes twice in one
    parent is ``repeated``, and a node with ``blocks`` has a text slot. Every page takes part, and in any order the
    wrapper is the same. Pages without text don't count.
    """
    parts = _parts(pages, url, page) if parts is None else parts
    n = parts.groupBy("host").agg(F.sum("pages").alias("n"))
    nodes = parts.select("host", F.explode("nodes").alias("x")).select("host", "x.*").groupBy("host", "node")
    nodes = nodes.agg(*(F.max(c).alias(c) for c in ("parent", "label", "times", "mode", "container")), *(F.sum(c).alias(c) for c in ("pages", "position", "blocks", "chars")))
    nodes = nodes.join(n, "host")
    return nodes.select("host", "node", "parent", "label", (F.col("position") / F.col("pages")).alias("position"), (F.col("pages") < F.col("n")).alias("optional"), (F.col("times") > 1).alias("repeated"), "blocks", "mode", "container", "chars")


def expression(nodes: list) -> str:
    """One host's wrapper as text: ``<label>...</>`` for elements, ``#`` for slots, ``(...)?`` and ``(...)+`` for groups."""
    below: dict[int, list] = {}
    for r in nodes:
        if r.label:
            below.setdefault(r.parent, []).append(r)

    def show(parent: int) -> str:
        out = []
        for r in sorted(below.get(parent, ()), key=lambda r: (r.position, r.label)):
            one = f"<{r.label}>{'#' if r.blocks else ''}{show(r.node)}</>"
            one = f"({one})+" if r.repeated else one
            out.append(f"({one})?" if r.optional else one)
        return "".join(out)

    return show(0)


def choices(pages: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """``host``, ``mode``, ``container`` and ``constant``: which slots of the host's wrapper are the article.

    Of the slots that may hold article text (not in elements of another role, nor marked so by class, id or role), those in
    ``article`` or ``main`` do; where the host has none, those in elements marked as content; else those under the
    element that directly holds most text outside links over all pages. Slots with the same text on every page of a
    host of two different pages or more are template (``constant``), unless they are three quarters of the text: such
    pages are copies of each other.
    """
    parts = _parts(pages, url, page)
    nodes = infer_wrappers(pages, url=url, page=page, parts=parts).filter("blocks > 0 AND mode >= 0")
    mode = nodes.groupBy("host").agg(F.max("mode").alias("mode"))
    held = nodes.groupBy("host", "container").agg(F.sum("chars").alias("chars"))
    best = held.groupBy("host").agg(F.max(F.struct("chars", (-F.col("container")).alias("c"), "container")).alias("best")).select("host", F.col("best.container").alias("container"))
    hosts = parts.groupBy("host").agg(F.count("*").alias("parts"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high")
    keys = parts.select("host", F.explode("common").alias("x")).groupBy("host", "x.key").agg(F.count("*").alias("m"), F.min("x.chars").alias("n"))
    keys = keys.join(hosts, "host").filter("m = parts").groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("constant"), F.sum("n").alias("n"), F.first("chars").alias("chars"), F.first("pages").alias("pages"))
    keys = keys.filter("4 * n * pages <= 3 * chars").select("host", "constant")
    return store(mode.join(best, "host").join(keys, "host", "left"))


_CONSTANT: dict[tuple, frozenset[int]] = {}


def _constant(keys: list[int] | None) -> frozenset[int]:
    if not keys:
        return frozenset()
    if (at := tuple(keys)) not in _CONSTANT:
        if len(_CONSTANT) > 500:
            _CONSTANT.clear()
        _CONSTANT[at] = frozenset(at)
    return _CONSTANT[at]


def main_texts(pages: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars`` (code points) of the main text.

    White space inside a block becomes one space, and blocks are joined by one. Null and empty pages, and pages
    without an article, get an empty text; pages are read whole, in time proportional to their length. What the host's
    wrapper holds to be template is left out. A page without any text in the article of its host's wrapper is judged by
    itself. Rows without a host (no url) share a wrapper. Repeated rows give repeated results, whatever task reads
    them; an empty table gives none. Columns ``text`` and ``n_chars`` of the input are replaced.
    """
    names = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    types = dict(pages.dtypes)
    host, of, mode, container, constant, html_ = fresh(pages.columns, "host", "of", "mode", "container", "constant", "html")
    known = choices(pages, url=url, page=page).select(F.col("host").alias(of), F.col("mode").alias(mode), F.col("container").alias(container), F.col("constant").alias(constant))
    rows = pages.withColumn(host, host_of(url)).join(known, F.col(host) == F.col(of), "left").select(*(F.col(f"`{c}`") for c in names), mode, container, constant, F.col(page).cast("string").alias(html_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(names)
            for part in slices(batch, k + 3):
                found = [main_text(p, m, c, _constant(keys)) for m, c, keys, p in zip(*(part.column(j).to_pylist() for j in range(k, k + 4)))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(k)), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*names, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "text string", "n_chars bigint"])
    return rows.mapInArrow(run, schema)
