"""Main text of web pages by wrapper induction.

A page becomes blocks of text and a tree of labels (element and class names), runs of equal siblings folded into one. For each
host the commonest tree is the reference; simple tree matching aligns every other tree with it, so that text blocks of all
pages fall into common slots. A block whose text stays the same while the articles around it differ is template, slot by
slot; the varying slots of the article are content. What is no article by its element or role (navigation, forms, hidden
parts) is left out before; class names are hints, of which the weak ones need a second sign.

Each page is parsed once, into a written table; trees, slots and verdicts are small tables beside it, joined by host and tree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import python_workers, stored, text_of

#: A block is template if it has the same text beside at least so many different articles of a host, and in this share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.8
#: Articles are told apart by min-hashes of what is left without such blocks: bodies that agree in half of them count once, and so do
#: all that have fewer words left.
SKETCH, OWN_WORDS = 32, 5
#: An article element is a mere teaser if what is outside has so many times its text.
OUTSIDE = 4
#: Rows of an Arrow batch that are in hand as Python objects at once; trees that a task remembers to have written.
ROWS, TOLD = 512, 100_000

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = set("nav footer aside button select option dialog menu svg canvas object audio video head fieldset".split())
CLOSES_P = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element that opens ends these, up to the nearest of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BAD_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Class names and ids of what is no article; names that begin or end with one of STRONG_PARTS are meant too.
STRONG_NAMES = set("ad ads adv adslot adsense nav navbar navigation menu menus footer masthead gdpr consent modal overlay disqus respond replies".split())
STRONG_PARTS = ("advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "newsletter", "popup", "promo", "promotion", "sidebar", "sidebars", "sponsor", "sponsored")
#: Names that say so only of what is mostly links, or is template by its slot.
WEAK_NAMES = set("banner header notice notices notification alert subscribe subscription signup login reply reviews related recommended recommendations share sharing social pagination pager toolbar widget widgets skip".split())
#: Names of elements with text of their own, which may say what the text is about.
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
#: A part of a name that says what the element goes with.
BESIDE = set("with has no without have".split())

_SPECIAL = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def host_of(url: str | None) -> str:
    """Host of an address, in lower case; an empty string where there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _strong(names: str) -> bool:
    for token in names.split():
        parts = [x.lower() for x in _SPLIT.split(token) if x]
        if not parts or not BESIDE.isdisjoint(parts):
            continue
        if "".join(parts) in STRONG_NAMES or parts[0] in STRONG_PARTS or parts[-1] in STRONG_PARTS:
            return True
    return False


def _weak(names: str) -> bool:
    return any(not WEAK_NAMES.isdisjoint(p := [x.lower() for x in _SPLIT.split(token)]) and BESIDE.isdisjoint(p) for token in names.split())


@dataclass
class Region:
    """An element that may be no article: what its characters tell decides."""

    kind: str  # form, strong or weak
    above: int  # region around it, -1 for none
    chars: int = 0
    linked: int = 0
    holds: bool = False  # the page's first article, or a heading of a page in a form


class Node:
    """An element of the folded tree."""

    __slots__ = ("label", "children", "slot", "seen")

    def __init__(self, label: str, slot: int):
        self.label, self.slot, self.children, self.seen = label, slot, [], {}

    def child(self, label: str) -> Node:
        """The last child, if it has the label, else a new one: its slot is its path, with its number among equal ones."""
        if self.children and self.children[-1].label == label:
            return self.children[-1]
        n = self.seen[label] = self.seen.get(label, -1) + 1
        self.children.append(Node(label, _slot(self.slot, label, n)))
        return self.children[-1]


def _slot(above: int, label: str, n: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(f"{above}/{label}/{n}") - (1 << 63)


class Page:
    """Blocks of a page, each (slot, text), and the folded tree of labels. No step recurses, and none looks twice at a character."""

    def __init__(self, source: str):
        self.root = Node("", 0)
        self.regions: list[Region] = []
        #: slot, region, whether in an article, characters, characters in links, text
        self.found: list[tuple[int, int, bool, int, int, str]] = []
        # open elements: name, node, region, whether dropped, inside an article
        self.open: list[tuple[str, Node, int, bool, bool]] = [("", self.root, -1, False, False)]
        self.names: Counter = Counter()
        self.text: list[str] = []
        self.linked = self.link = self.articles = 0
        at, size = 0, len(source)
        last, quotes = source.rfind(">"), True
        while at < size:
            start = source.find("<", at)
            if start < 0:
                self._add(source[at:])
                break
            if start > at:
                self._add(source[at:start])
            at = start
            if m := _SPECIAL.match(source, at):
                at = m.end()
                continue
            m = _NAME.match(source, at)
            if m is None or last < at:  # a tag that nothing ends is text
                self._add("<")
                at += 1
                continue
            closing, name = m[1], m[2].lower()
            rest = _REST.match(source, m.end()) if quotes else None
            if rest is None:  # a quote that nothing ends: from here on tags end at the next bracket
                quotes = False
                end = source.index(">", at)
                rest, at = source[m.end() : end], end + 1
            else:
                at, rest = rest.end(), rest[1]
            if closing:
                self._end(name)
            elif name in RAW and not rest.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else size
            else:
                self._start(name, rest)
        self._flush()

    def _add(self, text: str) -> None:
        if not self.open[-1][3]:
            self.text.append(text)
            if self.link:
                self.linked += len(text)

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", html.unescape("".join(self.text))).strip()
            if text:
                _, node, region, _, article = self.open[-1]
                chars, linked = len(text), min(self.linked, len(text))
                self.found.append((node.slot, region, article, chars, linked, text))
                if region >= 0:
                    self.regions[region].chars += chars
                    self.regions[region].linked += linked
            self.text, self.linked = [], 0

    def _pop(self, to: int) -> None:
        self._flush()
        self.names.subtract(x[0] for x in self.open[to:])
        del self.open[to:]
        if self.link >= to:
            self.link = 0

    def _held(self, region: int, forms_only: bool) -> None:
        while region >= 0 and not self.regions[region].holds:
            if not forms_only or self.regions[region].kind == "form":
                self.regions[region].holds = True
            region = self.regions[region].above

    def _start(self, name: str, rest: str) -> None:
        attrs = {a.lower(): (x or y or z) for a, x, y, z in _ATTR.findall(rest)} if "=" in rest or "hidden" in rest else {}
        role = attrs.get("role", "").lower()
        bad = "hidden" in attrs or attrs.get("aria-hidden") == "true" or role in BAD_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        main = name in ("article", "main") or role == "main"
        names = " ".join(attrs.get(x, "") for x in ("class", "id"))
        parts = sorted({x.lower() for x in _SPLIT.split(names) if x})
        label = ".".join([name, *parts])
        hint = ""
        if parts and name not in ("html", "body") and not (main and not self.articles):
            hint = "strong" if _strong(names) else "weak" if name not in INLINE and name not in TEXTUAL and _weak(names) else ""
        if name == "br":
            self.text.append(" ")
            return
        if name in INLINE:
            # names of inline elements are often those of code, or of what a word is about
            advert = hint == "strong" and any(p == "ad" or p == "ads" or p.startswith(("advert", "sponsor")) for p in parts)
            if name == "a" and not bad:
                self.link = len(self.open)
            if name in VOID or not (bad or advert):
                return
        else:
            self._flush()
            if name in CLOSES_P and self.names["p"] > 0:
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i][0] == "p":
                        self._pop(i)
                        break
                    if self.open[i][0] not in INLINE and self.open[i][0] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        break
            if name in ENDS and any(self.names[x] > 0 for x in ENDS[name][0]):
                closing, fence = ENDS[name]
                for i in range(len(self.open) - 1, 0, -1):
                    if self.open[i][0] in fence:
                        break
                    if self.open[i][0] in closing:
                        self._pop(i)
                        break
            if name in VOID:
                return
        _, parent, region, dropped, article = self.open[-1]
        if rest.endswith("/") and name in INLINE:
            return
        dropped = dropped or bad or name in DROPPED or name == "header" and not article or name in INLINE
        if not dropped:
            kind = "form" if name == "form" else hint
            if main and not self.articles:
                self._held(region, False)
            if main:
                self.articles += 1
            if name == "h1":
                self._held(region, True)
            if kind:
                self.regions.append(Region(kind, region))
                region = len(self.regions) - 1
        self.names[name] += 1
        self.open.append((name, parent.child(label), region, dropped, article or main))

    def _end(self, name: str) -> None:
        if name == "br":
            self.text.append(" ")
            return
        if name == "a":
            self.link = 0
        if self.names[name] > 0:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] == name:
                    self._pop(i)
                    return
                if name in INLINE and self.open[i][0] not in INLINE:
                    return
        if name not in INLINE:
            self._flush()

    def candidates(self) -> list[tuple[int, str]]:
        """(slot, text) of the blocks that may be the article's: those in article or main elements, unless what is outside
        them has over OUTSIDE times as much text that is no link."""
        for r in reversed(self.regions):
            if r.above >= 0:
                self.regions[r.above].chars += r.chars
                self.regions[r.above].linked += r.linked
        out: list[bool] = []
        for r in self.regions:
            own = not r.holds and (r.kind != "weak" or 2 * r.linked >= r.chars)
            out.append(own or r.above >= 0 and out[r.above])
        sides: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        prose = {True: 0, False: 0}
        for slot, region, article, chars, linked, text in self.found:
            if region < 0 or not out[region]:
                sides[article].append((slot, text))
                prose[article] += chars - linked
        return sides[bool(sides[True]) and OUTSIDE * prose[True] >= prose[False]]

    def tree(self) -> str:
        """A line for each node, parents before children: depth and label."""
        lines, todo = [], [(0, x) for x in reversed(self.root.children)]
        while todo:
            depth, node = todo.pop()
            lines.append(f"{depth} {node.label}")
            todo += [(depth + 1, x) for x in reversed(node.children)]
        return "\n".join(lines)


class Tree:
    """A tree read back: by node (0 is the root) its label, children, slot, size and hash of all below."""

    def __init__(self, text: str):
        self.label, self.children, self.slot = [""], [[]], [0]
        path = [0]
        seen: list[dict[str, int]] = [{}]
        for line in text.split("\n") if text else ():
            depth, _, label = line.partition(" ")
            del path[int(depth) + 1 :]
            above, here = path[-1], len(self.label)
            n = seen[above][label] = seen[above].get(label, -1) + 1
            self.label.append(label)
            self.children.append([])
            self.slot.append(_slot(self.slot[above], label, n))
            self.children[above].append(here)
            seen.append({})
            path.append(here)
        self.size, self.hash = [1] * len(self.label), [0] * len(self.label)
        for i in range(len(self.label) - 1, -1, -1):
            self.size[i] += sum(self.size[c] for c in self.children[i])
            self.hash[i] = xxhash.xxh3_64_intdigest(f"{self.label[i]} {[self.hash[c] for c in self.children[i]]}")


def _differing(a: Tree, b: Tree, i: int, j: int) -> tuple[list[int], list[int], int]:
    """The children of two nodes without the equal ones that both begin and end with, and how many both begin with.

    Matching equal first (or last) children with each other is never worse than another matching."""
    x, y = a.children[i], b.children[j]
    first = 0
    while first < min(len(x), len(y)) and a.hash[x[first]] == b.hash[y[first]]:
        first += 1
    last = 0
    while last < min(len(x), len(y)) - first and a.hash[x[-1 - last]] == b.hash[y[-1 - last]]:
        last += 1
    return x[first : len(x) - last], y[first : len(y) - last], first


def align(tree: str, reference: str) -> dict[int, int]:
    """Slots of ``tree``: the slots of ``reference`` that they match, by simple tree matching; ones of their own else."""
    a, b = Tree(tree), Tree(reference)
    needed, todo = {(0, 0): 0}, [(0, 0)]
    for i, j in todo:  # grows: pairs of nodes, those of their children after them
        x, y, _ = _differing(a, b, i, j)
        for p in x:
            for q in y:
                if a.label[p] == b.label[q] and a.hash[p] != b.hash[q] and (p, q) not in needed:
                    needed[p, q] = 0
                    todo.append((p, q))

    def weight(p: int, q: int) -> int:
        return a.size[p] if a.hash[p] == b.hash[q] else needed.get((p, q), 0)

    def table(x: list[int], y: list[int]) -> list[list[int]]:
        best = [[0] * (len(y) + 1)]
        for p in x:
            row, above = [0], best[-1]
            for k, q in enumerate(y):
                row.append(max(above[k + 1], row[k], above[k] + weight(p, q)))
            best.append(row)
        return best

    for i, j in reversed(todo):
        x, y, _ = _differing(a, b, i, j)
        equal = sum(a.size[c] for c in a.children[i]) - sum(a.size[c] for c in x)
        needed[i, j] = 1 + equal + table(x, y)[-1][-1]
    found: dict[int, int] = {}
    pairs = [(0, 0)]
    while pairs:
        i, j = pairs.pop()
        found[a.slot[i]] = b.slot[j]
        x, y, first = _differing(a, b, i, j)
        pairs += zip(a.children[i][:first], b.children[j][:first], strict=True)
        if rest := len(a.children[i]) - first - len(x):
            pairs += zip(a.children[i][-rest:], b.children[j][-rest:], strict=True)
        best = table(x, y)
        n, m = len(x), len(y)
        while n and m:
            w = weight(x[n - 1], y[m - 1])
            if w and best[n][m] == best[n - 1][m - 1] + w:
                pairs.append((x[n - 1], y[m - 1]))
                n, m = n - 1, m - 1
            elif best[n][m] == best[n - 1][m]:
                n -= 1
            else:
                m -= 1
    return {s: found[s] if s in found else _slot(s, "own") for s in a.slot[1:]}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


_FACTORS = np.random.default_rng(5).integers(0, 1 << 64, SKETCH, np.uint64) | np.uint64(1)


def sketch(blocks: list[str]) -> list[int] | None:
    """Min-hashes of the pairs of neighbouring words; None for fewer than OWN_WORDS words."""
    words = [b.split(" ") for b in blocks]
    if sum(map(len, words)) < OWN_WORDS:
        return None
    pairs = {" ".join(x) for w in words for x in (zip(w, w[1:], strict=False) if len(w) > 1 else [w])}
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in pairs], np.uint64)
    least = np.full(SKETCH, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[None, at : at + 4096] * _FACTORS[:, None]).min(axis=1))
    return least.view(np.int64).tolist()


def parsed(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, host, tree_id, tree (once a task at least), body (hash of its candidates), blocks."""
    python_workers(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[str, int]] = set()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            hosts, ids, trees, bodies, ends = [], [], [], [], [0]
            slots, hashes, texts = [], [], []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = Page(source)
                blocks = page.candidates()
                tree = page.tree()
                key = host_of(url), _hash(tree)
                hosts.append(key[0])
                ids.append(key[1])
                trees.append(None if key in told else tree)
                if len(told) < TOLD:
                    told.add(key)
                bodies.append(_hash("\n".join(t for _, t in blocks)))
                slots += [x for x, _ in blocks]
                texts += [t for _, t in blocks]
                hashes += [_hash(t) for _, t in blocks]
                ends.append(len(slots))
            inner = pa.StructArray.from_arrays([pa.array(slots, pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], ["slot", "hash", "text"])
            columns = [batch.column(0), batch.column(1), pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(trees, pa.string()), pa.array(bodies, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "tree_id", "tree", "body", "blocks"])

    schema = "page_id long, url string, host string, tree_id long, tree string, body long, blocks array<struct<slot: long, hash: long, text: string>>"
    return pages.mapInArrow(run, schema)


def _different(pages: DataFrame, places: DataFrame) -> DataFrame:
    """(host, block): of the constant blocks at ``places`` (host, tree_id, slot, text, block) those that stand beside enough different articles."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            sketches, found = [], []
            for blocks, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                known = {(x["slot"], x["text"]): x["block"] for x in drop or ()}
                blocks = [(known.get((x["slot"], x["hash"])), x["text"]) for x in blocks]
                sketches.append(sketch([t for b, t in blocks if b is None]))
                found.append(sorted({b for b, _ in blocks if b is not None}))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sketches, lists), pa.array(found, lists)], ["host", "body", "sketch", "blocks"])

    listed = places.groupBy("host", "tree_id").agg(F.collect_list(F.struct("slot", "text", "block")).alias("drop"))
    of_hosts = pages.join(places.select("host").distinct(), "host", "left_semi").join(listed, ["host", "tree_id"], "left")
    rows = of_hosts.select("host", "body", "blocks", "drop").mapInArrow(left, "host string, body long, sketch array<long>, blocks array<long>")
    bodies = stored(rows.distinct(), "bodies")
    values = bodies.where("sketch is not null").select("host", "sketch").distinct().withColumn("id", F.xxhash64("sketch")).select("host", "id", F.posexplode("sketch").alias("i", "value"))
    sizes = values.groupBy("host", "i", "value").agg(F.count("*").alias("n"))
    # in at least half of the min-hashes so many bodies agree with one
    alike = values.join(sizes, ["host", "i", "value"]).groupBy("host", "id").agg(F.sort_array(F.collect_list("n"))[SKETCH // 2].alias("alike"))
    own = bodies.select("host", F.xxhash64("sketch").alias("id"), F.col("sketch").isNull().alias("short"), "blocks")
    counted = own.join(alike, ["host", "id"], "left").select("host", "blocks", F.when(F.col("short"), -1).otherwise(F.col("id")).alias("id"), F.when(F.col("short"), 1.0).otherwise(1 / F.col("alike")).alias("part"))
    counted = stored(counted, "articles")
    articles = counted.select("host", "id", "part").distinct().groupBy("host").agg(F.sum("part").alias("articles"))
    beside = counted.select("host", "id", "part", F.explode("blocks").alias("block")).distinct().groupBy("host", "block").agg(F.sum("part").alias("beside"))
    enough = (F.col("beside") > TEMPLATE_PAGES - 0.01) & (F.col("beside") >= F.lit(TEMPLATE_SHARE) * F.col("articles"))
    return beside.join(articles, "host").where(enough).select("host", "block")


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """Per host and tree that have template blocks: ``drop``, an array of structs (slot, text) of hashes to leave out.

    ``pages`` is what ``parsed`` gives, as a written table. A tree's list is at most as long as the tree, times 1 / TEMPLATE_SHARE.
    """
    bodies = pages.groupBy("host", "body").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("bodies")).where(F.col("bodies") >= TEMPLATE_PAGES)
    bodies = stored(bodies, "hosts")
    some = pages.join(bodies.select("host"), "host", "left_semi")
    trees = some.groupBy("host", "tree_id").agg(F.min("tree").alias("tree"), F.count("*").alias("n"))
    trees = stored(trees, "trees")
    reference = trees.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree_id")).alias("reference"))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            host, tree_id, slot, at = [], [], [], []
            for h, i, tree, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in align(tree, ref).items():
                    host.append(h)
                    tree_id.append(i)
                    slot.append(a)
                    at.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(tree_id, pa.int64()), pa.array(slot, pa.int64()), pa.array(at, pa.int64())], ["host", "tree_id", "slot", "common"])

    alignment = trees.join(reference, "host").select("host", "tree_id", "tree", "reference").mapInArrow(aligned, "host string, tree_id long, slot long, common long")
    alignment = stored(alignment, "alignment")
    seen = some.select("host", "tree_id", "body", F.explode("blocks").alias("x")).select("host", "tree_id", "body", "x.slot", F.col("x.hash").alias("text"))
    slim = seen.join(alignment, ["host", "tree_id", "slot"])
    beside = slim.groupBy("host", "common", "text", "body").agg(F.lit(1).alias("one")).groupBy("host", "common", "text").agg(F.count("*").alias("beside")).where(F.col("beside") >= TEMPLATE_PAGES)
    constant = beside.join(bodies, "host").where(F.col("beside") >= F.lit(TEMPLATE_SHARE) * F.col("bodies")).select("host", "common", "text")
    places = stored(alignment.join(constant, ["host", "common"]).select("host", "tree_id", "slot", "text", F.xxhash64("common", "text").alias("block")).distinct(), "constant")
    template = places.join(_different(some, places), ["host", "block"])
    return template.groupBy("host", "tree_id").agg(F.collect_set(F.struct("slot", "text")).alias("drop"))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text`` (blocks joined by newlines, empty if there are none) and ``n_chars``.

    A null html is empty; pages without a host share a wrapper; repeated rows give repeated results; further columns are
    ignored; an empty table gives an empty one. Broken markup is read as far as it goes: an element without an end
    lasts to the end of its parent; a tag that no bracket ends is text; where a quote in a tag has no end, tags end at the next bracket.
    Elements may be nested to any depth.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    read = stored(parsed(slim), "pages")
    wrappers = stored(induce_wrappers(read), "wrappers")  # its size decides how it is joined
    joined = read.select("page_id", "url", "host", "tree_id", "blocks").join(wrappers, ["host", "tree_id"], "left")
    kept = F.filter("blocks", lambda b: ~F.array_contains("drop", F.struct(b["slot"].alias("slot"), b["hash"].alias("text"))))
    text = F.array_join(F.transform(F.when(F.col("drop").isNull(), F.col("blocks")).otherwise(kept), lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
