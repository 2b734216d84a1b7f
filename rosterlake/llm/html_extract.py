"""Main text of web pages by wrapper induction.

Every host gets a reference page, the one of least hash. A page's DOM tree is
aligned with its host's reference tree by simple tree matching (largest
order-preserving mapping of equally labelled nodes); neighbouring siblings of
one label are a list and count as one node. Over all pages of the host, each
reference node then has a number of aligned pages and of those with its very
text: a node that is nearly always the same is template, the others are slots.

The main text is what lies in the page's articles (or main elements, or else its
body) and is neither template nor an element that says it is something else:
navigation, forms, scripts, adverts, notices, comments. Inside an article a
constant node is template only if other nodes of the article vary, so a host
of copies keeps its text.

Only skeletons (labels and text hashes of a reference) and counts are joined to
the pages; the pages themselves are not shuffled while those tables are small.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.llm.common import Scratch, append_struct

MIN_PAGES = 4
CONSTANT = 0.9
VARIES = 0.5

TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<svg\b(?:"[^"]*"|'[^']*'|[^'">])*/>|<(script|style|noscript|template|iframe|svg|textarea)\b.*?(?:</\1\s*>|$)|<[!?][^>]*>|"""
    r"""<(/?)([a-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S | re.I)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Fixed values of HTML: elements without content, elements that end a
# paragraph, and elements that stand in a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SAME_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())
#: What is no main text wherever it stands.
OTHER_TAGS = frozenset("nav aside form button select dialog menu head title footer fieldset object canvas".split())
#: The same as a whole class, id or role, alone or joined ("cookie-notice"). A
#: name that only contains one ("no-sidebar") says nothing; the template decides.
_WORD = (r"(?:ads?|adverts?|advertisement|sponsored|promo|banner|cookies?|consent|notice|popup|modal|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
         r"footer|comments?|disqus|replies|share|sharing|social|related|newsletter|subscribe|complementary|contentinfo|search)")
OTHER_NAMES = re.compile(rf"(?:^|\s){_WORD}(?:[_-]+{_WORD})*(?:$|\s)", re.I)
#: Elements that hold or head the main text, or are text, whatever their names.
NAMELESS = frozenset("html body main h1 h2 h3 h4 h5 h6 hgroup p blockquote pre figcaption".split())


class Node:
    __slots__ = ("tag", "names", "children")

    def __init__(self, tag: str, names: str = "") -> None:
        self.tag, self.names, self.children = tag, names, []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag

    def named_other(self) -> bool:
        return self.tag not in NAMELESS and bool(self.names and OTHER_NAMES.search(self.names))

    def other(self) -> bool:
        return self.tag in OTHER_TAGS or self.named_other()


def parse(page: str) -> Node:
    """The DOM tree: children are nodes or strings. Open paragraphs, items and
    cells end where HTML says so; a stray end tag is ignored."""
    root = Node("#root")
    stack, at = [root], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in INLINE:
                reach = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag or stack[k].tag not in INLINE), 0)
            else:
                reach = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if reach and stack[reach].tag == tag:
                del stack[reach:]
            continue
        ends = SAME_ENDS.get(tag, ()) if tag in SAME_ENDS else () if tag in INLINE else ("p",)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        names = " ".join(x or y or z for x, y, z in NAMES.findall(m[4])) if m[4] else ""
        node = Node(tag, names)
        stack[-1].children.append(node)
        # Only void elements end at once: a slash at the end of another start
        # tag says nothing.
        if tag not in VOID:
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    return root


def squeeze(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


class Shape:
    """A node of the collapsed tree: sibling lists are one node."""

    __slots__ = ("label", "nodes", "children")

    def __init__(self, nodes: list[Node]) -> None:
        self.label, self.nodes, self.children = nodes[0].label, nodes, []

    def text_hash(self) -> int:
        text = squeeze([c for n in self.nodes for c in [*n.children, " "] if isinstance(c, str)])
        return crc32(text.encode("utf-8", "surrogatepass")) if text else 0

    def walk(self) -> Iterator[tuple[int, Shape]]:
        """(depth, shape), each before its children."""
        todo = [(0, self)]
        while todo:
            depth, s = todo.pop()
            yield depth, s
            todo.extend((depth + 1, c) for c in reversed(s.children))


def shape_of(tree: Node) -> Shape:
    top = Shape([tree])
    todo = [top]
    while todo:
        shape = todo.pop()
        run: list[Node] = []
        for child in (c for n in shape.nodes for c in n.children if isinstance(c, Node) and c.tag != "br"):
            if run and run[0].label != child.label:
                shape.children.append(Shape(run))
                run = []
            run.append(child)
        if run:
            shape.children.append(Shape(run))
        todo.extend(shape.children)
    return top


def skeleton(page: str) -> str:
    """Depths, labels and text hashes of the collapsed tree, as JSON."""
    return json.dumps([[depth, s.label, s.text_hash()] for depth, s in shape_of(parse(page)).walk()])


@functools.lru_cache(maxsize=4096)
def _reference(text: str) -> tuple[list[tuple[int, str]], list[int]]:
    told = json.loads(text)
    return [(depth, label) for depth, label, _ in told], [h for *_, h in told]


class Aligner:
    """Alignments of page shapes with references by simple tree matching.

    Equal subtrees have one number, and the size of the largest mapping is kept
    by pairs of these, so a tree of many like parts costs little. Equal
    subtrees at the ends of two sibling lists are mapped at once, which loses
    nothing: no other partner is larger. The rest of two lists is aligned a row
    at a time as arrays. Nothing recurses, so depth is no matter.
    """

    #: Numbers and sizes held before all are forgotten.
    HELD = 300_000

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple[str, int], dict[int, int]] = {}
        self.numbers: dict[tuple, int] = {}
        self.trees: list[tuple[str, tuple[int, ...], int]] = []
        self.sizes: dict[tuple[int, int], int] = {}

    def _number(self, flat: list[tuple[int, str]]) -> tuple[list[int], list[list[int]]]:
        """Each node's subtree number and its children, from a preorder."""
        kids: list[list[int]] = [[] for _ in flat]
        path: list[int] = []
        for k, (depth, _) in enumerate(flat):
            del path[depth:]
            if path:
                kids[path[-1]].append(k)
            path.append(k)
        number = [0] * len(flat)
        for k in range(len(flat) - 1, -1, -1):
            key = flat[k][1], tuple(number[c] for c in kids[k])
            if key not in self.numbers:
                self.numbers[key] = len(self.trees)
                self.trees.append((*key, 1 + sum(self.trees[c][2] for c in key[1])))
            number[k] = self.numbers[key]
        return number, kids

    @staticmethod
    def _ends(a: list[int] | tuple, b: list[int] | tuple) -> tuple[int, int]:
        """How many equal subtrees two lists begin and end with."""
        n, head, tail = min(len(a), len(b)), 0, 0
        while head < n and a[head] == b[head]:
            head += 1
        while tail < n - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return head, tail

    def _rows(self, a: list[int] | tuple, b: list[int] | tuple) -> np.ndarray:
        """best[i, j]: the largest mapping of the first i and j subtrees."""
        best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
        names, place = np.unique(np.array(b, np.int64), return_inverse=True)
        gains: dict[int, np.ndarray] = {}
        for i, x in enumerate(a):
            if x not in gains:
                gains[x] = np.array([self.sizes.get((x, int(y)), 0) for y in names], np.int32)[place]
            np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + gains[x]), out=best[i + 1, 1:])
        return best

    def _size(self, a: int, b: int) -> int:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.sizes:
                todo.pop()
                continue
            (label, rows, total), (other, cols, _) = self.trees[x], self.trees[y]
            if label != other or x == y:
                self.sizes[x, y] = total if x == y else 0
                todo.pop()
                continue
            head, tail = self._ends(rows, cols)
            mid, across = rows[head : len(rows) - tail], cols[head : len(cols) - tail]
            open_ = [(r, c) for r in set(mid) for c in set(across) if self.trees[r][0] == self.trees[c][0] and (r, c) not in self.sizes]
            if open_:
                todo.extend(open_)
                continue
            ends = sum(self.trees[r][2] for r in (*rows[:head], *rows[len(rows) - tail :]))
            self.sizes[x, y] = 1 + ends + (int(self._rows(mid, across)[-1, -1]) if mid and across else 0)
            todo.pop()
        return self.sizes[a, b]

    def match(self, a: list[tuple[int, str]], b: list[tuple[int, str]]) -> dict[int, int]:
        """The largest order-preserving mapping of two preorders' nodes that
        keeps labels and parents."""
        (left, left_kids), (right, right_kids) = self._number(a), self._number(b)
        if not self._size(left[0], right[0]):
            return {}
        pairs: dict[int, int] = {}
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            pairs[x] = y
            if left[x] != right[y]:
                self._size(left[x], right[y])
            rows, cols = left_kids[x], right_kids[y]
            head, tail = self._ends([left[r] for r in rows], [right[c] for c in cols])
            todo.extend(zip(rows[:head], cols[:head]))
            todo.extend(zip(rows[len(rows) - tail :], cols[len(cols) - tail :]))
            rows, cols = rows[head : len(rows) - tail], cols[head : len(cols) - tail]
            if not rows or not cols:
                continue
            best = self._rows([left[r] for r in rows], [right[c] for c in cols])
            i, j = len(rows), len(cols)
            while i and j and best[i, j]:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((rows[i], cols[j]))
        return pairs

    def align(self, shape: Shape, reference: str) -> dict[int, int]:
        """Page node number to reference node number, in walking order."""
        if len(self.trees) + len(self.sizes) > self.HELD:
            self._forget()
        flat = [(depth, s.label) for depth, s in shape.walk()]
        key = reference, self._number(flat)[0][0]
        if key not in self.known:
            self.known[key] = self.match(flat, _reference(reference)[0])
        return self.known[key]


def _below(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo.extend(c for c in n.children if isinstance(c, Node))


def _length(node: Node) -> int:
    """Characters of the texts below that are no other elements'."""
    total, todo = 0, [node]
    while todo:
        n = todo.pop()
        for c in n.children:
            if isinstance(c, str):
                total += len(c.strip())
            elif not c.other():
                todo.append(c)
    return total


def _roots(tree: Node) -> list[Node]:
    """All outermost articles in page order, else all main elements. Those
    whose own or outer elements' names are other ones count only where there is
    none else, and then the first that holds most of the page's text."""
    article, main = (lambda n: n.tag == "article"), (lambda n: n.tag == "main" or n.names == "main")
    rest = None
    for named in (False, True):
        for wanted in (article, main):
            found, todo = [], [tree]
            while todo:
                n = todo.pop()
                if n.tag in OTHER_TAGS or not named and n.named_other():
                    continue
                if wanted(n):
                    found.append(n)
                    if not named:
                        continue
                todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
            if found and not named:
                return found
            for n in found:
                rest = _length(tree) if rest is None else rest
                if _length(n) > rest:
                    return [n]
    return []


def main_text(page: str, reference: str | None, counts: dict[int, tuple[int, int]], aligner: Aligner) -> str:
    """Blocks of the main text, joined by line feeds."""
    tree = parse(page)
    roots = _roots(tree)
    template: set[int] = set()
    if reference:
        shape = shape_of(tree)
        mapped = aligner.align(shape, reference)
        shapes = [s for _, s in shape.walk()]
        inside = {id(n) for root in roots for n in _below(root)}
        share = {k: counts[r][1] / counts[r][0] for k, r in mapped.items() if r in counts and counts[r][0] >= MIN_PAGES}
        hashes = _reference(reference)[1]
        varies = any(v < VARIES for k, v in share.items() if id(shapes[k].nodes[0]) in inside) if roots else True
        for k, v in share.items():
            s = shapes[k]
            # A slot that differs on this very page is no template here.
            if v >= CONSTANT and hashes[mapped[k]] and s.text_hash() == hashes[mapped[k]] and (varies or id(s.nodes[0]) not in inside):
                template.update(id(n) for n in s.nodes)
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = squeeze(line)
        if text:
            blocks.append(text)
        line.clear()

    tops = {id(n) for n in roots}
    # Nodes, texts, and None where a block ends.
    todo: list[Node | str | None] = list(reversed(roots or [tree]))
    while todo:
        n = todo.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        elif id(n) in tops or not (n.other() or n.tag == "header" and not roots):
            if n.tag not in INLINE:
                close()
                todo.append(None)
            quiet = id(n) in template
            todo.extend(c for c in reversed(n.children) if not (quiet and isinstance(c, str)))
    close()
    return "\n".join(blocks)


def host_of(url: str):
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(F.length(host) > 0, host)


def induce(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, skeleton, counts) of every host, from (host, html): counts are
    (node, pages, same) of its reference's nodes over all its pages."""
    known = pages.where("host is not null and html is not null")
    least = scratch.table(known.groupBy("host").agg(F.min(F.xxhash64("html")).alias("least")), "least")

    def bones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([skeleton(x.as_py()) for x in b.column(1)], pa.string())], ["host", "skeleton"])

    chosen = known.join(least, "host").where(F.xxhash64("html") == F.col("least")).select("host", "html")
    references = scratch.table(chosen.mapInArrow(bones, "host string, skeleton string").groupBy("host").agg(F.min("skeleton").alias("skeleton")), "references")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, seen = Aligner(), {}
        for b in batches:
            for host, page, reference in zip(*(c for c in b.columns), strict=True):
                host, reference = host.as_py(), reference.as_py()
                hashes = _reference(reference)[1]
                shape = shape_of(parse(page.as_py()))
                mapped = aligner.align(shape, reference)
                for k, (_, s) in enumerate(shape.walk()):
                    r = mapped.get(k)
                    if r is not None and hashes[r]:
                        own = seen.setdefault((host, r), [0, 0])
                        own[0] += 1
                        own[1] += s.text_hash() == hashes[r]
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in keys], pa.string()), "node": pa.array([r for _, r in keys], pa.int32()),
                                          "pages": pa.array([seen[k][0] for k in keys], pa.int64()), "same": pa.array([seen[k][1] for k in keys], pa.int64())})

    counted = known.join(references, "host").select("host", "html", "skeleton").mapInArrow(count, "host string, node int, pages long, same long")
    per_node = counted.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    per_host = per_node.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "same")).alias("counts"))
    return scratch.table(references.join(per_host, "host", "left"), "wrappers")


KIND = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "main") -> DataFrame:
    """``pages`` with a struct ``out``: text and n_chars (code points).

    A null or empty page has the empty text. A page without a host has no
    wrapper: its elements alone decide. Repeated rows are pages each for
    itself; other columns pass, but for ``__host``, ``__skeleton`` and
    ``__counts``, which are this operator's own; no rows give no rows. Depth and
    length of a page are not bounded.
    """
    scratch = Scratch(pages.sparkSession, "html")
    named = pages.withColumn("__host", host_of(url_col))
    wrappers = induce(named.select(F.col("__host").alias("host"), F.col(html_col).alias("html")), scratch)
    wrappers = wrappers.select(F.col("host").alias("__host"), F.col("skeleton").alias("__skeleton"), F.col("counts").alias("__counts"))
    joined = named.join(wrappers, "__host", "left")

    def make():
        aligner = Aligner()

        def of(batch: pa.RecordBatch):
            page, reference, counts = (batch.column(batch.schema.get_field_index(c)) for c in (html_col, "__skeleton", "__counts"))
            ready: dict[str, dict] = {}
            texts = []
            for p, r, c in zip(page, reference, counts, strict=True):
                r = r.as_py()
                if r is not None and r not in ready:
                    ready[r] = {x["node"]: (x["pages"], x["same"]) for x in c.as_py() or ()}
                texts.append(main_text(p.as_py() or "", r, ready.get(r, {}), aligner))
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return of

    return append_struct(joined, out, KIND, make).drop("__host", "__skeleton", "__counts")
