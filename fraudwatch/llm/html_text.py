"""Main text of web pages by wrapper induction over the pages of a host.

Pages of one host are made by one program, so their trees agree where the
program wrote and differ where the author did.  The trees of all pages of a host are aligned with that of
one of them by simple tree matching, each in the task that reads it; the node that
holds the text that varies is the content slot.  Template is what all pages of the host tell: texts that nearly
all of its different pages have at the same path.  Every page of the host is then
read through that wrapper.
"""

import html
import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fraudwatch.llm.base import blocks as text_blocks, broadcast_if_small, shipped
from fraudwatch.session import broadcast_if_small as broadcast_small_bytes, settle

shipped(__name__)

#: Shapes of pages and hosts whose alignment a task remembers.
KNOWN_SHAPES, KNOWN_HOSTS = 500, 200
#: Different pages that must agree before a text counts as template.
LEAST_PAGES = 5
#: Share of a host's different pages that must have a text at the same path before it counts as template.
TEMPLATE_SHARE = 0.9
#: Share of the varying text that a node must hold to be the content slot.
SLOT_SHARE = 0.9

# HTML's element classes and the usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSED_BY_OWN_KIND = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = frozenset("html body article section main div ul ol dl table td th blockquote aside nav header footer form figure".split())
NEVER_CONTENT = frozenset("head nav footer aside form button select option dialog menu object audio video canvas map".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr "
    "notice notices alert alerts popup popups modal overlay comment comments commentlist reply replies respond discussion disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login toolbar widget widgets pagination "
    "pager skip complementary contentinfo search searchform".split()
)
ARTICLE_HEADER = frozenset("article entry post content main story page".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|textarea|title|noscript|template|svg|iframe|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^"'>])*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>
    |<[!?/][^>]*>""",
    re.S | re.I | re.X,
)
NAMING = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _furniture(tag: str, naming: list[str], in_main: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag in NEVER_CONTENT or tag == "header" and not in_main:
        return True
    words = {w.lower() for name in naming for w in WORDS.findall(name)}
    if words & FURNITURE:
        return True
    return "header" in words and not in_main and not words & ARTICLE_HEADER


def page_blocks(page: str) -> list[tuple[str, str, bool]]:
    """(path, text, whether inside article or main) of the blocks of a page that are no page furniture."""
    out: list[tuple[str, str, bool]] = []
    # Of each open element: tag, path of its block, whether it is left out, whether it is in article or main.
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((stack[-1][1], text, stack[-1][3]))

    def close(tags: tuple[str, ...], limit: frozenset[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in tags:
                flush()
                del stack[at:]
                return
            if stack[at][0] in limit:
                return

    last = 0
    for token in TOKEN.finditer(page):
        if token.start() > last and not stack[-1][2]:
            piece = page[last : token.start()]
            held.append(html.unescape(piece) if "&" in piece else piece)
        last = token.end()
        tag = (token["tag"] or token["tag2"] or "").lower()
        if not tag:
            continue
        if token["end"] or token["end2"]:
            if tag == "br":
                held.append(" ")
            elif any(x[0] == tag for x in stack):
                if tag in BLOCK:
                    flush()
                    while stack[-1][0] != tag:
                        stack.pop()
                    stack.pop()
                else:  # an inline end tag closes nothing outside its block
                    for at in range(len(stack) - 1, 0, -1):
                        if stack[at][0] == tag:
                            del stack[at:]
                            break
                        if stack[at][0] in BLOCK:
                            break
            continue
        if tag in BLOCK:
            flush()
            close(("p",), SCOPE)
        if tag in CLOSED_BY_OWN_KIND:
            close(CLOSED_BY_OWN_KIND[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        _, path, out_of_it, in_main = stack[-1]
        if not out_of_it:
            rest = token["rest"] or ""
            naming = [next(filter(None, x[1:]), "") for x in NAMING.findall(rest)] if "=" in rest else []
            out_of_it = _furniture(tag, naming, in_main)
            if tag in BLOCK:
                path += "/" + tag + ("." + ".".join(naming) if naming else "")
                in_main = in_main or tag in ("article", "main")
        stack.append((tag, path, out_of_it, in_main))
    if last < len(page) and not stack[-1][2]:
        piece = page[last:]
        if not re.match(r"<[a-zA-Z/!?]", piece):  # a tag cut off by the end of the page is no text
            held.append(html.unescape(piece))
    flush()
    return out


def mark(path: str, text: str) -> int:
    """64-bit hash of a text at a path."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    """An element with its texts; neighbouring elements of one signature are one node."""

    def __init__(self, name: str):
        self.name, self.kids, self.texts = name, [], []

    def child(self, name: str) -> "Node":
        if not self.kids or self.kids[-1].name != name:
            self.kids.append(Node(name))
        return self.kids[-1]


def tree(found: list[tuple[str, str, bool]]) -> Node:
    root = Node("")
    for path, text, _ in found:
        node = root
        for name in path.split("/")[1:]:
            node = node.child(name)
        node.texts.append(text)
    return root


class Shapes:
    """Numbers of subtrees that are alike in names and order, and how many nodes any two of them have in common."""

    def __init__(self):
        self.number, self.names, self.kids, self.sizes = {}, [], [], []
        self.known: dict[int, int] = {}
        self.common: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> int:
        """The number of a node's subtree; children are numbered before their parents."""
        for node in reversed(numbered(root)) if id(root) not in self.known else ():
            kids = tuple(self.known[id(k)] for k in node.kids)
            shape = self.number.setdefault((node.name, kids), len(self.names))
            if shape == len(self.names):
                self.names.append(node.name)
                self.kids.append(kids)
                self.sizes.append(1 + sum(self.sizes[k] for k in kids))
            self.known[id(node)] = shape
        return self.known[id(root)]

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: the most nodes that two subtrees have in common, order kept.  Trees may be of any depth."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            rest = _rest(self.kids[x], self.kids[y])
            asked = [] if self._plain(x, y) is not None else [
                p for p in itertools.product(dict.fromkeys(rest[0]), dict.fromkeys(rest[1])) if self._plain(*p) is None and p not in self.common]
            if asked:
                todo += asked
                continue
            todo.pop()
            if self._plain(x, y) is None and (x, y) not in self.common:
                row = np.zeros(len(rest[1]) + 1, np.int32)
                for weights in self.weights(*rest):
                    row = _next(row, weights)
                same = sum(self.sizes[k] for k in self.kids[x]) - sum(self.sizes[k] for k in rest[0])
                self.common[x, y] = 1 + same + int(row[-1])
        return self._common(a, b)

    def _plain(self, a: int, b: int) -> int | None:
        """What needs no alignment: subtrees of other names have nothing in common, equal ones everything."""
        return self.sizes[a] if a == b else 0 if self.names[a] != self.names[b] else None

    def _common(self, a: int, b: int) -> int:
        plain = self._plain(a, b)
        return self.common[a, b] if plain is None else plain

    def weights(self, first: tuple, second: tuple) -> Iterator[np.ndarray]:
        """For each child of one list what it has in common with the children of the other; pairs of them are known."""
        distinct, place = np.unique(np.array(second, np.int64), return_inverse=True)
        told: dict[int, np.ndarray] = {}
        for x in first:
            if x not in told:
                told[x] = np.array([self._common(x, y) for y in distinct.tolist()], np.int32)
            yield told[x][place]


def _rest(first: tuple, second: tuple, ends: bool = True) -> tuple[tuple, tuple]:
    """Two lists without the equal subtrees that both begin (and end) with: some best matching pairs these."""
    low, most = 0, min(len(first), len(second))
    while low < most and first[low] == second[low]:
        low += 1
    high = 0
    while ends and high < most - low and first[-1 - high] == second[-1 - high]:
        high += 1
    return first[low : len(first) - high], second[low : len(second) - high]


def _next(above: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of an alignment: the best sum of weights of pairs in order, by length of the second list."""
    row = above.copy()
    np.maximum(row[1:], above[:-1] + weights, out=row[1:])
    return np.maximum.accumulate(row)


def _score(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: the most nodes that two trees have in common, order kept."""
    shapes = memo.setdefault("shapes", Shapes())
    return shapes.match(shapes.of(a), shapes.of(b))


def _pairs(a: Node, b: Node, memo: dict) -> list[tuple[Node, Node]]:
    """The children of two matched nodes that the matching pairs.

    Some rows of the alignment are kept, those between are made anew on the way back.
    """
    shapes = memo.setdefault("shapes", Shapes())
    xs, ys = (tuple(shapes.of(k) for k in n.kids) for n in (a, b))
    rest = _rest(xs, ys, ends=False)  # of equal matchings the earliest children count
    for x, y in itertools.product(dict.fromkeys(rest[0]), dict.fromkeys(rest[1])):
        shapes.match(x, y)
    same, step = len(xs) - len(rest[0]), math.isqrt(len(rest[0])) + 1
    row, kept = np.zeros(len(rest[1]) + 1, np.int32), {}
    for i, weights in enumerate(shapes.weights(*rest)):
        if i % step == 0:
            kept[i] = row
        row = _next(row, weights)
    i, j, out = *map(len, rest), []
    while i and j:
        low = (i - 1) // step * step
        rows = [kept[low][: j + 1]]
        for weights in shapes.weights(rest[0][low:i], rest[1][:j]):
            rows.append(_next(rows[-1], weights))
        while i > low and j:
            if rows[i - low][j] == rows[i - low - 1][j]:
                i -= 1
            elif rows[i - low][j] == rows[i - low][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a.kids[same + i], b.kids[same + j]))
    return list(zip(a.kids[:same], b.kids[:same])) + out[::-1]


def numbered(root: Node) -> list[Node]:
    """The nodes of a tree, parents before their children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def aligned(reference: Node, page: Node) -> list[tuple[int, int]]:
    """Numbers of the nodes that simple tree matching pairs, in the reference and in the page."""
    first, second = ({id(n): i for i, n in enumerate(numbered(t))} for t in (reference, page))
    memo: dict = {}
    out, todo = [], [(reference, page)]
    while todo:
        a, b = todo.pop()
        out.append((first[id(a)], second[id(b)]))
        todo.extend(_pairs(a, b, memo))
    return out


def node_marks(reference: Node, found: list[tuple[str, str, bool]], shapes: dict) -> set[int]:
    """Marks of the reference's texts that a page has in the node matched with theirs, with the node's number.

    The matching looks at names alone: pages of one shape share it by ``shapes``.
    """
    page = tree(found)
    shape = tuple(path for path, _ in itertools.groupby(f[0] for f in found))
    if shape not in shapes:
        if len(shapes) >= KNOWN_SHAPES:
            shapes.clear()
        shapes[shape] = aligned(reference, page)
    own, other = numbered(reference), numbered(page)
    return {mark(f"\1{i}", t) for i, j in shapes[shape] for t in set(own[i].texts).intersection(other[j].texts)}


def slot_of(reference: Node, same: set[int]) -> str:
    """Path of the content slot: the lowest node that holds nearly all text that is not the same on the host's pages."""
    nodes = numbered(reference)
    varies: dict[int, int] = {}
    for i in reversed(range(len(nodes))):  # children come after their parents
        node = nodes[i]
        varies[id(node)] = sum(len(t) for t in node.texts if mark(f"\1{i}", t) not in same) + sum(varies[id(k)] for k in node.kids)
    total, node, slot = varies[id(reference)], reference, ""
    while total:
        into = [k for k in node.kids if k.kids and varies[id(k)] >= SLOT_SHARE * total]
        if not into or node.name.split(".")[0] in ("article", "main"):
            break
        node, slot = into[0], f"{slot}/{into[0].name}"
    return slot


def induce(pages: list[str]) -> dict:
    """The wrapper that some pages tell: path of the content slot, and marks of the constant texts.

    ``wrappers`` does the same for all pages of all hosts, in many tasks.
    """
    found = [b for b in map(page_blocks, pages) if b]
    different = list({tuple(t for _, t, _ in b): b for b in found}.values())
    if not different:
        return {"slot": "", "constant": []}
    reference, shapes = tree(different[0]), {}
    often = lambda told: {m for m, n in Counter(itertools.chain(*told)).items() if n >= max(LEAST_PAGES, TEMPLATE_SHARE * len(different))}
    constant = often({mark(path, text) for path, text, _ in b} for b in different)
    return {"slot": slot_of(reference, often(node_marks(reference, b, shapes) for b in different)), "constant": sorted(constant)}


def read(page: str, wrapper: dict) -> str:
    """The page's text through its host's wrapper.

    It is what lies in the content slot, or where the page has no such slot any
    block, without the host's constant texts.  If some of these blocks are inside
    article or main, those outside are furniture without a telling name.
    """
    found = page_blocks(page)
    slot, constant = wrapper["slot"], set(wrapper["constant"])
    in_slot = [x for x in found if x[0] == slot or x[0].startswith(slot + "/")] or found
    if any(main for _, _, main in found) and not any(main for _, _, main in in_slot):
        in_slot = found  # the slot of other pages
    own = [x for x in in_slot if mark(x[0], x[1]) not in constant]
    inside = any(main for _, _, main in in_slot)
    return "\n".join(text for _, text, main in own if main or not inside)


def host_of(url):
    """What is between the first :// and the next /, ? or #, A-Z in lower case; empty where there is none."""
    from fraudwatch.llm.base import lower_ascii

    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def references(pages: DataFrame) -> DataFrame:
    """host and the page (html) that the host's other pages are aligned with: the one with the smallest hash that is not blank."""
    key = F.xxhash64("page_id", "url")
    full = pages.where(F.length(F.trim("html")) > 0).select(host_of(F.col("url")).alias("host"), key.alias("key"), "html")
    chosen = full.groupBy("host").agg(F.min("key").alias("key")).select("key")
    mine = full.join(broadcast_if_small(chosen), "key", "left_semi").groupBy("key").agg(F.min("host").alias("of"), F.min("html").alias("reference"))
    return mine.select("of", "reference")


def constants(pages: DataFrame, reference: DataFrame) -> DataFrame:
    """host and the marks of its template texts (arrays), counted over all different pages of the host: by path, and by node of the reference.

    Pages with the same blocks are one page.  A page also tells a row without a mark,
    by which the host's pages are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in text_blocks(batches, "html"):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for host, page, first in zip(*(batch.column(n).to_pylist() for n in ("host", "html", "reference"))):
                found = page_blocks(page or "")
                marks = [mark(path, text) for path, text, _ in found]
                if marks:
                    if host not in known:
                        if len(known) >= KNOWN_HOSTS:
                            known.clear()
                        known[host] = tree(page_blocks(first or "")), {}
                    own = xxhash.xxh3_64_intdigest(repr(marks).encode()) - (1 << 63)
                    by_path, by_node = [None, *set(marks)], node_marks(known[host][0], found, known[host][1])
                    n = len(by_path) + len(by_node)
                    for column, values in zip(out, ([host] * n, [own] * n, [*by_path, *by_node], [False] * len(by_path) + [True] * len(by_node))):
                        column.extend(values)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["host", "own", "mark", "node"])

    slim = pages.select(host_of(F.col("url")).alias("host"), "html").join(reference, F.col("host") == F.col("of"), "left")
    told = slim.select("host", "html", "reference").mapInArrow(run, "host string, own bigint, mark bigint, node boolean")
    # Hashes of eight bytes are shuffled; a host with many pages is counted in many tasks first.
    counted = told.distinct().groupBy("host", "mark", "node").agg(F.count(F.lit(1)).alias("n"))
    counted = settle(counted.where(F.col("n") >= LEAST_PAGES))
    total = counted.where("mark IS NULL").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    often = counted.where("mark IS NOT NULL").join(broadcast_if_small(total, 10_000), F.col("host") == F.col("of"))
    # At most the blocks of a page by 1 / TEMPLATE_SHARE.
    often = often.where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    marks = lambda kind: F.sort_array(F.collect_list(F.when(kind, F.col("mark"))))
    return often.groupBy("host").agg(marks(~F.col("node")).alias("marks"), marks(F.col("node")).alias("nodes"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host and its wrapper as JSON: slot and template texts, both from all pages of the host."""
    # Texts of a page per host; measured, and broadcast if their bytes are few.
    reference = broadcast_small_bytes(references(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "reference"):
            pairs = zip(batch.column("reference").to_pylist(), batch.column("nodes").to_pylist())
            slots = [slot_of(tree(page_blocks(page)), set(same or ())) for page, same in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array(slots, pa.string()), batch.column("marks")], names=["host", "slot", "marks"])

    told = reference.join(constants(pages, reference), F.col("of") == F.col("host"), "left").select("of", "reference", "nodes", "marks")
    slots = told.mapInArrow(run, "host string, slot string, marks array<bigint>")
    marks = F.coalesce(F.col("marks"), F.array().cast("array<bigint>")).alias("constant")
    return slots.select("host", F.to_json(F.struct("slot", marks)).alias("wrapper"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty html, or a page without content, has an empty text.  Pages
    whose url is null or has no :// share the empty host.  Nulls in page_id and
    url stay; repeated rows give repeated rows; other columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # A wrapper is a few checksums, so the bound in rows also bounds the bytes that are broadcast.
    known = broadcast_if_small(wrappers(rows), 10_000)
    told = rows.withColumn("host", host_of(F.col("url"))).join(known, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in text_blocks(batches, "html"):
            texts = []
            for page, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
                if len(parsed) > 1000:
                    parsed.clear()
                if wrapper not in parsed:
                    parsed[wrapper] = json.loads(wrapper) if wrapper else {"slot": "", "constant": []}
                texts.append(read(page or "", parsed[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return told.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
