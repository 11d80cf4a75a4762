"""Main text of web pages by wrapper induction over the pages of a host.

One page of each host (the least by a hash, of those with no fewer kinds of element than usual)
gives the wrapper's tree. Every page of the host is aligned with it by simple tree matching: two nodes
match if their tags and classes agree, and the children of matched nodes are aligned in order so that as
many nodes as possible match. For each wrapper node the values that different pages have there are
counted over all pages, as hashes; copies of a page count once. A node whose pages mostly share their value
with several others is constant and becomes template; a node with values of its own is a content slot.
The text is taken from each page by aligning it with the finished wrapper again: template
nodes go, slots and nodes that no wrapper node matches stay.

A host may have several layouts. A page is of a wrapper's layout if at least half of its kinds of place
(tags and classes from the root down) are matched. From the pages that no wrapper of their host covers the
next one is made, up to ``LAYOUTS`` a host; pages of further layouts belong to the last one.

Constancy needs several pages, and a host may rotate its notices; so wrapper and page nodes
that HTML itself marks as no part of an article (navigation, footers, forms, scripts, classes
such as ``ad`` or ``comments``) are template from the start. Where a page marks its article
(``article`` or ``main``, at most ``MARK_DEPTH`` elements deep), text outside it goes too, and inside it
a node must be all but equal on the host's pages to count as constant, lest copies of one article erase it.

Blocks are the block-level elements' texts: references decoded, white space made one space,
trimmed, joined by an empty line. Null and empty pages give an empty text; pages without a
host form one group; repeated rows each get their text; extra columns are ignored. Nests and
child lists may be of any size: nothing recurses, and lists are aligned exactly, in memory that grows with
one list's length times the root of the other's.

Wrappers are written as a table, so Spark knows their size: it broadcasts them if they are
small and sorts by host otherwise. A host with a third of all pages is one small row there.
"""

from __future__ import annotations

import html as html_module
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import ship, work_path

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)[^>]*>",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_JOINED = re.compile(r"[-_]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no part of an article's text.
OUTSIDE = frozenset(
    "head nav footer aside form script style noscript template iframe svg button select "
    "textarea title menu dialog object canvas".split()
)
#: Words of class, id or role that mark the same, alone or joined with each other only
#: (cookie-notice, but not share-price).
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies dialog disqus footer gdpr login menu modal nav "
    "navbar navigation newsletter notice notices pagination popup promo related search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: An article element nested deeper than this does not mark its page.
MARK_DEPTH = 200
#: Wrappers a host has at most.
LAYOUTS = 4
#: Least different pages of a host and share of values that so many of them have for a constant
#: node, outside articles and (of one value) inside.
LEAST_PAGES, OUTSIDE_SHARE = 4, 0.6
LEAST_INSIDE, INSIDE_SHARE = 20, 0.95


#: A word sequence's hash is a polynomial of its words' hashes.
_BASE, _PRIME = 0x9E3779B97F4A7C15, (1 << 61) - 1


class Page:
    """A page's tree: per node its tag, label, parent and children (numbers, or text)."""

    def __init__(self, source: str):
        self.tags, self.labels, self.kids, self.skip = ["html"], ["html"], [[]], [False]
        self.parents = [-1]
        self.inside = [False]  # in an article or main element
        self.marked = False
        stack, at, tags = [0], 0, self.tags
        opened: Counter[str] = Counter()  # tags of the stack above the root
        for token in iter(_TOKEN.scanner(source).search, None):
            if token.start() < at:
                continue
            if token.start() > at:
                self.kids[stack[-1]].append(source[at : token.start()])
            at = token.end()
            tag = token["tag"] or token["odd"]
            if tag:
                tag = tag.lower()
                if tag in ("html", "body") and len(stack) == 1:
                    continue
                if tag in BLOCKS:
                    self._close(stack, opened, "p")
                    if tag in ("li", "dt", "dd", "tr", "td", "th"):
                        self._close(stack, opened, tag)
                node = self._add(stack, tag, token["attrs"] or "")
                if tag in RAW:
                    end = re.compile(rf"</{tag}[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                elif tag not in VOID and not (token["attrs"] or "").endswith("/"):
                    stack.append(node)
                    opened[tag] += 1
            elif token["end"]:
                tag = token["end"].lower()
                if opened[tag]:
                    while True:
                        last = tags[stack.pop()]
                        opened[last] -= 1
                        if last == tag:
                            break
        if at < len(source):
            self.kids[stack[-1]].append(source[at:])

    def _close(self, stack: list[int], opened: Counter[str], tag: str) -> None:
        if not opened[tag]:
            return
        for back in range(len(stack) - 1, 0, -1):
            open_tag = self.tags[stack[back]]
            if open_tag == tag:
                opened.subtract(self.tags[n] for n in stack[back:])
                del stack[back:]
                return
            if open_tag in ("table", "ul", "ol", "dl", "div", "article", "section"):
                return

    def _add(self, stack: list[int], tag: str, attrs: str) -> int:
        node, parent = len(self.tags), stack[-1]
        names = {}
        if attrs:
            names = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMES.finditer(attrs)}
        inside = self.inside[parent]
        named = any(OUTSIDE_NAMES.issuperset(_JOINED.split(w)) for v in names.values() for w in v.split())
        outside = tag in OUTSIDE or named or (tag == "header" and not inside)
        self.skip.append(self.skip[parent] or outside)
        article = tag in ("article", "main") or names.get("role") == "main"
        article = article and not self.skip[-1] and len(stack) < MARK_DEPTH
        self.marked |= article
        self.inside.append(inside or article)
        self.tags.append(tag)
        self.labels.append(f"{tag}.{names['class']}" if names.get("class") else tag)
        self.kids.append([])
        self.parents.append(parent)
        self.kids[parent].append(node)
        return node

    def elements(self, node: int) -> list[int]:
        """The child elements of a node."""
        return [k for k in self.kids[node] if type(k) is int]

    def text(self, node: int) -> str:
        """The node's whole text with white space made one space."""
        parts, stack = [], [node]
        while stack:
            item = stack.pop()
            if type(item) is str:
                parts.append(item)
            else:
                stack.extend(reversed(self.kids[item]))
        return " ".join(html_module.unescape(" ".join(parts)).split())

    def values(self) -> list[int | None]:
        """Per node a hash of its whole text's words in order, None without one; each word is read once."""
        import xxhash

        runs, powers = [0], [1]  # hash of all words before, and the base's powers
        begins, ends = [0] * len(self.tags), [0] * len(self.tags)
        stack: list = [0]
        while stack:
            item = stack.pop()
            if type(item) is str:
                for word in html_module.unescape(item).split():
                    runs.append((runs[-1] * _BASE + xxhash.xxh64_intdigest(word.encode())) % _PRIME)
                    powers.append(powers[-1] * _BASE % _PRIME)
            elif item < 0:
                ends[~item] = len(runs) - 1
            else:
                begins[item] = len(runs) - 1
                stack.append(~item)
                stack.extend(reversed(self.kids[item]))
        return [
            (runs[b] - runs[a] * powers[b - a]) % _PRIME if b > a else None for a, b in zip(begins, ends)
        ]

    def blocks(self, dropped: set[int]) -> list[str]:
        """The texts of blocks in page order without the dropped and outside nodes."""
        out, now = [], []

        def flush() -> None:
            text = " ".join("".join(now).split())
            if text:
                out.append(text)
            now.clear()

        marked = self.marked
        stack: list = [0]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif type(item) is tuple:
                if not marked or item[0]:
                    now.append(html_module.unescape(item[1]))
            elif not self.skip[item] and item not in dropped:
                block = self.tags[item] in BLOCKS
                if block:
                    flush()
                    stack.append(None)
                elif self.tags[item] == "br":
                    now.append(" ")
                inside = self.inside[item]
                stack.extend((inside, k) if type(k) is str else k for k in reversed(self.kids[item]))
        flush()
        return out


def shape(page: Page) -> list[list]:
    """[labels, parents] of the nodes in preorder, without outside nodes' insides."""
    labels, parents, number = [], [], {-1: -1}
    for node, parent in enumerate(page.parents):
        if parent in number and not (parent >= 0 and page.skip[parent]):
            number[node] = len(labels)
            labels.append(page.labels[node])
            parents.append(number[parent])
    return [labels, parents]


class Wrapper:
    """A wrapper's tree with the nodes that are template."""

    def __init__(self, text: str, template: frozenset[int]):
        self.labels, parents = json.loads(text)
        self.kids: list[list[int]] = [[] for _ in self.labels]
        self.template = template
        for node, parent in enumerate(parents):
            if parent >= 0:
                self.kids[parent].append(node)


def aligned(m: int, n: int, weights: Callable[[int], Sequence[int]]) -> list[tuple[int, int]]:
    """Pairs (i, j) of the heaviest alignment in order of m rows and n columns, last pair first.

    Every root-of-m-th row of sums is kept; those between are made again on the way back.
    """

    def below(row: Sequence[int], i: int) -> Sequence[int]:
        if n > 32:
            best = np.maximum(row[1:], np.add(row[:-1], weights(i)))
            return np.concatenate([[0], np.maximum.accumulate(best)])
        out = [0]
        for j, weight in enumerate(weights(i)):
            out.append(max(row[j + 1], out[j], row[j] + weight))
        return out

    every = isqrt(m) + 1
    row: Sequence[int] = np.zeros(n + 1, np.int64) if n > 32 else [0] * (n + 1)
    marks = [row]
    for i in range(m):
        row = below(row, i)
        if (i + 1) % every == 0:
            marks.append(row)
    pairs, i, j = [], m, n
    while i and j:
        first = (i - 1) // every * every
        rows = [marks[first // every]]
        for k in range(first, i):
            rows.append(below(rows[-1], k))
        while i > first and j:
            here, above = rows[i - first], rows[i - first - 1]
            if here[j] == above[j]:
                i -= 1
            elif here[j] == here[j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
    return pairs


def match(wrapper: Wrapper, page: Page) -> dict[int, int]:
    """Wrapper nodes and the page nodes they match, by simple tree matching."""
    kinds: dict[tuple, int] = {}

    def numbered(labels: list[str], kids: list[list[int]]) -> tuple[list[int], list[int]]:
        """Per node a number that equal subtrees share, and the number of nodes."""
        kind, size = [0] * len(labels), [1] * len(labels)
        for node in range(len(labels) - 1, -1, -1):  # children come after their parents
            name = (labels[node], tuple([kind[k] for k in kids[node]]))
            kind[node] = kinds.setdefault(name, len(kinds))
            size[node] += sum([size[k] for k in kids[node]])
        return kind, size

    page_kids = [[] if skip else page.elements(n) for n, skip in enumerate(page.skip)]
    mine, sizes = numbered(wrapper.labels, wrapper.kids)
    theirs, _ = numbered(page.labels, page_kids)
    scores: dict[tuple[int, int], int] = {}  # by kinds, of pairs with one label and unlike subtrees

    def middle(a: int, b: int) -> tuple[list[int], list[int], int, int]:
        """The children of a pair without the equal ones in front and at the back, and their numbers."""
        left, right = wrapper.kids[a], page_kids[b]
        low, m, n = 0, len(left), len(right)
        while low < min(m, n) and mine[left[low]] == theirs[right[low]]:
            low += 1
        while low < min(m, n) and mine[left[m - 1]] == theirs[right[n - 1]]:
            m, n = m - 1, n - 1
        return left[low:m], right[low:n], low, len(left) - m

    def unlike(left: list[int], right: list[int]) -> list[tuple[int, int]]:
        """One pair for every two kinds whose score is not known."""
        by_label: dict[str, dict[int, int]] = {}
        for y in right:
            by_label.setdefault(page.labels[y], {})[theirs[y]] = y
        return [
            (x, y)
            for own, x in {mine[x]: x for x in left}.items()
            for other, y in by_label.get(wrapper.labels[x], {}).items()
            if own != other and (own, other) not in scores
        ]

    def best(left: list[int], right: list[int]) -> list[tuple[int, int]]:
        """The alignment of two lists whose scores are known."""
        if not left or not right:
            return []
        places: dict[int, int] = {}
        at = [places.setdefault(theirs[y], len(places)) for y in right]
        named = [""] * len(places)
        for place, y in zip(at, right):
            named[place] = page.labels[y]

        def weights(i: int) -> Sequence[int]:
            x, own = left[i], mine[left[i]]
            label = wrapper.labels[x]
            each = [
                0 if named[p] != label else sizes[x] if own == kind else scores[own, kind]
                for kind, p in places.items()
            ]
            return np.array(each)[at] if len(at) > 32 else [each[p] for p in at]

        return [(left[i], right[j]) for i, j in aligned(len(left), len(right), weights)]

    def score(x: int, y: int) -> int:
        return sizes[x] if mine[x] == theirs[y] else scores[mine[x], theirs[y]]

    if wrapper.labels[0] != page.labels[0]:
        return {}
    stack = [(0, 0)] if mine[0] != theirs[0] else []
    while stack:
        a, b = stack[-1]
        left, right, front, back = middle(a, b)
        unknown = unlike(left, right)
        if unknown:
            stack.extend(unknown)
            continue
        stack.pop()
        if (mine[a], theirs[b]) not in scores:
            own = wrapper.kids[a]
            same = sum([sizes[x] for x in own[:front] + own[len(own) - back :]])
            scores[mine[a], theirs[b]] = 1 + same + sum([score(x, y) for x, y in best(left, right)])
    found, stack = {}, [(0, 0)]
    while stack:
        a, b = stack.pop()
        found[a] = b
        left, right, front, back = middle(a, b)
        own, other = wrapper.kids[a], page_kids[b]
        stack.extend(zip(own[:front], other))
        stack.extend(best(left, right))
        if back:
            stack.extend(zip(own[-back:], other[-back:]))
    return found


def covers(page: Page, found: dict[int, int]) -> bool:
    """Whether at least half of the page's kinds of place are matched."""
    places: dict[tuple[int, str], int] = {}
    at = [0] * len(page.tags)
    matched, held = set(), set()
    hit = set(found.values())
    for node in range(1, len(page.tags)):
        if not page.skip[page.parents[node]]:
            at[node] = places.setdefault((at[page.parents[node]], page.labels[node]), len(places) + 1)
            if not page.skip[node]:
                held.add(at[node])
                if node in hit:
                    matched.add(at[node])
    return 2 * len(matched) >= len(held)


def slot_values(page: Page, found: dict[int, int]) -> list[tuple[int, bool, int]]:
    """(wrapper node, inside an article, hash of the page's text there) of the matched nodes
    that may be template: those that hold text and do not hold the article."""
    out, values = [], page.values()
    holds = set()  # nodes above an article
    for node in range(len(page.tags) - 1, 0, -1):
        if page.inside[node] or node in holds:
            holds.update((node, page.parents[node]))
    for own, theirs in found.items():
        inside = page.inside[theirs]
        if page.skip[theirs] or page.tags[theirs] not in BLOCKS or page.tags[theirs] in ("article", "main"):
            continue
        if theirs in holds and not inside or theirs == 0:
            continue
        if values[theirs] is not None:
            out.append((own, inside, values[theirs]))
    return out


@lru_cache(maxsize=256)
def _wrapper(text: str, template: tuple[int, ...]) -> Wrapper:
    return Wrapper(text, frozenset(template))


def main_text(source: str | None, wrappers: Sequence[Wrapper]) -> str:
    """The page's main text under the first wrapper of its host that covers it, else the last."""
    if not source:
        return ""
    page, dropped = Page(source), set()
    for i, wrapper in enumerate(wrappers):
        # Without any template on it, the last wrapper need not be aligned.
        if i + 1 < len(wrappers) or wrapper.template:
            found = match(wrapper, page)
            if i + 1 == len(wrappers) or covers(page, found):
                dropped = {found[n] for n in wrapper.template if n in found}
                break
    return "\n\n".join(page.blocks(dropped))


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [json.dumps(shape(Page(x.as_py() or ""))) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(made, pa.string())], names=["host", "shape"]
        )


def _slots(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """The slots of the pages that the wrapper covers (all, if it is the last one a host may have); one row
    with node -1 for each other page."""
    for batch in batches:
        rows = [], [], [], []
        shapes = batch.column("shape")
        for i, source in enumerate(batch.column("html")):
            page = Page(source.as_py() or "")
            found = match(_wrapper(shapes[i].as_py(), ()), page)
            kept = last or covers(page, found)
            for node, inside, value in slot_values(page, found) if kept else [(-1, False, 0)]:
                for column, x in zip(rows, (i, node, inside, value)):
                    column.append(x)
        at = pa.array(rows[0], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("host").take(at),
                pa.array(rows[1], pa.int32()),
                pa.array(rows[2], pa.bool_()),
                pa.array(rows[3], pa.int64()),
                batch.column("page").take(at),
            ],
            names=["host", "node", "inside", "value", "page"],
        )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, made in zip(batch.column("html"), batch.column("wrappers")):
            wrappers = [_wrapper(w["shape"], tuple(w["template"] or ())) for w in made.as_py() or ()]
            texts.append(main_text(source.as_py(), wrappers))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string())],
            names=["id", "url", "text"],
        )


def _written(df: DataFrame, name: str) -> DataFrame:
    """A small table of the shared folder, whose size Spark knows."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.coalesce(1).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _pivots(rows: DataFrame) -> DataFrame:
    """(host, shape): the tree of one page a host, with no fewer kinds of element than usual."""
    kinds = F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][^\s/>]*(?:\s+class=[^\s>]*)?)"), F.lit(1))
    sized = rows.select("host", "html", F.coalesce(F.size(F.array_distinct(kinds)), F.lit(0)).alias("kinds"))
    usual = _written(sized.groupBy("host").agg(F.avg("kinds").alias("usual")), "usual")
    chosen = (
        sized.join(usual, "host")
        .where(F.col("kinds") >= F.col("usual"))
        .groupBy("host")
        .agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("html"))
    )
    return _written(chosen.mapInArrow(_shapes, "host string, shape string"), "shapes")


def induce(rows: DataFrame, layouts: int = LAYOUTS) -> DataFrame:
    """(host, wrappers): the wrappers of every host of (host, html) rows, as (layout, shape, template).

    Each layout beyond the first is a pass over the pages that no wrapper covers yet.
    """
    spark = rows.sparkSession
    left = rows = rows.select("host", "html", F.xxhash64("html").alias("page"))
    shapes, values = [], []
    for layout in range(layouts):
        made = _pivots(left)
        last = layout + 1 == layouts
        slots = left.join(made, "host").mapInArrow(
            lambda batches, last=last: _slots(batches, last),
            "host string, node int, inside boolean, value bigint, page bigint",
        )
        # Copies of a page are one page.
        path = work_path(spark, "slots")
        slots.distinct().write.parquet(path)
        slots = spark.read.schema(slots.schema).parquet(path)
        shapes.append(made.select("host", F.lit(layout).alias("layout"), "shape"))
        values.append(slots.where("node >= 0").withColumn("layout", F.lit(layout)))
        odd = slots.where("node < 0").select("host", "page")
        if odd.isEmpty():
            break
        left = rows.join(odd, ["host", "page"], "left_semi")
    shape_rows, value_rows = (reduce(DataFrame.unionByName, x) for x in (shapes, values))
    # Few equal values are copies or chance, not a template.
    counted = value_rows.groupBy("host", "layout", "node", "inside", "value").count()
    per_node = counted.groupBy("host", "layout", "node", "inside").agg(
        F.sum("count").alias("pages"),
        F.sum(F.when(F.col("count") >= LEAST_PAGES, F.col("count")).otherwise(0)).alias("repeated"),
        F.max("count").alias("most"),
    )
    outside = (F.col("pages") >= LEAST_PAGES) & (F.col("repeated") >= F.col("pages") * OUTSIDE_SHARE)
    inside = (F.col("pages") >= LEAST_INSIDE) & (F.col("most") >= F.col("pages") * INSIDE_SHARE)
    constant = per_node.where(F.when(F.col("inside"), inside).otherwise(outside))
    templates = constant.groupBy("host", "layout").agg(F.sort_array(F.collect_set("node")).alias("template"))
    each = shape_rows.join(templates, ["host", "layout"], "left")
    whole = F.sort_array(F.collect_list(F.struct("layout", "shape", "template"))).alias("wrappers")
    return _written(each.groupBy("host").agg(whole), "wrappers")


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) per page."""
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)[id_col]
    host = F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(host, F.lit("")).alias("host"),
        F.col(html_col).alias("html"),
    )
    wrappers = induce(rows.select("host", "html"))
    joined = rows.join(wrappers, "host", "left").select("id", "url", "html", "wrappers")
    texts = joined.mapInArrow(_extracted, f"id {kind}, url string, text string")
    return texts.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        "text",
        F.length("text").cast("bigint").alias("n_chars"),
    )
