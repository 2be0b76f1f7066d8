"""Main text of web pages by wrapper induction.

Pages of a host are aligned with one of them, the seed, by simple tree
matching. A node of the seed that most aligned pages repeat word for word is
template, a node that varies is a slot. A page is then aligned once more and
loses its template, inside articles too; menus, forms and the like also go by
their tags and names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hemicycle.session import cut_lineage

#: fixed values of the markup language and of common naming
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe svg math object canvas button select textarea input option dialog menu audio video map title".split()
)
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
} | {t: frozenset(["p"]) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
FENCES = frozenset("html body article main section div aside nav footer header form table ul ol dl blockquote figure".split())
NOISE = frozenset(
    "ad ads advert advertisement adverts adbox adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login menu nav navbar navigation topnav breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond reply replies "
    "share sharing social related recommended widget search pagination pager toolbar skip".split()
)
#: names that rule out even an article: a reader's comment, an advert
FOREIGN = frozenset("comment comments reply ad ads advert advertisement sponsored promo".split())
#: a node is template if this share of the aligned pages, and so many at least, repeat it
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 5
#: a paragraph of an article that has no name, nor anything between it and the article, needs so many pages
PLAIN_PAGES = 20
#: seeds up to this many bytes together are sent to all tasks; beyond that pages meet them by a shuffle
SEND_BYTES = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title|noscript|iframe)\b(?P<rattr>[^>]*+)>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("children", "ids", "kids", "names", "number", "tag", "words")

    def __init__(self, tag: str, names: frozenset, ids: frozenset = frozenset()):
        self.tag, self.names, self.ids, self.children, self.kids, self.number, self.words = tag, names, ids, [], (), -1, None


def parse(page: str) -> Node:
    """Tree of a page; missing end tags are implied, stray ones ignored."""
    root = Node("#root", frozenset())
    stack = [root]
    for m in _TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            stack[-1].children.append(m["text"])
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag in INLINE and stack[depth].tag in FENCES:
                    break
            continue
        closes = CLOSES.get(tag)
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    del stack[depth:]
                    break
                if stack[depth].tag in FENCES:
                    break
        attr = m["attr"]
        names = ids = frozenset()
        if "=" in attr:
            found = [(x[0].lower(), "".join(x[1:]).lower().split()) for x in _NAMES.findall(attr)]
            names, ids = (frozenset(w for kind, ws in found if (kind == "id") == own for w in ws) for own in (False, True))
        node = Node(tag, names, ids)
        stack[-1].children.append(node)
        if tag not in VOID and not attr.endswith("/"):
            stack.append(node)
    return root


def number(root: Node) -> list[Node]:
    """Nodes in page order, numbered, with the white-space-free text below each."""
    out: list[Node] = []

    def walk(top: Node) -> None:  # explicit stack: trees may be very deep
        todo = [(top, False)]
        while todo:
            node, left = todo.pop()
            if left:
                node.words = " ".join(w for c in node.children for w in (c.split() if isinstance(c, str) else [c.words]) if w)
                continue
            node.number = len(out)
            out.append(node)
            node.kids = [c for c in node.children if not isinstance(c, str)]
            todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.kids))

    walk(root)
    return out


#: cells of a table of child alignments that is kept whole; longer lists are halved until they fit
CELLS = 1 << 20


def align(seed: Node, page: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes of a largest order-keeping match of two trees.

    Simple tree matching: roots must agree, and the children are aligned so
    that the matched subtrees hold as many nodes as they can. How many that
    are depends on the shapes of the subtrees alone, so it is found once a
    pair of shapes. Any depth and any number of children is matched exactly.
    """
    shapes: dict[tuple, int] = {}
    kinds: list[tuple[str, tuple[int, ...], int]] = []  # tag, shapes of the children and nodes of each shape

    def shape(top: Node) -> dict[int, int]:
        own: dict[int, int] = {}
        todo = [(top, False)]
        while todo:
            node, left = todo.pop()
            if not left and node.kids:
                todo.append((node, True))
                todo.extend((c, False) for c in node.kids)
                continue
            key = node.tag, tuple(own[id(c)] for c in node.kids)
            if key not in shapes:
                shapes[key] = len(kinds)
                kinds.append((*key, 1 + sum(kinds[k][2] for k in key[1])))
            own[id(node)] = shapes[key]
        return own

    of = shape(seed) | shape(page)
    sizes: dict[tuple[int, int], int] = {}

    def known(p: int, q: int) -> int | None:
        """Matched nodes of two shapes; None if their children come first."""
        if kinds[p][0] != kinds[q][0]:
            return 0
        if p == q:
            return kinds[p][2]
        if not kinds[p][1] or not kinds[q][1]:
            return 1
        return sizes.get((p, q))

    def size(p: int, q: int) -> int:
        todo = [(p, q)]
        while todo:  # explicit stack: trees may be very deep
            p, q = todo[-1]
            if known(p, q) is not None:
                todo.pop()
                continue
            xs, ys, total, _ = _inner(kinds[p][1], kinds[q][1], kinds)
            more = [(x, y) for x in set(xs) for y in set(ys) if known(x, y) is None]
            if more:
                todo.extend(more)
            else:
                sizes[todo.pop()] = 1 + total + (int(_last_row(xs, ys, known)[-1]) if xs and ys else 0)
        return known(p, q) or 0

    pairs, todo = [], [(seed, page)]
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        if not a.kids or not b.kids:
            continue
        all_x, all_y = tuple(of[id(c)] for c in a.kids), tuple(of[id(c)] for c in b.kids)
        xs, ys, _, head = _inner(all_x, all_y, kinds)
        for x in set(xs):
            for y in set(ys):
                size(x, y)
        todo.extend(zip(a.kids[:head], b.kids[:head], strict=True))
        tail = len(all_x) - head - len(xs)
        if tail:
            todo.extend(zip(a.kids[-tail:], b.kids[-tail:], strict=True))
        todo.extend((a.kids[head + i], b.kids[head + j]) for i, j in _matched(xs, ys, known))
    return pairs


def _inner(xs: tuple, ys: tuple, kinds: list) -> tuple[tuple, tuple, int, int]:
    """Lists without the equal shapes at both ends (some largest match has them), the nodes of these, and those at the head."""
    least, head, tail = min(len(xs), len(ys)), 0, 0
    while head < least and xs[head] == ys[head]:
        head += 1
    while tail < least - head and xs[-1 - tail] == ys[-1 - tail]:
        tail += 1
    ends = xs[:head] + xs[len(xs) - tail :]
    return xs[head : len(xs) - tail], ys[head : len(ys) - tail], sum(kinds[k][2] for k in ends), head


def _rows(xs: tuple, ys: tuple, known) -> Iterator[np.ndarray]:
    """Row by row the most matched nodes of the first of ``xs`` with the first of ``ys``."""
    row = np.zeros(len(ys) + 1, np.int64)
    yield row
    different, place = np.unique(np.array(ys, np.int64), return_inverse=True)
    gains: dict[int, np.ndarray] = {}
    for x in xs:
        if x not in gains:
            if len(gains) * len(different) > CELLS:
                gains.clear()
            gains[x] = np.array([known(x, y) for y in different.tolist()], np.int64)
        gain = gains[x][place]
        step = np.where(gain > 0, row[:-1] + gain, 0)
        row = np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], step))])
        yield row


def _last_row(xs: tuple, ys: tuple, known) -> np.ndarray:
    row = np.zeros(len(ys) + 1, np.int64)
    for row in _rows(xs, ys, known):  # noqa: B007
        pass
    return row


def _matched(xs: tuple, ys: tuple, known) -> list[tuple[int, int]]:
    """Places of a best alignment; the first list is halved while the table is too large."""
    out, todo = [], [(0, len(xs), 0, len(ys))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:
            half = (a + b) // 2
            first = _last_row(xs[a:half], ys[c:d], known)
            second = _last_row(xs[half:b][::-1], ys[c:d][::-1], known)[::-1]
            cut = c + int(np.argmax(first + second))
            todo += [(a, half, c, cut), (half, b, cut, d)]
            continue
        table = list(_rows(xs[a:b], ys[c:d], known))
        i, j = b - a, d - c
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return out


@lru_cache(maxsize=512)
def _seed(page: str) -> Node:
    root = parse(page)
    number(root)
    return root


@lru_cache(maxsize=512)
def _plain(page: str) -> frozenset[int]:
    """Numbers of the seed's plain paragraphs in articles, with the inline nodes in them."""
    out = set()
    todo = [(_seed(page), False, False)]
    while todo:
        node, inside, plain = todo.pop()
        inside = node.tag in ("article", "main") or (inside and not node.names and not node.ids)
        plain = inside and not node.names and not node.ids and (node.tag == "p" or (plain and node.tag in INLINE))
        if plain:
            out.add(node.number)
        todo.extend((c, inside, plain) for c in node.kids)
    return frozenset(out)


def main_text(page: str, seed: str | None = None, template: frozenset[int] = frozenset(), places: frozenset[int] = frozenset()) -> str:
    """The blocks of the article, one a line.

    Without an article or main element the whole body counts. Template nodes
    (numbers of the seed's nodes) are dropped. Inside an article a constant
    inline node stays where it is part of a running text, and an article that
    is constant as a whole stays: the page itself is repeated. Nothing that
    holds an article goes by its name or tag. Classes and roles count as whole
    words; an id counts only in ``places``, where most pages have the same.
    """
    root = parse(page)
    nodes = number(root)
    constant: set[int] = set()
    placed: set[int] = set()
    if seed is not None and (template or places):
        pairs = align(_seed(seed), root)
        constant = {b.number for a, b in pairs if a.number in template and a.words == b.words}
        placed = {b.number for a, b in pairs if a.number in places and a.ids & b.ids & NOISE}
    articles = [n for n in nodes if n.tag == "article" and not n.names & FOREIGN] or [n for n in nodes if n.tag == "main"]
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(text)

    # (node, inside an article, in one that is constant, in a running text, leaving)
    todo: list[tuple[Node | str, bool, bool, bool, bool]] = [(root, not articles, False, False, False)]
    tops = set(map(id, articles))
    above = set()  # nodes that hold an article
    for node in reversed(nodes):
        if any(id(c) in tops or id(c) in above for c in node.kids):
            above.add(id(node))
    while todo:
        node, inside, whole, running, leaving = todo.pop()
        if isinstance(node, str):
            if inside:
                parts.append(node)
            continue
        if leaving:
            close()
            continue
        region = id(node) in tops
        if not region and id(node) not in above and node.tag not in ("html", "body", "#root", "main"):
            if node.tag in DROPPED or node.names & NOISE or node.number in placed or (node.tag == "header" and not (inside and articles)):
                continue
            if node.number in constant and node.words and not (whole or (running and node.tag in INLINE)):
                continue
        inside, whole = inside or region, whole or (region and node.number in constant)
        running = bool(articles) and inside and any(isinstance(c, str) and not c.isspace() for c in node.children)
        if node.tag == "br":
            parts.append(" ")
        if node.tag not in INLINE:
            if inside:
                close()
            todo.append((node, inside, whole, running, True))
        todo.extend((c, inside, whole, running, False) for c in reversed(node.children))
    close()
    return "\n".join(blocks)


def page_host(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def induce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, seed, template, places``: one seed page a host, its constant nodes, and those whose id repeats.

    The seed is a page with markup and text of middling length, so that an
    empty page or an odd short one is not taken. All pages of a host are
    counted. Pages without a host have no template.
    """
    base = pages.select(page_host(F.col(url_col)).alias("host"), F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    base = base.filter("host <> ''")
    whole = base.filter(F.regexp_replace("page", "<[^>]*>", "").rlike("\\S") & F.col("page").contains("<"))
    middle = cut_lineage(whole.groupBy("host").agg(F.percentile_approx(F.length("page"), 0.5).alias("middle")))
    far = F.abs(F.length("page") - F.col("middle"))
    seeds = cut_lineage(whole.join(_sent(middle, "host"), "host").groupBy("host").agg(F.min_by("page", F.struct(far, "id", "page")).alias("seed")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for host, page, seed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                root = parse(page)
                number(root)
                plain = _plain(seed)
                for a, b in align(_seed(seed), root):
                    if a.words:
                        one = sums.setdefault((host, a.number), [0, 0, 0, PLAIN_PAGES if a.number in plain else TEMPLATE_PAGES])
                        one[0] += 1
                        one[1] += a.words == b.words
                        one[2] += bool(a.ids & b.ids & NOISE)
            if len(sums) > 100_000:
                yield _counts(sums)
                sums = {}
        if sums:
            yield _counts(sums)

    aligned = base.join(_sent(seeds), "host").select("host", "page", "seed").mapInArrow(count, "host string, node int, pages long, equal long, same long, least int")
    total = aligned.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("equal").alias("equal"), F.sum("same").alias("same"), F.max("least").alias("least"))
    constant = (F.col("equal") >= F.col("least")) & (F.col("equal") >= TEMPLATE_SHARE * F.col("pages"))
    named = (F.col("same") >= TEMPLATE_PAGES) & (F.col("same") >= TEMPLATE_SHARE * F.col("pages"))
    nodes = total.filter(constant | named).groupBy("host").agg(
        F.collect_list(F.when(constant, F.col("node"))).alias("template"), F.collect_list(F.when(named, F.col("node"))).alias("places")
    )
    return seeds.join(nodes, "host", "left")


def _counts(sums: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h for h, _ in sums], pa.string()), pa.array([n for _, n in sums], pa.int32()),
            pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64()),
            pa.array([v[2] for v in sums.values()], pa.int64()), pa.array([v[3] for v in sums.values()], pa.int32()),
        ],
        names=["host", "node", "pages", "equal", "same", "least"],
    )


def _sent(seeds: DataFrame, text: str = "seed") -> DataFrame:
    """Broadcast the seeds, or what else there is a host, if their counted bytes allow it."""
    size = seeds.agg(F.coalesce(F.sum(F.octet_length(text) + 100), F.lit(0))).first()[0]
    return F.broadcast(seeds) if size <= SEND_BYTES else seeds


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page.

    Null and empty pages give an empty text; pages without a usable address
    are read without a template; repeated pages stay rows of their own; an
    empty table gives an empty result; other columns are not read.
    """
    wrappers = cut_lineage(induce(pages, id_col, url_col, html_col))
    id_type, url_type = (pages.schema[c].dataType for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page, seed, frozenset(template or ()), frozenset(places or ()))
                for page, seed, template, places in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"]
            )

    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("page"), page_host(F.col(url_col)).alias("host")
    )
    joined = base.join(_sent(wrappers), "host", "left").select("id", "url", "page", "seed", "template", "places")
    schema = f"`{id_col}` {id_type.simpleString()}, `{url_col}` {url_type.simpleString()}, text string, n_chars long"
    return joined.mapInArrow(run, schema)
