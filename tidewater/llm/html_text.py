"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, salted_join, staged
from tidewater.llm.urls import host_path

#: HTML's elements that begin a block; those whose content is never text of the page; those set aside by
#: themselves; and the whole names that classes, ids and roles give to parts besides the main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td template tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video title textarea select button".split())
ASIDE = frozenset("head nav footer aside form menu dialog".split())
NAMES = re.compile(
    r"(?:(?:site|page|main|top|global|primary|secondary|left|right|sub|has)[-_]?)?(?:nav|navbar|navigation|menu|breadcrumbs?|masthead|footer|side-?bar)"
    r"|(?:site|page|global|top)[-_]?header|header|banner|contentinfo|complementary"
    r"|(?:ad|ads|adsense|advert|adverts|advertisement|sponsor|sponsored|promo)(?:[-_](?:box|banner|slot|unit|container|wrapper|block|top|bottom|\d+))*"
    r"|(?:cookies?|consent|gdpr)(?:[-_]?(?:notice|banner|bar|consent|popup))?|notices?|alert|popup|modal|overlay"
    r"|newsletter(?:[-_]\w+)?|subscribe|signup|login|search[-_]?(?:form|box|bar)|(?:social[-_]?)?shar(?:e|ing)(?:[-_]\w+)?|social(?:[-_](?:links|icons|media))?"
    r"|related[-_](?:posts|articles|stories|links|content)|recommended(?:[-_]\w+)?|widgets?|toolbar|pagination|pager|skip[-_]link"
    r"|(?:user|reader)?[-_]?comments?(?:[-_](?:list|section|area|thread|form|box))?|disqus(?:[-_]thread)?|respond|replies"
)
#: What an opening element closes, what lists it stays in, and elements that may hold the whole content.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol dl table menu".split())
HOLDS = frozenset("html body article main div section center td table tbody tr details".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

#: Bits that describe a node of a tree.
HIDDEN, ARTICLE, MAIN, TITLE, MANY, HOLDER = 1, 2, 4, 8, 16, 32
#: A block is template if it stands at one node on this share of a host's different pages, of which there are so many at least.
CONSTANT, LEAST_PAGES = 0.9, 3
#: Blocks of fewer words (table labels, list items) repeat in contents, too: they say too little to be called template.
LEAST_WORDS = 3

TREE = "paths array<long>, parents array<int>, kinds array<int>"
LEAVES = "at array<int>, hashes array<long>, sizes array<int>"


class Tree:
    """A page's block tree; siblings with one label are one node, so a node is named by the labels on its way from the root
    (``paths``, hashed). Nodes are numbered so that parents come before children. Texts are leaves: the node that each
    belongs to, its hash, how many of its characters are outside of links, and the block itself."""

    __slots__ = ("at", "blocks", "hashes", "kinds", "parents", "paths", "sizes")

    def __init__(self) -> None:
        self.paths, self.parents, self.kinds = [1], [-1], [HOLDER]
        self.at: list[int] = []
        self.hashes: list[int] = []
        self.sizes: list[int] = []
        self.blocks: list[str] = []


def parse(page: str | None) -> Tree:
    """The page's tree; inline elements only part the text. Unclosed and stray tags are mended as browsers do. Linear in the page's
    length: nothing behind the last ``>`` is looked at as a tag, and no step walks down the open elements but to close them."""
    tree, page, pos = Tree(), page or "", 0
    last = page.rfind(">") + 1
    known: dict[int, int] = {1: 0}
    open_ = [("html", 0, False)]  # (element, node, set aside by itself) from the root to here
    counts: Counter[str] = Counter()
    asides: list[int] = []  # places in open_ of those set aside by themselves
    named: set[tuple[int, int]] = set()  # (parent element's number, node) met: a second time the node stands for many
    words: list[str] = []
    serials, serial = [0], 0
    linked = links = 0

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                node = open_[-1][1]
                tree.at.append(node)
                tree.hashes.append(xxhash.xxh64_intdigest(text) >> 1)
                tree.sizes.append(0 if tree.kinds[node] & HIDDEN else max(0, len(text) - links))
                tree.blocks.append(text)
        links = 0

    def pop() -> None:
        name, _, aside = open_.pop()
        counts[name] -= 1
        if aside:
            asides.pop()
        serials.pop()

    for m in iter(lambda: TAG.search(page, pos, last) if pos < last else None, None):
        words.append(page[pos : m.start()])
        if linked:
            links += m.start() - pos
        pos = m.end()
        if pos == last and m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
            pos = len(page)  # a comment that doesn't end
        close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = (name or "").lower()
        if name in RAW:
            if not close and not rest.endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos, last)
                pos = end.end() if end else len(page)
            words.append(" ")
        elif name == "br":
            words.append(" ")
        elif name == "a":
            linked = 0 if close else 1
        elif name in BLOCKS:
            flush()
            linked = 0
            if close:
                if counts[name]:
                    while open_[-1][0] != name:
                        pop()
                    pop()
                continue
            if name in ("html", "body"):
                continue
            if counts["p"] and open_[-1][0] == "p":
                pop()
            ends = CLOSES.get(name, ())
            if any(counts[x] for x in ends):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] in LISTS:
                        break
                    if open_[k][0] in ends:
                        while len(open_) > k:
                            pop()
                        if not any(counts[x] for x in ends):
                            break
            if name in ("article", "main") and asides:  # an unclosed menu doesn't hold the article
                for _ in range(len(open_) - asides[0]):
                    pop()
            marks = " ".join(v for _, *vs in ATTRIBUTE.findall(rest) for v in vs if v).lower().split() if rest else []
            inside = any(counts[x] for x in ("article", "main"))
            aside = name in ASIDE or name == "header" and not inside or name not in ("article", "main") and any(map(NAMES.fullmatch, marks))
            up = open_[-1][1]
            label = f"{name} {re.sub('[0-9]+', '0', marks[0]) if marks else ''} {int(aside)}"
            path = xxhash.xxh64_intdigest(label, tree.paths[up]) >> 1
            node = known.get(path)
            if node is None:
                node = known[path] = len(tree.paths)
                tree.paths.append(path)
                tree.parents.append(up)
                kind = (HIDDEN if aside or tree.kinds[up] & HIDDEN else 0) | (ARTICLE if name == "article" else MAIN if name == "main" else TITLE if name == "h1" else 0)
                tree.kinds.append(kind | (HOLDER if name in HOLDS else 0))
            if (serials[-1], node) in named:
                tree.kinds[node] |= MANY
            named.add((serials[-1], node))
            if name != "hr":
                serial += 1
                if aside:
                    asides.append(len(open_))
                open_.append((name, node, aside))
                serials.append(serial)
                counts[name] += 1
    words.append(page[pos:].partition("<!--")[0])
    flush()
    for k in range(1, len(tree.kinds)):  # many parents, many nodes
        if tree.kinds[tree.parents[k]] & MANY:
            tree.kinds[k] |= MANY
    return tree


def _heaviest_rise(js: list[int], ws: list[int]) -> list[int]:
    """Positions of a subsequence with rising ``js`` and the largest sum of ``ws``."""
    if all(a < b for a, b in pairwise(js)):
        return list(range(len(js)))
    rank = {j: r + 1 for r, j in enumerate(sorted(js))}
    best: list[tuple[int, int]] = [(0, -1)] * (len(js) + 1)  # a Fenwick tree of (sum, last position)
    before, top = [-1] * len(js), (0, -1)
    for i, j in enumerate(js):
        r, found = rank[j] - 1, (0, -1)
        while r:
            found = max(found, best[r], key=lambda x: x[0])
            r -= r & -r
        before[i], mine = found[1], (found[0] + ws[i], i)
        top = max(top, mine, key=lambda x: x[0])
        r = rank[j]
        while r <= len(js):
            if best[r][0] < mine[0]:
                best[r] = mine
            r += r & -r
    out, i = [], top[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def match(paths: list[int], parents: list[int], ref: dict[int, int]) -> dict[int, int]:
    """Simple tree matching with a reference tree ``ref`` (path -> number): node numbers to those of the reference, a largest
    pairing that keeps the order of siblings and in which paired nodes have equal labels and paired parents.

    Labels of siblings differ, so a node has one possible partner, and the best pairing of two lists of children is
    their heaviest rising subsequence: n log n steps for any width."""
    to = [ref.get(p, -1) for p in paths]
    children: list[list[int]] = [[] for _ in paths]
    for k in range(1, len(paths)):
        if to[k] >= 0:
            children[parents[k]].append(k)
    weight = [1] * len(paths)
    for k in range(len(paths) - 1, -1, -1):
        own = children[k]
        if own and to[k] >= 0:
            if len(own) > 1:
                own = children[k] = [own[i] for i in _heaviest_rise([to[c] for c in own], [weight[c] for c in own])]
            weight[k] += sum(weight[c] for c in own)
    out, todo = {}, [0] if to[0] >= 0 else []
    while todo:
        k = todo.pop()
        out[k] = to[k]
        todo += children[k]
    return out


def content_nodes(parents: list[int], kinds: list[int], chars: list[int]) -> list[int]:
    """The nodes whose blocks are the main text, by how much text that varies (outside of links and of parts set aside)
    stands at each node: from the root on into the one container that holds over half of it, as long as there is one. An
    article (else a main element) around it is taken whole, or the one in it with half of the text; else the page's titles
    before it belong to it, too."""
    total, titled = list(chars), [bool(k & TITLE and chars[i]) for i, k in enumerate(kinds)]
    for k in range(len(parents) - 1, 0, -1):
        if not kinds[k] & HIDDEN:
            total[parents[k]] += total[k]
            titled[parents[k]] |= titled[k]
    children: list[list[int]] = [[] for _ in parents]
    for k in range(1, len(parents)):
        if not kinds[k] & HIDDEN:
            children[parents[k]].append(k)
    at, way = 0, [0]
    while children[at]:
        best = max(children[at], key=lambda c: total[c])
        if 2 * total[best] <= total[at] or kinds[best] & MANY or not kinds[best] & HOLDER:
            break
        at = best
        way.append(at)
    for kind in (ARTICLE, MAIN):
        held = [k for k in way if kinds[k] & kind]
        if held:
            return held[-1:]
    inside, todo = [], [at]
    while todo:
        k = todo.pop()
        todo += children[k]
        if kinds[k] & (ARTICLE | MAIN) and 2 * total[k] >= total[at]:
            inside.append(k)
    if inside:
        return [max(inside, key=lambda k: (bool(kinds[k] & ARTICLE), total[k], -k))]
    if titled[at]:
        return [at]
    return [*(c for up, down in pairwise(way) for c in children[up] if c < down and titled[c]), at]


def kept_blocks(tree, wanted: set[int], constants: set[int]) -> list[int]:
    """Numbers of the leaves below the ``wanted`` nodes, without parts set aside in them and without constant ones; all of them,
    if constants hold over half of the text: such a page is a copy of others, and nothing says which of it is template."""
    inside = [False] * len(tree.paths)
    for k, (up, kind) in enumerate(zip(tree.parents, tree.kinds)):
        inside[k] = (k in wanted or up >= 0 and inside[up]) and not kind & HIDDEN
    own = [i for i, k in enumerate(tree.at) if inside[k]]
    if constants:
        rest = [i for i in own if tree.hashes[i] ^ tree.paths[tree.at[i]] not in constants or tree.blocks[i].count(" ") < LEAST_WORDS - 1]
        if 2 * sum(len(tree.blocks[i]) for i in rest) >= sum(len(tree.blocks[i]) for i in own):
            return rest
    return own


def own_content(tree) -> set[int]:
    """Content nodes by the page's own text alone."""
    chars = [0] * len(tree.paths)
    for k, n in zip(tree.at, tree.sizes):
        chars[k] += n
    articles = [k for k, kind in enumerate(tree.kinds) if kind & (ARTICLE | MAIN) and not kind & HIDDEN]
    if articles:  # the one with the most text, the first of equal ones
        total = list(chars)
        for k in range(len(total) - 1, 0, -1):
            if not tree.kinds[k] & HIDDEN:
                total[tree.parents[k]] += total[k]
        best = max(articles, key=lambda k: (total[k], -k))
        if total[best]:
            return {best}
    return set(content_nodes(tree.parents, tree.kinds, chars))


def extract(tree, ref: list[int] | None = None, nodes: list[int] | None = None, constants: set[int] = frozenset()) -> str:
    """The main text of a page, with its host's wrapper if there is one and the page has its content nodes."""
    kept: list[int] = []
    if ref and nodes:
        goal = set(nodes)
        wanted = {own for own, other in match(tree.paths, tree.parents, {p: i for i, p in enumerate(ref)}).items() if other in goal}
        kept = kept_blocks(tree, wanted, constants)
    if not kept:
        kept = kept_blocks(tree, own_content(tree), frozenset())
    return "\n\n".join(tree.blocks[i] for i in kept)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    long, whole, text = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())
    names = ["__id", "__url", "__host", "digest", "shape", "paths", "parents", "kinds", "at", "hashes", "sizes", "blocks"]
    for b in batches:
        trees = [parse(p.as_py()) for p in b.column("__html")]
        digests, shapes = [], []
        for t in trees:
            digests.append(xxhash.xxh64_intdigest(np.array([*t.paths, *t.at, *t.hashes], "<i8").tobytes()) >> 1)
            held = sorted({t.paths[p] for p in t.parents[1:] if not t.kinds[p] & HIDDEN})
            shapes.append(xxhash.xxh64_intdigest(np.array(held, "<i8").tobytes()) >> 1)
        cols = [pa.array(digests, pa.int64()), pa.array(shapes, pa.int64())]
        cols += [pa.array([getattr(t, n) for t in trees], kind) for n, kind in (("paths", long), ("parents", whole), ("kinds", whole), ("at", whole), ("hashes", long), ("sizes", whole), ("blocks", text))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *cols], names)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host, node of its reference tree and block there: on how many pages it stands, and how long it is in all. Node -1
    counts the pages."""
    for b in batches:
        sums: dict[tuple[str, int, int], list[int]] = {}
        for r in b.to_pylist():
            to = match(r["paths"], r["parents"], {p: i for i, p in enumerate(r["ref"])})
            pages = {(r["__host"], -1, 0): 0}
            for k, h, n in zip(r["at"], r["hashes"], r["sizes"]):
                if k in to:
                    key = (r["__host"], to[k], h)
                    pages[key] = pages.get(key, 0) + n
            for key, n in pages.items():
                s = sums.setdefault(key, [0, 0])
                s[0] += 1
                s[1] += n
        if sums:
            host, node, block = zip(*sums)
            pages, chars = zip(*sums.values())
            yield pa.RecordBatch.from_pydict({"__host": host, "node": pa.array(node, pa.int32()), "block": pa.array(block, pa.int64()), "pages": pa.array(pages, pa.int64()), "chars": pa.array(chars, pa.int64())})


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            chars = [0] * len(r["ref"])
            for n in r["nodes"] or ():
                chars[n["node"]] = n["chars"]
            out.append(content_nodes(r["parents"], r["kinds"], chars) if any(chars) else [])
        yield pa.RecordBatch.from_arrays([b.column("__host"), b.column("ref"), pa.array(out, pa.list_(pa.int32())), b.column("constants")], ["__host", "ref", "nodes", "constants"])


def induce(trees: DataFrame) -> DataFrame:
    """Wrappers ``(__host, ref, nodes, constants)`` from pages' trees: the paths of the reference page, the numbers of its content
    nodes (none where the host's pages don't differ) and the constant blocks (hash XOR path of their node).

    The reference is a page of the host's most frequent shape, that of least digest. No page or block of a host is
    gathered: blocks are counted per batch before the shuffle. What is collected for a host is bounded by the
    reference page: its nodes, and the constant blocks, each of which most pages hold."""
    distinct = trees.select("__host", "digest", "shape", *(c.split()[0] for c in (TREE + ", " + LEAVES).split(", "))).dropDuplicates(["__host", "digest"])
    shapes = distinct.groupBy("__host", "shape").agg(F.count("*").alias("n"), F.min("digest").alias("digest"))
    best = shapes.groupBy("__host").agg(F.max_by("digest", F.struct("n", "shape")).alias("digest"))
    refs = distinct.join(best, ["__host", "digest"], "left_semi").select("__host", F.col("paths").alias("ref"), "parents", "kinds")
    refs = staged(refs)
    pairs = salted_join(distinct.drop("shape", "kinds"), refs.select("__host", "ref"), "__host", F.col("digest"), "inner", 8 * F.size("ref"))
    sums = arrow_map(pairs, _aligned, "__host string, node int, block long, pages long, chars long")
    sums = staged(sums.groupBy("__host", "node", "block").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars")))
    n = staged(sums.where("node = -1").select("__host", F.col("pages").alias("n")))
    same = (F.col("n") >= LEAST_PAGES) & (F.col("pages") >= CONSTANT * F.col("n"))
    marked = salted_join(sums.where("node >= 0"), n, "__host", F.struct("node", "block")).withColumn("same", same)
    nodes = marked.groupBy("__host", "node").agg(F.sum(F.when(F.col("same"), 0).otherwise(F.col("chars"))).alias("chars"))
    nodes = nodes.groupBy("__host").agg(F.collect_list(F.struct("node", "chars")).alias("nodes"))
    constant = marked.where("same").join(refs.select("__host", F.posexplode("ref").alias("node", "path")), ["__host", "node"])
    constant = constant.groupBy("__host").agg(F.collect_list(F.col("block").bitwiseXOR(F.col("path"))).alias("constants"))
    out = refs.join(nodes, "__host", "left").join(constant, "__host", "left")
    return staged(arrow_map(out, _chosen, "__host string, ref array<long>, nodes array<int>, constants array<long>"))


class _Row:
    """One page's tree as it was staged."""

    def __init__(self, r: dict) -> None:
        self.__dict__.update(r)


def _extracted(id_col: str, url_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [extract(_Row(r), r["ref"], r["nodes"], set(r["constants"] or ())) for r in b.drop_columns(["__id", "__url"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every page.

    Per host the block trees of the different pages are aligned with that of a reference page by simple tree matching. Blocks
    of LEAST_WORDS words that are the same at their node on CONSTANT of at least LEAST_PAGES pages are template and go, wherever they stand;
    nodes whose text varies are slots. The content is the container into which most of the varying text leads (see
    content_nodes()); links and parts that their element, or the whole name of a class, id or role, sets aside (menu, header,
    footer, sidebar, notice, advert, form, comments) count for nothing there and are left out within it.
    A host of one page, or of equal ones, shows no slots: there, and where a page has no such node, its largest article
    or main element is taken (the first of equal ones), else the same search over its own text. Several articles that
    are siblings with one label are all text. A tree may be of any width and depth; nothing is cut.
    Null or empty html gives an empty text; a URL without host counts as the host ''; repeated pages give
    repeated rows; other columns of the input are ignored. Hosts with many pages are joined in salted parts."""
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    base = base.withColumn("__host", host_path(F.col("__url"))[0]).select("__id", "__url", "__host", "__html")
    kind = base.schema["__id"].dataType.simpleString()
    trees = staged(arrow_map(base, _parsed, f"__id {kind}, __url string, __host string, digest long, shape long, {TREE}, {LEAVES}, blocks array<string>"))
    weight = 8 * (F.size("ref") + F.coalesce(F.size("nodes"), F.lit(0)) + F.coalesce(F.size("constants"), F.lit(0)))
    joined = salted_join(trees, induce(trees), "__host", F.struct("__id", "__url", "digest"), "left", weight)
    joined = joined.select("__id", "__url", "paths", "parents", "kinds", "at", "hashes", "sizes", "blocks", "ref", "nodes", "constants")
    return arrow_map(joined, _extracted(id_col, url_col), f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
