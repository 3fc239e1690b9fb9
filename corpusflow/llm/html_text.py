"""Main text of web pages by site style trees.

Pages of one host are merged into a tree of element paths, each child at its place among the siblings of its
label, counted from the first and from the last.  For each path two distributions over the
host's pages are counted: the presentations (sequences of child elements) and the contents (text of the
branch).  Entropies to the base of the number of pages make their importance: 0 where all pages agree,
1 where all differ.  A branch's importance weighs both, ``(1 - g^l) * presentation + g^l * content`` with
l presentations.  Branches of low importance on enough pages are removed from each page of that host.
What an element declares to be (menu, form, advert, notice, comment, ...) counts as importance 0 on any
page, since its words may differ on every page; where a page marks its article, the rest of the page does too.
Inside a marked article a low branch goes where it holds the host's usual content of that branch, which stands on
enough pages; the article itself and what leads to it stay.  Pages of a host with the same text count once in its tree.

Counts are combined map-side per (host, path, value), so a hot host is spread over its values.  Low-importance
paths meet the paths that each page may lose, salted, and make a list per page; only pages with a list are read again.

Defined results
  NULL and empty pages, and pages without text, give the empty text.  NULL URLs share the empty host.
  Unclosed, misplaced and cut tags are repaired as browsers do in the common cases; very long pages are read whole.
  Repeated rows and copies count in the tree once and are extracted alike.  A page of low branches only keeps them.
"""
from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, maybe_listed, slices, stored, take_worker
from .url_filter import host

#: Weight of content in a branch with one presentation.
GAMMA = 0.9
#: Importance below which a branch is removed, and pages it needs, however large the host.
LEAST, PAGES = 0.1, 8
SALTS = 64

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul
    caption option""".split())
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
         "option": ("select", "datalist"), "tbody": ("table",), "tfoot": ("table",), "p": ("td", "th", "table", "button", "caption", "html")}

#: What elements declare themselves to be: tags, roles and words of class and id.
NOISE_TAGS = frozenset("""nav aside footer form script style noscript iframe template head title svg canvas object button select textarea
    input dialog menu audio video map datalist fieldset search""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar
    navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay
    newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply related
    recommended widget pagination pager toolbar skip copyright form search""".split())
ARTICLE_WORDS = frozenset("article post entry story content main body text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
CUT = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "label", "noise", "children", "parent")

    def __init__(self, tag: str, attributes: str, parent: "Node | None"):
        self.tag, self.parent, self.children = tag, parent, []
        self.noise = tag in NOISE_TAGS
        self.label = tag
        if attributes and not attributes.isspace():
            found = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes)}
            names = html.unescape(f"{found.get('class', '')} {found.get('id', '')}")
            words = sorted({w.lower() for w in WORD.findall(names)})
            if words:
                self.label = tag + "." + ".".join(words)
            self.noise = (self.noise or "hidden" in found or found.get("aria-hidden") == "true"
                          or found.get("role", "").lower() in NOISE_ROLES or _declares_noise(words, tag))


def _declares_noise(words: list[str], tag: str) -> bool:
    bad = NOISE_WORDS.intersection(words)
    if tag in ("html", "body", "article", "main") or not bad:
        return False
    # "article-header", "post-body" and the like name parts of the article
    return not (bad <= {"header", "banner", "text"} and ARTICLE_WORDS.intersection(words))


def parse(page: str | None) -> Node:
    """Tree of elements; children are nodes and strings (references decoded)."""
    root = top = Node("#", "", None)
    page = page or ""
    at = 0
    while True:
        found = TOKEN.search(page, at)
        # a tag that the end of the page cuts off is dropped
        text = page[at:found.start()] if found else CUT.sub("", page[at:])
        if text:
            top.children.append(html.unescape(text))
        if not found:
            return root
        at = found.end()
        closing, tag = found.group(1), found.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            top = _close(top, tag)
            continue
        top = _open(top, tag)
        node = Node(tag, found.group(3), top)
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(page[at:end.start()] if end else page[at:])
            at = end.end() if end else len(page)
        elif tag not in VOID and not found.group(3).endswith("/"):
            top = node


def _open(top: Node, tag: str) -> Node:
    if tag in ENDS_P:
        top = _up(top, ("p",), SCOPE["p"])
    if tag in CLOSES:
        top = _up(top, CLOSES[tag], SCOPE[tag])
    return top


def _up(top: Node, tags: tuple, stops: tuple) -> Node:
    """Close the outermost open element of ``tags`` inside the nearest of ``stops``."""
    node, out = top, top
    while node.parent is not None and node.tag not in stops:
        if node.tag in tags:
            out = node.parent
        node = node.parent
    return out


def _close(top: Node, tag: str) -> Node:
    node = top
    while node.parent is not None and node.tag != tag:
        node = node.parent
    return node.parent if node.parent is not None else top


def _hash(*parts) -> int:
    import xxhash
    value = xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def placed(node: Node, path: int):
    """Child elements with their two paths: the parent's path, the label, and the place among the siblings of that
    label, from the first and from the last; the second is None for an only one.  What is below hangs on the first."""
    children = [c for c in node.children if isinstance(c, Node)]
    left = Counter(c.label for c in children)
    alone = {label for label, n in left.items() if n == 1}
    seen: Counter = Counter()
    for c in children:
        yield c, _hash(path, c.label, seen[c.label]), None if c.label in alone else _hash(path, c.label, -left[c.label])
        seen[c.label] += 1
        left[c.label] -= 1


def paths(root: Node) -> dict[int, tuple[int, int]]:
    """Path -> (presentation, content) of a page, all as hashes.

    Contents are hashes over the children's contents, so a deeply nested page costs no more than a flat one.
    """
    order: list[tuple[Node, int, int | None]] = []
    stack: list[tuple[Node, int, int | None]] = [(root, 0, None)]
    while stack:
        node, path, last = stack.pop()
        order.append((node, path, last))
        stack += placed(node, path)
    content: dict[int, int] = {}
    out: dict[int, tuple[int, int]] = {}
    for node, path, last in reversed(order):
        shape: list[str] = []
        words: list = []
        for c in node.children:
            if isinstance(c, Node):
                label = c.label
                if c.tag not in RAW:
                    words.append(content[id(c)])
            else:
                plain = " ".join(c.split())
                label = "#" if plain else ""
                words += [plain] if plain else []
            if label and (not shape or shape[-1] != label):
                shape.append(label)
        content[id(node)] = _hash(*words)
        for p in (path, last):
            if p:
                out[p] = (_hash(" ".join(shape)), content[id(node)])
    return out


def articles(root: Node) -> list[Node]:
    """Outermost elements that mark the page's article."""
    marked = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.noise:
            continue
        is_article = node.tag in ("article", "main")
        if is_article and not inside:
            marked.append(node)
        stack += [(c, inside or is_article) for c in reversed(node.children) if isinstance(c, Node)]
    return [n for n in marked if n.tag == "article"] if not any(n.tag == "main" for n in marked) else marked


def located(root: Node, wanted: list[Node]) -> list[tuple[Node, int, int | None]]:
    """The nodes with their paths in the page."""
    left, found = {id(n) for n in wanted}, {}
    stack: list[tuple[Node, int, int | None]] = [(root, 0, None)]
    while stack and left:
        node, path, last = stack.pop()
        if id(node) in left:
            found[id(node)] = (node, path, last)
            left.discard(id(node))
        stack += placed(node, path)
    return [found[id(n)] for n in wanted]


def main_text(root: Node, low: frozenset[int] = frozenset()) -> str:
    """Blocks of the page's article, or of a page that marks none, left when noise and the paths in ``low`` are removed.

    A page that ``low`` would empty keeps its blocks.
    """
    starts = articles(root) or [root]
    return (_blocks(located(root, starts), low) if low else "") or _blocks([(n, 0, None) for n in starts])


def _blocks(starts: list[tuple[Node, int, int | None]], low: frozenset[int] = frozenset()) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        words = " ".join("".join(held).split())
        if words:
            blocks.append(words)
        held.clear()

    for start, at_path, at_last in starts:
        within = start.tag in ("article", "main")
        todo: list = [(start, at_path, at_last)]
        while todo:
            item, path, last = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                held.append(item)
            elif item.noise or (item.tag == "header" and not within) or (item is not start and (path in low or last in low)):
                if item.tag in BLOCK:
                    flush()
            elif item.tag == "br":
                held.append(" ")
            else:
                if item.tag in BLOCK:
                    flush()
                    todo.append((None, 0, None))
                at = placed(item, path) if low else None
                todo += [(c, 0, None) if isinstance(c, str) or at is None else next(at) for c in item.children][::-1]
        flush()
    return "\n\n".join(blocks)


def removable(root: Node, starts: list[Node]) -> set[int]:
    """Paths below the marked articles."""
    out, stack = set(), [(n, p) for n, p, _ in located(root, starts)]
    while stack:
        node, path = stack.pop()
        for child, first, last in placed(node, path):
            out.update(x for x in (first, last) if x)
            stack.append((child, first))
    return out


FEATURES = """host string, page_id long, url string, key long, marked boolean, text string, twin long, tree long,
    paths array<struct<path:long,shape:long,content:long,own:boolean>>"""


def _features(batches):
    take_worker("style tree")
    kind = pa.list_(pa.struct([*[(n, pa.int64()) for n in ("path", "shape", "content")], ("own", pa.bool_())]))
    schema = pa.schema([("host", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("key", pa.int64()), ("marked", pa.bool_()),
                        ("text", pa.string()), ("twin", pa.int64()), ("tree", pa.int64()), ("paths", kind)])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        for start, stop in slices(batch.column("html")):
            marked, texts, twins, trees, ends = [], [], [], [], [0]
            values: tuple[list, ...] = ([], [], [], [])
            for page in batch.column("html").slice(start, stop - start).to_pylist():
                root = parse(page)
                starts = articles(root)
                own = removable(root, starts) if starts else None
                found = sorted((p, s, t) for p, (s, t) in paths(root).items())
                marked.append(bool(starts))
                texts.append(main_text(root))
                twins.append(_hash(texts[-1]))
                trees.append(_hash(*found))
                for p, s, t in found:
                    for column, value in zip(values, (p, s, t, own is None or p in own)):
                        column.append(value)
                ends.append(len(values[0]))
            items = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(values, types)], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(n).slice(start, stop - start) for n in ("host", "page_id", "url", "key")),
                pa.array(marked, pa.bool_()), pa.array(texts, pa.string()), pa.array(twins, pa.int64()), pa.array(trees, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=kind)], schema=schema)


def features(pages: DataFrame) -> DataFrame:
    """Per page (host, page_id, url, key, html): whether it marks an article, the ``text`` it has without a style tree and
    its hash (``twin``), a hash of its tree, and its paths; ``own`` are the paths that the page may lose."""
    return pages.select("host", "page_id", "url", "key", "html").mapInArrow(_features, FEATURES)


def once(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One page for each text of a host; where copies differ in their trees, the smallest hash decides.

    ``rows`` have a number, ``row``.  Only numbers move to find the copies; paths move only for rows that hit a filter of them.
    """
    keys = rows.select("host", "twin", "tree", "row")
    first = keys.groupBy("host", "twin").agg(F.min(F.struct("tree", "row")).alias("b")).select("host", "twin", F.col("b.row").alias("kept"))
    copies = scratch.keep(keys.join(first, ["host", "twin"]).filter(F.col("row") != F.col("kept")).select("row"), "copies")
    flagged = maybe_listed(rows.select("row", "host", "paths"), copies, ["row"], "maybe")
    own = flagged.filter("maybe").drop("maybe").join(copies, "row", "left_anti")
    return flagged.filter(~F.col("maybe")).drop("maybe").unionByName(own).select("host", "paths")


def low_of(rows: DataFrame, least: float = LEAST, least_pages: int = PAGES) -> DataFrame:
    """``host, path`` of low importance from ``features``, each row counted, with the most frequent content, ``usual``,
    NULL where that stands on fewer than ``least_pages``."""
    # a branch is one number from here on: host and path come back for the few that are low
    rows = rows.select("host", F.explode("paths").alias("p")).select(F.xxhash64("host", "p.path").alias("branch"), "host", "p.path", "p.shape", "p.content")
    values = rows.select("branch", F.explode(F.array(
        F.struct(F.lit(0).cast("byte").alias("kind"), F.col("shape").alias("value")),
        F.struct(F.lit(1).cast("byte").alias("kind"), F.col("content").alias("value")))).alias("v"))
    counts = values.groupBy("branch", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("c"))
    # sum c*log c gives the entropy of a path without its distribution: log n - sum / n
    sums = counts.groupBy("branch").pivot("kind", [0, 1]).agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "value")).alias("top"))
    share = lambda k: F.when(F.col(f"{k}_n") > 1, 1 - F.col(f"{k}_s") / (F.col(f"{k}_n") * F.log(f"{k}_n"))).otherwise(1.0)
    weight = F.pow(F.lit(GAMMA), F.col("0_k"))
    usual = F.when(F.col("1_top.c") >= least_pages, F.col("1_top.value"))
    trees = sums.select("branch", F.col("0_n").alias("n"), usual.alias("usual"), (F.lit(GAMMA) * share(1)).alias("content"), ((1 - weight) * share(0) + weight * share(1)).alias("importance"))
    # contents that differ are kept however alike and however many their presentations are
    low = trees.filter((F.col("n") >= least_pages) & (F.col("importance") < least) & (F.col("content") < least)).select("branch", "usual")
    low = stored(low, "low-branches")
    named = maybe_listed(rows.select("branch", "host", "path"), low, ["branch"], "maybe").filter("maybe").select("branch", "host", "path").distinct()
    return named.join(low, "branch").select("host", "path", "usual")


def low_paths(pages: DataFrame, least: float = LEAST, least_pages: int = PAGES) -> DataFrame:
    """``host, low``: paths (hashes) of low importance as one list per host, for small ``pages`` (host, html), each row counted."""
    rows = pages.select("host", F.lit(0).cast("long").alias("page_id"), F.lit("").alias("url"), F.lit(0).cast("long").alias("key"), "html")
    return low_of(features(rows), least, least_pages).groupBy("host").agg(F.collect_list("path").alias("low"))


RESULT = "page_id long, url string, text string, n_chars long"


def _texts(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                       pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _cleared(batches):
    """Texts of pages with a list of low paths."""
    take_worker("style tree")
    for whole in batches:
        for start, stop in slices(whole.column("html")):
            batch = whole.slice(start, stop - start)
            pages, low = batch.column("html").to_pylist(), batch.column("low").to_pylist()
            yield _texts(batch, [main_text(parse(p), frozenset(x or ())) for p, x in zip(pages, low)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"), host(F.col(url_col).cast("string")).alias("host"))
    # equal keys mean equal pages, whose lists are equal
    rows = rows.withColumn("key", F.xxhash64("page_id", "html"))
    scratch = Scratch(pages.sparkSession, "site-style")
    found = scratch.keep(features(rows).withColumn("row", F.monotonically_increasing_id()), "features", "zstd")
    low = scratch.keep(low_of(once(found, scratch)), "branches")
    # of all paths only those that hit a filter of the low ones move
    own = found.select("host", "page_id", "key", "marked", F.explode(F.filter("paths", lambda p: p["own"])).alias("p")).select(
        "host", "page_id", "key", "marked", "p.path", "p.content")
    usual = low.filter(F.col("usual").isNotNull()).select("host", "path", F.col("usual").alias("content"))
    inside = maybe_listed(own.filter("marked"), usual, ["host", "path", "content"], "maybe").filter("maybe")
    free = maybe_listed(own.filter(~F.col("marked")), low, ["host", "path"], "maybe").filter("maybe")
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of_pages = inside.unionByName(free).drop("maybe").withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    lists = scratch.keep(of_pages.join(salted, ["host", "path", "salt"]).filter(~F.col("marked") | (F.col("content") == F.col("usual")))
                         .groupBy(F.col("host").alias("h"), F.col("page_id").alias("id"), F.col("key").alias("k")).agg(F.collect_set("path").alias("low")), "low")
    keys = lists.select(F.col("h").alias("host"), F.col("id").alias("page_id"), F.col("k").alias("key"))
    on = (F.col("host") == F.col("h")) & F.col("page_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))
    names = ["host", "page_id", "key"]
    texts = maybe_listed(found.select(*names, "url", "text"), keys, names, "maybe")
    kept = texts.filter(~F.col("maybe")).drop("maybe").unionByName(texts.filter("maybe").drop("maybe").join(lists, on, "left_anti"))
    again = maybe_listed(rows, keys, names, "maybe").filter("maybe").join(lists, on)
    cleared = again.select("page_id", "url", "html", "low").mapInArrow(_cleared, RESULT)
    out = stored(kept.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")).unionByName(cleared), "main-texts")
    scratch.close()
    return out
