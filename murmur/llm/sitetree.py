"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged: elements with the same path of tags and
classes are one style node. Over the pages that have a node, two importances are
measured, both by entropy with base m, the number of those pages:

* presentation: the entropy of its variants of child elements (the same
  everywhere: 0, different on every page: 1);
* content: 1 less the mean entropy of its texts over pages (a text on every page
  counts 0, one on a single page counts 1).

A branch's importance is the mean over the text-bearing nodes in it, weighted by
their occurrences, and shrunk towards a prior by tag and class, which decides on
hosts with few pages. Branches under ``LIMIT`` are removed from every page of the
host, but for running text (paragraphs, headings) of an article. Elements that
are furniture by tag, role or class are removed whatever their host shows. If a
page has an article or main element with text, only what is inside is its text.

Only hashes are shuffled, never page text. The removed branches of a host are
joined to its pages: broadcast if there are at most ``BROADCAST_ROWS`` in all (a
row is some 100 bytes), else by a shuffle join.

An element's class decides by whole words, so a class such as ``has-sidebar`` marks
nothing, an article's own header or footer block stays, and an article that is a
comment goes.

Null or empty html has empty text. Repeated rows get equal rows. A null or odd
url is the host "". Character references are decoded, white space within a block
is one space, blocks are joined by one line feed in page order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import batch, small_batches
from murmur.session import materialise

LIMIT = 0.3
#: Pages that the prior by tag and class weighs as much as.
PRIOR_PAGES = 8
CONTENT_SHARE = 0.75
BROADCAST_ROWS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul title option".split()
)
#: Elements that are never main text.
FURNITURE = frozenset(
    "head script style noscript template nav footer aside form iframe svg math button select option "
    "textarea input object canvas audio video dialog menu title".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Words of class and id names that mark furniture.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice pagination popup promo promoted recommended related replies reply respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Those that mark an article which is a reader's, and those that an article's own head and foot bear.
REPLIES = frozenset("comment comments replies reply respond".split())
LEADS = frozenset("header footer".split())
STATE = re.compile("(?:has|no|with|without|is|hide|show)[-_]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = HEADINGS | frozenset("p blockquote pre b i em strong a span u s small sub sup mark code q cite abbr time".split())
#: What closes an open element of the same group when it starts.
CLOSES = {
    "p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "option", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}
STOPS = frozenset("article body div section main table ul ol dl td th blockquote html".split())
_WORDS = re.compile("[a-z]+")
_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@\s]*@)?([^/?#:\s]+)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Shape:
    """What elements with the same path and role have in common."""

    __slots__ = ("tag", "path", "prior", "furniture", "inside", "kept_as_text", "block")

    def __init__(self, tag: str, names: str, above: Shape | None, role: str | None):
        self.tag = tag
        self.path = xxhash.xxh64_intdigest(
            f"{above.path if above else 0}/{tag}.{names}".encode()
        ) - (1 << 63)
        in_article = bool(above and above.inside)
        # classes that say what a page has or lacks name no part of it
        words = {w for token in names.split() if not STATE.match(token) for w in _WORDS.findall(token)}
        if in_article:
            words -= LEADS
        marked = not words.isdisjoint(REPLIES if tag == "article" else MARKS) and tag not in ("html", "body", "main")
        self.furniture = bool(above and above.furniture) or tag in FURNITURE or (
            tag == "header" and not in_article
        ) or role in ROLES or marked
        self.inside = not self.furniture and (in_article or tag in ("article", "main") or role in ("main", "article"))
        self.prior = 0.0 if self.furniture else 1.0 if self.inside or tag in RUNNING else 0.5
        self.kept_as_text = self.inside and tag in RUNNING | {"article", "main"}
        self.block = tag in BLOCKS


#: Shapes a worker has met; sites repeat theirs on every page.
_shapes: dict[tuple, Shape] = {}
SHAPES = 50_000


def shape_of(tag: str, names: str, above: Shape | None, role: str | None) -> Shape:
    key = (tag, names, above, role)
    found = _shapes.get(key)
    if found is None:
        if len(_shapes) >= SHAPES:
            _shapes.clear()
        found = _shapes[key] = Shape(tag, names, above, role)
    return found


class Node:
    """An element of a page."""

    __slots__ = ("shape", "above", "children", "dropped")

    def __init__(self, shape: Shape, above: Node | None):
        self.shape, self.above = shape, above
        self.children: list[str] = []
        self.dropped = shape.furniture or (above is not None and above.dropped)

    tag = property(lambda self: self.shape.tag)
    path = property(lambda self: self.shape.path)
    prior = property(lambda self: self.shape.prior)
    inside = property(lambda self: self.shape.inside)


class Reader(HTMLParser):
    """Blocks of one page: (node, text). ``drop`` holds the paths removed on its host."""

    def __init__(self, drop: frozenset = frozenset()):
        super().__init__(convert_charrefs=True)
        self.drop = drop
        self.stack: list[Node] = []
        self.blocks: list[tuple[Node, str]] = []
        self.parts: list[str] = []
        self.owner: Node | None = None

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and self.owner is not None:
                self.blocks.append((self.owner, text))
            self.parts = []
        self.owner = None

    def _pop_to(self, index: int) -> None:
        if any(n.shape.block for n in self.stack[index:]):
            self.flush()
        del self.stack[index:]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
            return
        if tag in ENDS_PARAGRAPH or tag in CLOSES:
            closing = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_PARAGRAPH else frozenset())
            for i in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[i].shape.tag
                if open_tag in closing:
                    self._pop_to(i)
                    break
                if open_tag in STOPS:
                    break
        names, role = "", None
        if attrs:
            values = {k: v or "" for k, v in attrs if k in ("class", "id", "role")}
            if values:
                names = re.sub(r"\d+", "", f"{values.get('class', '')} {values.get('id', '')}").lower()
                names = " ".join(sorted(names.split()))
                role = values.get("role", "").lower() or None
        above = self.stack[-1] if self.stack else None
        shape = shape_of(tag, names, above.shape if above else None, role)
        node = Node(shape, above)
        if shape.path in self.drop and not shape.kept_as_text:
            node.dropped = True
        if shape.block:
            self.flush()
        if above is not None:
            above.children.append(tag)
        self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].shape.tag == tag:
                self._pop_to(i)
                return
        if tag == "p":
            self.flush()

    def handle_data(self, data):
        if not self.stack or self.stack[-1].shape.tag in ("script", "style"):
            if self.stack or not data.strip():
                return
        node = self.stack[-1] if self.stack else Node(shape_of("body", "", None, None), None)
        if self.owner is None or self.owner.dropped != node.dropped or self.owner.inside != node.inside:
            self.flush()
            self.owner = node
        self.parts.append(data)


def read(html: str | None, drop: frozenset = frozenset()) -> Reader:
    reader = Reader(drop)
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader


def main_text(html: str | None, drop: frozenset = frozenset()) -> str:
    blocks = [(n, t) for n, t in read(html, drop).blocks if not n.dropped]
    inside = [t for n, t in blocks if n.inside]
    return "\n".join(inside or [t for _, t in blocks])


NODES_DDL = "host string, path long, kind int, value long, pages long, prior double, above array<long>"
NODES = pa.schema(
    [("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()),
     ("pages", pa.int64()), ("prior", pa.float64()), ("above", pa.list_(pa.int64()))]
)
#: Kinds of rows: a page has the node; a variant of its children; a text in it.
HAS, CHILDREN, TEXT = 0, 1, 2


def _observed(html: str | None) -> Iterator[tuple[Node, int, int]]:
    reader = read(html)
    texts: dict[int, list] = {}
    for node, text in reader.blocks:
        texts.setdefault(id(node), [node]).append(text)
    seen = set()
    for found in texts.values():
        node = found[0]
        if node.path in seen:
            pass
        else:
            seen.add(node.path)
            yield node, HAS, 0
            yield node, CHILDREN, xxhash.xxh64_intdigest(" ".join(node.children).encode()) - (1 << 63)
        for text in found[1:]:
            yield node, TEXT, xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def observations(pages: DataFrame) -> DataFrame:
    """Counts of (host, path, kind, value) over pages; ``above`` lists the node and its ancestors."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            counts: Counter = Counter()
            about: dict[tuple, tuple] = {}
            for url, html in zip(rows.column("url").to_pylist(), rows.column("html").to_pylist(), strict=True):
                host = host_of(url)
                page = set()
                for node, kind, value in _observed(html):
                    page.add((host, node.path, kind, value))
                    if kind == HAS and (host, node.path) not in about:
                        above, at = [], node
                        while at is not None:
                            above.append(at.path)
                            at = at.above
                        about[host, node.path] = (node.prior, above)
                counts.update(page)
            keys = list(counts)
            yield batch(
                NODES,
                {"host": [k[0] for k in keys], "path": [k[1] for k in keys], "kind": [k[2] for k in keys],
                 "value": [k[3] for k in keys], "pages": list(counts.values()),
                 # what a path is like travels with one row of it
                 "prior": [about[k[:2]][0] if k[2] == HAS else None for k in keys],
                 "above": [about[k[:2]][1] if k[2] == HAS else None for k in keys]},
            )

    return pages.select(
        F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).mapInArrow(run, NODES_DDL)


def importance(observed: DataFrame) -> DataFrame:
    """(host, path, importance) of every branch that holds text."""
    values = observed.groupBy("host", "path", "kind", "value").agg(
        F.sum("pages").alias("pages"), F.max("prior").alias("prior"), F.max("above").alias("above")
    )
    n = F.col("pages").cast("double")
    of = lambda kind, column: F.sum(F.when(F.col("kind") == kind, column))
    # with m pages: -sum(p log p) / log m from sums of n log n
    nodes = values.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == HAS, n)).alias("m"),
        F.max("prior").alias("prior"),
        F.max("above").alias("above"),
        of(CHILDREN, n).alias("variants"),
        of(CHILDREN, n * F.log(n)).alias("variants_log"),
        of(TEXT, n).alias("texts"),
        of(TEXT, n * F.log(n)).alias("texts_log"),
    )
    log_m = F.log("m")
    presentation = F.when(F.col("m") > 1, (F.log("variants") - F.col("variants_log") / F.col("variants")) / log_m).otherwise(1.0)
    content = F.when(F.col("m") > 1, 1 - F.col("texts_log") / F.col("texts") / log_m).otherwise(1.0)
    scored = nodes.select(
        "host", "m", "texts", "prior", "above",
        (CONTENT_SHARE * content + (1 - CONTENT_SHARE) * presentation).alias("own"),
    )
    branches = scored.select(
        "host", "m", "texts", "prior", "own", F.explode("above").alias("path")
    ).groupBy("host", "path").agg(
        (F.sum(F.col("own") * F.col("texts")) / F.sum("texts")).alias("own"),
        F.max("m").alias("m"),
        F.max("prior").alias("prior"),
    )
    return branches.select(
        "host", "path",
        ((F.col("m") * F.col("own") + PRIOR_PAGES * F.col("prior")) / (F.col("m") + PRIOR_PAGES)).alias("importance"),
    )


TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, limit: float = LIMIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``."""
    small_batches(pages.sparkSession)
    low = materialise(importance(observations(pages)).where(F.col("importance") < limit).select("host", "path"), "tree-low")
    removed = low.groupBy("host").agg(F.collect_set("path").alias("drop"))
    if low.count() <= broadcast_rows:
        removed = F.broadcast(removed)
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).withColumn(
        # the same host as host_of
        "host",
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1)),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple, frozenset] = {}
        for rows in batches:
            texts = []
            for html, drop in zip(rows.column("html").to_pylist(), rows.column("drop").to_pylist(), strict=True):
                key = tuple(drop or ())
                if key not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[key] = frozenset(key)
                texts.append(main_text(html, sets[key]))
            yield batch(
                TEXTS,
                {"page_id": rows.column("page_id"), "url": rows.column("url"), "text": texts, "n_chars": [len(t) for t in texts]},
            )

    return own.join(removed, "host", "left").select("page_id", "url", "html", "drop").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
