"""Readers for captured documents: markup in Python workers, JSON natively."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import jsontext, text
from murmur.sources.archives import framed

#: The tag a normalised document carries. Pass the tag your own documents were written with.
POSTS_TAG = "posts.v1"
#: Marker attributes are ``data-<prefix>-item`` and so on.
MARKER_PREFIX = "post"

# HTML elements that have no end tag.
VOID_ELEMENTS = frozenset(
    ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
     "source", "track", "wbr"]
)
# Class names of the public channel preview page.
MESSAGE_CLASS = "tgme_widget_message"
TEXT_CLASS = "tgme_widget_message_text"
OWNER_CLASS = "tgme_widget_message_owner_name"

ROW_FIELDS = ["external_id", "author", "display_name", "text", "posted_at_raw"]


class _ElementStack(HTMLParser):
    """Keeps the open elements with a role each; subclasses give roles and take text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.rows: list[dict[str, str]] = []
        self.item: dict[str, str] | None = None

    def role_of(self, tag: str, attrs: dict[str, str]) -> str:
        raise NotImplementedError

    def has(self, role: str) -> bool:
        return any(r == role for _, r in self.open)

    def handle_starttag(self, tag, attrs):
        role = self.role_of(tag, {k: v or "" for k, v in attrs})
        if tag not in VOID_ELEMENTS:
            self.open.append((tag, role))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_ELEMENTS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, role = self.open.pop()
            if role == "item" and self.item is not None:
                self.rows.append(self.item)
                self.item = None
            if name == tag:
                break


class MarkerReader(_ElementStack):
    """Items are elements that carry the marker attributes; all text inside is theirs."""

    def __init__(self, prefix: str = MARKER_PREFIX) -> None:
        super().__init__()
        self.names = {
            "external_id": f"data-{prefix}-item",
            "author": f"data-{prefix}-author",
            "display_name": f"data-{prefix}-display-name",
            "posted_at_raw": f"data-{prefix}-posted-at",
        }

    def role_of(self, tag, attrs):
        if self.names["external_id"] not in attrs:
            return ""
        # An item that starts inside another takes its place.
        self.open = [(t, "") for t, _ in self.open]
        self.item = {field: attrs.get(name, "") for field, name in self.names.items()}
        self.item["text"] = ""
        return "item"

    def handle_data(self, data):
        if self.item is not None:
            self.item["text"] += data


class ChannelReader(_ElementStack):
    """Messages of a public channel page. The handle is the id before the slash."""

    def role_of(self, tag, attrs):
        classes = attrs.get("class", "").split()
        role = ""
        if self.item is None:
            if MESSAGE_CLASS in classes and "data-post" in attrs:
                post = attrs["data-post"]
                self.item = dict.fromkeys(ROW_FIELDS, "")
                self.item["external_id"], self.item["author"] = post, post.split("/")[0]
                role = "item"
        elif TEXT_CLASS in classes:
            role = "text"
        elif OWNER_CLASS in classes:
            role = "owner"
        if self.item is not None and tag == "time" and not self.item["posted_at_raw"]:
            self.item["posted_at_raw"] = attrs.get("datetime", "")
        return role

    def handle_data(self, data):
        if self.item is None:
            return
        if self.has("text"):
            self.item["text"] += data
        elif self.has("owner"):
            self.item["display_name"] += data


def read_markup(captures: DataFrame, keys: list[str], prefix: str = MARKER_PREFIX) -> DataFrame:
    """keys + platform + body(string) to one row per item, in document order."""
    key_fields = [captures.schema[k] for k in keys]
    schema = T.StructType(
        [*key_fields, T.StructField("ordinal", T.LongType())]
        + [T.StructField(name, T.StringType()) for name in ROW_FIELDS]
    )

    def items(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for record in batch.itertuples(index=False):
                reader = ChannelReader() if record.platform == "telegram" else MarkerReader(prefix)
                reader.feed(record.body or "")
                reader.close()
                key = [getattr(record, k) for k in keys]
                for i, row in enumerate(reader.rows):
                    yield (*key, i, *[row[f] for f in ROW_FIELDS])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return framed(items(batches), schema.names)

    return captures.select(*keys, "platform", "body").mapInPandas(parse, schema)


def read_posts_json(captures: DataFrame, keys: list[str], tag: str = POSTS_TAG) -> DataFrame:
    """The normalised JSON document, natively. Anything malformed gives no rows."""
    document = F.from_json("body", "schema string, posts array<string>")
    fields = (
        "external_id string, page_handle string, page_name string, text string, "
        "posted_at_raw string"
    )
    posts = (
        captures.select(*keys, document.alias("d"))
        .where(F.col("d.schema") == tag)
        .select(*keys, F.posexplode("d.posts").alias("ordinal", "post"))
        .where(F.col("post").startswith("{"))
        .select(*keys, F.col("ordinal").cast("long").alias("ordinal"),
                F.from_json("post", fields).alias("p"))
    )
    blank = F.lit("")
    return posts.select(
        *keys,
        "ordinal",
        F.coalesce("p.external_id", blank).alias("external_id"),
        F.coalesce("p.page_handle", blank).alias("author"),
        F.coalesce("p.page_name", blank).alias("display_name"),
        F.coalesce("p.text", blank).alias("text"),
        F.coalesce("p.posted_at_raw", blank).alias("posted_at_raw"),
    )


def read_rows(
    captures: DataFrame, keys: list[str], tag: str = POSTS_TAG, prefix: str = MARKER_PREFIX
) -> DataFrame:
    """Dispatch by platform: pages as JSON, channels and everything else as markup.

    ``captures`` has keys, platform and body (binary).
    """
    body, _ = text.decode_utf8(F.col("body"))
    decoded = captures.select(*keys, "platform", body.alias("body"))
    is_json = F.col("platform") == "facebook"
    markup = read_markup(decoded.where(~is_json), keys, prefix)
    return markup.unionByName(read_posts_json(decoded.where(is_json), keys, tag))


def normalise_api(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Landed API pages (keys, page_handle, body string) to posts worth keeping.

    Dropped: posts without id or time, and posts with neither message nor story.
    """
    item = (
        "id string, message string, story string, created_time string, permalink_url string"
    )
    document = F.from_json("body", f"data array<struct<{item.replace(' string', ':string')}>>")
    rows = payloads.select(*keys, "page_handle", F.posexplode(document["data"]).alias("i", "p"))
    said = F.coalesce(
        F.nullif("p.message", F.lit("")), F.nullif("p.story", F.lit("")), F.lit("")
    )
    return rows.where(
        (F.coalesce("p.id", F.lit("")) != "")
        & (F.coalesce("p.created_time", F.lit("")) != "")
        & (said != "")
    ).select(
        *keys,
        F.col("i").cast("long").alias("ordinal"),
        F.col("p.id").alias("external_id"),
        "page_handle",
        F.col("page_handle").alias("page_name"),
        said.alias("text"),
        F.col("p.created_time").alias("posted_at_raw"),
        F.coalesce("p.permalink_url", F.lit("")).alias("permalink"),
    )


def posts_to_documents(posts: DataFrame, keys: list[str], tag: str = POSTS_TAG) -> DataFrame:
    """Posts of one fetched page to the bytes that get sealed: sorted keys, stable order.

    ``keys`` must identify one fetch; the group is that document and no larger.
    """
    names = ["external_id", "page_handle", "page_name", "permalink", "posted_at_raw", "text"]
    post = jsontext.obj({n: jsontext.string(F.col(n)) for n in names})
    return (
        posts.select(*keys, F.struct("ordinal", post.alias("post")).alias("p"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
        .select(
            *keys,
            jsontext.obj(
                {"schema": jsontext.text(tag), "posts": jsontext.array(F.col("ps.post"))}
            ).alias("body"),
        )
    )
