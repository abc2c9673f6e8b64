"""Scalar, extraction, content and source-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import addresses, ids, jsontext, moments, text
from murmur.operators import collect, content, extract
from murmur.plans import sample
from murmur.plans.registry import plain, prefixed_sql, query, table, uuid5_sql
from murmur.sources import markup, tables

# ---------------------------------------------------------------- times in many spellings


def _spelled():
    """The event time as text, spelled eight ways."""
    ts = F.col("ts").cast("timestamp")

    def fmt(pattern: str):
        return F.date_format(ts, pattern)

    later = F.date_format(ts + F.expr("interval 4 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 8
    return (
        F.when(kind == 0, fmt("yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 1, F.concat(F.lit("  "), fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z ")))
        .when(kind == 2, F.concat(fmt("yyyy-MM-dd'T'HH:mm"), F.lit("+00:00")))
        .when(kind == 3, fmt("yyyy-MM-dd"))
        .when(kind == 4, fmt("yyyy-MM-dd'T'HH"))
        .when(kind == 5, F.concat(later, F.lit("+04:00")))
        .when(kind == 6, F.concat(fmt("H:mm"), F.lit(" todays")))
        .otherwise(fmt("yyyyMMdd'T'HHmmss"))
    )


_UTC_SQL = """CASE event_id % 8 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN
 date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('day', ts)
 WHEN 4 THEN date_trunc('hour', ts) WHEN 5 THEN ts WHEN 7 THEN date_trunc('second', ts) END"""
_PREC_SQL = """CASE event_id % 8 WHEN 2 THEN 'minute' WHEN 3 THEN 'day' WHEN 4 THEN 'hour'
 ELSE 'second' END"""


@query(
    "timestamp_precision",
    f"SELECT event_id, {_PREC_SQL} AS timestamp_precision FROM events",
)
def timestamp_precision(spark, sf):
    raw = table(spark, sf, "events").select("event_id", _spelled().alias("raw"))
    return raw.select(
        "event_id", moments.timestamp_precision(F.col("raw")).alias("timestamp_precision")
    )


@query("timestamp_utc", f"SELECT event_id, {_UTC_SQL}::TIMESTAMP AS posted_at FROM events")
def timestamp_utc(spark, sf):
    raw = table(spark, sf, "events").select("event_id", _spelled().alias("raw"))
    return raw.select("event_id", plain(moments.parse_iso(F.col("raw"))).alias("posted_at"))


@query(
    "time_texts",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS hashed_form,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS export_form,
 CAST((isodow(ts) - 1) * 24 + hour(ts) AS BIGINT) AS hour_of_week FROM events""",
)
def time_texts(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        moments.rfc3339_micros(ts).alias("hashed_form"),
        moments.export_time(ts).alias("export_form"),
        moments.hour_of_week(ts).cast("long").alias("hour_of_week"),
    )


# ---------------------------------------------------------------- text


@query(
    "script_of_text",
    """WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
 length(regexp_replace(text, '[^\\x{10a0}-\\x{10ff}]', '', 'g')) AS georgian FROM documents)
SELECT doc_id, CASE WHEN latin = 0 AND georgian = 0 THEN NULL WHEN georgian >= latin
 THEN 'georgian' ELSE 'latin' END AS script FROM c""",
)
def script_of_text(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.script_of(F.col("text")).alias("script")
    )


_SPACE_SQL = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


@query(
    "whitespace_norm",
    f"""SELECT doc_id, sha256(trim(regexp_replace(text, '{_SPACE_SQL}', ' ', 'g'))) AS digest,
 CAST(length(trim(regexp_replace(text, '{_SPACE_SQL}', ' ', 'g'))) AS BIGINT) AS chars
 FROM documents""",
)
def whitespace_norm(spark, sf):
    tidy = text.collapse_whitespace(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", text.text_digest(tidy).alias("digest"), F.length(tidy).cast("long").alias("chars")
    )


@query(
    "text_digest",
    """SELECT doc_id, sha256(text) AS text_sha256,
 regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS well_formed FROM documents""",
)
def text_digest(spark, sf):
    digest = text.text_digest(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", digest.alias("text_sha256"), text.is_digest(digest).alias("well_formed")
    )


@query(
    "bytes_decoded",
    """SELECT page_id, page_id % 3 <> 0 AS was_utf8,
 CAST(length(html) + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS chars FROM pages""",
)
def bytes_decoded(spark, sf):
    """Captured bytes to text; a stray byte in every third page is replaced and reported."""
    body = F.when(
        F.col("page_id") % 3 == 0, F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF")))
    ).otherwise(F.encode("html", "UTF-8"))
    decoded, valid = text.decode_utf8(body)
    return table(spark, sf, "pages").select(
        "page_id", valid.alias("was_utf8"), F.length(decoded).cast("long").alias("chars")
    )


@query(
    "float_texts",
    """SELECT event_id, CAST(value AS VARCHAR) AS plain, CAST(value * 1000000 AS VARCHAR) AS large,
 CAST(floor(value * 100) AS VARCHAR) AS whole FROM events""",
)
def float_texts(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id",
        text.float_text(v).alias("plain"),
        text.float_text(v * 1000000).alias("large"),
        text.float_text(F.floor(v * 100).cast("double")).alias("whole"),
    )


@query(
    "canonical_documents",
    """SELECT conv_id, turn, sha256('{"role":'||CAST(to_json(role) AS VARCHAR)||',"text":'||
 CAST(to_json(text) AS VARCHAR)||',"turn":'||turn||'}') AS digest FROM conversations""",
)
def canonical_documents(spark, sf):
    """Sorted-key compact JSON, hashed as bytes."""
    document = jsontext.obj(
        {
            "turn": jsontext.integer(F.col("turn")),
            "text": jsontext.string(F.col("text")),
            "role": jsontext.string(F.col("role")),
        }
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.text_digest(document).alias("digest")
    )


@query(
    "canonical_any_document",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 7 THEN sha256('{"10":'||doc_id||',"9":[3,{"a":true,"b":null},[]],'
 ||'"Z":{"k":{"y":1.5,"é":{}},"x":-2},"lang":'||CAST(to_json(lang) AS VARCHAR)||',"text":'
 ||CAST(to_json(text) AS VARCHAR)||',"ä":"last"}') END AS digest FROM documents""",
)
def canonical_any_document(spark, sf):
    """Documents of unknown keys, nested and spaced, in the form that is hashed; cut ones are refused."""
    written = F.concat(
        F.lit('{ "text" : '), jsontext.string(F.col("text"), ascii_only=True),
        F.lit(', "\\u00e4": "first", "Z": {"x": -2, "k": { "\\u00e9": {}, "y":1.50}},\n "lang":\t'),
        jsontext.string(F.col("lang")), F.lit(', "9": [3, {"b": null, "a": true}, [ ]], "10": '),
        F.col("doc_id").cast("string"), F.lit(', "ä":"last"'),
        F.when(F.col("doc_id") % 10 == 7, F.lit("")).otherwise(F.lit("}")),
    )
    return table(spark, sf, "documents").select(
        "doc_id", text.text_digest(jsontext.canonical(written)).alias("digest")
    )


@query(
    "deterministic_ids",
    f"""SELECT doc_id, {uuid5_sql(ids.CONTENT_NAMESPACE, "'account|html|'||source")} AS account_id,
 {uuid5_sql(ids.CONTENT_NAMESPACE, "'content|html|'||doc_id")} AS content_id,
 {uuid5_sql(ids.SOURCE_NAMESPACE, "'source|html|'||lang||source")} AS source_id FROM documents""",
)
def deterministic_ids(spark, sf):
    html = F.lit("html")
    return table(spark, sf, "documents").select(
        "doc_id",
        ids.account_id(html, F.col("source")).alias("account_id"),
        ids.content_id(html, F.col("doc_id").cast("string")).alias("content_id"),
        ids.source_id(html, F.concat("lang", "source")).alias("source_id"),
    )


@query(
    "length_prefixed_hash",
    f"""SELECT doc_id, sha256({prefixed_sql("lang", "text", "CAST(doc_id AS VARCHAR)")}) AS digest
 FROM documents""",
)
def length_prefixed_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        ids.prefixed_digest(F.col("lang"), F.col("text"), F.col("doc_id").cast("string")).alias(
            "digest"
        ),
    )


# ---------------------------------------------------------------- documents and posts


def _posts(spark, sf):
    """Events as the posts of fetched pages, at most a hundred to a page."""
    e = table(spark, sf, "events")
    blank = F.col("event_id") % 50 == 7
    return e.select(
        F.lit("t0").alias("tenant_id"),
        F.col("event_type").alias("source_id"),
        F.concat_ws("-", "event_type", F.expr("event_id div 100").cast("string")).alias(
            "capture_id"
        ),
        F.concat(F.lit("tr-"), F.expr("event_id div 100").cast("string")).alias("trace_id"),
        F.col("event_id").alias("ordinal"),
        F.when(blank, F.lit("")).otherwise(F.col("event_id").cast("string")).alias("external_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("page_handle"),
        F.concat(F.lit("User <"), F.col("user_id").cast("string"), F.lit(">")).alias("page_name"),
        F.concat_ws(" ", F.lit("a\n\"quoted\" \\ "), "event_type", "props").alias("text"),
        _spelled().alias("posted_at_raw"),
        F.lit("").alias("permalink"),
    )


KEYS = ["tenant_id", "source_id", "capture_id", "trace_id"]


def _json_captures(spark, sf):
    documents = markup.posts_to_documents(_posts(spark, sf), KEYS)
    return documents.select(
        *KEYS, F.lit("facebook").alias("platform"), F.encode("body", "UTF-8").alias("body")
    )


_TEXT_SQL = """'a "quoted" \\ '||event_type||' '||props"""


@query(
    "posts_roundtrip",
    """SELECT event_type||'-'||(event_id // 100) AS capture_id, CASE WHEN event_id % 50 = 7 THEN ''
 ELSE CAST(event_id AS VARCHAR) END AS external_id, 'u'||user_id AS author,
 'User <'||user_id||'>' AS display_name, sha256('a'||chr(10)||'"quoted" \\  '||event_type||' '||props)
 AS text_sha256 FROM events""",
)
def posts_roundtrip(spark, sf):
    """Posts written to normalised documents and read back."""
    rows = markup.read_rows(_json_captures(spark, sf), KEYS)
    return rows.select(
        "capture_id", "external_id", "author", "display_name",
        text.text_digest(F.col("text")).alias("text_sha256"),
    )


_SHAPED_SQL = f"""SELECT event_type||'-'||(event_id // 100) AS capture_id, event_id,
 CASE WHEN event_id % 50 = 7 THEN '' ELSE CAST(event_id AS VARCHAR) END AS external_id,
 {_UTC_SQL}::TIMESTAMP AS posted_at FROM events"""


@query(
    "row_quarantine",
    f"""SELECT capture_id, external_id, CASE WHEN external_id = '' THEN 'missing id or author'
 ELSE 'unreadable time in' END AS problem FROM ({_SHAPED_SQL})
 WHERE external_id = '' OR posted_at IS NULL""",
)
def row_quarantine(spark, sf):
    """Rows without id, author or readable time, with the reason."""
    bad = extract.quarantined(extract.extract(_json_captures(spark, sf)))
    return bad.select(
        "capture_id", "external_id",
        F.regexp_extract("problem", r"\A(missing id or author|unreadable time in)", 1).alias(
            "problem"
        ),
    )


VALIDATION_SQL = f"""SELECT capture_id, count(*) FILTER (WHERE external_id <> '' AND posted_at IS NOT NULL)
 AS items, count(*) FILTER (WHERE external_id = '' OR posted_at IS NULL) AS rejected,
 count(*) FILTER (WHERE external_id = '' OR posted_at IS NULL) = 0 AND
 count(*) FILTER (WHERE external_id <> '' AND posted_at IS NOT NULL) >= 10 AS validation_passed
 FROM ({_SHAPED_SQL}) GROUP BY 1"""


@query("capture_validation", VALIDATION_SQL)
def capture_validation(spark, sf):
    """Per capture: how many items, and whether the page still looks as it should."""
    captures = _json_captures(spark, sf)
    runs = extract.validate_captures(captures, extract.extract(captures), KEYS, minimum=10)
    return runs.select("capture_id", "items", "rejected", "validation_passed")


@query(
    "extracted_content",
    f"""SELECT {uuid5_sql(ids.CONTENT_NAMESPACE, "'content|facebook|'||external_id")} AS content_id,
 {uuid5_sql(ids.CONTENT_NAMESPACE, "'account|facebook|u'||user_id")} AS account_id,
 posted_at, timestamp_precision, sha256({_TEXT_SQL}) AS text_sha256, 'latin' AS script,
 CAST(2 AS INTEGER) AS extractor_version FROM (SELECT *, CAST(event_id AS VARCHAR) AS external_id,
 {_UTC_SQL}::TIMESTAMP AS posted_at, {_PREC_SQL} AS timestamp_precision FROM events)
 WHERE event_id % 50 <> 7 AND posted_at IS NOT NULL""",
)
def extracted_content(spark, sf):
    """Captures to typed, identified content records."""
    rows = extract.content_rows(extract.extract(_json_captures(spark, sf)))
    return rows.select(
        "content_id", "account_id", plain("posted_at").alias("posted_at"), "timestamp_precision",
        "text_sha256", "script", "extractor_version",
    )


def _escape(column):
    return F.replace(F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"),
                               F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _html_captures(spark, sf, platform: str):
    """The same posts as pages of markup: marked elements, or a channel preview."""
    posts = _posts(spark, sf)
    body = _escape(F.col("text"))
    if platform == "telegram":
        item = F.concat(
            F.lit(f'<div class="{markup.MESSAGE_CLASS} js" data-post="'),
            F.concat_ws("/", "page_handle", "external_id"),
            F.lit(f'"><a class="{markup.OWNER_CLASS}"><span>'), _escape(F.col("page_name")),
            F.lit(f'</span></a><div class="{markup.TEXT_CLASS}" dir="auto">'), body,
            F.lit('<br>end</div><time datetime="'), F.col("posted_at_raw"),
            F.lit('">x</time><time datetime="1999-01-01"></time></div>'),
        )
    else:
        item = F.concat(
            F.lit('<div data-post-item="'), F.col("external_id"),
            F.lit('" data-post-author="'), F.col("page_handle"),
            F.lit('" data-post-display-name="'), _escape(F.col("page_name")),
            F.lit('" data-post-posted-at="'), F.col("posted_at_raw"), F.lit('"><p>'), body,
            F.lit("<br></p><b>end</b></div><i>outside</i>"),
        )
    return (
        posts.select(*KEYS, F.struct("ordinal", item.alias("html")).alias("p"))
        .groupBy(*KEYS)
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
        .select(
            *KEYS,
            F.lit(platform).alias("platform"),
            F.encode(
                F.concat(F.lit("<html><body>"), F.array_join(F.col("ps.html"), "\n"),
                         F.lit("</body></html>")), "UTF-8",
            ).alias("body"),
        )
    )


@query(
    "dom_marked_pages",
    f"""SELECT capture_id, external_id, 'u'||user_id AS author_handle, 'User <'||user_id||'>'
 AS author_display_name, posted_at, sha256({_TEXT_SQL}||'end') AS text_sha256 FROM (SELECT *,
 event_type||'-'||(event_id // 100) AS capture_id, CAST(event_id AS VARCHAR) AS external_id,
 {_UTC_SQL}::TIMESTAMP AS posted_at FROM events) WHERE event_id % 50 <> 7
 AND posted_at IS NOT NULL""",
)
def dom_marked_pages(spark, sf):
    """Items read from marked elements of captured pages."""
    rows = extract.accepted(extract.extract(_html_captures(spark, sf, "canary")))
    return rows.select(
        "capture_id", "external_id", "author_handle", "author_display_name",
        plain("posted_at").alias("posted_at"), text.text_digest(F.col("text")).alias("text_sha256"),
    )


@query(
    "dom_channel_pages",
    f"""SELECT capture_id, 'u'||user_id||'/'||CASE WHEN event_id % 50 = 7 THEN '' ELSE
 CAST(event_id AS VARCHAR) END AS external_id, 'u'||user_id AS author_handle, 'User <'||user_id||'>'
 AS author_display_name, posted_at, sha256({_TEXT_SQL}||'end') AS text_sha256 FROM (SELECT *,
 event_type||'-'||(event_id // 100) AS capture_id, {_UTC_SQL}::TIMESTAMP AS posted_at
 FROM events) WHERE posted_at IS NOT NULL""",
)
def dom_channel_pages(spark, sf):
    """Messages read from channel previews."""
    rows = extract.accepted(extract.extract(_html_captures(spark, sf, "telegram")))
    return rows.select(
        "capture_id", "external_id", "author_handle", "author_display_name",
        plain("posted_at").alias("posted_at"), text.text_digest(F.col("text")).alias("text_sha256"),
    )


@query(
    "api_normalise",
    """SELECT event_type||'-'||(event_id // 100) AS capture_id, CAST(event_id AS VARCHAR) AS external_id,
 CASE WHEN event_id % 3 = 0 THEN 'story '||event_type ELSE 'said '||props END AS text,
 strftime(ts, '%Y-%m-%dT%H:%M:%S+0000') AS posted_at_raw FROM events
 WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 3 <> 2""",
)
def api_normalise(spark, sf):
    """Landed API pages: no id, no time or nothing said means no post."""
    eid = F.col("event_id")
    post = jsontext.obj(
        {
            "id": F.when(eid % 7 == 0, F.lit("null")).otherwise(
                jsontext.string(eid.cast("string"))
            ),
            "message": F.when(eid % 3 == 1, jsontext.string(F.concat(F.lit("said "), "props")))
            .otherwise(F.lit('""')),
            "story": F.when(
                eid % 3 == 0, jsontext.string(F.concat(F.lit("story "), "event_type"))
            ).otherwise(F.lit("null")),
            "created_time": F.when(eid % 11 == 0, F.lit('""')).otherwise(
                jsontext.string(
                    F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+0000'")
                )
            ),
        }
    )
    landed = (
        table(spark, sf, "events")
        .select(
            F.concat_ws("-", "event_type", F.expr("event_id div 100").cast("string")).alias(
                "capture_id"
            ),
            F.struct("event_id", post.alias("post")).alias("p"),
        )
        .groupBy("capture_id")
        .agg(F.array_sort(F.collect_list("p")).alias("ps"))
        .select(
            "capture_id",
            F.lit("page").alias("page_handle"),
            F.concat(F.lit('{"data":['), F.array_join(F.col("ps.post"), ","), F.lit("]}")).alias(
                "body"
            ),
        )
    )
    posts = markup.normalise_api(landed, ["capture_id"])
    return posts.select("capture_id", "external_id", "text", "posted_at_raw")


# ---------------------------------------------------------------- upserts


def _sightings(spark, sf):
    """Events as sightings in two batches; odd users are processed newest first."""
    e = table(spark, sf, "events")
    half = F.col("event_id") % 100 < 50
    seq = F.when(F.col("user_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))
    return e.withColumn("seq", seq), half


def _one_of_three():
    return F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))


@query(
    "account_upsert",
    """WITH e AS (SELECT 'u'||user_id AS account_id, 't'||(event_id % 3) AS tenant_id, event_type, ts, {'b': event_id % 100 >= 50,
 's': CASE WHEN user_id % 2 = 0 THEN event_id ELSE -event_id END} AS ord FROM events)
SELECT tenant_id, account_id, arg_min(event_type, ord) AS display_name, arg_min(ts, ord) AS first_seen,
 arg_max(ts, ord) AS last_seen FROM e GROUP BY 1, 2""",
)
def account_upsert(spark, sf):
    """Two batches merged; the last processed sighting wins, not the latest in time.

    Three tenants see the same accounts and share none.
    """
    e, half = _sightings(spark, sf)
    seen = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account_id"),
        _one_of_three().alias("tenant_id"),
        F.lit("html").alias("platform"),
        F.col("user_id").cast("string").alias("handle"),
        F.col("event_type").alias("display_name"),
        F.col("ts").cast("timestamp").alias("seen_at"),
        "seq", half.alias("early"),
    )
    first = content.merge_accounts(None, seen.where("early"))
    merged = content.merge_accounts(first, seen.where("not early"))
    return merged.select(
        "tenant_id", "account_id", "display_name", plain("first_seen").alias("first_seen"),
        plain("last_seen").alias("last_seen"),
    )


REOBSERVED_SQL = """WITH e AS (SELECT user_id||'/'||strftime(ts,'%d') AS content_id, 't'||(event_id % 3) AS tenant_id, date_trunc('day', ts)
 AS posted_at, event_type AS capture_id, 'tr'||event_id AS trace_id, ts, {'b': event_id % 100 >= 50,
 's': CASE WHEN user_id % 2 = 0 THEN event_id ELSE -event_id END} AS ord FROM events)
SELECT tenant_id, content_id, posted_at, arg_min(capture_id, ord) AS capture_id, arg_min(trace_id, ord)
 AS trace_id, arg_max(capture_id, ord) AS last_capture_id, arg_max(trace_id, ord) AS last_trace_id,
 arg_min(ts, ord) AS first_seen, arg_max(ts, ord) AS last_seen FROM e GROUP BY 1, 2, 3"""


def content_sightings(spark, sf):
    """Items as captures saw them; ``early`` marks the first batch."""
    e, half = _sightings(spark, sf)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format(ts, "dd")).alias(
            "content_id"
        ),
        F.date_trunc("day", ts).alias("posted_at"),
        _one_of_three().alias("tenant_id"),
        F.col("event_type").alias("capture_id"),
        F.concat(F.lit("tr"), F.col("event_id").cast("string")).alias("trace_id"),
        ts.alias("seen_at"), "seq", half.alias("early"),
    )


def reobserved(merged):
    return merged.select(
        "tenant_id", "content_id", plain("posted_at").alias("posted_at"), "capture_id", "trace_id",
        "last_capture_id", "last_trace_id", plain("first_seen").alias("first_seen"),
        plain("last_seen").alias("last_seen"),
    )


@query("content_reobservation", REOBSERVED_SQL)
def content_reobservation(spark, sf):
    """A repeat moves the last_* columns and leaves the provenance alone."""
    batch = content_sightings(spark, sf)
    first = content.merge_content(None, batch.where("early"))
    return reobserved(content.merge_content(first, batch.where("not early")))


def _stored(spark, sf):
    d = table(spark, sf, "documents")
    did = F.col("doc_id")
    return d.select(
        F.lit("t0").alias("tenant_id"),
        did.cast("string").alias("content_id"),
        F.timestamp_seconds(F.lit(1704067200) + did).alias("posted_at"),
        F.col("source").alias("source_id"),
        F.concat_ws("-", "source", (did % 50).cast("string")).alias("last_capture_id"),
        (F.lit(1) + (F.expr("doc_id div 7") % 2)).cast("int").alias("extractor_version"),
        "text",
        text.text_digest(F.col("text")).alias("text_sha256"),
        F.lit(None).cast("string").alias("script"),
        F.lit("second").alias("timestamp_precision"),
        F.when(did % 97 == 0, F.lit("2024-01-02").cast("timestamp")).alias("deleted_at"),
    )


def _doc_sources(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("source_id")).distinct().select(
        "source_id",
        F.when(F.col("source_id").endswith("7"), "telegram").otherwise("html").alias("platform"),
    )


_STORED_SQL = """SELECT CAST(doc_id AS VARCHAR) AS content_id, doc_id, source,
 source||'-'||(doc_id % 50) AS capture_id, CAST(1 + (doc_id // 7) % 2 AS INTEGER) AS v
 FROM documents WHERE doc_id % 97 <> 0"""
_BACKLOG_SQL = f"""SELECT capture_id, CASE WHEN source LIKE '%7' THEN 'telegram' ELSE 'html' END
 AS platform, min(v) AS oldest_extractor_version, count(*) AS items FROM ({_STORED_SQL})
 GROUP BY 1, 2 HAVING min(v) < 2"""


@query("reprocess_backlog", _BACKLOG_SQL)
def reprocess_backlog(spark, sf):
    backlog = content.reprocessing_backlog(_stored(spark, sf), _doc_sources(spark, sf))
    return backlog.drop("tenant_id")


def _parsed(spark, sf):
    """A second reading of all documents; some times come out different."""
    did = F.col("doc_id")
    tidy = text.collapse_whitespace(F.col("text"))
    return table(spark, sf, "documents").select(
        F.lit("t0").alias("tenant_id"),
        F.concat_ws("-", "source", (did % 50).cast("string")).alias("capture_id"),
        did.cast("string").alias("content_id"),
        # its place in the capture, as readers number what they find
        did.alias("ordinal"),
        F.timestamp_seconds(
            F.lit(1704067200) + did + F.when(did % 11 == 0, 60).otherwise(0)
        ).alias("posted_at"),
        tidy.alias("text"),
        text.text_digest(tidy).alias("text_sha256"),
        text.script_of(F.col("text")).alias("script"),
        F.lit("minute").alias("timestamp_precision"),
        F.lit(extract.EXTRACTOR_VERSION).alias("extractor_version"),
    )


_OUTCOME_SQL = f"""SELECT CAST(d.doc_id AS VARCHAR) AS content_id, CASE WHEN s.v IS NULL
 THEN 'unknown' WHEN d.doc_id % 11 = 0 THEN 'needs_migration' WHEN s.v < 2 THEN 'updated'
 ELSE 'unchanged' END AS outcome FROM documents d LEFT JOIN ({_STORED_SQL}) s
 ON s.doc_id = d.doc_id"""


@query("reprocess_outcomes", _OUTCOME_SQL)
def reprocess_outcomes(spark, sf):
    """Every re-read item: unknown, needs migration, updated or unchanged."""
    return content.reprocess_outcomes(_stored(spark, sf), _parsed(spark, sf)).select(
        "content_id", "outcome"
    )


@query(
    "reprocess_apply",
    f"""WITH o AS ({_OUTCOME_SQL}) SELECT CAST(d.doc_id AS VARCHAR) AS content_id,
 CASE WHEN o.outcome = 'updated' THEN 2 ELSE CAST(1 + (d.doc_id // 7) % 2 AS INTEGER) END
 ::INTEGER AS extractor_version, CASE WHEN o.outcome = 'updated' THEN 'minute' ELSE 'second' END
 AS timestamp_precision, CASE WHEN o.outcome = 'updated' THEN
 sha256(trim(regexp_replace(d.text, '{_SPACE_SQL}', ' ', 'g'))) ELSE sha256(d.text) END
 AS text_sha256 FROM documents d LEFT JOIN o ON o.content_id = CAST(d.doc_id AS VARCHAR)""",
)
def reprocess_apply(spark, sf):
    """The stored table after a newer extractor's reading is written over older ones."""
    stored = _stored(spark, sf)
    new = content.apply_reprocessing(
        stored, content.reprocess_outcomes(stored, _parsed(spark, sf))
    )
    return new.select("content_id", "extractor_version", "timestamp_precision", "text_sha256")


@query(
    "reprocess_report",
    f"""WITH b AS ({_BACKLOG_SQL}), o AS ({_OUTCOME_SQL}), c AS (SELECT b.capture_id,
 bool_or(d.doc_id IS NOT NULL) AS have FROM b LEFT JOIN documents d ON
 d.source||'-'||(d.doc_id % 50) = b.capture_id AND d.doc_id % 50 % 4 <> 3 GROUP BY 1)
SELECT (SELECT count(*) FROM c) AS captures_examined, (SELECT count(*) FROM c WHERE have)
 AS captures_reprocessed, (SELECT count(*) FROM c WHERE NOT have) AS captures_unavailable,
 (SELECT count(*) FROM o WHERE outcome = 'updated') AS items_updated,
 (SELECT count(*) FROM o WHERE outcome = 'unchanged') AS items_unchanged,
 (SELECT count(*) FROM o WHERE outcome = 'needs_migration') AS items_needing_migration,
 CAST(0 AS BIGINT) AS fetches_performed""",
)
def reprocess_report(spark, sf):
    stored = _stored(spark, sf)
    backlog = content.reprocessing_backlog(stored, _doc_sources(spark, sf))
    documents = (
        stored.where(F.col("content_id").cast("long") % 50 % 4 != 3)
        .groupBy("tenant_id", F.col("last_capture_id").alias("capture_id"))
        .agg(F.min("text_sha256").alias("document"))
    )
    outcomes = content.reprocess_outcomes(stored, _parsed(spark, sf))
    return content.reprocess_report(backlog, documents, outcomes).drop("tenant_id")


@query(
    "recent_content",
    """SELECT CAST(event_id AS VARCHAR) AS content_id, 'User '||user_id AS display_name,
 ts AS posted_at FROM events WHERE event_type <> 'error'
 ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 100""",
)
def recent_content(spark, sf):
    """The newest live items with their authors."""
    obs = sample.observations(spark, sf).withColumn(
        "deleted_at", F.when(F.col("source_id") == "error", F.col("posted_at"))
    )
    known = table(spark, sf, "events").select("user_id").distinct()
    who = known.select(
        F.lit("t0").alias("tenant_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account_id"),
        F.col("user_id").cast("string").alias("handle"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("display_name"),
    )
    return content.recent(obs, who, 100).select(
        "content_id", "display_name", plain("posted_at").alias("posted_at")
    )


@query(
    "month_partitions",
    """SELECT strftime(o_orderdate, '%Y-%m') AS posted_month, count(*) AS items FROM orders
 GROUP BY 1""",
)
def month_partitions(spark, sf):
    return tables.month_counts(table(spark, sf, "orders"), "o_orderdate")


@query(
    "out_of_range_rows",
    """SELECT count(*) FILTER (WHERE o_orderdate < DATE '1993-01-01' OR
 o_orderdate >= DATE '1998-01-01') AS outside, count(*) AS total FROM orders""",
)
def out_of_range_rows(spark, sf):
    return tables.out_of_range(
        table(spark, sf, "orders"), "o_orderdate", "1993-01-01", "1998-01-01"
    )


@query(
    "detection_view",
    """SELECT event_type AS source_id, count(*) AS items FROM events WHERE event_id % 10 <> 0
 GROUP BY 1""",
)
def detection_view(spark, sf):
    """The view detection reads: live rows, behaviour columns only."""
    obs = sample.observations(spark, sf).withColumns(
        {
            "deleted_at": F.when(
                F.col("content_id").cast("long") % 10 == 0, F.col("posted_at")
            ),
            "text": F.col("content_id"),
        }
    )
    mine = tables.for_tenant(tables.content_for_detection(obs), "t0")
    return mine.groupBy("source_id").agg(F.count("*").alias("items"))


# ---------------------------------------------------------------- source lists


def _pasted(spark, sf):
    """Each page as a pasted list: its address, a comment, a channel and a page name."""
    pid = F.col("page_id")
    return table(spark, sf, "pages").select(
        F.concat(F.lit("t"), (pid % 2).cast("string")).alias("tenant_id"),
        F.when(pid % 3 == 0, "telegram").when(pid % 3 == 1, "facebook").otherwise("html").alias(
            "platform"
        ),
        "page_id",
        F.concat(
            F.lit("# list\n <"), F.regexp_replace("url", r"\?.*", ""), F.lit("/>, @chan_"),
            (pid % 40).cast("string"), F.lit("\n\nhttps://t.me/s/chan_"), (pid % 60).cast("string"),
            F.lit("?before=9\nhttps://m.facebook.com/page."), (pid % 50).cast("string"),
            F.lit("/posts/1"),
        ).alias("pasted"),
    )


_LINES_SQL = r"""SELECT page_id, line_no, 't'||(page_id % 2) AS tenant_id, CASE page_id % 3 WHEN 0
 THEN 'telegram' WHEN 1 THEN 'facebook' ELSE 'html' END AS platform, line FROM (
 SELECT page_id, 1 AS line_no, '<'||regexp_replace(url, '\?.*', '')||'/>' AS line FROM pages UNION ALL
 SELECT page_id, 2, '@chan_'||(page_id % 40) FROM pages UNION ALL
 SELECT page_id, 4, 'https://t.me/s/chan_'||(page_id % 60)||'?before=9' FROM pages UNION ALL
 SELECT page_id, 5, 'https://m.facebook.com/page.'||(page_id % 50)||'/posts/1' FROM pages)"""
_NORMAL_SQL = rf"""SELECT *, CASE platform
 WHEN 'telegram' THEN CASE WHEN regexp_matches(tg, '^[\pL\pN_]+$') THEN 'https://t.me/s/'||tg END
 WHEN 'facebook' THEN CASE WHEN regexp_matches(fb, '^[\pL\pN._-]+$')
 THEN 'https://www.facebook.com/'||fb END
 ELSE CASE WHEN regexp_matches(v, '^https?://') THEN v END END AS url FROM (SELECT *,
 regexp_replace(regexp_replace(regexp_replace(v, '^(https?://t\.me/s/|https?://t\.me/|@)', ''),
 '\?.*', ''), '/.*', '') AS tg, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 regexp_replace(v, '^@+', ''), '^https?://', ''),
 '^(www\.facebook\.com/|m\.facebook\.com/|mbasic\.facebook\.com/|facebook\.com/)', ''),
 '\?.*', ''), '/.*', '') AS fb FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(line,
 '^[<>]+', ''), '[<>]+$', ''), '/+$', '') AS v FROM ({_LINES_SQL})))"""


@query(
    "source_lines_normalised",
    f"SELECT page_id, line, url FROM ({_NORMAL_SQL})",
)
def source_lines_normalised(spark, sf):
    lines = collect.source_lines(_pasted(spark, sf))
    n = addresses.normalise_source(F.col("line"), F.col("platform"))
    return lines.select("page_id", "line", n["url"].alias("url"))


@query(
    "source_list_ingest",
    f"""WITH n AS ({_NORMAL_SQL}), w AS (SELECT tenant_id, url, count(*) AS c FROM n
 WHERE url LIKE '%chan_1%' GROUP BY 1, 2), r AS (SELECT n.*, row_number() OVER (PARTITION BY
 n.tenant_id, n.platform, n.url ORDER BY page_id, line_no) AS rn, w.url IS NOT NULL AS watched
 FROM n LEFT JOIN w ON w.tenant_id = n.tenant_id AND w.url = n.url)
SELECT tenant_id, platform, CASE WHEN url IS NULL THEN 'rejected' WHEN rn > 1 OR watched
 THEN 'duplicate' ELSE 'added' END AS outcome, count(*) AS lines FROM r GROUP BY 1, 2, 3""",
)
def source_list_ingest(spark, sf):
    """Pasted lists to added, duplicate and rejected lines."""
    lines = collect.source_lines(_pasted(spark, sf)).withColumn(
        "seq", F.struct("page_id", "line_no")
    )
    n = addresses.normalise_source(F.col("line"), F.col("platform"))
    existing = (
        lines.select("tenant_id", n["url"].alias("url"))
        .where(F.col("url").contains("chan_1"))
        .distinct()
        .withColumn("source_id", F.lit("older"))
    )
    done = collect.ingest_sources(lines, existing)
    return done.groupBy("tenant_id", "platform", "outcome").agg(F.count("*").alias("lines"))


@query(
    "duplicate_sources",
    """WITH s AS (SELECT page_id, 't'||(page_id % 2) AS tenant_id, regexp_replace(
 regexp_replace(url, '[?#].*', ''), '[0-9]+$', '') AS url, -(page_id % 7) AS created FROM pages)
SELECT page_id AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, url
 ORDER BY created, page_id) AS rn FROM s) WHERE rn > 1""",
)
def duplicate_sources(spark, sf):
    """Pages watched twice; the earliest row stays."""
    pid = F.col("page_id")
    sources = table(spark, sf, "pages").select(
        pid.alias("source_id"),
        F.concat(F.lit("t"), (pid % 2).cast("string")).alias("tenant_id"),
        F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), r"[0-9]+\z", "").alias("url"),
        (-(pid % 7)).alias("created_at"),
    )
    return collect.duplicate_sources(sources).select("source_id")


@query(
    "fetch_outcomes",
    """SELECT CASE WHEN event_id % 13 = 1 THEN 'failed_timeout' WHEN event_id % 13 = 2 THEN
 'failed_network' WHEN event_id % 13 = 3 THEN 'failed_internal' WHEN event_id % 13 = 4 THEN
 'failed_not_found' WHEN event_id % 13 IN (5, 6, 7) THEN 'failed_blocked' WHEN event_id % 13 = 8
 THEN 'failed_network' WHEN value > 300 THEN 'failed_internal' ELSE 'succeeded' END AS outcome,
 count(*) AS attempts FROM events GROUP BY 1""",
)
def fetch_outcomes(spark, sf):
    """Logged attempts to outcome classes."""
    k = F.col("event_id") % 13
    error = F.when(k == 1, "timeout").when(k == 2, "connection").when(k == 3, "crash")
    status = (
        F.when(k == 4, 404).when(k == 5, 401).when(k == 6, 403).when(k == 7, 429)
        .when(k == 8, 503).otherwise(200)
    )
    size = F.when(F.col("value") > 300, 9 * 1024 * 1024).otherwise(1000)
    outcome = addresses.fetch_outcome(status, error, size)
    return table(spark, sf, "events").groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("attempts")
    )


@query(
    "platform_support",
    """SELECT p AS platform, count(*) AS sources, CASE p WHEN 'canary' THEN 'extracts' WHEN 'html'
 THEN 'capture_only' WHEN 'facebook' THEN 'needs_route' WHEN 'x' THEN 'blocked' WHEN 'tiktok'
 THEN 'blocked' WHEN 'telegram' THEN 'extracts' ELSE 'unknown' END AS support FROM (SELECT
 ['canary','html','facebook','x','tiktok','telegram','forum'][page_id % 7 + 1] AS p FROM pages)
 GROUP BY 1""",
)
def platform_support(spark, sf):
    keys = ["canary", "html", "facebook", "x", "tiktok", "telegram", "forum"]
    key = F.element_at(
        F.array(*[F.lit(k) for k in keys]), (F.col("page_id") % 7 + 1).cast("int")
    )
    counted = table(spark, sf, "pages").groupBy(key.alias("platform")).agg(
        F.count("*").alias("sources")
    )
    return counted.withColumn("support", addresses.platform_support(F.col("platform")))
