"""Evidence queries: pages as captures, sealed in bundles and chained per tenant."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from murmur.functions import text
from murmur.operators import chain, evidence, quality
from murmur.plans import sample
from murmur.plans.registry import plain, prefixed_sql, query, table
from murmur.session import materialise, work_dir
from murmur.sources import archive_files, archives

KEY = ["tenant_id", "bundle_id"]


def _bundles(spark, sf):
    """Each page is a capture, a minute after the one before; 64 in a row are one tenant's."""
    pid = F.col("page_id")
    number = pid.cast("string")
    micro = F.when(pid % 2 == 1, pid % 1000).otherwise(0)
    return table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("t"), F.expr("page_id div 64").cast("string")).alias("tenant_id"),
        F.concat(F.lit("b"), number).alias("bundle_id"),
        F.concat(F.lit("c"), number).alias("capture_id"),
        F.concat(F.lit("tr"), number).alias("trace_id"),
        F.col("url").alias("source_url"),
        F.timestamp_micros((F.lit(1704067200) + pid * 60) * 1000000 + micro).alias("captured_at"),
        F.encode("html", "UTF-8").alias("body"),
        F.when(pid % 5 == 0, F.lit("text/html; charset=utf-8")).otherwise(F.lit("")).alias(
            "content_type"
        ),
    )


def _artifacts(spark, sf):
    """Two files per bundle: the document and a note of its address."""
    b = _bundles(spark, sf)
    dom = evidence.artifact_table(b, KEY)
    note = b.select(
        *KEY,
        F.lit("address.txt").alias("name"),
        F.lit("metadata").alias("kind"),
        F.lit("text/plain").alias("media_type"),
        F.octet_length("source_url").cast("long").alias("size_bytes"),
        text.text_digest(F.col("source_url")).alias("sha256"),
    )
    return dom.unionByName(note)


_P = """SELECT page_id, 't'||(page_id // 64) AS tenant_id, 'b'||page_id AS bundle_id,
 'c'||page_id AS capture_id, 'tr'||page_id AS trace_id, url AS source_url, url, html,
 strftime(TIMESTAMP '2024-01-01' + to_minutes(page_id), '%Y-%m-%dT%H:%M:%S')||CASE WHEN
 page_id % 2 = 1 AND page_id % 1000 > 0 THEN printf('.%06d', page_id % 1000) ELSE '' END||'+00:00'
 AS captured FROM pages"""

_MANIFEST_SQL = """'{"artifacts":[{"kind":"metadata","media_type":"text/plain","name":"address.txt",'||
 '"sha256":"'||sha256(url)||'","size_bytes":'||octet_length(encode(url))||'},{"kind":"dom",'||
 '"media_type":"text/html","name":"dom.html","sha256":"'||sha256(html)||'","size_bytes":'||
 octet_length(encode(html))||'}],"capture":{"bundle_id":"'||bundle_id||'","capture_id":"'||
 capture_id||'","captured_at":"'||captured||'","source_url":'||CAST(to_json(url) AS VARCHAR)||
 ',"tenant_id":"'||tenant_id||'","trace_id":"'||trace_id||'"},"hash_algorithm":"sha256",'||
 '"render_params":null,"spec":"evidence-manifest-v1"}'"""
_SEALED = f"SELECT *, {_MANIFEST_SQL} AS manifest, sha256({_MANIFEST_SQL}) AS manifest_sha256 FROM ({_P})"


def _sealed(spark, sf):
    return evidence.build_manifests(_bundles(spark, sf), _artifacts(spark, sf))


@query(
    "artifact_hashes",
    f"""SELECT bundle_id, 'dom.html' AS name, 'text/html' AS media_type,
 CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, sha256(html) AS sha256 FROM ({_P})
 UNION ALL SELECT bundle_id, 'address.txt', 'text/plain',
 CAST(octet_length(encode(url)) AS BIGINT), sha256(url) FROM ({_P})""",
)
def artifact_hashes(spark, sf):
    return _artifacts(spark, sf).drop("tenant_id", "kind")


@query("manifest_build", f"SELECT bundle_id, manifest FROM ({_SEALED})")
def manifest_build(spark, sf):
    """The exact text that is hashed and archived."""
    return _sealed(spark, sf).select("bundle_id", "manifest")


@query("manifest_digest", f"SELECT bundle_id, manifest_sha256 FROM ({_SEALED})")
def manifest_digest(spark, sf):
    return _sealed(spark, sf).select("bundle_id", "manifest_sha256")


@query(
    "manifest_refusals",
    """SELECT 'b'||page_id AS bundle_id, CASE WHEN page_id % 11 = 0 THEN 'no artifacts'
 WHEN page_id % 7 = 0 THEN 'duplicate name' WHEN page_id % 5 = 0 THEN 'malformed digest'
 WHEN page_id % 3 = 0 THEN 'negative size' END AS refusal FROM pages""",
)
def manifest_refusals(spark, sf):
    """Bundles that may not be sealed, and why."""
    number = F.substring("bundle_id", 2, 20).cast("long")
    files = (
        _artifacts(spark, sf)
        .where(number % 11 != 0)
        .withColumn("name", F.when(number % 7 == 0, F.lit("same")).otherwise(F.col("name")))
        .withColumn("sha256", F.when(number % 5 == 0, F.upper("sha256")).otherwise(F.col("sha256")))
        .withColumn("size_bytes", F.when(number % 3 == 0, -F.col("size_bytes")).otherwise(
            F.col("size_bytes")))
    )
    return evidence.manifest_lists(_bundles(spark, sf), files).select("bundle_id", "refusal")


def _observed(spark, sf):
    """What the archives hold: some files changed, some gone, some that nobody listed."""
    number = F.substring("bundle_id", 2, 20).cast("long")
    files = _artifacts(spark, sf).select(*KEY, "name", "sha256")
    kept = files.where(~((number % 19 == 0) & (F.col("name") == "address.txt"))).withColumn(
        "sha256",
        F.when((number % 13 == 0) & (F.col("name") == "dom.html"), F.sha2("bundle_id", 256))
        .otherwise(F.col("sha256")),
    )
    extra = (
        files.where((number % 17 == 0) & (F.col("name") == "dom.html"))
        .withColumn("name", F.lit("planted.txt"))
    )
    return kept.unionByName(extra)


@query(
    "manifest_verify",
    """SELECT 'b'||page_id AS bundle_id, 'address.txt' AS name, 'missing' AS problem FROM pages
 WHERE page_id % 19 = 0 UNION ALL SELECT 'b'||page_id, 'dom.html', 'mismatch' FROM pages
 WHERE page_id % 13 = 0 UNION ALL SELECT 'b'||page_id, 'planted.txt', 'unlisted' FROM pages
 WHERE page_id % 17 = 0""",
)
def manifest_verify(spark, sf):
    """Manifest against archive in both directions, and by digest."""
    parsed = evidence.parse_manifests(_sealed(spark, sf))
    found = evidence.compare_artifacts(evidence.listed_artifacts(parsed), _observed(spark, sf))
    return found.select("bundle_id", "name", "problem")


# ---------------------------------------------------------------- the chain

GENESIS_SQL = "repeat('0', 64)"


def _entry_sql(tag: str, tenant: str, index: str, prev: str, *fields: str) -> str:
    return (
        "sha256("
        + prefixed_sql(f"'{tag}'", "'sha256'", tenant, f"CAST({index} AS VARCHAR)", prev, *fields)
        + ")"
    )


_LINK0 = _entry_sql("evidence-chain-v1", "tenant_id", "i", GENESIS_SQL, "manifest_sha256", "bundle_id")
_LINK = _entry_sql(
    "evidence-chain-v1", "s.tenant_id", "s.i", "c.entry_hash", "s.manifest_sha256", "s.bundle_id"
)
_CHAIN = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT tenant_id, bundle_id, manifest_sha256, page_id,
 row_number() OVER (PARTITION BY tenant_id ORDER BY page_id) - 1 AS i FROM ({_SEALED})),
c AS (SELECT tenant_id, bundle_id, manifest_sha256, page_id, i, {GENESIS_SQL} AS prev_hash,
 {_LINK0} AS entry_hash FROM s WHERE i = 0 UNION ALL
 SELECT s.tenant_id, s.bundle_id, s.manifest_sha256, s.page_id, s.i, c.entry_hash, {_LINK}
 FROM c JOIN s ON s.tenant_id = c.tenant_id AND s.i = c.i + 1),
chain AS (SELECT tenant_id, bundle_id, manifest_sha256, page_id, CAST(i AS BIGINT) AS chain_index,
 prev_hash, entry_hash, 'sha256' AS algorithm FROM c)"""


def _chain(spark, sf):
    return materialise(chain.append(_sealed(spark, sf), ["page_id"], chain.EVIDENCE), "chain")


@query(
    "chain_append",
    _CHAIN + " SELECT tenant_id, chain_index, bundle_id, prev_hash, entry_hash FROM chain",
)
def chain_append(spark, sf):
    """Bundles linked onto each tenant's chain."""
    return chain.append(_sealed(spark, sf), ["page_id"], chain.EVIDENCE).select(
        "tenant_id", "chain_index", "bundle_id", "prev_hash", "entry_hash"
    )


@query(
    "chain_append_to_heads",
    _CHAIN + " SELECT tenant_id, chain_index, bundle_id, entry_hash FROM chain",
)
def chain_append_to_heads(spark, sf):
    """The same chain written in two runs, the second starting from the stored heads."""
    sealed = _sealed(spark, sf)
    first_half = F.col("page_id") % 64 < 32
    early, late = sealed.where(first_half), sealed.where(~first_half)
    first = chain.append(early, ["page_id"], chain.EVIDENCE)
    second = chain.append(late, ["page_id"], chain.EVIDENCE, chain.heads(first))
    return first.unionByName(second).select("tenant_id", "chain_index", "bundle_id", "entry_hash")


@query(
    "chain_verify",
    _CHAIN
    + """ SELECT tenant_id, count(*) AS entries, CAST(0 AS BIGINT) AS broken FROM chain
 GROUP BY 1""",
)
def chain_verify(spark, sf):
    checked = chain.verify(_chain(spark, sf), chain.EVIDENCE)
    return chain.verify_summary(checked).drop("first_broken")


def _tampered(spark, sf):
    """Some digests edited, some entries removed, some relinked."""
    i = F.col("chain_index")
    return (
        _chain(spark, sf)
        .where(i % 11 != 5)
        .withColumn(
            "manifest_sha256",
            F.when(i % 7 == 3, F.sha2("bundle_id", 256)).otherwise(F.col("manifest_sha256")),
        )
        .withColumn("prev_hash", F.when(i % 13 == 0, F.sha2("bundle_id", 256)).otherwise(
            F.col("prev_hash")))
    )


_RECOMPUTED = _entry_sql(
    "evidence-chain-v1", "tenant_id", "chain_index", "prev_hash", "manifest_sha256", "bundle_id"
)
_TAMPERED = (
    _CHAIN
    + f""", bad AS (SELECT tenant_id, bundle_id, chain_index, entry_hash,
 CASE WHEN chain_index % 7 = 3 THEN sha256(bundle_id) ELSE manifest_sha256 END AS manifest_sha256,
 CASE WHEN chain_index % 13 = 0 THEN sha256(bundle_id) ELSE prev_hash END AS prev_hash
 FROM chain WHERE chain_index % 11 <> 5), v AS (SELECT *,
 entry_hash = {_RECOMPUTED} AS hash_ok, lag(chain_index) OVER w AS pi, lag(entry_hash) OVER w AS ph
 FROM bad WINDOW w AS (PARTITION BY tenant_id ORDER BY chain_index)), flags AS (SELECT tenant_id,
 bundle_id, chain_index, hash_ok, pi IS NOT NULL OR chain_index <> 0 OR prev_hash = {GENESIS_SQL}
 AS genesis_ok, pi IS NULL OR chain_index = pi + 1 AS index_ok, ph IS NULL OR prev_hash = ph
 AS link_ok, pi FROM v)"""
)


@query(
    "chain_verify_tampered",
    _TAMPERED
    + """ SELECT tenant_id, chain_index, hash_ok, genesis_ok, index_ok, link_ok FROM flags""",
)
def chain_verify_tampered(spark, sf):
    """Edited, removed and relinked entries are all seen."""
    checked = chain.verify(_tampered(spark, sf), chain.EVIDENCE)
    return checked.select(
        "tenant_id", "chain_index", "hash_ok", "genesis_ok", "index_ok", "link_ok"
    )


_FORGOTTEN = (
    _CHAIN
    + f""", bad AS (SELECT tenant_id, bundle_id, chain_index,
 CASE WHEN chain_index % 6 = 0 THEN NULL ELSE manifest_sha256 END AS manifest_sha256,
 CASE WHEN chain_index % 6 = 1 THEN NULL ELSE entry_hash END AS entry_hash,
 CASE WHEN chain_index % 6 = 2 THEN NULL ELSE prev_hash END AS prev_hash,
 CASE WHEN chain_index % 6 = 3 THEN NULL ELSE 'sha256' END AS algorithm FROM chain),
v AS (SELECT *, algorithm IS NOT NULL AND entry_hash = {_RECOMPUTED} AS h,
 lag(chain_index) OVER w AS pi, lag(entry_hash) OVER w AS ph
 FROM bad WINDOW w AS (PARTITION BY tenant_id ORDER BY chain_index))
SELECT tenant_id, chain_index, coalesce(h, false) AS hash_ok,
 coalesce(pi IS NOT NULL OR (prev_hash IS NOT NULL AND chain_index <> 0) OR prev_hash = {GENESIS_SQL}, false)
 AS genesis_ok, pi IS NULL OR chain_index = pi + 1 AS index_ok,
 pi IS NULL OR coalesce(prev_hash = ph, false) AS link_ok FROM v"""
)


@query("chain_verify_nulls", _FORGOTTEN)
def chain_verify_nulls(spark, sf):
    """Entries that lost a field are as unsound as edited ones."""
    kept = _chain(spark, sf)
    lost = {"manifest_sha256": 0, "entry_hash": 1, "prev_hash": 2, "algorithm": 3}
    for name, rest in lost.items():
        kept = kept.withColumn(name, F.when(F.col("chain_index") % 6 != rest, F.col(name)))
    return chain.verify(kept, chain.EVIDENCE).select(
        "tenant_id", "chain_index", "hash_ok", "genesis_ok", "index_ok", "link_ok"
    )


@query(
    "chain_refused",
    f"""SELECT bundle_id, page_id % 6 > 1 AS linked FROM ({_SEALED})""",
)
def chain_refused(spark, sf):
    """Malformed and missing digests are set aside and never linked."""
    pid = F.col("page_id")
    rows = _sealed(spark, sf).withColumn(
        "manifest_sha256",
        F.when(pid % 6 == 0, F.upper("manifest_sha256")).when(pid % 6 > 1, F.col("manifest_sha256")),
    )
    linked = chain.append(rows, ["page_id"], chain.EVIDENCE)
    return linked.select("bundle_id", F.lit(True).alias("linked")).unionByName(
        chain.refused_entries(rows).select("bundle_id", F.lit(False).alias("linked"))
    )


@query(
    "chain_head",
    _CHAIN
    + """ SELECT tenant_id, max(chain_index) AS chain_index, arg_max(entry_hash, chain_index)
 AS entry_hash FROM chain GROUP BY 1""",
)
def chain_head(spark, sf):
    return chain.heads(_chain(spark, sf)).select("tenant_id", "chain_index", "entry_hash")


@query(
    "chain_segment",
    _CHAIN + " SELECT tenant_id, chain_index, entry_hash FROM chain WHERE chain_index BETWEEN 3 AND 12",
)
def chain_segment(spark, sf):
    return chain.segment(_chain(spark, sf), 3, 12).select("tenant_id", "chain_index", "entry_hash")


def _anchors(spark, sf):
    """Every entry whose page number ends in 0 was anchored; one tenant never anchors."""
    return (
        _chain(spark, sf)
        .where((F.col("page_id") % 10 == 0) & (F.col("tenant_id") != "t2"))
        .select(
            "tenant_id", "chain_index",
            F.timestamp_seconds(F.col("page_id") * 60).alias("anchored_at"),
            F.lit("https://tsa.example.org").alias("authority_url"),
        )
    )


@query(
    "anchor_lag",
    _CHAIN
    + """, h AS (SELECT tenant_id, max(chain_index) AS head_index, max(chain_index) FILTER
 (WHERE page_id % 10 = 0 AND tenant_id <> 't2') AS anchored_index FROM chain GROUP BY 1),
t AS (SELECT DISTINCT 't'||(page_id // 50) AS tenant_id FROM pages)
SELECT t.tenant_id, head_index, anchored_index, head_index - anchored_index AS behind,
 CASE WHEN head_index IS NULL THEN 'empty' WHEN anchored_index IS NULL THEN 'never'
 WHEN head_index = anchored_index THEN 'current' ELSE 'behind' END AS state
 FROM t LEFT JOIN h ON h.tenant_id = t.tenant_id""",
)
def anchor_lag(spark, sf):
    tenants = table(spark, sf, "pages").select(
        F.concat(F.lit("t"), F.expr("page_id div 50").cast("string")).alias("tenant_id")
    ).distinct()
    return chain.anchor_lag(tenants, _chain(spark, sf), _anchors(spark, sf))


@query(
    "anchors_due",
    _CHAIN
    + """, h AS (SELECT tenant_id, max(chain_index) AS chain_index, max(chain_index) FILTER
 (WHERE page_id % 10 = 0 AND tenant_id <> 't2') AS done FROM chain GROUP BY 1)
SELECT tenant_id, chain_index FROM h WHERE done IS NULL OR done <> chain_index""",
)
def anchors_due(spark, sf):
    due = chain.due_for_anchor(_chain(spark, sf), _anchors(spark, sf))
    return due.select("tenant_id", "chain_index")


# ---------------------------------------------------------------- bundles


def _tokens(spark, sf):
    """Two thirds have a token; some attest to another digest, some do not validate."""
    pid = F.col("page_id")
    return _sealed(spark, sf).where(pid % 3 != 0).select(
        *KEY,
        F.when(pid % 10 == 4, F.sha2("bundle_id", 256)).otherwise(F.col("manifest_sha256")).alias(
            "manifest_sha256"
        ),
        F.when(pid % 10 == 5, F.lit(None)).when(pid % 10 == 7, F.lit(False))
        .otherwise(F.lit(True)).alias("validates"),
        F.lit("https://tsa.example.org").alias("authority_url"),
        F.col("captured_at").alias("obtained_at"),
        F.encode("bundle_id", "UTF-8").alias("token"),
    )


@query(
    "bundle_outcomes",
    _TAMPERED
    + """, k AS (SELECT page_id, tenant_id, bundle_id, CAST(row_number() OVER (PARTITION BY tenant_id
 ORDER BY page_id) - 1 AS BIGINT) AS i FROM s), spoil AS (
 SELECT tenant_id, unnest([chain_index - 1, chain_index, chain_index + 1]) AS i FROM flags
 WHERE NOT hash_ok UNION SELECT tenant_id, unnest([chain_index - 1, chain_index]) FROM flags
 WHERE NOT link_ok AND pi = chain_index - 1 UNION
 SELECT tenant_id, unnest([chain_index, chain_index + 1]) FROM flags WHERE NOT genesis_ok),
 o AS (SELECT k.bundle_id, page_id, NOT (page_id % 13 = 0 OR page_id % 17 = 0 OR page_id % 19 = 0)
 AS manifest_ok, k.i % 11 <> 5 AND k.i % 7 <> 3 AND NOT EXISTS (SELECT 1 FROM spoil
 WHERE spoil.tenant_id = k.tenant_id AND spoil.i = k.i) AS chain_ok,
 page_id % 3 <> 0 AND page_id % 10 <> 5 AS has_token, page_id % 3 <> 0 AND
 page_id % 10 NOT IN (4, 5, 7) AS tsa_ok FROM k)
SELECT bundle_id, manifest_ok, chain_ok, tsa_ok, CASE WHEN NOT manifest_ok OR NOT chain_ok
 THEN 'failed' WHEN tsa_ok THEN 'verified' WHEN has_token THEN 'failed' ELSE 'incomplete' END
 AS outcome FROM o""",
)
def bundle_outcomes(spark, sf):
    """verified, failed or incomplete for every bundle, against tampered stores."""
    out = evidence.verify_bundles(
        _sealed(spark, sf), _observed(spark, sf), _tampered(spark, sf), _tokens(spark, sf)
    )
    return out.select("bundle_id", "manifest_ok", "chain_ok", "tsa_ok", "outcome")


@query(
    "token_disagreements",
    "SELECT 'b'||page_id AS bundle_id FROM pages WHERE page_id % 3 <> 0 AND page_id % 10 = 4",
)
def token_disagreements(spark, sf):
    bad = evidence.token_disagreements(_sealed(spark, sf), _tokens(spark, sf))
    return bad.select("bundle_id")


@query(
    "bundles_for_review",
    _CHAIN
    + """ SELECT bundle_id, tenant_id, chain_index, entry_hash, page_id % 3 <> 0 AS has_timestamp
 FROM chain ORDER BY chain_index DESC, page_id DESC LIMIT 200""",
)
def bundles_for_review(spark, sf):
    """Newest links first, with whether any token exists."""
    shown = evidence.bundles_for_review(
        _sealed(spark, sf), _chain(spark, sf).drop("page_id", "manifest_sha256"),
        _tokens(spark, sf),
    )
    top = shown.orderBy(F.desc("chain_index"), F.desc("page_id")).limit(200)
    return top.select("bundle_id", "tenant_id", "chain_index", "entry_hash", "has_timestamp")


@query(
    "bundle_without_chain",
    _CHAIN + " SELECT bundle_id FROM chain WHERE chain_index % 11 = 5",
)
def bundle_without_chain(spark, sf):
    lost = evidence.without_chain_row(_sealed(spark, sf), _tampered(spark, sf))
    return lost.select("bundle_id")


@query(
    "bundle_counts",
    """SELECT 't'||(page_id // 64) AS tenant_id, count(*) AS bundles, count(*) FILTER (WHERE
 TIMESTAMP '2024-01-01' + to_minutes(page_id) > TIMESTAMP '2023-12-31 02:00:00' + INTERVAL 24 HOUR)
 AS bundles_last_24h FROM pages GROUP BY 1""",
)
def bundle_counts(spark, sf):
    now = F.lit("2024-01-02 02:00:00.000000").cast("timestamp")
    return evidence.bundle_counts(_bundles(spark, sf), now)


@query(
    "seal_documents",
    _CHAIN
    + """ SELECT bundle_id, chain_index, entry_hash, CASE WHEN page_id % 3 <> 0 THEN
 to_base64(encode(bundle_id)) END AS token FROM chain""",
)
def seal_documents(spark, sf):
    """The seal of every entry, read back from its JSON."""
    seals = evidence.seal_documents(_chain(spark, sf), _tokens(spark, sf))
    seal = F.col("seal")
    return seals.select(
        "bundle_id",
        F.get_json_object(seal, "$.chain.chain_index").cast("long").alias("chain_index"),
        F.get_json_object(seal, "$.chain.entry_hash").alias("entry_hash"),
        F.get_json_object(seal, "$.timestamps[0].token_base64").alias("token"),
    )


@query(
    "chain_quality",
    _TAMPERED
    + f""" SELECT tenant_id, chain_index, 'genesis_is_index_zero' AS violated FROM bad
 WHERE (chain_index = 0) <> (prev_hash = {GENESIS_SQL})""",
)
def chain_quality(spark, sf):
    """The chain table's own invariants."""
    found = quality.violations(_tampered(spark, sf), "hash_chain", ["tenant_id", "chain_index"])
    return found.select("tenant_id", "chain_index", F.explode("violated").alias("violated"))


# ---------------------------------------------------------------- archives


def _archive_bytes(spark, sf):
    """Archives as a capture service writes them: one gzip member per record.

    Some have a changed document, an unlisted record, no seal, or two seals.
    """
    seals = evidence.seal_documents(_chain(spark, sf), _tokens(spark, sf)).select(*KEY, "seal")
    rows = _sealed(spark, sf).join(seals, KEY).select(
        "page_id", "bundle_id", "source_url", "body", "manifest", "seal"
    )

    def member(uri: str, media: str, payload: bytes) -> bytes:
        head = (
            f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {uri}\r\n"
            f"Content-Type: {media}\r\nContent-Length: {len(payload)}\r\n\r\n"
        )
        return gzip.compress(head.encode() + payload + b"\r\n\r\n", 1, mtime=0)

    prefix = archives.URI_PREFIX

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                body = bytes(r.body) + (b"!" if r.page_id % 13 == 0 else b"")
                parts = [
                    member(f"{prefix}:manifest", "application/json", r.manifest.encode()),
                    member(f"{prefix}:artifact:address.txt", "text/plain", r.source_url.encode()),
                    member(f"{prefix}:artifact:dom.html", "text/html", body),
                ]
                if r.page_id % 17 == 0:
                    parts.append(member(f"{prefix}:artifact:planted", "text/plain", b"x"))
                if r.page_id % 19 != 0:
                    if r.page_id % 2 == 0:
                        parts.append(member(f"{prefix}:seal", "application/json", b"{}"))
                    parts.append(member(f"{prefix}:seal", "application/json", r.seal.encode()))
                yield r.bundle_id, b"".join(parts)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return archives.framed(packed(batches), ["path", "content"])

    return rows.mapInPandas(write, "path string, content binary")


@query(
    "archive_scan",
    """SELECT 'b'||page_id AS path, 'address.txt' AS name, sha256(url) AS sha256 FROM pages UNION ALL
 SELECT 'b'||page_id, 'dom.html', sha256(CASE WHEN page_id % 13 = 0 THEN html||'!' ELSE html END)
 FROM pages UNION ALL SELECT 'b'||page_id, 'planted', sha256('x') FROM pages
 WHERE page_id % 17 = 0""",
)
def archive_scan(spark, sf):
    """Every artifact record of every archive, expected or not."""
    found = archives.artifacts(archives.read_archives(_archive_bytes(spark, sf)))
    return found.select("path", "name", text.bytes_digest(F.col("payload")).alias("sha256"))


def _archive_files(spark, sf):
    """The archives of all pages as eight files in the shared folder, written by tasks."""
    path = work_dir(spark, "archives")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, folder = archive_files.opened(path)
        files.create_dir(folder)
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        written = 0
        # a task that is repeated writes a file of its own; only files that a task has named are read
        with files.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for content in batch["content"]:
                    written += out.write(bytes(content))
        yield pd.DataFrame({"name": [name], "bytes": [written]})

    rows = _archive_bytes(spark, sf).repartition(8, "path")
    named = materialise(rows.mapInPandas(write, "name string, bytes long"), "archive-names")
    return path, named


def _split_of(size: int) -> int:
    """Bytes of a split: some hundred tasks, and more only where splits would pass the usual size."""
    return min(archive_files.SPLIT_BYTES, max(1 << 16, size // 96))


@query(
    "archive_files_scan",
    """SELECT 'address.txt' AS name, sha256(url) AS sha256, octet_length(encode(url)) AS size FROM pages UNION ALL
 SELECT 'dom.html', sha256(CASE WHEN page_id % 13 = 0 THEN html||'!' ELSE html END),
 octet_length(encode(html)) + CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END FROM pages UNION ALL
 SELECT 'planted', sha256('x'), 1 FROM pages WHERE page_id % 17 = 0""",
)
def archive_files_scan(spark, sf):
    """Size and digest of every artifact in archive files, many tasks to a file, no payload held."""
    path, named = _archive_files(spark, sf)
    split = _split_of(named.agg(F.sum("bytes").alias("n")).first().n or 0)
    found = archive_files.read(spark, path, split=split, payload=False)
    lead = f"{archives.URI_PREFIX}:artifact:"
    return (
        found.join(named.where("bytes > 0"), F.col("path") == F.col("name"), "left_semi")
        .where(F.col("uri").startswith(lead))
        .select(F.substr(F.col("uri"), F.lit(len(lead) + 1)).alias("name"), "sha256", "size")
    )


@query(
    "archive_seals",
    _CHAIN
    + """ SELECT bundle_id AS path, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT)
 AS seals, entry_hash FROM chain WHERE page_id % 19 <> 0""",
)
def archive_seals(spark, sf):
    """The last seal of each archive is the one that counts."""
    seals = archives.latest_seals(archives.read_archives(_archive_bytes(spark, sf)))
    return seals.select(
        "path", "seals",
        F.get_json_object(F.col("seal").cast("string"), "$.chain.entry_hash").alias("entry_hash"),
    )


@query(
    "archive_verify",
    """SELECT 'b'||page_id AS path, page_id % 13 <> 0 AND page_id % 17 <> 0 AS files_ok,
 page_id % 19 <> 0 AS sealed, page_id % 19 <> 0 AND page_id % 3 <> 0 AS stamped FROM pages""",
)
def archive_verify(spark, sf):
    """Each archive checked from its own records alone."""
    checked = evidence.verify_archives(archives.read_archives(_archive_bytes(spark, sf)))
    problems = F.col("problems")
    sealed = ~F.array_contains(problems, "no seal record")
    return checked.select(
        "path",
        (~F.array_contains(problems, "artifacts differ")).alias("files_ok"),
        sealed.alias("sealed"),
        (sealed & ~F.array_contains(problems, "no timestamp token")).alias("stamped"),
    )


@query(
    "archive_verify_damaged",
    """SELECT 'b'||page_id AS path, page_id % 5 < 4 AS damaged, page_id % 5 <> 3 AS manifest_read,
 CASE WHEN page_id % 5 = 3 THEN 0 ELSE 2 + CASE WHEN page_id % 17 = 0 THEN 1 ELSE 0 END END
 AS artifacts FROM pages""",
)
def archive_verify_damaged(spark, sf):
    """Damage is reported for the archive it is in, and what lies behind it is still read."""

    def damaged(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        junk = gzip.compress(b"left over\r\n", 1, mtime=0)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                content, kind = bytes(content), int(path[1:]) % 5
                if kind == 0:
                    content += gzip.compress(b"more", 1, mtime=0)[:-3]
                elif kind == 1:
                    content = junk + content
                elif kind == 2:
                    content += b"after the end"
                elif kind == 3:
                    content = b"\x1f\x8b" + content[20:]
                yield path, content

    def damage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return archives.framed(damaged(batches), ["path", "content"])

    files = _archive_bytes(spark, sf).mapInPandas(damage, "path string, content binary")
    records = archives.read_archives(files)
    found = archives.artifacts(records).groupBy("path").agg(F.count("*").alias("n"))
    problems = F.col("problems")
    return (
        evidence.verify_archives(records)
        .join(found, "path", "left")
        .select(
            "path",
            F.array_contains(problems, "archive damaged").alias("damaged"),
            (~F.array_contains(problems, "no manifest record")).alias("manifest_read"),
            F.coalesce("n", F.lit(0)).cast("int").alias("artifacts"),
        )
    )


@query(
    "capture_documents",
    """SELECT 'c'||(page_id % 100) AS capture_id, CASE WHEN max(page_id) % 7 = 0 THEN NULL ELSE
 sha256(arg_max(CASE WHEN page_id % 13 = 0 THEN html||'!' ELSE html END, page_id)) END
 AS document_sha256 FROM pages GROUP BY 1""",
)
def capture_documents(spark, sf):
    """The document of each capture, from its latest bundle; null where the archive is gone."""
    placed = _bundles(spark, sf).select(
        F.lit("t").alias("tenant_id"),
        F.concat(F.lit("c"), (F.col("page_id") % 100).cast("string")).alias("capture_id"),
        "bundle_id", "captured_at", F.col("bundle_id").alias("path"),
    )
    kept = _archive_bytes(spark, sf).where(F.substring("path", 2, 20).cast("long") % 7 != 0)
    documents = archives.capture_documents(placed, archives.read_archives(kept))
    return documents.select(
        "capture_id",
        text.bytes_digest(F.col("document")).alias("document_sha256"),
    )


@query(
    "recent_bundles",
    f"""SELECT bundle_id, source_url, captured_at FROM ({sample.BUNDLES_SQL})
 ORDER BY captured_at DESC, bundle_id DESC LIMIT 200""",
)
def recent_bundles(spark, sf):
    top = sample.bundles(spark, sf).orderBy(F.desc("captured_at"), F.desc("bundle_id")).limit(200)
    return top.select("bundle_id", "source_url", plain("captured_at").alias("captured_at"))
