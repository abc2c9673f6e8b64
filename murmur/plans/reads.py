"""Review, export, access, audit and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import access, burst, chain, collect, content, export, quality, review
from murmur.plans import sample
from murmur.plans.detection import DEFAULT, FINDING_ID, _POSITIONS_SQL
from murmur.plans.registry import plain, query, table
from murmur.plans.sample import BUNDLES_SQL, CAPTURES_SQL, bursts_sql
from murmur.plans.sealed import GENESIS_SQL, _entry_sql
from murmur.session import materialise

# ---------------------------------------------------------------- findings as stored


def _stored_findings(spark, sf):
    """(findings, members, evidence positions), with only evidenced clusters kept.

    Membership, positions and findings are written out once, as a detection run would; everything
    else reads them.
    """
    obs = sample.observations(spark, sf)
    inside = materialise(
        burst.members(obs, burst.burst_starts(obs, DEFAULT), DEFAULT), "members"
    )
    positions = materialise(
        review.evidence_positions(inside, sample.bundles(spark, sf)), "positions"
    )
    found = review.evidenced(burst.findings(inside, DEFAULT), positions)
    labelled = review.label_findings(
        found, F.concat(F.lit("tr-"), sample.hour_label(F.col("window_start"))),
        F.col("window_end"),
    )
    return materialise(labelled, "labelled"), inside, positions


_STORED = (
    bursts_sql()
    + _POSITIONS_SQL
    + f""", f0 AS (SELECT project_id, t AS s, n, a, e FROM win), f AS (SELECT {FINDING_ID}
 AS finding_id, s, n, a, e, make_timestamp(s) AS window_start, make_timestamp(e) AS window_end
 FROM f0 WHERE EXISTS (SELECT 1 FROM pos WHERE pos.s = f0.s)),
firsts AS (SELECT s, arg_min(bundle_id, rank) AS bundle_id, count(*) AS bundles FROM pos GROUP BY 1)"""
)


@query(
    "provenance_trace",
    _STORED
    + f""", x AS (SELECT f.finding_id, f.window_start, q.bundle_id, b2.capture_id,
 b2.source_url, b2.trace_id FROM f LEFT JOIN firsts q ON q.s = f.s
 LEFT JOIN ({BUNDLES_SQL}) b2 ON b2.bundle_id = q.bundle_id),
c1 AS (SELECT capture_id, count(*) AS n1 FROM obs GROUP BY 1),
c2 AS (SELECT last_capture_id, count(*) AS n2 FROM obs GROUP BY 1),
c3 AS (SELECT cap, count(DISTINCT tr) AS n3 FROM (SELECT capture_id AS cap, last_capture_id AS tr
 FROM obs UNION SELECT last_capture_id, last_capture_id FROM obs) GROUP BY 1)
SELECT finding_id, bundle_id AS claimed_bundle, x.capture_id, source_url,
 coalesce(n1, 0) AS items_from_this_capture, coalesce(n2, 0) AS items_still_pointing_here,
 coalesce(n3, 0) AS traces_that_touched_it, 'tr-'||strftime(window_start,'%Y%m%d%H') = x.trace_id
 AS trace_is_continuous FROM x LEFT JOIN c1 ON c1.capture_id = x.capture_id
 LEFT JOIN c2 ON c2.last_capture_id = x.capture_id LEFT JOIN c3 ON c3.cap = x.capture_id""",
)
def provenance_trace(spark, sf):
    """Every finding down to the capture and bundle it rests on."""
    findings, _, positions = _stored_findings(spark, sf)
    seen = sample.observations(spark, sf).withColumn("last_trace_id", F.col("last_capture_id"))
    traced = review.provenance(
        findings, review.first_refs(positions), sample.bundles(spark, sf), seen
    )
    return traced.drop("tenant_id", "chain_index", "traceable", "summary")


@query(
    "timeline",
    _STORED
    + f""" SELECT * FROM (SELECT 'capture' AS kind, requested_at AS at_time, trace_id,
 url AS label, status AS detail FROM ({CAPTURES_SQL})
 UNION ALL SELECT 'bundle', captured_at, trace_id, source_url, manifest_sha256 FROM ({BUNDLES_SQL})
 UNION ALL SELECT 'finding', window_end, 'tr-'||strftime(window_start,'%Y%m%d%H'),
 'burst windows', n||' items / '||a||' accounts' FROM f
 UNION ALL SELECT 'export', window_end + INTERVAL 1 HOUR, 'tr-'||strftime(window_start,'%Y%m%d%H'),
 'STIX 2.1', sha256(finding_id) FROM f WHERE n > 4)
 ORDER BY at_time DESC, kind, label, detail, trace_id LIMIT 200""",
)
def timeline(spark, sf):
    """Captures, bundles, findings and exports on one axis; the newest 200."""
    findings, _, _ = _stored_findings(spark, sf)
    exports = findings.where("item_count > 4").select(
        "trace_id",
        (F.col("window_end") + F.expr("interval 1 hour")).alias("created_at"),
        F.sha2("finding_id", 256).alias("bundle_sha256"),
    )
    line = review.timeline(
        sample.captures(spark, sf), sample.bundles(spark, sf), findings, exports
    )
    return line.select(
        "kind", plain("at").alias("at_time"), "trace_id", "label", "detail"
    )


@query(
    "dashboard",
    _STORED
    + f""" SELECT (SELECT count(*) FROM obs) AS content, (SELECT count(DISTINCT account_id) FROM obs)
 AS accounts, (SELECT count(*) FROM f) AS findings, (SELECT count(*) FROM f) AS shadow_findings,
 (SELECT count(*) FROM ({BUNDLES_SQL})) AS bundles, (SELECT count(*) FROM ({BUNDLES_SQL}) WHERE
 captured_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR) AS bundles_last_24h,
 (SELECT count(DISTINCT user_id % 20) FROM events) AS sources, (SELECT count(DISTINCT user_id % 20)
 FROM events WHERE user_id % 20 % 7 <> 3) AS sources_enabled""",
)
def dashboard(spark, sf):
    """The counts of one tenant in one row."""
    from murmur.operators import evidence

    findings, _, _ = _stored_findings(spark, sf)
    obs = sample.observations(spark, sf)
    sources = sample.job_sources(spark, sf).groupBy("tenant_id").agg(
        F.count("*").alias("sources"), F.count_if("enabled").alias("sources_enabled")
    )
    tenants = sources.select("tenant_id")
    accounts = obs.select("tenant_id", "account_id").distinct()
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    none = findings.where(F.lit(False)).groupBy("tenant_id").agg(F.count("*").alias("exports"))
    board = review.dashboard(
        tenants, sources, content.counts(obs, accounts), review.finding_counts(findings),
        evidence.bundle_counts(sample.bundles(spark, sf), now), none,
    )
    return board.drop("tenant_id", "exports")


# ---------------------------------------------------------------- graph


@query(
    "coparticipation_members",
    _STORED
    + """, m AS (SELECT DISTINCT f.finding_id, i.account_id FROM inside i JOIN f ON f.s = i.s)
SELECT finding_id, account_id, 'handle '||account_id AS handle,
 count(*) OVER (PARTITION BY finding_id) - 1 AS linked_to FROM m""",
)
def coparticipation_members(spark, sf):
    """Who took part in which finding; each is linked to all others of it."""
    return _graph(spark, sf).drop("tenant_id", "members")


def _graph(spark, sf):
    findings, inside, _ = _stored_findings(spark, sf)
    members = burst.finding_accounts(inside).join(
        findings.select("finding_id"), "finding_id", "left_semi"
    )
    who = sample.observations(spark, sf).select("tenant_id", "account_id").distinct().withColumn(
        "handle", F.concat(F.lit("handle "), "account_id")
    )
    return review.graph_members(members, who)


@query(
    "graph_summary",
    _STORED
    + """, m AS (SELECT DISTINCT f.finding_id, i.account_id FROM inside i JOIN f ON f.s = i.s)
SELECT 't0' AS tenant_id, (SELECT count(DISTINCT account_id) FROM m) AS nodes,
 (SELECT count(*) FROM m x JOIN m y ON x.finding_id = y.finding_id
 AND x.account_id < y.account_id) AS edges, (SELECT count(DISTINCT finding_id) FROM m)
 AS clusters WHERE (SELECT count(*) FROM m) > 0""",
)
def graph_summary(spark, sf):
    return review.graph_summary(_graph(spark, sf))


# ---------------------------------------------------------------- verdicts

_VERDICT = """CASE WHEN quality = 1 AND toxic = 1 THEN 'confirmed_coordination' WHEN quality = 1
 THEN 'likely_coordination' WHEN toxic = 1 THEN 'insufficient_evidence' ELSE 'no_coordination' END"""
_VERDICTS_SQL = f"""SELECT doc_id AS finding_id, 2 * doc_id AS verdict_id, {_VERDICT} AS verdict,
 TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS decided_at FROM labels UNION ALL
 SELECT doc_id, 2 * doc_id + 1, CASE WHEN doc_id % 6 = 0 THEN 'no_coordination' ELSE
 'likely_coordination' END, TIMESTAMP '2024-01-01' + to_minutes(doc_id + CASE WHEN doc_id % 2 = 0
 THEN 0 ELSE 60 END) FROM labels WHERE doc_id % 3 = 0"""


def _verdicts(spark, sf):
    """A verdict for every label; a third are decided again, half of those at the same time."""
    labels = table(spark, sf, "labels")
    doc = F.col("doc_id")
    base = F.lit(1704067200)
    first = labels.select(
        doc.alias("finding_id"), (2 * doc).alias("verdict_id"),
        F.expr(_VERDICT).alias("verdict"),
        F.timestamp_seconds(base + doc * 60).alias("decided_at"),
    )
    again = labels.where(doc % 3 == 0).select(
        doc.alias("finding_id"), (2 * doc + 1).alias("verdict_id"),
        F.when(doc % 6 == 0, F.lit("no_coordination")).otherwise(F.lit("likely_coordination"))
        .alias("verdict"),
        F.timestamp_seconds(base + (doc + F.when(doc % 2 == 0, 0).otherwise(60)) * 60).alias(
            "decided_at"
        ),
    )
    return first.unionByName(again)


@query(
    "current_verdicts",
    f"""SELECT finding_id, verdict_id, verdict, decided_at FROM (SELECT *, row_number() OVER (
 PARTITION BY finding_id ORDER BY decided_at DESC, verdict_id DESC) AS rn FROM ({_VERDICTS_SQL}))
 WHERE rn = 1""",
)
def current_verdicts(spark, sf):
    latest = review.current_verdicts(_verdicts(spark, sf))
    return latest.withColumn("decided_at", plain("decided_at"))


@query("verdict_history", f"SELECT * FROM ({_VERDICTS_SQL})")
def verdict_history(spark, sf):
    history = review.verdict_history(_verdicts(spark, sf))
    return history.withColumn("decided_at", plain("decided_at"))


@query(
    "verdicts_refused",
    f"SELECT finding_id FROM ({_VERDICTS_SQL}) WHERE verdict = 'insufficient_evidence'",
)
def verdicts_refused(spark, sf):
    """Only the known verdict values may be appended."""
    odd = _verdicts(spark, sf).withColumn(
        "verdict", F.when(F.col("verdict") == "insufficient_evidence", F.lit("maybe")).otherwise(
            F.col("verdict"))
    )
    return review.check_verdicts(odd)[1].select("finding_id")


def _decided(findings):
    """Verdicts on burst findings, by the size of the cluster; some wait."""
    size = F.col("item_count") * 10 + F.col("account_count")
    verdict = (
        F.when(size % 5 == 3, F.lit("confirmed_coordination"))
        .when(size % 5 == 4, F.lit("likely_coordination"))
        .when(size % 5 == 0, F.lit("no_coordination"))
    )
    return findings.select(
        "finding_id", F.lit("v").alias("verdict_id"), verdict.alias("verdict"),
        F.col("window_end").alias("decided_at"),
    ).where(F.col("verdict").isNotNull())


_DECIDED = """, d AS (SELECT finding_id, s, n, a, CASE (n * 10 + a) % 5 WHEN 3 THEN
 'confirmed_coordination' WHEN 4 THEN 'likely_coordination' WHEN 0 THEN 'no_coordination' END
 AS verdict FROM f)"""


@query(
    "review_queue",
    _STORED + _DECIDED + """ SELECT finding_id, n AS item_count, verdict FROM d""",
)
def review_queue(spark, sf):
    findings, _, _ = _stored_findings(spark, sf)
    queue = review.review_queue(findings, _decided(findings))
    return queue.select("finding_id", "item_count", "verdict")


@query(
    "finding_detail",
    _STORED
    + _DECIDED
    + """, m AS (SELECT f.finding_id, i.account_id, count(*) AS c FROM inside i JOIN f ON f.s = i.s
 GROUP BY 1, 2) SELECT d.finding_id, string_agg(m.account_id||':'||m.c, ',' ORDER BY m.account_id)
 AS cluster, coalesce(any_value(d.verdict), '') AS verdicts FROM d JOIN m ON m.finding_id = d.finding_id GROUP BY 1""",
)
def finding_detail(spark, sf):
    """Each finding with its cluster and verdict history."""
    findings, inside, _ = _stored_findings(spark, sf)
    detail = review.finding_detail(findings, burst.finding_accounts(inside), _decided(findings))
    return detail.select(
        "finding_id",
        F.array_join(
            F.transform("cluster", lambda c: F.concat(c["account_id"], F.lit(":"),
                                                      c["item_count"].cast("string"))), ","
        ).alias("cluster"),
        F.coalesce(F.array_join("verdict_history.verdict", ","), F.lit("")).alias("verdicts"),
    )


@query(
    "recent_findings",
    _STORED
    + """ SELECT finding_id, window_end AS detected_at FROM f ORDER BY window_end DESC,
 finding_id DESC LIMIT 100""",
)
def recent_findings(spark, sf):
    findings, _, _ = _stored_findings(spark, sf)
    top = collect.newest(findings, "detected_at", "finding_id", 100)
    return top.select("finding_id", plain("detected_at").alias("detected_at"))


# ---------------------------------------------------------------- export


def _gated(spark, sf):
    findings, inside, positions = _stored_findings(spark, sf)
    gated = export.export_gate(
        findings, review.current_verdicts(_decided(findings)), review.first_refs(positions)
    )
    return gated, inside, positions


@query(
    "export_gate",
    _STORED
    + _DECIDED
    + """ SELECT finding_id, verdict, CASE WHEN verdict IN ('confirmed_coordination',
 'likely_coordination') THEN NULL ELSE 'verdict is '||coalesce(verdict, 'missing') END AS refusal
 FROM d""",
)
def export_gate(spark, sf):
    return _gated(spark, sf)[0].select("finding_id", "verdict", "refusal")


@query(
    "export_refusals",
    _STORED
    + _DECIDED
    + """ SELECT CASE WHEN verdict IN ('confirmed_coordination', 'likely_coordination') THEN
 'exported' ELSE 'verdict is '||coalesce(verdict, 'missing') END AS reason, count(*) AS findings
 FROM d GROUP BY 1""",
)
def export_refusals(spark, sf):
    """How many findings went out or were held, by reason."""
    return export.gate_report(_gated(spark, sf)[0]).drop("tenant_id")


def _bundles(spark, sf):
    gated, inside, positions = _gated(spark, sf)
    who = sample.observations(spark, sf).select("tenant_id", "account_id").distinct().select(
        "tenant_id", "account_id", F.lit("html").alias("platform"),
        F.concat(F.lit("handle “"), "account_id", F.lit("”")).alias("handle"),
    ).where(~F.col("account_id").endswith("7"))
    members = export.export_members(burst.finding_accounts(inside), who)
    sealed = sample.bundles(spark, sf).select(
        "tenant_id", "bundle_id", "source_url", "manifest_sha256"
    )
    proofs = positions.join(sealed, ["tenant_id", "bundle_id"])
    return export.build_bundles(gated, members, proofs)


@query(
    "export_objects",
    _STORED
    + _DECIDED
    + """, m AS (SELECT f.finding_id, count(DISTINCT i.account_id) FILTER
 (WHERE i.account_id NOT LIKE '%7') AS c FROM inside i JOIN f ON f.s = i.s GROUP BY 1)
SELECT d.finding_id, 5 + m.c + q.bundles AS object_count, m.c AS accounts, q.bundles AS evidence,
 CAST(d.n AS VARCHAR) AS number_observed FROM d JOIN m ON m.finding_id = d.finding_id
 JOIN firsts q ON q.s = d.s WHERE verdict IN ('confirmed_coordination', 'likely_coordination')""",
)
def export_objects(spark, sf):
    """The objects of each exported bundle, counted in the written JSON."""
    def objects_of(kind: str):
        found = F.regexp_count("bundle_json", F.lit(f'"type":"{kind}"'))
        return found.cast("long")

    return _bundles(spark, sf).select(
        "finding_id", "object_count",
        objects_of("x-social-account").alias("accounts"),
        objects_of("x-evidence-bundle").alias("evidence"),
        F.regexp_extract("bundle_json", r'"number_observed":(\d+)', 1).alias("number_observed"),
    )


@query("export_digests")
def export_digests(spark, sf):
    """The bundle texts themselves with their digests."""
    return _bundles(spark, sf).select("finding_id", "bundle_sha256", "bundle_json")


# ---------------------------------------------------------------- audit


def _audit_rows(spark, sf):
    """Conversation turns as audited actions; 64 conversations in a row are one tenant's."""
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("t"), F.expr("conv_id div 64").cast("string")).alias("tenant_id"),
        F.concat_ws("-", c.cast("string"), t.cast("string")).alias("entry_id"),
        F.concat(F.lit("actor"), (c % 9).cast("string")).alias("actor_id"),
        F.col("role").alias("action"),
        F.lit("conversation").alias("resource_type"),
        c.cast("string").alias("resource_id"),
        F.when(F.col("role") == "system", "denied").otherwise("allowed").alias("outcome"),
        F.timestamp_seconds(F.lit(1704067200) + c * 3600 + t).alias("occurred_at"),
        F.col("text").alias("reason"),
    )


_AUDIT_ROWS = """SELECT 't'||(conv_id // 64) AS tenant_id, conv_id||'-'||turn AS entry_id,
 'actor'||(conv_id % 9) AS actor_id, role AS action, 'conversation' AS resource_type,
 CAST(conv_id AS VARCHAR) AS resource_id, CASE role WHEN 'system' THEN 'denied' ELSE 'allowed' END
 AS outcome, strftime(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn),
 '%Y-%m-%dT%H:%M:%S.000000Z') AS occurred, row_number() OVER (PARTITION BY conv_id // 64
 ORDER BY conv_id, turn) - 1 AS i FROM conversations"""
_AUDIT_FIELDS = [
    "entry_id", "actor_id", "action", "resource_type", "resource_id", "outcome", "occurred",
]
_AUDIT = f"""WITH RECURSIVE s AS MATERIALIZED ({_AUDIT_ROWS}), c AS (SELECT s.*, {GENESIS_SQL}
 AS prev_hash, {_entry_sql("audit-chain-v1", "tenant_id", "i", GENESIS_SQL, *_AUDIT_FIELDS)}
 AS entry_hash FROM s WHERE i = 0 UNION ALL SELECT s.*, c.entry_hash,
 {_entry_sql("audit-chain-v1", "s.tenant_id", "s.i", "c.entry_hash",
             *[f"s.{f}" for f in _AUDIT_FIELDS])}
 FROM c JOIN s ON s.tenant_id = c.tenant_id AND s.i = c.i + 1)"""


def _audit_chain(spark, sf):
    rows = chain.with_occurred_text(_audit_rows(spark, sf))
    return chain.append(rows, ["conv_id", "turn"], chain.AUDIT)


@query(
    "audit_append",
    _AUDIT + " SELECT tenant_id, CAST(i AS BIGINT) AS chain_index, entry_id, entry_hash FROM c",
)
def audit_append(spark, sf):
    return _audit_chain(spark, sf).select("tenant_id", "chain_index", "entry_id", "entry_hash")


@query(
    "audit_verify",
    _AUDIT
    + f""", v AS (SELECT tenant_id, i, entry_hash, prev_hash, {_entry_sql("audit-chain-v1",
    "tenant_id", "i", "prev_hash", "entry_id", "actor_id",
    "CASE WHEN i % 9 = 4 THEN 'edited' ELSE action END", *_AUDIT_FIELDS[3:])} = entry_hash AS ok
 FROM c) SELECT tenant_id, count(*) AS entries, count(*) FILTER (WHERE NOT ok) AS broken,
 CAST(min(i) FILTER (WHERE NOT ok) AS BIGINT) AS first_broken FROM v GROUP BY 1""",
)
def audit_verify(spark, sf):
    """Edited actions are seen; the free-text reason is not part of the hash."""
    edited = _audit_chain(spark, sf).withColumn(
        "action",
        F.when(F.col("chain_index") % 9 == 4, F.lit("edited")).otherwise(F.col("action")),
    )
    return chain.verify_summary(chain.verify(edited, chain.AUDIT))


@query(
    "audit_verify_nulls",
    _AUDIT
    + f""", v AS (SELECT tenant_id, i, coalesce({_entry_sql("audit-chain-v1",
    "tenant_id", "i", "prev_hash", "entry_id", "actor_id",
    "CASE WHEN i % 5 = 2 THEN NULL ELSE action END", *_AUDIT_FIELDS[3:])} = entry_hash, false) AS ok
 FROM c) SELECT tenant_id, count(*) AS entries, count(*) FILTER (WHERE NOT ok) AS broken,
 CAST(min(i) FILTER (WHERE NOT ok) AS BIGINT) AS first_broken FROM v GROUP BY 1""",
)
def audit_verify_nulls(spark, sf):
    """An action that was deleted is seen like one that was edited."""
    lost = _audit_chain(spark, sf).withColumn(
        "action", F.when(F.col("chain_index") % 5 != 2, F.col("action"))
    )
    return chain.verify_summary(chain.verify(lost, chain.AUDIT))


@query(
    "audit_recent",
    _AUDIT
    + """ SELECT tenant_id, CAST(i AS BIGINT) AS chain_index, entry_id FROM c
 ORDER BY i DESC, entry_id DESC LIMIT 100""",
)
def audit_recent(spark, sf):
    top = collect.newest(_audit_chain(spark, sf), "chain_index", "entry_id", 100)
    return top.select("tenant_id", "chain_index", "entry_id")


# ---------------------------------------------------------------- access


def _requests(spark, sf):
    """Events as access requests: the user asks for a permission in some tenant and project."""
    names = [*access.DATA_PERMISSIONS, "manage_users", "read_audit", "manage_rules"]
    uid, eid = F.col("user_id"), F.col("event_id")
    return table(spark, sf, "events").select(
        eid.alias("request_id"),
        F.concat(F.lit("u"), uid.cast("string")).alias("user_id"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (eid % 10 + 1).cast("int")).alias(
            "permission"
        ),
        F.concat(F.lit("t"), F.when(eid % 4 == 0, (uid + 1) % 3).otherwise(uid % 3).cast("string"))
        .alias("tenant_id"),
        F.when(eid % 6 != 0, F.concat(F.lit("p"), (eid % 5).cast("string"))).alias("project_id"),
        F.col("ts").cast("timestamp").alias("asked_at"),
    )


def _people(spark, sf):
    """Users with roles, assignments, projects and grants, all from the users in events."""
    who = table(spark, sf, "events").select("user_id").distinct()
    uid = F.col("user_id")
    name = F.concat(F.lit("u"), uid.cast("string"))
    roles = list(access.ROLE_PERMISSIONS)
    users = who.where(uid % 29 != 0).select(
        name.alias("user_id"), F.concat(F.lit("t"), (uid % 3).cast("string")).alias("tenant_id"),
        F.concat(name, F.lit("@example.org")).alias("email"),
        F.when(uid % 31 == 0, F.lit("2024-01-01").cast("timestamp")).alias("disabled_at"),
    )
    picks = F.array((uid % 6 + 1).cast("int"), (uid % 4 + 1).cast("int"))
    role_rows = who.select(
        name.alias("user_id"),
        F.explode(F.transform(picks, lambda i: F.element_at(
            F.array(*[F.lit(r) for r in roles]), i))).alias("role"),
    )
    assignments = who.select(
        name.alias("user_id"),
        F.explode(F.array(uid % 5, (uid + 2) % 5)).alias("p"),
    ).select("user_id", F.concat(F.lit("p"), F.col("p").cast("string")).alias("project_id"))
    projects = assignments.select("project_id").distinct().withColumn(
        "archived_at",
        F.when(F.col("project_id") == "p3", F.lit("2024-01-01").cast("timestamp")),
    )
    grants = who.where(uid % 2 == 0).select(
        name.alias("granted_to"),
        F.concat(F.lit("t"), ((uid + 1) % 3).cast("string")).alias("tenant_id"),
        F.array(F.lit("read_findings"), F.lit("read_content"), F.lit("manage_users")).alias(
            "permissions"
        ),
        F.timestamp_seconds(F.lit(1704067200) + (uid % 30) * 86400).alias("expires_at"),
        F.when(uid % 10 == 0, F.lit("2024-01-01").cast("timestamp")).alias("revoked_at"),
    )
    return users, role_rows, assignments, projects, grants


_ROLES = list(access.ROLE_PERMISSIONS)
_ROLE_LIST = "[" + ",".join(f"'{r}'" for r in _ROLES) + "]"
_PERMISSION_LIST = "[" + ",".join(
    f"'{p}'" for p in [*access.DATA_PERMISSIONS, "manage_users", "read_audit", "manage_rules"]
) + "]"
_GRANTED_ROWS = ",".join(f"('{r}','{p}')" for r, ps in access.ROLE_PERMISSIONS.items() for p in ps)
_DATA = ",".join(f"'{p}'" for p in access.DATA_PERMISSIONS)


@query(
    "access_decisions",
    f"""WITH who AS (SELECT DISTINCT user_id AS u FROM events), rp(role, permission) AS (
 VALUES {_GRANTED_ROWS}), ur AS (SELECT u, unnest([{_ROLE_LIST}[u % 6 + 1], {_ROLE_LIST}[u % 4 + 1]])
 AS role FROM who), q AS (SELECT event_id AS request_id, user_id AS u, ts AS asked_at,
 {_PERMISSION_LIST}[event_id % 10 + 1] AS permission, CASE WHEN event_id % 4 = 0
 THEN (user_id + 1) % 3 ELSE user_id % 3 END AS tenant, CASE WHEN event_id % 6 <> 0
 THEN event_id % 5 END AS project FROM events), x AS (SELECT q.*,
 u % 29 <> 0 AS known, u % 3 AS home, EXISTS (SELECT 1 FROM ur JOIN rp ON rp.role = ur.role
 WHERE ur.u = q.u AND rp.permission = q.permission) AS by_role, u % 2 = 0 AND u % 10 <> 0 AND
 (u + 1) % 3 = tenant AND permission IN ('read_findings','read_content','manage_users') AND
 asked_at < TIMESTAMP '2024-01-01' + to_days(CAST(u % 30 AS INTEGER)) AS by_grant,
 permission IN ({_DATA}) AS reads, project IN (u % 5, (u + 2) % 5) AND project <> 3 AS assigned FROM q),
 r AS (SELECT request_id, CASE WHEN NOT known THEN 'unknown user' WHEN tenant <> home AND
 NOT by_grant THEN 'other tenant' WHEN NOT by_role AND NOT by_grant THEN 'not granted'
 WHEN reads AND project IS NULL THEN 'no project named' WHEN reads AND NOT assigned
 THEN 'not assigned to project' ELSE 'granted' END AS reason FROM x)
SELECT request_id, reason, reason = 'granted' AS allowed FROM r""",
)
def access_decisions(spark, sf):
    """Allowed or denied, with the reason, for every request."""
    decided = access.decide(_requests(spark, sf), *_people(spark, sf))
    return decided.select("request_id", "reason", "allowed")


@query(
    "principals",
    f"""WITH who AS (SELECT DISTINCT user_id AS u FROM events), rp(role, permission) AS (
 VALUES {_GRANTED_ROWS}), ur AS (SELECT DISTINCT u, unnest([{_ROLE_LIST}[u % 6 + 1],
 {_ROLE_LIST}[u % 4 + 1]]) AS role FROM who), up AS (SELECT DISTINCT u, permission FROM ur
 JOIN rp ON rp.role = ur.role), ap AS (SELECT DISTINCT u, unnest([u % 5, (u + 2) % 5]) AS p FROM who)
SELECT 'u'||u AS user_id, (SELECT string_agg(role, ',' ORDER BY role) FROM ur WHERE ur.u = who.u)
 AS roles, (SELECT string_agg(permission, ',' ORDER BY permission) FROM up WHERE up.u = who.u)
 AS permissions, coalesce((SELECT string_agg('p'||p, ',' ORDER BY p) FROM ap WHERE ap.u = who.u
 AND p <> 3), '') AS projects FROM who WHERE u % 29 <> 0""",
)
def principals(spark, sf):
    """Users with their roles, permissions and live projects."""
    users, roles, assignments, projects, _ = _people(spark, sf)
    out = access.principals(users, roles, assignments, projects)
    return out.select(
        "user_id", F.array_join("roles", ",").alias("roles"),
        F.array_join("permissions", ",").alias("permissions"),
        F.array_join("project_ids", ",").alias("projects"),
    )


@query(
    "active_grants",
    """SELECT DISTINCT 'u'||user_id AS granted_to FROM events WHERE user_id % 2 = 0 AND
 user_id % 10 <> 0 AND TIMESTAMP '2024-01-10 12:00:00' < TIMESTAMP '2024-01-01' +
 to_days(CAST(user_id % 30 AS INTEGER))""",
)
def active_grants(spark, sf):
    grants = _people(spark, sf)[4]
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    return access.active_grants(grants, now).select("granted_to")


@query(
    "active_users",
    """SELECT DISTINCT 'u'||user_id AS user_id FROM events WHERE user_id % 29 <> 0
 AND user_id % 31 <> 0""",
)
def active_users(spark, sf):
    from murmur.sources import tables

    return tables.active_users(_people(spark, sf)[0]).select("user_id")


@query(
    "audit_of_decisions",
    f"""SELECT 't'||(CASE WHEN event_id % 4 = 0 THEN (user_id + 1) % 3 ELSE user_id % 3 END)
 AS tenant_id, count(*) AS entries, CAST(0 AS BIGINT) AS broken FROM events GROUP BY 1""",
)
def audit_of_decisions(spark, sf):
    """Every decision becomes one entry of its tenant's audit chain, which then verifies."""
    decided = access.decide(_requests(spark, sf), *_people(spark, sf))
    rows = access.audit_rows(
        decided.withColumns({"resource_type": F.lit("page"), "resource_id": F.col("project_id")})
    ).withColumn("entry_id", F.format_string("%015d", "entry_id"))
    entries = chain.append(chain.with_occurred_text(rows), ["entry_id"], chain.AUDIT)
    return chain.verify_summary(chain.verify(entries, chain.AUDIT)).drop("first_broken")


# ---------------------------------------------------------------- quality


@query(
    "quality_violations",
    """SELECT source_id, violated, count(*) AS rows FROM (SELECT 's'||(user_id % 20) AS source_id,
 unnest(list_filter([CASE WHEN event_id % 12 NOT BETWEEN 1 AND 10 THEN 'priority_range' END,
 CASE WHEN value * 30 < 60 THEN 'interval_sane' END,
 CASE WHEN event_type = 'view' THEN 'url_is_http' END], lambda x: x IS NOT NULL)) AS violated
 FROM events) GROUP BY 1, 2""",
)
def quality_violations(spark, sf):
    """Rows that break the invariants of the sources table, by rule."""
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("source_id"),
        (F.col("event_id") % 12).alias("priority"),
        (F.col("value") * 30).alias("interval_seconds"),
        F.when(F.col("event_type") == "view", F.lit("ftp://x")).otherwise(F.lit("https://x")).alias(
            "url"
        ),
    )
    broken = quality.violations(rows, "sources", ["source_id"])
    return (
        broken.select("source_id", F.explode("violated").alias("violated"))
        .groupBy("source_id", "violated").agg(F.count("*").alias("rows"))
    )


@query(
    "finding_quality",
    _STORED + " SELECT count(*) AS findings, CAST(0 AS BIGINT) AS violating FROM f",
)
def finding_quality(spark, sf):
    """Recorded findings obey the invariants of their table."""
    findings, _, positions = _stored_findings(spark, sf)
    full = findings.join(review.evidence_refs(positions), ["finding_id", "tenant_id"], "left")
    bad = quality.violations(full, "findings", ["finding_id"]).agg(
        F.count("*").alias("violating")
    )
    total = findings.agg(F.count("*").alias("findings"))
    return total.select("findings", F.lit(0).alias("k")).join(
        bad.withColumn("k", F.lit(0)), "k"
    ).drop("k")


@query(
    "uniqueness_violations",
    """SELECT 'html' AS platform, source||'/'||lang AS handle, count(*) AS rows FROM documents
 GROUP BY 1, 2 HAVING count(*) > 1""",
)
def uniqueness_violations(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.lit("html").alias("platform"), F.concat_ws("/", "source", "lang").alias("handle")
    )
    return quality.repeated(rows, ["platform", "handle"])


@query(
    "orphan_rows",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def orphan_rows(spark, sf):
    return quality.orphans(
        table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]
    ).select("doc_id")
