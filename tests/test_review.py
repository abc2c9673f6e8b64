"""Evidence order, provenance, graph, export bundles and access."""

import hashlib
import json
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from murmur.functions import ids
from murmur.operators import access, burst, export, review

BASE = datetime(2026, 8, 4, 9, 12)


def setup(spark):
    rows = [
        ("t", "p", "s1", "i1", "a1", "cap2", "cap9", BASE),
        ("t", "p", "s2", "i2", "a2", "cap1", None, BASE + timedelta(seconds=5)),
        ("t", "p", "s1", "i3", "a3", "cap2", "cap8", BASE + timedelta(seconds=9)),
        ("t", "p", "s1", "i4", "a1", "gone", "cap1", BASE + timedelta(seconds=9)),
        ("t", "q", "s1", "j1", "a1", "gone", None, BASE),
        ("t", "q", "s1", "j2", "a2", "gone", None, BASE),
        ("t", "q", "s1", "j3", "a3", "gone", None, BASE),
        ("t", "q", "s1", "j4", "a4", "gone", None, BASE),
    ]
    obs = spark.createDataFrame(
        [(*r, "second") for r in rows],
        "tenant_id string, project_id string, source_id string, content_id string, "
        "account_id string, capture_id string, last_capture_id string, posted_at timestamp, "
        "timestamp_precision string",
    )
    bundles = spark.createDataFrame(
        [("t", f"b{n}", f"cap{n}", f"https://x/{n}", f"d{n}", "tr", n) for n in (1, 2, 8)]
        + [("t", "b1", "cap9", "https://x/1", "d1", "tr", 1)],
        "tenant_id string, bundle_id string, capture_id string, source_url string, "
        "manifest_sha256 string, trace_id string, chain_index int",
    )
    inside = burst.members(obs, burst.burst_starts(obs))
    return obs, bundles, inside


def test_evidence_order_and_missing(spark):
    _, bundles, inside = setup(spark)
    found = burst.findings(inside)
    positions = review.evidence_positions(inside, bundles)
    (refs,) = review.evidence_refs(positions).collect()
    assert refs.evidence_refs == ["b1", "b2", "b8"]
    assert [r.project_id for r in review.unevidenced(found, positions).collect()] == ["q"]
    claims = positions.select("finding_id", "tenant_id", "bundle_id").unionByName(
        positions.select("finding_id", "tenant_id", F.lit("lost").alias("bundle_id"))
    )
    assert review.dangling_references(claims, bundles).first().dangling_findings == 1


def test_provenance(spark):
    obs, bundles, inside = setup(spark)
    found = burst.findings(inside).withColumn("trace_id", F.lit("tr"))
    first = review.first_refs(review.evidence_positions(inside, bundles))
    rows = review.provenance(
        found, first, bundles.where("capture_id <> 'cap9'"),
        obs.withColumn("last_trace_id", F.col("content_id")),
    ).collect()
    by = {r.traceable: r for r in rows}
    assert by[True].capture_id == "cap1"
    assert (by[True].items_from_this_capture, by[True].items_still_pointing_here,
            by[True].traces_that_touched_it) == (1, 1, 2)
    assert by[True].trace_is_continuous
    assert (by[False].items_from_this_capture, by[False].claimed_bundle) == (0, None)


def test_graph(spark):
    _, _, inside = setup(spark)
    people = spark.createDataFrame(
        [("t", f"a{i}", f"h{i}") for i in (1, 2, 3)],
        "tenant_id string, account_id string, handle string",
    )
    members = review.graph_members(burst.finding_accounts(inside), people)
    row = review.graph_summary(members).first()
    assert (row.nodes, row.edges, row.clusters) == (3, 6, 2)
    chosen = spark.createDataFrame([("a1",)], "account_id string")
    edges = {(r.source, r.target) for r in review.edges_of(members, chosen).collect()}
    assert edges == {("a1", "a2"), ("a1", "a3")}
    everyone = people.select("account_id")
    assert review.edges_of(members, everyone).count() == row.edges


def exported(spark):
    _, bundles, inside = setup(spark)
    found = review.label_findings(
        burst.findings(inside), F.lit("tr"), F.lit(BASE).cast("timestamp")
    )
    positions = review.evidence_positions(inside, bundles)
    verdicts = found.select(
        "finding_id", F.lit("v1").alias("verdict_id"),
        F.lit("likely_coordination").alias("verdict"), F.lit(BASE).alias("decided_at"),
    )
    gated = export.export_gate(found, review.current_verdicts(verdicts),
                               review.first_refs(positions))
    known = spark.createDataFrame(
        [("t", "a1", "html", "ხიდი"), ("t", "a3", "html", 'q"3')],
        "tenant_id string, account_id string, platform string, handle string",
    )
    members = export.export_members(burst.finding_accounts(inside), known)
    proofs = positions.join(
        bundles.select("tenant_id", "bundle_id", "source_url", "manifest_sha256").distinct(),
        ["tenant_id", "bundle_id"],
    )
    return gated, export.build_bundles(gated, members, proofs)


def test_export_bundle(spark):
    gated, bundles = exported(spark)
    (held,) = gated.where("not exportable").collect()
    assert held.refusal == "no evidence references"
    (row,) = bundles.collect()
    doc = json.loads(row.bundle_json)
    assert row.bundle_json == json.dumps(doc, sort_keys=True, separators=(",", ":"))
    assert row.bundle_sha256 == hashlib.sha256(row.bundle_json.encode()).hexdigest()
    assert row.object_count == len(doc["objects"])
    kinds = [o["type"] for o in doc["objects"]]
    assert kinds == ["extension-definition", "identity"] + ["x-social-account"] * 2 + [
        "x-evidence-bundle"] * 3 + ["observed-data", "note", "grouping"]
    by = {o["type"]: o for o in doc["objects"]}
    ns = uuid.UUID(ids.STIX_NAMESPACE)
    assert doc["id"] == f"bundle--{uuid.uuid5(ns, row.finding_id)}"
    accounts = [o for o in doc["objects"] if o["type"] == "x-social-account"]
    assert [a["account_handle"] for a in accounts] == ["ხიდი", 'q"3']
    assert accounts[0]["id"] == f"x-social-account--{uuid.uuid5(ns, 'html|a1')}"
    assert accounts[0]["items_in_window"] == 2
    refs = by["grouping"]["object_refs"]
    assert len(refs) == 5 and not any(r.startswith("identity") for r in refs)
    inner = next(iter(by["grouping"]["extensions"].values()))
    assert inner["evidence_bundle_ids"] == ["b1", "b2", "b8"]
    assert inner["evidence_manifest_sha256"] == ["d1", "d2", "d8"]
    assert [s["observed"] for s in inner["signals"]] == [4.0, 3.0, 9.0]
    assert by["observed-data"]["number_observed"] == 4
    assert by["observed-data"]["first_observed"] == "2026-08-04T09:12:00.000Z"
    assert by["note"]["object_refs"] == [by["grouping"]["id"]]
    assert "  [PASS] item_count: observed 4.0, threshold 4.0 — items published" in (
        by["note"]["content"])


def test_gate_order(spark):
    frame = spark.createDataFrame(
        [(0, 3, "confirmed_coordination"), (1, 2, "confirmed_coordination"), (1, 3, None),
         (1, 3, "no_coordination"), (1, 3, "likely_coordination")],
        "e long, s int, v string",
    )
    got = [r[0] for r in frame.select(
        export.refusal(F.col("e"), F.col("s"), F.col("v"))).collect()]
    assert got == ["no evidence references", "2 signals, 3 required", "verdict is missing",
                   "verdict is no_coordination", None]


def test_latest_verdict_breaks_ties_by_id(spark):
    rows = [("f", "v1", BASE, "a"), ("f", "v3", BASE, "c"), ("f", "v2", BASE, "b")]
    frame = spark.createDataFrame(
        rows, "finding_id string, verdict_id string, decided_at timestamp, verdict string"
    )
    assert review.current_verdicts(frame).first().verdict == "c"


def test_access_table(spark):
    now = BASE
    cases = [
        ("analyst reads own project", "an", "read_findings", "t", "p1", "granted"),
        ("analyst other project", "an", "read_findings", "t", "p2", "not assigned to project"),
        ("analyst archived project", "an", "read_findings", "t", "old", "not assigned to project"),
        ("analyst without project", "an", "read_content", "t", None, "no project named"),
        ("analyst may not manage", "an", "manage_users", "t", None, "not granted"),
        ("other tenant", "an", "read_findings", "u", "p1", "other tenant"),
        ("super admin reads nothing", "su", "read_findings", "t", "p1", "not granted"),
        ("super admin manages", "su", "manage_tenants", "t", None, "granted"),
        ("auditor", "au", "read_audit", "t", None, "granted"),
        ("live grant crosses, project still needed", "gr", "read_findings", "u", "p9",
         "not assigned to project"),
        ("live grant crosses", "gr", "read_findings", "u", "p1", "granted"),
        ("expired grant", "ex", "read_findings", "u", "p1", "other tenant"),
        ("expiry is exclusive", "eq", "read_findings", "u", "p1", "other tenant"),
        ("revoked grant", "re", "read_findings", "u", "p1", "other tenant"),
        ("nobody", "zz", "read_audit", "t", None, "unknown user"),
    ]
    requests = spark.createDataFrame(
        [(i, u, p, t, pr, now) for i, (_, u, p, t, pr, _) in enumerate(cases)],
        "request_id int, user_id string, permission string, tenant_id string, "
        "project_id string, asked_at timestamp",
    )
    users = spark.createDataFrame([(u, "t") for u in ("an", "su", "au", "gr", "ex", "re", "eq")],
                                  "user_id string, tenant_id string")
    roles = spark.createDataFrame([("an", "analyst"), ("su", "super_admin"), ("au", "auditor")],
                                  "user_id string, role string")
    projects = spark.createDataFrame([("p1", None), ("p2", None), ("old", BASE)],
                                     "project_id string, archived_at timestamp")
    assigned = spark.createDataFrame(
        [("an", "p1"), ("an", "old"), ("su", "p1"), ("gr", "p1"), ("ex", "p1"), ("re", "p1"),
         ("eq", "p1")],
        "user_id string, project_id string",
    )
    hour = timedelta(hours=1)
    grants = spark.createDataFrame(
        [("gr", "u", ["read_findings"], now + hour, None),
         ("ex", "u", ["read_findings"], now - hour, None),
         ("eq", "u", ["read_findings"], now, None),
         ("re", "u", ["read_findings"], now + hour, now)],
        "granted_to string, tenant_id string, permissions array<string>, expires_at timestamp, "
        "revoked_at timestamp",
    )
    out = access.decide(requests, users, roles, assigned, projects, grants)
    got = {r.request_id: (r.reason, r.allowed) for r in out.collect()}
    assert got == {i: (c[5], c[5] == "granted") for i, c in enumerate(cases)}
    audit = {r.entry_id: r.outcome for r in access.audit_rows(
        out.withColumns({"resource_type": F.lit("x"), "resource_id": F.lit("y")})).collect()}
    assert audit[0] == "allowed" and audit[1] == "denied"


def test_stored_findings_are_written_once_and_read(spark, monkeypatch):
    from murmur.plans import reads

    made, keep = [], reads.materialise
    monkeypatch.setattr(reads, "materialise", lambda df, name: made.append(name) or keep(df, name))
    reads._stored_findings(spark, "/root/testdata/sf0.001")
    assert made == ["members", "positions", "labelled"]
