"""Manifests, verification outcomes, seals and archives."""

import gzip
import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from murmur.operators import chain, evidence
from murmur.sources import archives

BUNDLES = (
    "tenant_id string, bundle_id string, capture_id string, source_url string, "
    "captured_at timestamp, trace_id string"
)
FILES = (
    "tenant_id string, bundle_id string, name string, kind string, media_type string, "
    "size_bytes long, sha256 string"
)
URL = 'https://example.org/ხიდი?q="x"'


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def bundles(spark, *ids):
    return spark.createDataFrame(
        [("t", b, f"c{b}", URL, datetime(2026, 8, 4, 9, 12, 4), "tr") for b in ids], BUNDLES
    )


def files(spark, *rows):
    return spark.createDataFrame(
        [("t", b, n, "dom", "text/html", 3, s) for b, n, s in rows], FILES
    )


def test_manifest_is_what_python_writes(spark):
    a = files(spark, ("b1", "z.html", sha("z")), ("b1", "a.html", sha("a")))
    made = evidence.build_manifests(bundles(spark, "b1"), a).first()
    want = json.dumps(
        {
            "spec": "evidence-manifest-v1",
            "hash_algorithm": "sha256",
            "capture": {
                "bundle_id": "b1", "tenant_id": "t", "capture_id": "cb1", "source_url": URL,
                "captured_at": "2026-08-04T09:12:04+00:00", "trace_id": "tr",
            },
            "render_params": None,
            "artifacts": [
                {"name": n, "kind": "dom", "media_type": "text/html", "size_bytes": 3,
                 "sha256": sha(s)}
                for n, s in (("a.html", "a"), ("z.html", "z"))
            ],
        },
        sort_keys=True, separators=(",", ":"), ensure_ascii=False,
    )
    assert made.manifest == want
    assert made.manifest_sha256 == sha(want)


def test_render_params_are_text_where_floats(spark):
    b = bundles(spark, "b1").withColumn(
        "render_params",
        F.expr(
            "named_struct('viewport_width', 1280, 'viewport_height', 720, 'device_pixel_ratio', "
            "1.0D, 'locale', 'ka', 'timezone', 'UTC', 'animations_disabled', true, "
            "'network_idle_ms', 500, 'settle_delay_ms', 0, 'scroll_sequence', array(0, 720))"
        ),
    )
    made = evidence.build_manifests(b, files(spark, ("b1", "a", sha("a")))).first()
    assert json.loads(made.manifest)["render_params"] == {
        "viewport_width": 1280, "viewport_height": 720, "device_pixel_ratio": "1.0",
        "locale": "ka", "timezone": "UTC", "animations_disabled": True, "network_idle_ms": 500,
        "settle_delay_ms": 0, "scroll_sequence": [0, 720],
    }


def test_refusals(spark):
    rows = files(spark, ("dup", "a", sha("a")), ("dup", "a", sha("b")), ("bad", "a", "ABC"),
                 ("ok", "a", sha("a")))
    rows = rows.unionByName(
        files(spark, ("neg", "a", sha("a"))).withColumn("size_bytes", F.lit(-1).cast("long"))
    )
    lists = evidence.manifest_lists(bundles(spark, "dup", "bad", "ok", "neg", "none"), rows)
    assert {r.bundle_id: r.refusal for r in lists.collect()} == {
        "dup": "duplicate name", "bad": "malformed digest", "ok": None, "neg": "negative size",
        "none": "no artifacts",
    }


def test_outcomes(spark):
    ids = ["whole", "waiting", "changed", "extra", "gone", "relabelled", "badtoken", "othertoken",
           "unchecked"]
    b = bundles(spark, *ids)
    a = files(spark, *[(i, "dom.html", sha(i)) for i in ids])
    made = evidence.build_manifests(b, a).withColumn("seq", F.monotonically_increasing_id())
    made = spark.createDataFrame(made.collect(), made.schema)
    entries = chain.append(made, ["seq"], chain.EVIDENCE)
    observed = a.where("bundle_id <> 'gone'").withColumn(
        "sha256", F.when(F.col("bundle_id") == "changed", sha("other")).otherwise(F.col("sha256"))
    ).select("tenant_id", "bundle_id", "name", "sha256")
    observed = observed.unionByName(
        spark.createDataFrame([("t", "extra", "planted", sha("p"))], observed.schema)
    )
    recorded = made.withColumn(
        "source_url",
        F.when(F.col("bundle_id") == "relabelled", F.lit("https://other")).otherwise(
            F.col("source_url")),
    )
    tokens = made.where("bundle_id <> 'waiting'").select(
        "tenant_id", "bundle_id",
        F.when(F.col("bundle_id") == "othertoken", sha("x")).otherwise(F.col("manifest_sha256"))
        .alias("manifest_sha256"),
        F.when(F.col("bundle_id") == "unchecked", F.lit(None)).otherwise(
            F.col("bundle_id") != "badtoken").alias("validates"),
    )
    out = evidence.verify_bundles(recorded, observed, entries, tokens)
    got = {r.bundle_id: r.outcome for r in out.collect()}
    assert got == {
        "whole": "verified", "waiting": "incomplete", "changed": "failed", "extra": "failed",
        "gone": "failed", "relabelled": "failed", "badtoken": "failed", "othertoken": "failed",
        "unchecked": "incomplete",
    }


def member(uri, payload):
    head = f"WARC/1.1\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return gzip.compress(head.encode() + payload + b"\r\n\r\n")


def test_archive_from_its_own_records(spark):
    b = bundles(spark, "b1")
    body = b"<p>hello\r\n\r\nWARC/1.1 not a header</p>"
    a = files(spark, ("b1", "dom.html", hashlib.sha256(body).hexdigest()))
    made = evidence.build_manifests(b, a).withColumn("seq", F.lit(0).cast("long"))
    entries = chain.append(made, ["seq"], chain.EVIDENCE)
    tokens = made.select(
        "tenant_id", "bundle_id", "manifest_sha256", F.lit("u").alias("authority_url"),
        F.col("captured_at").alias("obtained_at"), F.encode(F.lit("tok"), "UTF-8").alias("token"),
    )
    seal = evidence.seal_documents(entries, tokens).first().seal
    manifest = made.first().manifest
    assert json.loads(seal)["timestamps"][0]["token_base64"] == "dG9r"
    whole = (
        member("urn:evidence:manifest", manifest.encode())
        + member("urn:evidence:artifact:dom.html", body)
        + member("urn:evidence:seal", b"{}")
        + member("urn:evidence:seal", seal.encode())
    )
    forged = json.loads(seal)
    forged["chain"]["chain_index"] = 7
    cases = {
        "whole": whole,
        "planted": whole + member("urn:evidence:artifact:x", b"x"),
        "unsealed": member("urn:evidence:manifest", manifest.encode())
        + member("urn:evidence:artifact:dom.html", body),
        "forged": whole + member("urn:evidence:seal", json.dumps(forged).encode()),
        "no manifest": member("urn:evidence:artifact:dom.html", body),
        "cut": whole + member("urn:evidence:seal", seal.encode())[:-2],
        "broken": b"\x1f\x8b" + whole[30:],
        "empty": b"",
        "between": gzip.compress(b"not a record\r\n") + whole,
        "stripped": member("urn:evidence:manifest", json.dumps({"spec": json.loads(manifest)["spec"]}).encode())
        + member("urn:evidence:artifact:dom.html", body) + member("urn:evidence:seal", seal.encode()),
        "hollow seal": whole + member("urn:evidence:seal", b'{"chain": {"chain_index": 0}}'),
    }
    frame = spark.createDataFrame(list(cases.items()), "path string, content binary")
    records = archives.read_archives(frame)
    got = {r.path: r.problems for r in evidence.verify_archives(records).collect()}
    assert got == {
        "whole": [],
        "planted": ["artifacts differ"],
        "unsealed": ["no seal record"],
        "forged": ["chain entry does not recompute"],
        "no manifest": ["no manifest record"],
        "cut": ["archive damaged"],
        "broken": ["no manifest record", "archive damaged"],
        "empty": ["no manifest record", "archive damaged"],
        "between": ["archive damaged"],
        "stripped": ["manifest unreadable", "seal attests to another manifest"],
        "hollow seal": ["seal unreadable"],
    }
    between = [r for r in records.where("path = 'between'").orderBy("record_no").collect()]
    assert [r.uri is None for r in between] == [True, False, False, False, False]
    placed = b.withColumn("path", F.lit("whole")).unionByName(
        bundles(spark, "b2").withColumn("path", F.lit("expired"))
    )
    docs = {r.capture_id: r.document for r in
            archives.capture_documents(placed, records).collect()}
    assert bytes(docs["cb1"]) == body
    assert docs["cb2"] is None
