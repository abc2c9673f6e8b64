"""Evidence bundles: artifact hashes, manifests, verification, seals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import ids, jsontext, text
from murmur.functions.moments import iso_offset_text
from murmur.operators import chain
from murmur.sources.archives import URI_PREFIX

#: Names inside documents. Pass the ones your own documents were written with.
MANIFEST_SPEC = "evidence-manifest-v1"
SEAL_SPEC = "evidence-seal-v1"

BINDING = ["bundle_id", "tenant_id", "capture_id", "source_url", "captured_at", "trace_id"]
ARTIFACT = ["name", "kind", "media_type", "size_bytes", "sha256"]
RENDER_NUMBERS = ["viewport_width", "viewport_height", "network_idle_ms", "settle_delay_ms"]


def artifact_table(captures: DataFrame, keys: list[str], name: str = "dom.html") -> DataFrame:
    """The document of each capture as an artifact row. ``body`` is binary."""
    media = F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))
    return captures.select(
        *keys,
        F.lit(name).alias("name"),
        F.lit("dom").alias("kind"),
        F.when(media == "", F.lit("text/html")).otherwise(media).alias("media_type"),
        F.octet_length("body").cast("long").alias("size_bytes"),
        text.bytes_digest(F.col("body")).alias("sha256"),
    )


def _artifact_json() -> Column:
    return jsontext.obj(
        {
            "name": jsontext.string(F.col("name")),
            "kind": jsontext.string(F.col("kind")),
            "media_type": jsontext.string(F.col("media_type")),
            "size_bytes": jsontext.integer(F.col("size_bytes")),
            "sha256": jsontext.string(F.col("sha256")),
        }
    )


def manifest_lists(bundles: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifacts per bundle, by name, with the reasons a manifest must be refused.

    A bundle's document lists all its artifacts, so the group is one bundle's list of names
    and digests; the bytes are not in it.
    """
    listed = artifacts.groupBy("tenant_id", "bundle_id").agg(
        F.array_sort(
            F.collect_list(F.struct("name", _artifact_json().alias("json")))
        ).alias("listed"),
        F.count_if(~text.is_digest(F.col("sha256"))).alias("bad_digests"),
        F.count_if(F.col("size_bytes") < 0).alias("bad_sizes"),
    )
    names = F.col("listed.name")
    refusal = (
        F.when(F.col("listed").isNull(), F.lit("no artifacts"))
        .when(F.size(F.array_distinct(names)) < F.size(names), F.lit("duplicate name"))
        .when(F.col("bad_digests") > 0, F.lit("malformed digest"))
        .when(F.col("bad_sizes") > 0, F.lit("negative size"))
    )
    return (
        bundles.join(listed, ["tenant_id", "bundle_id"], "left")
        .withColumn("refusal", refusal)
        .drop("bad_digests", "bad_sizes")
    )


def _render_json(render: Column) -> Column:
    fields = {n: jsontext.integer(render[n]) for n in RENDER_NUMBERS}
    fields["device_pixel_ratio"] = jsontext.string(text.float_text(render["device_pixel_ratio"]))
    fields["locale"] = jsontext.string(render["locale"])
    fields["timezone"] = jsontext.string(render["timezone"])
    fields["animations_disabled"] = jsontext.boolean(render["animations_disabled"])
    fields["scroll_sequence"] = jsontext.array(
        F.transform(render["scroll_sequence"], lambda x: x.cast("string"))
    )
    return F.when(render.isNull(), F.lit("null")).otherwise(jsontext.obj(fields))


def build_manifests(
    bundles: DataFrame, artifacts: DataFrame, spec: str = MANIFEST_SPEC
) -> DataFrame:
    """Bundles that may be sealed, with ``manifest`` (exact text) and ``manifest_sha256``.

    ``render_params`` is used when the bundles have it.
    """
    lists = manifest_lists(bundles, artifacts)
    capture = jsontext.obj(
        {
            **{
                name: jsontext.string(F.col(name))
                for name in BINDING
                if name != "captured_at"
            },
            "captured_at": jsontext.string(iso_offset_text(F.col("captured_at"))),
        }
    )
    render = F.lit("null")
    if "render_params" in bundles.columns:
        render = _render_json(F.col("render_params"))
    document = jsontext.obj(
        {
            "spec": jsontext.text(spec),
            "hash_algorithm": jsontext.text(chain.ALGORITHM),
            "capture": capture,
            "render_params": render,
            "artifacts": jsontext.array(F.col("listed.json")),
        }
    )
    return (
        lists.where(F.col("refusal").isNull())
        .withColumn("manifest", document)
        .withColumn("manifest_sha256", text.text_digest(F.col("manifest")))
        .drop("listed", "refusal")
    )


MANIFEST_SCHEMA = (
    "spec string, hash_algorithm string, "
    "capture struct<bundle_id:string,tenant_id:string,capture_id:string,source_url:string,"
    "captured_at:string,trace_id:string>, "
    "artifacts array<struct<name:string,kind:string,media_type:string,size_bytes:bigint,"
    "sha256:string>>"
)


def parse_manifests(documents: DataFrame, spec: str = MANIFEST_SPEC) -> DataFrame:
    """Add ``m``, the parsed manifest; null when unreadable, incomplete or of an unknown kind."""
    parsed = F.from_json("manifest", MANIFEST_SCHEMA)
    return documents.withColumn("m", parsed).withColumn(
        "m", F.when(complete_manifest(F.col("m"), spec), F.col("m"))
    )


def _all_there(record: Column, *fields: str) -> Column:
    out = F.lit(True)
    for field in fields:
        value = record
        for step in field.split("."):
            value = value[step]
        out = out & value.isNotNull()
    return out


def complete_manifest(m: Column, spec: str = MANIFEST_SPEC) -> Column:
    """The kind is known and every field that the checks rely on is there."""
    return F.coalesce(
        (m["spec"] == spec)
        & _all_there(
            m, "hash_algorithm", "artifacts", "capture.bundle_id", "capture.tenant_id",
            "capture.capture_id", "capture.source_url", "capture.captured_at",
        )
        & F.forall(m["artifacts"], lambda a: a["name"].isNotNull() & a["sha256"].isNotNull()),
        F.lit(False),
    )


def complete_seal(s: Column) -> Column:
    return _all_there(
        s, "manifest_sha256", "chain.preimage_version", "chain.algorithm", "chain.tenant_id",
        "chain.chain_index", "chain.prev_hash", "chain.bundle_id", "chain.entry_hash",
    )


def differs(a: Column, b: Column) -> Column:
    """True unless both are known and equal."""
    return ~F.coalesce(a == b, F.lit(False))


def compare_artifacts(listed: DataFrame, observed: DataFrame) -> DataFrame:
    """Both directions and the digests: missing, unlisted, mismatch. Only differences remain.

    Both sides have tenant_id, bundle_id, name and sha256. Serves declared against supplied
    files as well as a manifest against an archive.
    """
    key = ["tenant_id", "bundle_id", "name"]
    a = listed.select(*key, F.col("sha256").alias("listed"), F.lit(True).alias("in_list"))
    b = observed.select(*key, F.col("sha256").alias("found"), F.lit(True).alias("in_bundle"))
    problem = (
        F.when(F.col("in_bundle").isNull(), F.lit("missing"))
        .when(F.col("in_list").isNull(), F.lit("unlisted"))
        .when(~F.col("listed").eqNullSafe(F.col("found")), F.lit("mismatch"))
    )
    return (
        a.join(b, key, "full")
        .select(*key, "listed", "found", problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def listed_artifacts(parsed: DataFrame) -> DataFrame:
    return parsed.select("tenant_id", "bundle_id", F.inline("m.artifacts"))


def manifest_checks(
    bundles: DataFrame, observed: DataFrame, spec: str = MANIFEST_SPEC
) -> DataFrame:
    """Per bundle: digest, binding and artifacts agree with what is stored.

    ``bundles`` has tenant_id, bundle_id, source_url, manifest_sha256 as recorded, and
    ``manifest`` as archived (null when the archive cannot be read).
    """
    parsed = parse_manifests(bundles, spec)
    differing = (
        compare_artifacts(listed_artifacts(parsed), observed)
        .groupBy("tenant_id", "bundle_id")
        .agg(F.count("*").alias("differing"))
    )
    read = F.col("m").isNotNull()
    flags = F.array_compact(
        F.array(
            F.when(F.col("manifest").isNull(), F.lit("archive unreadable")),
            F.when(
                F.col("manifest").isNotNull()
                & differs(text.text_digest(F.col("manifest")), F.col("manifest_sha256")),
                F.lit("manifest digest differs"),
            ),
            F.when(
                F.col("manifest").isNotNull() & F.col("m").isNull(), F.lit("manifest unreadable")
            ),
            F.when(read & differs(F.col("m.hash_algorithm"), F.lit(chain.ALGORITHM)),
                   F.lit("unexpected algorithm")),
            F.when(read & differs(F.col("m.capture.bundle_id"), F.col("bundle_id")),
                   F.lit("other bundle")),
            F.when(read & differs(F.col("m.capture.source_url"), F.col("source_url")),
                   F.lit("other address")),
            F.when(
                F.col("m").isNotNull() & (F.coalesce("differing", F.lit(0)) > 0),
                F.lit("artifacts differ"),
            ),
        )
    )
    return (
        parsed.join(differing, ["tenant_id", "bundle_id"], "left")
        .select("tenant_id", "bundle_id", flags.alias("manifest_problems"))
    )


def chain_checks(
    bundles: DataFrame, entries: DataFrame, fmt: chain.ChainFormat = chain.EVIDENCE
) -> DataFrame:
    """Per bundle: is its entry sound together with the entries on both sides?

    Each broken entry is booked to the neighbours it spoils, so only broken entries are
    shuffled again: a bad hash spoils index-1 to index+1, a bad link index-1 and index, a bad
    start the first two.
    """
    checked = chain.verify(entries, fmt)
    i = F.col("chain_index")
    adjacent = F.col("previous_index").eqNullSafe(i - 1)
    spoiled = F.array_distinct(
        F.flatten(
            F.array_compact(
                F.array(
                    F.when(~F.col("hash_ok"), F.array(i - 1, i, i + 1)),
                    F.when(adjacent & ~F.col("link_ok"), F.array(i - 1, i)),
                    F.when(~F.col("genesis_ok"), F.array(i, i + 1)),
                )
            )
        )
    )
    bad = (
        checked.where(F.size("problems") > 0)
        .select("tenant_id", F.explode(spoiled).alias("chain_index"))
        .distinct()
        .withColumn("spoiled", F.lit(True))
    )
    placed = entries.select(
        "tenant_id", "bundle_id", "chain_index", F.col("manifest_sha256").alias("attested")
    ).join(bad, ["tenant_id", "chain_index"], "left")
    flags = F.array_compact(
        F.array(
            F.when(F.col("chain_index").isNull(), F.lit("no chain entry")),
            F.when(
                F.col("chain_index").isNotNull()
                & differs(F.col("attested"), F.col("manifest_sha256")),
                F.lit("other manifest"),
            ),
            F.when(F.col("spoiled"), F.lit("chain broken here")),
        )
    )
    return bundles.select("tenant_id", "bundle_id", "manifest_sha256").join(
        placed, ["tenant_id", "bundle_id"], "left"
    ).select("tenant_id", "bundle_id", "chain_index", flags.alias("chain_problems"))


def token_disagreements(bundles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens that attest to another digest than the bundle's."""
    recorded = bundles.select(
        "tenant_id", "bundle_id", F.col("manifest_sha256").alias("recorded")
    )
    return tokens.join(recorded, ["tenant_id", "bundle_id"]).where(
        F.col("manifest_sha256") != F.col("recorded")
    )


def verify_bundles(
    bundles: DataFrame,
    observed: DataFrame,
    entries: DataFrame,
    tokens: DataFrame,
    spec: str = MANIFEST_SPEC,
    fmt: chain.ChainFormat = chain.EVIDENCE,
) -> DataFrame:
    """verified, failed or incomplete for every bundle.

    ``tokens`` has tenant_id, bundle_id, manifest_sha256 and ``validates``: true or false from
    the certificate check, null where nobody could check it. A token that could not be
    checked is not one that failed.
    """
    key = ["tenant_id", "bundle_id"]
    checkable = tokens.where(F.col("validates").isNotNull())
    by_bundle = (
        checkable.join(
            bundles.select(*key, F.col("manifest_sha256").alias("recorded")), key
        )
        .groupBy(*key)
        .agg(
            F.bool_and((F.col("manifest_sha256") == F.col("recorded")) & F.col("validates"))
            .alias("all_valid")
        )
    )
    manifest_ok = F.size("manifest_problems") == 0
    chain_ok = F.size("chain_problems") == 0
    has_token = F.col("all_valid").isNotNull()
    tsa_ok = F.coalesce("all_valid", F.lit(False))
    outcome = (
        F.when(~manifest_ok | ~chain_ok, F.lit("failed"))
        .when(tsa_ok, F.lit("verified"))
        .when(has_token, F.lit("failed"))
        .otherwise(F.lit("incomplete"))
    )
    return (
        manifest_checks(bundles, observed, spec)
        .join(chain_checks(bundles, entries, fmt), key)
        .join(by_bundle, key, "left")
        .select(
            *key,
            manifest_ok.alias("manifest_ok"),
            chain_ok.alias("chain_ok"),
            tsa_ok.alias("tsa_ok"),
            outcome.alias("outcome"),
            F.concat("manifest_problems", "chain_problems").alias("problems"),
        )
    )


def bundles_for_review(bundles: DataFrame, entries: DataFrame, tokens: DataFrame) -> DataFrame:
    """Bundles with their chain position and whether any token exists."""
    key = ["tenant_id", "bundle_id"]
    stamped = tokens.select(*key).distinct().withColumn("stamped", F.lit(True))
    return (
        bundles.join(
            entries.select(*key, "chain_index", "entry_hash", "prev_hash", "algorithm"), key
        )
        .join(stamped, key, "left")
        .withColumn("has_timestamp", F.col("stamped").isNotNull())
        .drop("stamped")
    )


def without_chain_row(bundles: DataFrame, entries: DataFrame) -> DataFrame:
    key = ["tenant_id", "bundle_id"]
    return bundles.join(entries.select(*key), key, "left_anti")


def bundle_counts(bundles: DataFrame, now: Column) -> DataFrame:
    """Per tenant: all bundles and those of the last 24 hours."""
    recent = F.col("captured_at").cast("timestamp") > now - F.expr("interval 24 hours")
    return bundles.groupBy("tenant_id").agg(
        F.count("*").alias("bundles"), F.count_if(recent).alias("bundles_last_24h")
    )


def seal_documents(
    entries: DataFrame,
    tokens: DataFrame,
    spec: str = SEAL_SPEC,
    fmt: chain.ChainFormat = chain.EVIDENCE,
) -> DataFrame:
    """One JSON text per entry: its place in the chain and its tokens in base64."""
    key = ["tenant_id", "bundle_id"]
    stamp = jsontext.obj(
        {
            "authority_url": jsontext.string(F.col("authority_url")),
            "manifest_sha256": jsontext.string(F.col("manifest_sha256")),
            "obtained_at": jsontext.string(iso_offset_text(F.col("obtained_at"))),
            "token_base64": jsontext.string(F.base64("token")),
            "token_format": jsontext.text("RFC3161 TimeStampToken, DER"),
        }
    )
    stamps = tokens.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("obtained_at", stamp.alias("json")))).alias("s")
    )
    link = jsontext.obj(
        {
            "preimage_version": jsontext.text(fmt.tag),
            "algorithm": jsontext.string(F.col("algorithm")),
            "tenant_id": jsontext.string(F.col("tenant_id")),
            "chain_index": jsontext.integer(F.col("chain_index")),
            "prev_hash": jsontext.string(F.col("prev_hash")),
            "bundle_id": jsontext.string(F.col("bundle_id")),
            "entry_hash": jsontext.string(F.col("entry_hash")),
        }
    )
    document = jsontext.obj(
        {
            "spec": jsontext.text(spec),
            "manifest_sha256": jsontext.string(F.col("manifest_sha256")),
            "manifest_digest_recipe": jsontext.text("SHA-256 of the manifest record's bytes"),
            "chain": link,
            "chain_preimage_recipe": jsontext.text(
                "SHA-256 over preimage_version, algorithm, tenant_id, chain_index, prev_hash, "
                "manifest_sha256, bundle_id; each as UTF-8 after its length in 8 bytes, "
                "big-endian"
            ),
            "timestamps": jsontext.array(F.coalesce("s.json", F.array())),
        }
    )
    return entries.join(stamps, key, "left").select(
        *key, "chain_index", document.alias("seal")
    )


SEAL_SCHEMA = (
    "spec string, manifest_sha256 string, chain struct<preimage_version:string,"
    "algorithm:string,tenant_id:string,chain_index:bigint,prev_hash:string,bundle_id:string,"
    "entry_hash:string>, timestamps array<struct<authority_url:string,manifest_sha256:string>>"
)


def verify_archives(
    records: DataFrame, prefix: str = URI_PREFIX, spec: str = MANIFEST_SPEC
) -> DataFrame:
    """Check each archive from its own records, without any table.

    One pass over the records and one shuffle: payloads of artifacts are replaced by their
    digests first, and an archive's group holds names and digests, its manifest and its last
    seal.
    """
    lead = f"{prefix}:artifact:"
    is_artifact = F.col("uri").startswith(lead)
    lean = records.select(
        "path",
        "record_no",
        F.when(is_artifact, F.substr(F.col("uri"), F.lit(len(lead) + 1))).alias("name"),
        F.when(is_artifact, text.bytes_digest(F.col("payload"))).alias("sha256"),
        F.when(F.col("uri") == f"{prefix}:manifest", F.col("payload")).alias("manifest"),
        F.when(F.col("uri") == f"{prefix}:seal", F.col("payload")).alias("seal"),
        "problem",
    )

    def at(kind: str) -> Column:
        return F.when(F.col(kind).isNotNull(), F.col("record_no"))

    found = F.collect_list(
        F.when(F.col("name").isNotNull(), F.struct("name", "sha256"))
    )
    archives = lean.groupBy("path").agg(
        F.array_sort(found).alias("found"),
        F.min_by("manifest", at("manifest")).alias("manifest"),
        F.max_by("seal", at("seal")).alias("seal"),
        F.bool_or(F.col("problem").isNotNull()).alias("damaged"),
    )
    read = archives.select(
        "path",
        "found",
        "damaged",
        F.col("seal").isNotNull().alias("has_seal"),
        F.col("manifest").isNotNull().alias("has_manifest"),
        F.sha2("manifest", 256).alias("digest"),
        F.from_json(F.col("manifest").cast("string"), MANIFEST_SCHEMA).alias("m"),
        F.from_json(F.col("seal").cast("string"), SEAL_SCHEMA).alias("s"),
    )
    link = F.col("s.chain")
    recomputed = ids.prefixed_digest(
        link["preimage_version"], link["algorithm"], link["tenant_id"],
        link["chain_index"].cast("string"), link["prev_hash"], F.col("s.manifest_sha256"),
        link["bundle_id"],
    )
    listed = F.array_sort(
        F.transform("m.artifacts", lambda a: F.struct(a["name"], a["sha256"]))
    )
    readable = F.col("has_manifest") & complete_manifest(F.col("m"), spec)
    sealed = F.col("has_seal") & complete_seal(F.col("s"))

    def flag(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    flags = F.array_compact(
        F.array(
            flag(~F.col("has_manifest"), "no manifest record"),
            flag(F.col("damaged"), "archive damaged"),
            flag(F.col("has_manifest") & ~readable, "manifest unreadable"),
            flag(readable & differs(listed, F.col("found")), "artifacts differ"),
            flag(F.col("has_manifest") & ~F.col("has_seal"), "no seal record"),
            flag(F.col("has_seal") & ~sealed, "seal unreadable"),
            flag(
                F.col("has_manifest") & sealed
                & differs(F.col("s.manifest_sha256"), F.col("digest")),
                "seal attests to another manifest",
            ),
            flag(sealed & differs(link["entry_hash"], recomputed),
                 "chain entry does not recompute"),
            flag(
                F.col("has_manifest") & sealed
                & (F.coalesce(F.size("s.timestamps"), F.lit(0)) == 0),
                "no timestamp token",
            ),
        )
    )
    return read.select("path", flags.alias("problems"))
