"""Analyst reads: evidence behind findings, provenance, timeline, verdicts, graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.burst import finding_id

# Verdicts an analyst may record.
VERDICTS = [
    "confirmed_coordination",
    "likely_coordination",
    "insufficient_evidence",
    "no_coordination",
]


def evidence_positions(inside: DataFrame, bundles: DataFrame) -> DataFrame:
    """finding_id, tenant_id, bundle_id and ``rank``, which orders a finding's evidence.

    First the bundles of the captures that first saw the items, by capture id; then those of
    the captures that saw them last, in item order. A bundle counts once, at its first place.
    Captures are reduced per finding before the join, and the place is a minimum, so nothing
    is collected.
    """
    first = F.struct(
        F.lit(0).alias("kind"), F.col("capture_id").alias("capture"),
        F.lit(0).cast("long").alias("t"), F.lit("").alias("item"),
    )
    live = F.struct(
        F.lit(1).alias("kind"), F.lit("").alias("capture"), F.col("t").alias("t"),
        F.col("content_id").alias("item"),
    )
    candidates = F.array_compact(
        F.array(
            F.struct(F.col("capture_id").alias("capture_id"), first.alias("rank")),
            F.when(
                F.col("last_capture_id").isNotNull(),
                F.struct(F.col("last_capture_id").alias("capture_id"), live.alias("rank")),
            ),
        )
    )
    captures = (
        inside.select(
            finding_id().alias("finding_id"), "tenant_id", F.inline(candidates)
        )
        .groupBy("finding_id", "tenant_id", "capture_id")
        .agg(F.min("rank").alias("rank"))
    )
    known = bundles.select("tenant_id", "capture_id", "bundle_id")
    return (
        captures.join(known, ["tenant_id", "capture_id"])
        .groupBy("finding_id", "tenant_id", "bundle_id")
        .agg(F.min("rank").alias("rank"))
    )


def evidence_refs(positions: DataFrame) -> DataFrame:
    """The ordered list of bundles a finding record carries."""
    return positions.groupBy("finding_id", "tenant_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "bundle_id"))).alias("r")
    ).select("finding_id", "tenant_id", F.col("r.bundle_id").alias("evidence_refs"))


def first_refs(positions: DataFrame) -> DataFrame:
    """Only the first bundle of each finding; no list is built."""
    return positions.groupBy("finding_id", "tenant_id").agg(
        F.min_by("bundle_id", "rank").alias("bundle_id"), F.count("*").alias("bundles")
    )


def unevidenced(findings: DataFrame, positions: DataFrame) -> DataFrame:
    """Clusters no surviving bundle supports; they must not become findings."""
    return findings.join(positions.select("finding_id"), "finding_id", "left_anti")


def evidenced(findings: DataFrame, positions: DataFrame) -> DataFrame:
    return findings.join(positions.select("finding_id"), "finding_id", "left_semi")


def dangling_references(refs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Per tenant, findings with a reference that resolves to nothing.

    ``refs`` has one row per finding and bundle id it claims.
    """
    missing = refs.join(
        bundles.select("tenant_id", "bundle_id"), ["tenant_id", "bundle_id"], "left_anti"
    ).select("tenant_id", "finding_id").distinct()
    return missing.groupBy("tenant_id").agg(F.count("*").alias("dangling_findings"))


def provenance(
    findings: DataFrame, first: DataFrame, bundles: DataFrame, content: DataFrame
) -> DataFrame:
    """From every finding to the bytes it rests on.

    ``findings`` has finding_id, tenant_id and trace_id; ``first`` the first reference of
    each; ``bundles`` bundle_id, capture_id, trace_id, source_url and chain_index; ``content``
    is the provenance view. The condition "first or last capture" is turned into two
    equi-keys and counted per capture, for captures some finding rests on.
    """
    claimed = first.select(
        "finding_id", "tenant_id", F.col("bundle_id").alias("claimed_bundle")
    )
    b = bundles.select(
        "tenant_id",
        F.col("bundle_id").alias("claimed_bundle"),
        "capture_id",
        F.col("trace_id").alias("bundle_trace_id"),
        "source_url",
        "chain_index",
    )
    located = claimed.join(b, ["tenant_id", "claimed_bundle"], "left")
    needed = located.where(F.col("capture_id").isNotNull()).select(
        "tenant_id", "capture_id"
    ).distinct()
    same = F.col("capture_id").eqNullSafe(F.col("last_capture_id"))
    touched = F.when(
        same,
        F.array(F.struct(F.col("capture_id").alias("c"), F.lit(1).alias("a"), F.lit(1).alias("z"))),
    ).otherwise(
        F.array(
            F.struct(F.col("capture_id").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("z")),
            F.struct(F.col("last_capture_id").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("z")),
        )
    )
    per_trace = (
        content.select("tenant_id", "last_trace_id", F.inline(touched))
        .withColumnRenamed("c", "capture_id")
        .join(needed, ["tenant_id", "capture_id"], "left_semi")
        .groupBy("tenant_id", "capture_id", "last_trace_id")
        .agg(F.sum("a").alias("a"), F.sum("z").alias("z"))
    )
    per_capture = per_trace.groupBy("tenant_id", "capture_id").agg(
        F.sum("a").alias("items_from_this_capture"),
        F.sum("z").alias("items_still_pointing_here"),
        F.count("last_trace_id").alias("traces_that_touched_it"),
    )
    traceable = F.col("capture_id").isNotNull()
    summary = F.when(
        traceable,
        F.concat(
            F.lit("capture "), F.col("capture_id"), F.lit(" sealed as bundle "),
            F.col("claimed_bundle"), F.lit(" at chain index "),
            F.coalesce(F.col("chain_index").cast("string"), F.lit("?")), F.lit(" from "),
            F.col("source_url"),
        ),
    ).otherwise(
        F.concat(
            F.lit("cannot be traced: claims "), F.coalesce("claimed_bundle", F.lit("nothing"))
        )
    )
    zero = F.lit(0).cast("long")
    return (
        findings.join(located, ["finding_id", "tenant_id"], "left")
        .join(per_capture, ["tenant_id", "capture_id"], "left")
        .select(
            "finding_id",
            "tenant_id",
            "claimed_bundle",
            "capture_id",
            "source_url",
            "chain_index",
            F.coalesce("items_from_this_capture", zero).alias("items_from_this_capture"),
            F.coalesce("items_still_pointing_here", zero).alias("items_still_pointing_here"),
            F.coalesce("traces_that_touched_it", zero).alias("traces_that_touched_it"),
            (F.col("trace_id") == F.col("bundle_trace_id")).alias("trace_is_continuous"),
            traceable.alias("traceable"),
            summary.alias("summary"),
        )
    )


def timeline(
    captures: DataFrame, bundles: DataFrame, findings: DataFrame, exports: DataFrame,
    limit: int | None = 200,
) -> DataFrame:
    """Captures, bundles, findings and exports on one axis, newest first.

    Each part is cut to its own newest rows before the union.
    """
    counts = F.concat(
        F.col("item_count").cast("string"), F.lit(" items / "),
        F.col("account_count").cast("string"), F.lit(" accounts"),
    )
    parts = [
        captures.select(
            F.lit("capture").alias("kind"), F.col("requested_at").alias("at"), "trace_id",
            F.col("url").alias("label"), F.col("status").alias("detail"),
        ),
        bundles.select(
            F.lit("bundle").alias("kind"), F.col("captured_at").alias("at"), "trace_id",
            F.col("source_url").alias("label"), F.col("manifest_sha256").alias("detail"),
        ),
        findings.select(
            F.lit("finding").alias("kind"), F.col("detected_at").alias("at"), "trace_id",
            F.col("rule_name").alias("label"), counts.alias("detail"),
        ),
        exports.select(
            F.lit("export").alias("kind"), F.col("created_at").alias("at"), "trace_id",
            F.lit("STIX 2.1").alias("label"), F.col("bundle_sha256").alias("detail"),
        ),
    ]
    order = [F.desc("at"), "kind", "label", "detail", "trace_id"]
    if limit is not None:
        parts = [p.orderBy(*order).limit(limit) for p in parts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if limit is None else out.orderBy(*order).limit(limit)


def check_verdicts(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): only the known values may be appended."""
    known = F.col("verdict").isin(VERDICTS)
    return verdicts.where(known), verdicts.where(~known | F.col("verdict").isNull())


def current_verdicts(verdicts: DataFrame) -> DataFrame:
    """The latest verdict of each finding; the id breaks ties."""
    names = [c for c in verdicts.columns if c != "finding_id"]
    return verdicts.groupBy("finding_id").agg(
        F.max_by(F.struct(*names), F.struct("decided_at", "verdict_id")).alias("v")
    ).select("finding_id", "v.*")


def verdict_history(verdicts: DataFrame) -> DataFrame:
    """All verdicts; newest first within a finding."""
    return verdicts.orderBy("finding_id", F.desc("decided_at"), F.desc("verdict_id"))


def review_queue(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with their current verdict, null while nobody decided."""
    current = current_verdicts(verdicts).select("finding_id", "verdict", "decided_at")
    return findings.join(current, "finding_id", "left")


def finding_detail(
    findings: DataFrame, accounts: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """Findings (the ones asked for) with their cluster and verdict history as arrays.

    For reading single findings; narrow ``findings`` first.
    """
    wanted = findings.select("finding_id")
    cluster = (
        accounts.join(wanted, "finding_id", "left_semi")
        .groupBy("finding_id")
        .agg(F.array_sort(F.collect_list(F.struct("account_id", "item_count"))).alias("cluster"))
    )
    history = (
        verdicts.join(wanted, "finding_id", "left_semi")
        .groupBy("finding_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("decided_at", "verdict_id", "verdict")), asc=False
            ).alias("verdict_history")
        )
    )
    return findings.join(cluster, "finding_id", "left").join(history, "finding_id", "left")


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("tenant_id").agg(
        F.count("*").alias("findings"), F.count_if("shadow").alias("shadow_findings")
    )


def dashboard(
    tenants: DataFrame, sources: DataFrame, content: DataFrame, findings: DataFrame,
    bundles: DataFrame, exports: DataFrame,
) -> DataFrame:
    """One row per tenant from already counted frames, each keyed by tenant."""
    out = tenants.select("tenant_id")
    for part in (sources, content, findings, bundles, exports):
        out = out.join(part, "tenant_id", "left")
    return out.na.fill(0)


def graph_members(finding_accounts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Who took part in which finding, with the number of others in it.

    Accounts of a finding are all linked to each other, so membership *is* the graph: the
    edges of a finding are the pairs (a, b) with a < b among its rows. Pairs are not written
    out, as they grow with the square of a cluster; :func:`edges_of` gives them for chosen
    accounts.
    """
    known = finding_accounts.join(
        accounts.select("tenant_id", "account_id", "handle"), ["tenant_id", "account_id"]
    )
    size = known.groupBy("finding_id").agg(F.count("*").alias("members"))
    return known.join(size, "finding_id").select(
        "finding_id", "tenant_id", "account_id", "handle",
        (F.col("members") - 1).alias("linked_to"), "members",
    )


def edges_of(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges that touch the chosen accounts, once each, smaller id first.

    Linear in the clusters of the chosen accounts.
    """
    seeds = members.join(chosen.select("account_id").distinct(), "account_id", "left_semi")
    a = seeds.select("finding_id", F.col("account_id").alias("seed"))
    b = members.select("finding_id", F.col("account_id").alias("other"))
    return (
        a.join(b, "finding_id")
        .where(F.col("seed") != F.col("other"))
        .select(
            "finding_id",
            F.least("seed", "other").alias("source"),
            F.greatest("seed", "other").alias("target"),
        )
        .distinct()
    )


def graph_summary(members: DataFrame) -> DataFrame:
    """Nodes, edges and clusters, without listing an edge."""
    clusters = members.groupBy("tenant_id", "finding_id").agg(F.count("*").alias("m"))
    edges = clusters.groupBy("tenant_id").agg(
        F.count("*").alias("clusters"),
        F.sum(F.expr("m * (m - 1) div 2")).alias("edges"),
    )
    nodes = (
        members.select("tenant_id", "account_id").distinct()
        .groupBy("tenant_id").agg(F.count("*").alias("nodes"))
    )
    return edges.join(nodes, "tenant_id").select("tenant_id", "nodes", "edges", "clusters")


def label_findings(findings: DataFrame, trace_id: Column, detected_at: Column) -> DataFrame:
    """Add what the run knows: its trace and when it ran."""
    return findings.withColumn("trace_id", trace_id).withColumn("detected_at", detected_at)
