"""Access decisions in bulk: requests against users, roles, projects and grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each role may do, and which permissions read tenant data.
ROLE_PERMISSIONS = {
    "super_admin": ["manage_tenants", "manage_rules", "manage_system_config"],
    "tenant_admin": ["manage_users", "manage_projects", "approve_bulk_export"],
    "analyst": [
        "read_findings",
        "read_content",
        "read_evidence",
        "record_verdict",
        "export_stix",
        "request_bulk_export",
    ],
    "reviewer": ["read_findings", "record_verdict"],
    "read_only": ["read_findings"],
    "auditor": ["read_audit"],
}
DATA_PERMISSIONS = [
    "read_findings",
    "read_content",
    "read_evidence",
    "record_verdict",
    "export_stix",
    "request_bulk_export",
    "approve_bulk_export",
]


def permissions_of(roles: Column) -> Column:
    """Union of what an array of roles grants; an unknown role grants nothing."""
    out = F.expr("cast(array() as array<string>)")
    for role, granted in ROLE_PERMISSIONS.items():
        names = F.array(*[F.lit(g) for g in granted])
        out = F.when(F.array_contains(roles, role), F.array_union(out, names)).otherwise(out)
    return F.array_sort(out)


def active_grants(grants: DataFrame, now: Column) -> DataFrame:
    return grants.where(F.col("revoked_at").isNull() & (now < F.col("expires_at")))


def live_assignments(assignments: DataFrame, projects: DataFrame) -> DataFrame:
    live = projects.where(F.col("archived_at").isNull()).select("project_id")
    return assignments.join(live, "project_id", "left_semi")


def principals(
    users: DataFrame, roles: DataFrame, assignments: DataFrame, projects: DataFrame
) -> DataFrame:
    """Users with their roles, permissions and live projects as sorted arrays.

    These are configuration: a user holds a few roles and the projects somebody assigned.
    """
    role_sets = roles.groupBy("user_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    project_sets = (
        live_assignments(assignments, projects)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_set("project_id")).alias("project_ids"))
    )
    none = F.expr("cast(array() as array<string>)")
    return (
        users.select("user_id", "tenant_id")
        .join(role_sets, "user_id", "left")
        .join(project_sets, "user_id", "left")
        .withColumn("roles", F.coalesce("roles", none))
        .withColumn("project_ids", F.coalesce("project_ids", none))
        .withColumn("permissions", permissions_of(F.col("roles")))
    )


def decide(
    requests: DataFrame,
    users: DataFrame,
    roles: DataFrame,
    assignments: DataFrame,
    projects: DataFrame,
    grants: DataFrame,
) -> DataFrame:
    """Allowed or not, and why, for each request. Denied unless something grants it.

    ``requests`` has request_id, user_id, permission, tenant_id, project_id (null for none)
    and ``asked_at``; ``grants`` granted_to, tenant_id, permissions, expires_at, revoked_at.
    A user missing from ``users`` is denied.
    """
    who = users.select("user_id", F.col("tenant_id").alias("home_tenant"))
    held = (
        roles.groupBy("user_id").agg(F.collect_set("role").alias("roles"))
        .select("user_id", permissions_of(F.col("roles")).alias("held"))
    )
    given = (
        grants.where(F.col("revoked_at").isNull())
        .select(
            F.col("granted_to").alias("user_id"), "tenant_id",
            F.explode("permissions").alias("permission"), "expires_at",
        )
        .groupBy("user_id", "tenant_id", "permission")
        .agg(F.max("expires_at").alias("granted_until"))
    )
    assigned = (
        live_assignments(assignments, projects).select("user_id", "project_id").distinct()
        .withColumn("assigned", F.lit(True))
    )
    # Facts have one row per key, so every join keeps the requests' rows; a user with very many
    # grants, projects or requests is split by the skew join, as no fact is a user's whole list.
    facts = (
        requests.join(who.join(held, "user_id", "left"), "user_id", "left")
        .join(given, ["user_id", "tenant_id", "permission"], "left")
        .join(assigned, ["user_id", "project_id"], "left")
    )
    by_grant = F.coalesce(F.col("asked_at") < F.col("granted_until"), F.lit(False))
    in_project = F.coalesce("assigned", F.lit(False))
    by_role = F.coalesce(F.array_contains("held", F.col("permission")), F.lit(False))
    reads_data = F.col("permission").isin(DATA_PERMISSIONS)
    reason = (
        F.when(F.col("home_tenant").isNull(), F.lit("unknown user"))
        .when((F.col("tenant_id") != F.col("home_tenant")) & ~by_grant, F.lit("other tenant"))
        .when(~by_role & ~by_grant, F.lit("not granted"))
        .when(reads_data & F.col("project_id").isNull(), F.lit("no project named"))
        .when(reads_data & ~in_project, F.lit("not assigned to project"))
        .otherwise(F.lit("granted"))
    )
    return facts.select(*requests.columns, reason.alias("reason")).withColumn(
        "allowed", F.col("reason") == "granted"
    )


def audit_rows(decisions: DataFrame) -> DataFrame:
    """One row to append to the audit chain per decision, denials included."""
    return decisions.select(
        F.col("request_id").alias("entry_id"),
        "tenant_id",
        F.col("user_id").alias("actor_id"),
        F.col("permission").alias("action"),
        F.coalesce("resource_type", F.lit("")).alias("resource_type"),
        F.coalesce("resource_id", F.lit("")).alias("resource_id"),
        F.when(F.col("allowed"), F.lit("allowed")).otherwise(F.lit("denied")).alias("outcome"),
        F.col("asked_at").alias("occurred_at"),
        "reason",
    )
