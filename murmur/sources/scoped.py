"""Published views as SQL, behind a tenant that is set for the session.

The tenant is a session variable, and the views are stored as SQL over tables or files, so
each statement is planned with the tenant set at that moment. The value is a constant of
the plan: it reaches the scan like a literal and prunes files and row groups. Where no
tenant is set the comparison is null, and a view has no rows, never all rows.

The views narrow what a statement sees by mistake. They are no access control: a session
that may read the files may read them without a view.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

VARIABLE = "tenant"

#: View: the table it is over, its columns, and a condition beside the tenant.
VIEWS = {
    "content_for_detection": (
        "content",
        "tenant_id source_id content_id account_id capture_id last_capture_id posted_at timestamp_precision",
        "deleted_at IS NULL",
    ),
    "content_provenance": (
        "content",
        "tenant_id content_id capture_id last_capture_id trace_id last_trace_id extractor_version",
        "true",
    ),
    "accounts_for_export": ("accounts", "tenant_id account_id platform handle", "true"),
    "active_users": ("users", "user_id tenant_id email", "disabled_at IS NULL"),
}


def publish(spark: SparkSession, relations: dict[str, str]) -> list[str]:
    """Create the views over ``relations``: table name to SQL relation, such as ``parquet.`path```.

    A tenant that was set stays set. Views over tables that are not given are left out.
    """
    if not _declared(spark):
        spark.sql(f"DECLARE VARIABLE {VARIABLE} STRING DEFAULT NULL")
    made = []
    for view, (name, columns, condition) in VIEWS.items():
        if name in relations:
            spark.sql(
                f"CREATE OR REPLACE TEMPORARY VIEW {view} AS SELECT {', '.join(columns.split())} "
                f"FROM {relations[name]} WHERE tenant_id = session.{VARIABLE} AND {condition}"
            )
            made.append(view)
    return made


def files(path: str) -> str:
    """A folder of Parquet files as a relation."""
    if "`" in path:
        raise ValueError("a path with a backquote is no relation")
    return f"parquet.`{path}`"


def _declared(spark: SparkSession) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.sql(f"SELECT session.{VARIABLE}")
    except AnalysisException:
        return False
    return True


def set_tenant(spark: SparkSession, tenant: str | None) -> None:
    """The tenant of the statements from here on; None for no rows."""
    if tenant is None:
        spark.sql(f"SET VARIABLE {VARIABLE} = CAST(NULL AS STRING)")
    else:
        spark.sql(f"SET VARIABLE {VARIABLE} = (SELECT CAST(:tenant AS STRING))", args={"tenant": tenant})
