from datetime import datetime, timedelta

from pyspark.sql import functions as F

from murmur.operators import burst, sinks
from murmur.sources.snapshots import Store
from murmur.streaming import jobs

BASE = datetime(2026, 8, 4)
SHAPE = (
    "tenant_id string, project_id string, source_id string, content_id string, account_id string, "
    "capture_id string, last_capture_id string, posted_at timestamp, timestamp_precision string"
)


def posts(spark, *seconds):
    return spark.createDataFrame(
        [("t", "p", "s", f"c{s}", f"a{i}", f"k{i % 2}", f"k{i % 2}", None if s is None else BASE + timedelta(seconds=s), "second")
         for i, s in enumerate(seconds)],
        SHAPE,
    )


def test_findings_and_members_are_one_run(spark, tmp_path):
    rules = [burst.BurstRule()]
    sinks.write_findings(posts(spark, 0, 10, 20, 30), rules, str(tmp_path), "r1")
    sinks.write_findings(posts(spark, 0, 10, 20, 30), rules, str(tmp_path), "r1")
    sinks.write_findings(posts(spark, 0, 10, 20, 30, 5000), rules, str(tmp_path), "r2")
    assert sinks.read_findings(spark, str(tmp_path)).count() == 2
    accounts = sinks.read_findings(spark, str(tmp_path), "finding_accounts")
    assert accounts.groupBy("run_id").count().where("count = 4").count() == 2
    # what no commit names is not read, and a reader keeps what it resolved
    before = Store(spark, str(tmp_path)).state()
    Store(spark, str(tmp_path)).stage(accounts)
    sinks.write_findings(posts(spark, 0, 10, 20, 30, 40), rules, str(tmp_path), "r2")
    assert sinks.read_findings(before, "", "finding_accounts").count() == 8
    assert sinks.read_findings(spark, str(tmp_path), "finding_accounts").count() == 9


def test_exports_are_appended(spark, tmp_path):
    bundles = spark.createDataFrame([("f1", "{}"), ("f2", "{}")], "finding_id string, bundle_json string")
    for day in (1, 2, 2):
        sinks.append_exports(bundles, f"{tmp_path}/exports", F.lit(datetime(2026, 8, day)), str(day))
    rows = Store(spark, f"{tmp_path}/exports").state().read("exports").collect()
    assert len(rows) == len({r.export_id for r in rows}) == 4


def test_late_and_timeless_items_are_kept(spark, tmp_path):
    job = jobs.BurstStream(spark, str(tmp_path), burst.BurstRule(), 60)
    job.process(posts(spark, 0, 10, 20, 30, 4000), 0)
    assert job.late_items() is None
    job.process(posts(spark, 40, 4100, None), 1)
    assert sorted(r.content_id for r in job.late_items().collect()) == ["c40", "cNone"]
    assert job.late_rows().first().late == 2


def test_a_run_that_is_written_again_reads_the_membership_it_has(spark, tmp_path, monkeypatch):
    """Saved findings and run logs are worked out once, however often their jobs are repeated."""
    from murmur.plans import sinks as plans

    made = []
    keep = sinks.materialise
    monkeypatch.setattr(sinks, "materialise", lambda df, name: made.append(name) or keep(df, name))
    monkeypatch.setattr(plans, "materialise", lambda df, name: made.append(name) or keep(df, name), raising=False)
    plans.findings_saved(spark, "/root/testdata/sf0.001")
    plans.runs_saved(spark, "/root/testdata/sf0.001")
    assert made == ["members", "validated"]
