import pytest
from pyspark.sql import functions as F

from murmur.operators import chain
from murmur.session import work_dir
from murmur.sources.snapshots import Store
from murmur.streaming import jobs
from murmur.streaming.chains import ChainStream

DDL = "n int, tenant_id string, manifest_sha256 string, bundle_id string"


def rows(spark, numbers):
    made = [(n, f"t{n % 3}", f"{n:064x}", f"b{n}") for n in numbers]
    return spark.createDataFrame(made, DDL)


def linked(frame):
    return sorted((r.tenant_id, r.chain_index, r.bundle_id, r.prev_hash, r.entry_hash) for r in frame.collect())


def stream_at(spark, path=None, writer="chain"):
    return ChainStream(spark, path or work_dir(spark, "chain-stream"), chain.EVIDENCE, ["n"], writer, buckets=4)


@pytest.fixture(scope="module")
def whole(spark):
    return linked(chain.append(rows(spark, range(12)), ["n"], chain.EVIDENCE))


def test_batches_give_the_chain_of_one_pass(spark, whole):
    job = stream_at(spark)
    for batch_id, numbers in enumerate((range(5), [], range(5, 6), range(6, 12))):
        job.process(rows(spark, numbers), batch_id)
    assert linked(job.entries()) == whole
    heads = {r.tenant_id: r.entry_hash for r in job.heads().collect()}
    assert heads == {t: h for t, _, _, _, h in whole} and job.heads().count() == 3
    assert chain.verify(job.entries(), chain.EVIDENCE).where(F.size("problems") > 0).count() == 0


def test_replayed_and_killed_batches(spark, whole, monkeypatch):
    job = stream_at(spark)
    job.process(rows(spark, range(7)), 0)
    job.process(rows(spark, range(7)), 0)
    publish = Store.publish

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(Store, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        job.process(rows(spark, range(7, 12)), 1)
    assert job.entries().count() == 7
    monkeypatch.setattr(Store, "publish", publish)
    again = stream_at(spark, job.store.path)
    again.process(rows(spark, range(7, 12)), 1)
    again.process(rows(spark, range(7, 12)), 1)
    assert linked(again.entries()) == whole


def test_two_writers_from_the_same_head(spark, whole, monkeypatch):
    """The second to publish links its batch again, onto what the first left."""
    one = stream_at(spark, writer="one")
    two = stream_at(spark, one.store.path, "two")
    one.process(rows(spark, range(4)), 0)
    link, seen = ChainStream._linked, []

    def slow(self, base, batch, batch_id):
        changes = link(self, base, batch, batch_id)
        seen.append(self.writer)
        if self.writer == "two" and seen.count("two") == 1:
            one.process(rows(spark, range(4, 8)), 1)
        return changes

    monkeypatch.setattr(ChainStream, "_linked", slow)
    two.process(rows(spark, range(8, 12)), 0)
    assert seen == ["one", "two", "one", "two"] or seen.count("two") == 2
    assert linked(one.entries()) == whole


def test_refused_rows_are_kept_aside(spark):
    job = stream_at(spark)
    bad = spark.createDataFrame([(1, "t0", "x", "b1"), (2, None, "0" * 64, "b2")], DDL)
    job.process(bad, 0)
    assert job.entries().count() == 0 and job.heads() is None and job.refused().count() == 2
    job.process(bad.unionByName(rows(spark, [3])), 1)
    assert job.entries().count() == 1 and job.refused().count() == 4


def test_driven_by_a_stream(spark, whole):
    path = work_dir(spark, "chain-landing")
    job = stream_at(spark)
    for numbers in (range(6), range(6, 12)):
        rows(spark, numbers).coalesce(1).write.mode("append").parquet(path)
        jobs.run(spark.readStream.schema(DDL).parquet(path), job.process, f"{job.store.path}/checkpoint")
    assert linked(job.entries()) == whole
