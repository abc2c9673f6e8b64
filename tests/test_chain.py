"""Hash chains: what tampering does, and agreement with a plain implementation."""

import hashlib

import pytest
from pyspark.sql import functions as F

from murmur.operators import chain, evidence
from murmur.operators.neighbours import with_previous


def sealed(spark, n=6, tenants=("t1", "t2")):
    rows = [
        (t, i, f"b{t}{i}", hashlib.sha256(f"{t}{i}".encode()).hexdigest())
        for t in tenants for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "tenant_id string, seq long, bundle_id string, manifest_sha256 string"
    )


@pytest.fixture(scope="module")
def entries(spark):
    made = chain.append(sealed(spark), ["seq"], chain.EVIDENCE)
    return spark.createDataFrame(made.collect(), made.schema)


def plain(fields):
    data = b"".join(len(f.encode()).to_bytes(8, "big") + f.encode() for f in fields)
    return hashlib.sha256(data).hexdigest()


def test_append_matches_plain_code(entries):
    rows = entries.where("tenant_id = 't1'").orderBy("chain_index").collect()
    head = "0" * 64
    for i, r in enumerate(rows):
        want = plain(["evidence-chain-v1", "sha256", "t1", str(i), head, r.manifest_sha256,
                      r.bundle_id])
        assert (r.chain_index, r.prev_hash, r.entry_hash) == (i, head, want)
        head = want


def broken(frame):
    checked = chain.verify(frame, chain.EVIDENCE).where(F.size("problems") > 0)
    return {(r.tenant_id, r.chain_index): set(r.problems) for r in checked.collect()}


def test_intact(entries):
    assert broken(entries) == {}


def test_alter_remove_forge_and_replay(spark, entries):
    at = (F.col("tenant_id") == "t1") & (F.col("chain_index") == 2)

    def altered(column, value):
        return entries.withColumn(column, F.when(at, value).otherwise(F.col(column)))

    edited = altered("manifest_sha256", F.lit("a" * 64))
    assert set(broken(edited)) == {("t1", 2)}
    rehashed = edited.withColumn(
        "entry_hash", F.when(at, chain.entry_digest(chain.EVIDENCE)).otherwise(F.col("entry_hash"))
    )
    assert set(broken(rehashed)) == {("t1", 3)}
    assert set(broken(entries.where(~at))) == {("t1", 3)}
    replayed = entries.where("tenant_id = 't1'").withColumn("tenant_id", F.lit("t9"))
    assert len(broken(replayed)) == 6
    start = altered("prev_hash", F.lit("b" * 64)).where("chain_index >= 2 and tenant_id = 't1'")
    assert set(broken(start)) == {("t1", 2)}
    genesis = entries.withColumn(
        "prev_hash", F.when(F.col("chain_index") == 0, "b" * 64).otherwise(F.col("prev_hash"))
    )
    assert all("genesis" in " ".join(p) for p in broken(genesis).values())


def test_second_run_links_onto_heads(spark, entries):
    more = spark.createDataFrame(
        [("t1", 9, "bx", "c" * 64), ("t3", 1, "by", "d" * 64)],
        "tenant_id string, seq long, bundle_id string, manifest_sha256 string",
    )
    new = chain.append(more, ["seq"], chain.EVIDENCE, chain.heads(entries))
    rows = {r.tenant_id: r for r in new.collect()}
    assert (rows["t1"].chain_index, rows["t3"].chain_index) == (6, 0)
    assert broken(entries.unionByName(new)) == {}


def test_malformed_digest_is_refused(spark):
    bad = sealed(spark, 1, ("t",)).withColumn("manifest_sha256", F.lit("XYZ"))
    assert chain.refused_entries(bad).count() == 1


@pytest.mark.parametrize("block", [1, 2, 3, 1000])
def test_previous_row_in_blocks(spark, block):
    index = [0, 1, 4, 5, 6, 11, 12, 30, 31]
    frame = spark.createDataFrame([("k", i, f"v{i}") for i in index], "k string, i long, v string")
    rows = with_previous(frame, ["k"], "i", ["i", "v"], block).orderBy("i").collect()
    assert [r.previous and r.previous.i for r in rows] == [None, *index[:-1]]


def test_foreign_entry(spark):
    frame = spark.createDataFrame(
        [("s", 0, "t1"), ("s", 1, "t2"), ("s", 2, "t1")],
        "segment_id string, position long, tenant_id string",
    )
    assert [r.position for r in chain.foreign_entries(frame).collect()] == [1]


AUDIT = (
    "tenant_id string, entry_id string, actor_id string, action string, resource_type string, "
    "resource_id string, outcome string, occurred_at timestamp, reason string"
)


def test_audit_hash_ignores_reason_and_zone(spark):
    from datetime import UTC, datetime, timedelta, timezone

    def entry(reason, at):
        row = ("t", "e", "a", "read", "finding", "f", "denied", at, reason)
        frame = chain.with_occurred_text(spark.createDataFrame([row], AUDIT))
        return chain.append(frame, ["entry_id"], chain.AUDIT).first().entry_hash

    utc = datetime(2026, 8, 4, 9, 12, 4, 5, tzinfo=UTC)
    local = utc.astimezone(timezone(timedelta(hours=4)))
    assert entry("one", utc) == entry("two", local)
    assert entry("one", utc) != entry("one", utc + timedelta(microseconds=1))
    want = plain(["audit-chain-v1", "sha256", "t", "0", "0" * 64, "e", "a", "read", "finding",
                  "f", "denied", "2026-08-04T09:12:04.000005Z"])
    assert entry("x", utc) == want


def test_bundle_neighbours_decide(spark, entries):
    """An edited entry spoils the bundles on both sides; a lone check would miss that."""
    at = (F.col("tenant_id") == "t1") & (F.col("chain_index") == 2)
    edited = entries.withColumn(
        "entry_hash", F.when(at, F.lit("e" * 64)).otherwise(F.col("entry_hash"))
    )
    bundles = entries.select("tenant_id", "bundle_id", "manifest_sha256")
    bad = evidence.chain_checks(bundles, edited).where(F.size("chain_problems") > 0)
    assert sorted(r.chain_index for r in bad.collect()) == [1, 2, 3]


def test_missing_fields_are_unsound(entries):
    at = (F.col("tenant_id") == "t1") & (F.col("chain_index") == 3)
    for column in ("manifest_sha256", "entry_hash", "prev_hash", "algorithm", "bundle_id"):
        lost = entries.withColumn(column, F.when(~at, F.col(column)))
        assert ("t1", 3) in broken(lost), column
        if column in ("prev_hash", "entry_hash"):
            found = {r.bundle_id: r.chain_problems for r in evidence.chain_checks(
                entries.select("tenant_id", "bundle_id", "manifest_sha256"), lost).collect()}
            assert "chain broken here" in found["bt13"], column
    start = (F.col("tenant_id") == "t1") & (F.col("chain_index") == 0)
    lost = entries.withColumn("prev_hash", F.when(~start, F.col("prev_hash")))
    assert "does not start from the genesis hash" in broken(lost)["t1", 0]


def test_malformed_rows_are_never_linked(spark):
    good = sealed(spark, 3, ("t1",))
    odd = spark.createDataFrame(
        [("t1", 10, "x", "XYZ"), ("t1", 11, "y", None), ("t1", 12, None, "a" * 64), (None, 13, "z", "a" * 64),
         ("t1", 14, "w", "A" * 64)], good.schema)
    rows = good.unionByName(odd)
    linked = chain.append(rows, ["seq"], chain.EVIDENCE)
    assert sorted(r.seq for r in linked.collect()) == [0, 1, 2]
    assert sorted(r.seq for r in chain.refused_entries(rows).collect()) == [10, 11, 12, 13, 14]
    assert broken(linked) == {}


def test_heads_that_turn_out_small_at_run_time_split_no_tenant(spark, tmp_path):
    """The join with the heads may become a broadcast while running; a tenant stays one sequence."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "300000",
        "spark.sql.files.openCostInBytes": str(64 << 20),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
    }
    spark.range(0, 64 * 200, numPartitions=6).select(
        F.concat(F.lit("t"), (F.col("id") % 200).cast("string")).alias("tenant_id"),
        F.expr("id div 200").alias("seq"),
        F.concat(F.lit("b"), F.col("id").cast("string")).alias("bundle_id"),
        F.sha2(F.col("id").cast("string"), 256).alias("manifest_sha256"),
    ).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    before = {name: spark.conf.get(name) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        first = chain.append(rows.where("seq < 32"), ["seq"], chain.EVIDENCE)
        second = chain.append(rows.where("seq >= 32"), ["seq"], chain.EVIDENCE, chain.heads(first))
        got = {(r.tenant_id, r.seq, r.entry_hash) for r in first.unionByName(second).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    whole = chain.append(rows, ["seq"], chain.EVIDENCE).collect()
    assert got == {(r.tenant_id, r.seq, r.entry_hash) for r in whole}


def test_a_chain_from_its_start_sorts_no_heads(spark):
    """Without heads no row carries one, so the sort of a tenant's rows holds hashed fields alone."""
    made = chain.append(sealed(spark), ["seq"], chain.EVIDENCE)
    assert "head_hash" not in made._jdf.queryExecution().optimizedPlan().toString()
