"""Hash chains as a stream: every batch is linked once, whatever is killed or replayed.

The store holds two tables: ``entries``, one part for each batch, and ``heads``, the latest
entry of each tenant, in parts by a hash of the tenant. A batch is linked onto the heads of
one commit and published with the heads it moved in the next. So

* a batch that was published is not linked again when it is replayed;
* a batch that was killed before left folders that nothing names, and its retry links onto
  the same heads and gives the same hashes;
* of two writers that move the same heads one is published. The other sees that the heads
  are no longer those it linked onto and links its batch again, onto the new ones;
* readers see entries and heads of one commit.

A batch reads the heads of the parts that its tenants fall into, not the chain. An entry
whose identity is in the chain already, because a source delivers it twice in different
batches, is up to the caller: the chain keeps what it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators import chain
from murmur.operators.chain import ChainFormat
from murmur.sources.snapshots import PART, Conflict, Store, bucket

HEAD_COLUMNS = ("tenant_id", "chain_index", "entry_hash")


class ChainStream:
    """``order`` are the columns that order the new rows of a tenant within a batch."""

    def __init__(
        self, spark: SparkSession, path: str, fmt: ChainFormat, order: list[str], writer: str = "chain",
        buckets: int = 64,
    ):
        self.store = Store(spark, path)
        self.fmt, self.order, self.writer = fmt, order, writer
        self.part = bucket("tenant_id", buckets=buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. Rows that the chain refuses are kept in ``refused``."""
        while True:
            base = self.store.state()
            if base.applied.get(self.writer, -1) >= batch_id:
                return
            try:
                self.store.publish(base, self._linked(base, batch, batch_id), self.writer, batch_id)
                return
            except Conflict:
                continue

    def _linked(self, base, batch: DataFrame, batch_id: int) -> dict[str, dict[str, str]]:
        """Staged folders of a batch linked onto the heads of ``base``."""
        spark, name = self.store.spark, f"{self.writer}-{batch_id:012d}"
        tenants = batch.where(chain.acceptable(self.fmt))
        touched = sorted(r[0] for r in tenants.select(self.part()).distinct().collect())
        heads = base.read("heads", touched)
        entries = self.store.stage(chain.append(batch, self.order, self.fmt, heads))
        changes = {
            "entries": {name: entries},
            "refused": {name: self.store.stage(chain.refused_entries(batch, self.fmt))},
        }
        if touched:
            moved = chain.heads(spark.read.parquet(entries).select(*HEAD_COLUMNS))
            if heads is not None:
                still = heads.select(*HEAD_COLUMNS).join(moved, "tenant_id", "left_anti")
                moved = moved.unionByName(still)
            folder = self.store.stage(moved, self.part())
            changes["heads"] = {p: f"{folder}/{PART}={p}" for p in touched}
        return changes

    def entries(self) -> DataFrame | None:
        return self.store.state().read("entries")

    def refused(self) -> DataFrame | None:
        return self.store.state().read("refused")

    def heads(self) -> DataFrame | None:
        return self.store.state().read("heads")
