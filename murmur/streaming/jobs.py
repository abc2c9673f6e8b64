"""Stream jobs whose state is a table: one version per micro-batch in the shared folder.

State per key would put a busy project into one task. Here every micro-batch is a batch
job over the rows that are still open, with the same operators and the same skew handling.
A version is named by the batch id and overwritten when a batch is replayed, so a restart
gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from murmur.functions.moments import MICROS, micros
from murmur.operators import burst
from murmur.operators.burst import KEYS, BurstRule
from murmur.operators.content import CONTENT_KEY, FIRST_ONLY
from murmur.operators.spacing import NEVER, choose_spaced


def _version(path: str, table: str, batch_id: int) -> str:
    return f"{path}/{table}/batch={batch_id}"


class BurstStream:
    """Streaming burst windows, exact for everything that arrives before the watermark.

    A start is decided once the watermark has passed its window. Rows at or before the
    watermark, or without a time, are late: the windows they belong to are out, so they are counted
    and kept aside (:meth:`late_items`) for a batch run.
    """

    def __init__(self, spark: SparkSession, path: str, rule: BurstRule, delay_seconds: int):
        self.spark, self.path, self.rule = spark, path, rule
        self.delay = delay_seconds * MICROS
        self.gap = rule.window_seconds * MICROS
        self.last = -1

    def _read(self, table: str, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(_version(self.path, table, batch_id))

    def _write(self, frame: DataFrame, table: str, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(_version(self.path, table, batch_id))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        self._advance(batch.select(*[c for c in burst.OBSERVATION_COLUMNS if c in batch.columns]),
                      batch_id, flush=False)

    def flush(self, last: int | None = None) -> None:
        """Decide what is still open after batch ``last``; for the end of a bounded stream."""
        last = self.last if last is None else last
        nothing = self._read("open", last).limit(0).drop("_t")
        self._advance(nothing, last + 1, flush=True)

    def _advance(self, batch: DataFrame, batch_id: int, flush: bool) -> None:
        new = batch.withColumn("_t", micros(F.col("posted_at")))
        before, undecided, cover = NEVER, None, None
        if batch_id > 0:
            clock = self._read("clock", batch_id - 1).first()
            before = clock.watermark
            undecided = self._read("open", batch_id - 1).where(F.col("_t") > clock.final)
            cover = self._read("cover", batch_id - 1)
        too_late = F.coalesce(F.col("_t") <= before, F.lit(True))
        late, watermark = 0, 2**62
        if flush:
            self._write(undecided, "open", batch_id)
        else:
            # The batch is read once: what is late is counted while the rest is written.
            seen = Observation()
            rows = new.observe(seen, F.max("_t").alias("m"), F.count_if(too_late).alias("late")).where(~too_late)
            if undecided is not None:
                rows = rows.unionByName(undecided)
            self._write(rows, "open", batch_id)
            late, newest = seen.get["late"], seen.get["m"]
            watermark = max(before, NEVER if newest is None else newest - self.delay)
        # Every step below reads this version.
        rows = self._read("open", batch_id)
        final = watermark - self.gap

        if late:
            # kept, so that a batch run can decide their windows again
            self._write(new.where(too_late).drop("_t"), "late", batch_id)
        rules = [self.rule]
        decided = burst.qualifying_starts(rows, rules).where(F.col("at") <= final)
        starts = choose_spaced(
            decided, KEYS, keep=["item_count", "account_count"], covered=cover
        )
        self._write(starts, "starts", batch_id)
        starts = self._read("starts", batch_id)
        self._write(burst.findings_of_starts(rows, starts, rules), "findings", batch_id)
        ends = starts.select(*KEYS, (F.col("at") + F.col("gap")).alias("covered_until"))
        if cover is not None:
            ends = ends.unionByName(cover)
        self._write(
            ends.groupBy(*KEYS).agg(F.max("covered_until").alias("covered_until")),
            "cover", batch_id,
        )
        # The clock is written last: a version without it is incomplete and done again.
        self._write(
            self.spark.range(1).select(
                F.lit(watermark).cast("long").alias("watermark"),
                F.lit(final).cast("long").alias("final"),
                F.lit(late).cast("long").alias("late"),
            ),
            "clock", batch_id,
        )
        self.last = batch_id

    def findings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/findings")

    def late_items(self) -> DataFrame | None:
        """Items behind the watermark, and items without a time; None if there were none."""
        if not self.spark.read.parquet(f"{self.path}/clock").where("late > 0").limit(1).count():
            return None
        return self.spark.read.parquet(f"{self.path}/late")

    def late_rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/clock").agg(F.sum("late").alias("late"))


class ContentLog:
    """Re-observation upsert as a log of small merges, folded when read.

    A micro-batch adds what it learned per item, already merged; nothing stored is rewritten.
    ``current`` folds the log, ``compact`` writes the fold as a new base.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. Needs the content columns, ``seen_at`` and ``seq``."""
        first = [c for c in FIRST_ONLY if c in batch.columns]
        order = F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("seq"))
        learned = batch.groupBy(*CONTENT_KEY).agg(
            F.min(order).alias("first_order"),
            F.min_by(F.struct(*first, F.col("seen_at").alias("first_seen")), order).alias("f"),
            F.max(order).alias("last_order"),
            F.max_by(
                F.struct(
                    F.col("seen_at").alias("last_seen"),
                    F.col("capture_id").alias("last_capture_id"),
                    F.col("trace_id").alias("last_trace_id"),
                ),
                order,
            ).alias("l"),
        )
        (
            learned.withColumn("posted_month", F.date_format("posted_at", "yyyy-MM"))
            .write.mode("overwrite")
            .partitionBy("posted_month")
            .parquet(_version(self.path, "log", batch_id))
        )

    def current(self) -> DataFrame:
        log = self.spark.read.parquet(f"{self.path}/log")
        return (
            log.groupBy("posted_month", *CONTENT_KEY)
            .agg(
                F.min_by("f", "first_order").alias("f"),
                F.max_by("l", "last_order").alias("l"),
            )
            .select(*CONTENT_KEY, "f.*", "l.*")
        )

    def compact(self, path: str, through: int) -> "ContentLog":
        """A new log whose first part is the fold of the batches up to ``through``.

        The old log is left as it is, so readers may finish; point the stream at the new one.
        """
        log = self.spark.read.parquet(f"{self.path}/log")
        old = F.col("last_order.batch") <= through
        folded = log.where(old).groupBy("posted_month", *CONTENT_KEY).agg(
            F.min("first_order").alias("first_order"),
            F.min_by("f", "first_order").alias("f"),
            F.max("last_order").alias("last_order"),
            F.max_by("l", "last_order").alias("l"),
        )
        made = ContentLog(self.spark, path)
        for part, number in ((folded, through), (log.where(~old), through + 1)):
            part.select(*[c for c in folded.columns if c != "posted_month"], "posted_month").write.mode(
                "overwrite"
            ).partitionBy("posted_month").parquet(_version(path, "log", number))
        return made


class HealthStream:
    """Source health kept up to date in processing order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.last = -1

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``. Attempts count in order of arrival, then of time."""
        order = F.struct("started_at", "job_id")
        ok = F.col("status") == "succeeded"
        done = batch.where(F.col("status") != "running")
        success = done.groupBy("source_id").agg(F.max(F.when(ok, order)).alias("ok_order"))
        later = F.col("ok_order").isNull() | (order > F.col("ok_order"))
        fresh = (
            done.join(success, "source_id")
            .groupBy("source_id")
            .agg(
                F.max_by("started_at", order).alias("last_attempt_at"),
                F.max_by(F.when(ok, F.col("started_at")), F.when(ok, order)).alias(
                    "last_success_at"
                ),
                F.count_if(later & ~ok).alias("consecutive_failures"),
                F.max_by(F.when(later & ~ok, F.col("failure_reason")), order).alias(
                    "last_failure_reason"
                ),
            )
        )
        if batch_id > 0:
            fresh = self._merge(
                self.spark.read.parquet(_version(self.path, "health", batch_id - 1)), fresh
            )
        fresh.write.mode("overwrite").parquet(_version(self.path, "health", batch_id))
        self.last = batch_id

    @staticmethod
    def _merge(old: DataFrame, new: DataFrame) -> DataFrame:
        o, n = old.alias("o"), new.alias("n")
        reset = F.col("n.last_success_at").isNotNull()
        carried = F.coalesce("o.consecutive_failures", F.lit(0))
        added = F.coalesce("n.consecutive_failures", F.lit(0))
        return o.join(n, F.col("o.source_id") == F.col("n.source_id"), "full").select(
            F.coalesce("o.source_id", "n.source_id").alias("source_id"),
            F.coalesce("n.last_attempt_at", "o.last_attempt_at").alias("last_attempt_at"),
            F.coalesce("n.last_success_at", "o.last_success_at").alias("last_success_at"),
            F.when(reset, added).otherwise(carried + added).alias("consecutive_failures"),
            F.when(reset, F.col("n.last_failure_reason"))
            .otherwise(F.coalesce("n.last_failure_reason", "o.last_failure_reason"))
            .alias("last_failure_reason"),
        )

    def current(self, last: int | None = None) -> DataFrame:
        version = self.last if last is None else last
        return self.spark.read.parquet(_version(self.path, "health", version))


def run(stream: DataFrame, process, checkpoint: str) -> None:
    """Drive a ``foreachBatch`` job over everything that is there, then stop."""
    query = (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drive an append query over everything that is there into files."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
