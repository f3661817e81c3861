"""Rolling message quota as a Structured Streaming job (re-aimed: the
reference only queries a log; here the log is a stream).

File source -> user messages -> per micro-batch counts of (user, hour), written
through ``foreachBatch`` as increments.  A 24-hour window that slides by an hour
is the sum of 24 hours, and counts add up, so no operator has to keep state:
nothing in memory or in a state store grows with the history, and any order of
the files gives the same windows.

Late rows are those more than ``lateness`` behind the newest event of all earlier
batches.  They are counted like any other and are also listed, row by row, in a side
table, so that a reader can tell which windows changed after they were due.

Everything a batch writes lies in folders named by its number and is
overwritten when Spark runs the batch again after a failure; the checkpoint lies
under the session's ``spark.checkpoint.dir``, so a restarted query resumes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path, table_exists

LATENESS = "1 hour"
WINDOW_HOURS = 24


@dataclass(frozen=True)
class QuotaTables:
    """The tables of one quota stream under ``path``."""

    spark: SparkSession
    path: str
    user: str = "user_id"
    ts: str = "ts"

    def _read(self, table: str) -> DataFrame | None:
        path = f"{self.path}/{table}"
        return self.spark.read.parquet(path) if table_exists(self.spark, path) else None

    def folder(self, table: str, epoch: int) -> str:
        return f"{self.path}/{table}/epoch={epoch}"

    def newest_before(self, epoch: int):
        """Newest event of all batches before ``epoch`` (the last one's one-row note), or None."""
        path = self.folder("progress", epoch - 1)
        return self.spark.read.parquet(path).first()["newest"] if epoch and table_exists(self.spark, path) else None

    def windows(self) -> DataFrame | None:
        """(window_start, window_end, user, n): user messages of every 24-hour window, late ones included."""
        hours = self._read("hours")
        if hours is None:
            return None
        per_hour = hours.groupBy(self.user, "hour").agg(F.sum("n").alias("n"))
        starts = F.sequence(F.col("hour") - F.expr(f"INTERVAL {WINDOW_HOURS - 1} HOURS"), F.col("hour"), F.expr("INTERVAL 1 HOUR"))
        return (per_hour.select(self.user, "n", F.explode(starts).alias("window_start"))
                        .groupBy("window_start", self.user).agg(F.sum("n").alias("n"))
                        .select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                                (F.col("window_start") + F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")).cast("timestamp_ntz").alias("window_end"),
                                self.user, "n"))

    def late_rows(self) -> DataFrame | None:
        """(user, ts, due, epoch): rows that came after ``due``, the newest event then known less the lateness."""
        return self._read("late")


def write_increment(tables: QuotaTables, batch: DataFrame, epoch: int, lateness: str = LATENESS) -> None:
    """One micro-batch: its counts, its late rows, and the newest event so far."""
    user, ts = tables.user, tables.ts
    newest = F.lit(tables.newest_before(epoch)).cast("timestamp")
    due = newest - F.expr(f"INTERVAL {lateness}")
    rows = batch.filter(F.col(ts).isNotNull()).select(user, F.col(ts).cast("timestamp").alias(ts))
    rows.persist()      # read three times; lost blocks are read again from the source files
    try:
        (rows.groupBy(user, F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
             .write.mode("overwrite").parquet(tables.folder("hours", epoch)))
        (rows.filter(F.col(ts) < due).withColumn("due", due)
             .write.mode("overwrite").parquet(tables.folder("late", epoch)))
        (rows.agg(F.greatest(F.max(ts), newest).alias("newest"))
             .write.mode("overwrite").parquet(tables.folder("progress", epoch)))
    finally:
        rows.unpersist()


def run_quota_stream(spark: SparkSession, source_glob: str, is_user_message, out_path: str | None = None,
                     user: str = "user_id", ts: str = "ts", max_files_per_trigger: int = 1000,
                     lateness: str = LATENESS, checkpoint: str | None = None) -> QuotaTables:
    """Process everything available (``availableNow``, in micro-batches of at
    most ``max_files_per_trigger`` files) and return the tables.  The windows do
    not depend on the batches; which rows are late does.  Rows without a time are
    left out, a null user is a user of its own.  With ``out_path`` and
    ``checkpoint`` of an earlier run, only files that it has not seen are read."""
    tables = QuotaTables(spark, out_path or scratch_path(spark, "quota-out"), user, ts)
    schema = spark.read.parquet(source_glob).schema
    # the file source watches a directory or a glob, not a bare file name
    glob = source_glob if any(ch in source_glob for ch in "*?[{") else source_glob[:-1] + "[" + source_glob[-1] + "]"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(glob)

    def sink(batch: DataFrame, epoch: int) -> None:
        write_increment(tables, batch, epoch, lateness)

    q = (src.filter(is_user_message).writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint or scratch_path(spark, "quota-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return tables
