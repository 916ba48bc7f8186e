"""Watching a set of notes: a kept listing, compared with the present one at every step.

``listings/step=N`` is the listing after step N, ``changes/step=N`` what the step
found: paths that appeared (``add``), differ in size or time (``change``), or are
gone (``unlink``). ``steps`` gets one row per phase of a step: ``listed`` once
its listing is complete, ``published`` once its changes are. A step that was cut
short is taken up where it stopped, so listings and changes always fit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LISTING = "path string, size_bytes long, modified_at timestamp"
CHANGES = "path string, kind string, ts timestamp"
STEPS = "step long, phase string, cutoff timestamp"


def compare(before: DataFrame, now: DataFrame, cutoff: Column) -> DataFrame:
    """Full outer join of two listings: ``path``, ``kind`` (NULL if nothing happened), and the entry to keep.

    Files touched after ``cutoff`` are still being written: a new one does not
    exist yet, a known one keeps its old entry. A file that was moved here with
    an old time is found all the same, and so is one whose size alone differs.
    """
    old = before.select("path", F.col("size_bytes").alias("old_size"), F.col("modified_at").alias("old_at"), F.lit(True).alias("known"))
    new = now.select("path", "size_bytes", "modified_at", F.lit(True).alias("present"))
    both = old.join(new, "path", "full_outer")
    settled = F.coalesce(F.col("modified_at") <= cutoff, F.lit(True))
    same = F.col("size_bytes").eqNullSafe(F.col("old_size")) & F.col("modified_at").eqNullSafe(F.col("old_at"))
    kind = F.when(F.col("present").isNull(), "unlink").when(~settled | (F.col("known").isNotNull() & same), F.lit(None)).when(F.col("known").isNull(), "add").otherwise("change")
    stays = F.col("present").isNotNull() & (settled | F.col("known").isNotNull())
    return both.select(
        "path",
        kind.alias("kind"),
        stays.alias("stays"),
        F.when(settled, F.col("size_bytes")).otherwise(F.col("old_size")).alias("size_bytes"),
        F.when(settled, F.col("modified_at")).otherwise(F.col("old_at")).alias("modified_at"),
    )


class Watch:
    """The kept listings below ``base``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def _state(self) -> tuple[int, str, dt.datetime | None]:
        """The last step, its phase and its cutoff; -1 before the first one."""
        try:
            rows = self.spark.read.schema(STEPS).parquet(f"{self.base}/steps")
        except AnalysisException:
            return -1, "published", None
        last = rows.agg(F.max(F.struct("step", "phase", "cutoff")).alias("s")).first()["s"]
        return (-1, "published", None) if last is None else (last["step"], last["phase"], last["cutoff"])

    def _mark(self, step: int, phase: str, cutoff: dt.datetime) -> None:
        self.spark.createDataFrame([(step, phase, cutoff)], STEPS).coalesce(1).write.mode("append").parquet(f"{self.base}/steps")

    def listing(self, step: int) -> DataFrame:
        if step < 0:
            return self.spark.createDataFrame([], LISTING)
        return self.spark.read.schema(LISTING).parquet(f"{self.base}/listings/step={step}")

    def advance(self, now: DataFrame, cutoff: dt.datetime | None = None) -> int:
        """Take one step to the listing ``now`` (``path, size_bytes, modified_at``) and return its number.

        The first step only keeps the listing: files that are there at the
        start are no changes.
        """
        step, phase, when = self._state()
        if phase == "listed":
            self._publish(step, when)
        cutoff = cutoff or dt.datetime.now(dt.timezone.utc)
        kept = compare(self.listing(step), now, F.lit(cutoff)).filter("stays").select("path", "size_bytes", "modified_at")
        kept.write.mode("overwrite").parquet(f"{self.base}/listings/step={step + 1}")
        self._mark(step + 1, "listed", cutoff)
        self._publish(step + 1, cutoff)
        return step + 1

    def _publish(self, step: int, cutoff: dt.datetime) -> None:
        if step > 0:
            # Both listings are complete and hold settled entries only.
            found = compare(self.listing(step - 1), self.listing(step), F.lit(None).cast("timestamp")).filter("kind IS NOT NULL")
            ts = F.coalesce(F.when(F.col("kind") == "unlink", F.lit(cutoff)).otherwise(F.col("modified_at")), F.lit(cutoff))
            found.select("path", "kind", ts.alias("ts")).write.mode("overwrite").parquet(f"{self.base}/changes/step={step}")
        self._mark(step, "published", cutoff)

    def changes(self) -> DataFrame:
        """All changes so far with their ``step``."""
        try:
            return self.spark.read.schema(CHANGES + ", step long").parquet(f"{self.base}/changes")
        except AnalysisException:
            return self.spark.createDataFrame([], CHANGES + ", step long")

    def stream(self) -> DataFrame:
        """The changes as a stream: ``path, kind, ts, step``; deletes are rows like any other."""
        self.spark.createDataFrame([], CHANGES + ", step long").write.partitionBy("step").mode("append").parquet(f"{self.base}/changes")
        return self.spark.readStream.schema(CHANGES + ", step long").parquet(f"{self.base}/changes")

    def forget(self, keep: int = 2) -> DataFrame:
        """Steps whose listings are no longer needed; the caller's store removes them."""
        step, _, _ = self._state()
        return self.spark.range(max(0, step + 1 - keep)).select(F.concat(F.lit(f"{self.base}/listings/step="), "id").alias("folder"))


def start_watching(watch: Watch, listing: Callable[[], DataFrame], settle_ms: int = 100, interval: str = "1 second") -> StreamingQuery:
    """Step by step on a clock; each step lists the notes anew. The clock's checkpoint lies beside the listings."""

    def step(_: DataFrame, epoch: int) -> None:
        watch.advance(listing(), dt.datetime.now(dt.timezone.utc) - dt.timedelta(milliseconds=settle_ms))

    clock = watch.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(step).option("checkpointLocation", f"{watch.base}/clock").trigger(processingTime=interval).start()
