"""Change events: debounce, deduplication, deletes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

# Quiet period in milliseconds for the library and for a service.
DEBOUNCE_MS = 500
SERVICE_DEBOUNCE_MS = 1000


def firings(changes: DataFrame, path: str, micros: str, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Last event of every burst: no later event of the path within the gap.

    Time is cut into buckets as wide as the gap. Only the last event of a
    bucket can fire, and only the first event of the next bucket can stop it,
    so each event contributes to its own bucket and, as a possible successor,
    to the one before. One grouped pass with map-side combining does it; the
    key is (path, bucket), so one busy path does not end up in one task.
    ``micros`` is a BIGINT column; gives ``path, last_micros``.
    """
    gap = gap_ms * 1000
    bucket = F.floor(F.expr(f"({micros} - pmod({micros}, {gap})) div {gap}"))
    own = F.struct(bucket.alias("b"), F.col(micros).alias("own"), F.lit(None).cast("bigint").alias("next"))
    prior = F.struct((bucket - 1).alias("b"), F.lit(None).cast("bigint").alias("own"), F.col(micros).alias("next"))
    marks = changes.select(path, F.explode_outer(F.array(own, prior)).alias("m")).select(path, "m.*")
    grouped = marks.groupBy(path, "b").agg(F.max("own").alias("last_micros"), F.min("next").alias("next"))
    quiet = F.col("next").isNull() | (F.col("next") - F.col("last_micros") > gap)
    return grouped.filter(F.col("last_micros").isNotNull() & quiet).select(path, "last_micros")


def queue(changes: DataFrame, path: str, micros: str) -> DataFrame:
    """Distinct paths with their first appearance."""
    return changes.groupBy(path).agg(F.min(micros).alias("first_micros"))


def queue_entries(events: DataFrame, path: str, micros: str, is_delete: Column, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """What enters the queue: debounced changes, and deletes at once."""
    changed = firings(events.filter(~is_delete), path, micros, gap_ms)
    changes = changed.select(path, (F.col("last_micros") + gap_ms * 1000).alias("at_micros"), F.lit("change").alias("kind"))
    deletes = events.filter(is_delete).select(path, F.col(micros).alias("at_micros"), F.lit("unlink").alias("kind"))
    return changes.unionByName(deletes)


def sessions(stream: DataFrame, path: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """Streaming debounce: one row per path and burst once the watermark passes its end.

    ``watermark`` is how late events may come; it has no default, because later
    ones are dropped. Zero suits sources that are in order.
    """
    return bursts(stream.withWatermark(ts, watermark), path, ts, gap)


def bursts(events: DataFrame, path: str, ts: str, gap: str) -> DataFrame:
    """One row per path and burst, of a table or a stream."""
    return (
        events.groupBy(path, F.session_window(ts, gap).alias("w"))
        .agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events"))
        .select(path, "last_ts", "n_events", F.col("w.end").alias("fires_at"))
    )


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The open bursts of a path: first and last event and number of events of each, in order.
OPEN = "first array<bigint>, last array<bigint>, n array<bigint>"


class _Debouncer(StatefulProcessor):
    """Keeps the open bursts of a path; a timer fires them when they have been quiet for the gap.

    There is one state row and one timer for each path with an open burst, and
    more than one burst in it only where events come late.
    """

    def __init__(self, path: str, gap_micros: int) -> None:
        self.path, self.gap = path, gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def _rows(self, path: object, at: list[int], kind: str, n: list[int], fires: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.path: [path] * len(at), "last_micros": at, "kind": kind, "n_events": n, "at_micros": fires})

    def _due(self, last: int) -> int:
        """Milliseconds at which nothing more can belong to a burst with this last event."""
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        times = []
        for part in rows:
            gone = part["unlink"].to_numpy(bool)
            if gone.any():
                at = part["micros"].to_numpy()[gone].tolist()
                yield self._rows(key[0], at, "unlink", [1] * len(at), at)
            times.append(part["micros"].to_numpy(np.int64)[~gone])
        fresh = np.sort(np.concatenate(times))
        if not len(fresh):
            return
        # The batch's own bursts, then those of the state: both become one ordered list that is joined where gaps are small.
        cut = np.flatnonzero(np.diff(fresh) > self.gap) + 1
        starts, ends = np.append(0, cut), np.append(cut, len(fresh))
        spans = [(int(fresh[s]), int(fresh[e - 1]), int(e - s)) for s, e in zip(starts, ends, strict=True)]
        if self.open.exists():
            old = self.open.get()
            self.handle.deleteTimer(self._due(old[1][0]))
            spans = sorted(spans + list(zip(*old, strict=True)))
        joined = [list(spans[0])]
        for first, last, n in spans[1:]:
            if first - joined[-1][1] <= self.gap:
                joined[-1][1] = max(joined[-1][1], last)
                joined[-1][2] += n
            else:
                joined.append([first, last, n])
        self._keep(joined)

    def _keep(self, bursts: list[list[int]]) -> None:
        self.open.update(tuple([b[i] for b in bursts] for i in range(3)))
        self.handle.registerTimer(self._due(bursts[0][1]))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers set from here wait for the next batch, so all that is due leaves now.
        now = timerValues.getCurrentWatermarkInMs()
        bursts = [list(b) for b in zip(*self.open.get(), strict=True)]
        done = [b for b in bursts if self._due(b[1]) <= now]
        left = bursts[len(done) :]
        if left:
            self._keep(left)
        else:
            self.open.clear()
        yield self._rows(key[0], [b[1] for b in done], "change", [b[2] for b in done], [b[1] + self.gap for b in done])

    def close(self) -> None:
        pass


def debounced(events: DataFrame, path: str, ts: str, gap_ms: int = DEBOUNCE_MS, watermark: str = "0 seconds", is_delete: Column | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """A stream of what enters the queue: ``path, last_micros, kind, n_events, at_micros``.

    A burst of changes of a path leaves once, when no event of the path came for
    longer than the gap; rows of ``is_delete`` leave at once and do not touch an
    open burst. Append mode; a path without an open burst has no state. The
    watermark says how late events may come. Timers follow the newest event of
    any path; ``ticks`` (a stream with a column ``ts``) moves time on while
    nothing happens. Rows without a path are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    gone = F.lit(False) if is_delete is None else F.coalesce(is_delete, F.lit(False))
    kind = events.schema[path].dataType.simpleString()
    rows = events.filter(F.col(path).isNotNull()).select(path, F.col(ts).cast("timestamp").alias("ts"), gone.alias("unlink"))
    if ticks is not None:
        rows = rows.unionByName(ticks.select(F.lit(None).cast(kind).alias(path), F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("unlink")))
    timed = rows.withWatermark("ts", watermark).withColumn("micros", F.unix_micros("ts"))
    result = f"`{path}` {kind}, last_micros bigint, kind string, n_events bigint, at_micros bigint"
    return timed.groupBy(path).transformWithStateInPandas(_Debouncer(path, gap_ms * 1000), result, "Append", "EventTime")


def drained(events: DataFrame, path: str, ts: str, base: str, gap_ms: int = DEBOUNCE_MS, watermark: str = "0 seconds", is_delete: Column | None = None) -> DataFrame:
    """All of :func:`debounced` for the input there is now, bursts still open at its end too.

    A tick later than all events fires the last timers. ``base`` is a folder
    for checkpoint, ticks and result; a further call with the same folder goes
    on from there with new input and returns all results so far.
    """
    spark = events.sparkSession
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(f"{base}/ticks")
    ticks = spark.readStream.schema("ts timestamp").parquet(f"{base}/ticks")
    found = debounced(events, path, ts, gap_ms, watermark, is_delete, ticks)

    def run() -> str | None:
        out = found.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
        query = out.trigger(availableNow=True).start()
        query.awaitTermination()
        return max((p["eventTime"]["max"] for p in query.recentProgress if "max" in p["eventTime"]), default=None)

    newest = run()
    if newest is not None:
        later = F.lit(newest).cast("timestamp") + F.expr(f"INTERVAL {gap_ms + 2} MILLISECONDS") + F.expr(f"INTERVAL {watermark}")
        spark.range(1).select(later.alias("ts")).write.mode("append").parquet(f"{base}/ticks")
        run()
    return spark.read.schema(found.schema).parquet(f"{base}/out")


def micros_of(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)
