"""Workflow state kept by a streaming query.

Events of a micro-batch are dealt by ranges of (key, order) and folded where
they lie: a stretch of events of one key becomes one small table "from place ->
(to place, counts)". Only these tables, at most one per task and key, reach the
key's state, where they are composed in order. A key with most of the events is
thus spread over the tasks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from marginalia.operators.workflow import PLACES, _Run, available
from marginalia.streaming.debounce import STATE_STORE

STATE = "place int, n_ok bigint, n_rejected bigint"


class _Machine(StatefulProcessor):
    """Place and counts of one key."""

    def __init__(self, key: str, order: list[str]) -> None:
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        place, ok, rejected = self.state.get() if self.state.exists() else (0, 0, 0)
        runs = [run for part in rows for run in part.to_dict("records")]
        for run in sorted(runs, key=lambda r: [r[c] for c in self.order]):
            # A hard reset forgets what came before it.
            ok, rejected = (0, 0) if run["cleared"] else (ok, rejected)
            ok, rejected, place = ok + int(run["ok"][place]), rejected + int(run["rejected"][place]), int(run["place"][place])
        self.state.update((place, ok, rejected))
        names = ",".join(available(PLACES[place]))
        yield pd.DataFrame([(key[0], PLACES[place], ok, rejected, names)], columns=[self.key, "final_place", "n_ok", "n_rejected", "available"])

    def close(self) -> None:
        pass


def folded(events: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """One row per task and key: the first order values and the effect of the key's events in this task.

    A task orders its share of the micro-batch itself; sorting is no operation
    on streams. ``maxFilesPerTrigger`` and the like bound that share.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = events.filter(events[key].isNotNull()).select(key, *order, name).repartitionByRange(n, key, *order)
    fields = [f"`{c}` {ranged.schema[c].dataType.simpleString()}" for c in (key, *order)]
    columns = [key, *order, "place", "ok", "rejected", "cleared"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values([key, *order])
        for _, own in rows.groupby(key, sort=False):
            run = _Run()
            for event in own[name]:
                run.step(event)
            yield pd.DataFrame([(*own.iloc[0][[key, *order]], run.place, run.ok, run.rejected, run.cleared)], columns=columns)

    return ranged.mapInPandas(fold, ", ".join(fields) + ", place array<bigint>, ok array<bigint>, rejected array<bigint>, cleared boolean")


def workflow_states(events: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``key, final_place, n_ok, n_rejected, available`` of the keys of each micro-batch (update mode).

    ``order`` must be unique within a key. ``available`` lists the transitions
    that the place allows.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kind = events.schema[key].dataType.simpleString()
    result = f"`{key}` {kind}, final_place string, n_ok bigint, n_rejected bigint, available string"
    return folded(events, key, order, name).groupBy(key).transformWithStateInPandas(_Machine(key, order), result, "Update", "None")
