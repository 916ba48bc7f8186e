"""Keyed workflow state machine over ordered events.

An event maps each place to a place, and such maps compose. Events are
therefore range-partitioned by (key, order), so a key with a third of all
events is spread over many tasks; each task folds its run of a key into one
small table "from place -> (to place, counts)", and the runs of a key, at most
one per task, are composed in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.errors import InvalidTransition
from marginalia.session import shared_dir

# Places and transitions of the workflow.
PLACES = ("idle", "exploring", "editing", "reviewing")
TRANSITIONS = (
    ("search", "idle", "exploring"),
    ("open_note", "exploring", "editing"),
    ("refine", "exploring", "exploring"),
    ("reset", "exploring", "idle"),
    ("save", "editing", "reviewing"),
    ("back", "editing", "exploring"),
    ("reset", "editing", "idle"),
    ("done", "reviewing", "idle"),
    ("open_note", "reviewing", "editing"),
    ("search", "reviewing", "exploring"),
)
# Event name that forces the idle place and forgets what came before.
HARD_RESET = "hard_reset"

_SLOT = {p: i for i, p in enumerate(PLACES)}
_MOVES: dict[str, dict[int, int]] = {}
for _name, _from, _to in TRANSITIONS:
    _MOVES.setdefault(_name, {})[_SLOT[_from]] = _SLOT[_to]


def next_place(place: str, transition: str) -> str:
    target = _MOVES.get(transition, {}).get(_SLOT[place])
    if target is None:
        raise InvalidTransition(place, f"{transition} (not available from {place})")
    return PLACES[target]


def available(place: str) -> list[str]:
    return [name for name, start, _ in TRANSITIONS if start == place]


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRANSITIONS), "name string, from_place string, to_place string")


STARTS = T.ArrayType(T.StructType([T.StructField("run", T.IntegerType()), T.StructField("start", T.LongType())]))


class _Run:
    """Effect of a stretch of events for each possible starting place."""

    def __init__(self) -> None:
        self.place = [0, 1, 2, 3]
        self.ok = [0, 0, 0, 0]
        self.rejected = [0, 0, 0, 0]
        self.cleared = False

    def step(self, name: str) -> None:
        if name == HARD_RESET:
            self.place, self.ok, self.rejected, self.cleared = [0] * 4, [0] * 4, [0] * 4, True
            return
        moves = _MOVES.get(name, {})
        for start, at in enumerate(self.place):
            to = moves.get(at)
            if to is None:
                self.rejected[start] += 1
            else:
                self.place[start] = to
                self.ok[start] += 1


def _ranged(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.filter(F.col(key).isNotNull()).repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)


def _runs(ranged: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """One row per task and key: the first order values and the effect of the run."""
    fields = [ranged.schema[c] for c in [key, *order]]
    longs = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("place", "ok", "rejected")]
    schema = T.StructType([*fields, *longs, T.StructField("cleared", T.BooleanType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, head, run = None, None, None

        def row() -> tuple:
            return (*head, run.place, run.ok, run.rejected, run.cleared)

        for batch in batches:
            done = []
            heads = list(zip(*[batch[c] for c in [key, *order]]))
            for values, event in zip(heads, batch[name]):
                if run is None or values[0] != current:
                    if run is not None:
                        done.append(row())
                    current, head, run = values[0], values, _Run()
                run.step(event)
            yield pd.DataFrame(done, columns=schema.names)
        if run is not None:
            yield pd.DataFrame([row()], columns=schema.names)

    return ranged.select(key, *order, name).mapInPandas(fold, schema)


def _compose(runs: Column) -> Column:
    """Fold ordered runs from the idle place: ``struct<place,ok,rejected>``."""
    zero = F.lit(0).cast("bigint")

    def step(s: Column, r: Column) -> Column:
        at = s["place"].cast("int")
        keep = F.when(r["cleared"], zero)
        return F.struct(
            F.get(r["place"], at).alias("place"),
            (F.coalesce(keep, s["ok"]) + F.get(r["ok"], at)).alias("ok"),
            (F.coalesce(keep, s["rejected"]) + F.get(r["rejected"], at)).alias("rejected"),
        )

    start = F.struct(zero.alias("place"), zero.alias("ok"), zero.alias("rejected"))
    return F.aggregate(runs, start, step)


@F.arrow_udf(STARTS)
def _starts(runs: pa.Array) -> pa.Array:
    """Starting place of every run of a key, in one pass over its ordered runs."""
    out = []
    for ordered in runs.to_pylist():
        at, row = 0, []
        for run in ordered:
            row.append({"run": run["run"], "start": at})
            at = run["place"][at]
        out.append(row)
    return pa.array(out, pa.list_(pa.struct([("run", pa.int32()), ("start", pa.int64())])))


def _place_name(slot: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in PLACES]), slot.cast("int"))


def _collected(runs: DataFrame, key: str, order: list[str], *extra: str) -> DataFrame:
    """Runs of each key in order; a key has at most one run per task."""
    fields = [*order, *extra, "place", "ok", "rejected", "cleared"]
    return runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("runs"))


def final_state(events: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``key, final_place, n_ok, n_rejected`` after all events of each key.

    ``order`` must be unique within a key, so that range bounds can split it.
    """
    runs = _runs(_ranged(events, key, order), key, order, name)
    folded = _collected(runs, key, order).select(key, _compose(F.col("runs")).alias("s"))
    return folded.select(
        key,
        _place_name(F.col("s.place")).alias("final_place"),
        F.col("s.ok").alias("n_ok"),
        F.col("s.rejected").alias("n_rejected"),
    )


def history(events: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Every event with the place before and after it; rejected events keep the place.

    The range-partitioned events are checkpointed, because their split into
    runs must be the same when the starting places are brought back to them.
    """
    shared_dir(events.sparkSession)
    ranged = _ranged(events.select(key, *order, name), key, order).withColumn("run", F.spark_partition_id()).checkpoint()
    runs = _runs(ranged, key, order + ["run"], name)
    numbered = _collected(runs, key, order, "run")
    starts = numbered.select(key, F.explode_outer(_starts("runs")).alias("b")).select(key, "b.run", "b.start")
    joined = ranged.join(starts, [key, "run"]).repartition(key, "run").sortWithinPartitions(key, "run", *order)
    fields = [ranged.schema[c] for c in [key, *order, name]]
    schema = T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in ("from_place", "to_place")], T.StructField("accepted", T.BooleanType())])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, at = None, 0
        for batch in batches:
            rows = []
            for values in zip(*[batch[c] for c in [key, "run", "start", *order, name]]):
                if values[:2] != current:
                    current, at = values[:2], int(values[2])
                event = values[-1]
                to = 0 if event == HARD_RESET else _MOVES.get(event, {}).get(at)
                rows.append((values[0], *values[3:], PLACES[at], PLACES[at if to is None else to], to is not None))
                at = at if to is None else to
            yield pd.DataFrame(rows, columns=schema.names)

    return joined.select(key, "run", "start", *order, name).mapInPandas(replay, schema)
