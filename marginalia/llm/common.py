"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* A null text is an empty text, a null source or id is a value of its own.
* Repeated rows are separate rows; each gets its own result row.
* An empty table gives an empty result.
* Extra input columns are ignored where a narrow result is returned and kept
  where rows pass through. Work columns start with ``__``; an input column with
  the name of a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.session import bounded_batches, materialise, shared_dir, ship_package

__all__ = ["PIECE_BYTES", "bounded_batches", "first_by_hash", "is_held_out", "join_small", "materialise", "row_hash", "shared_dir", "ship_package", "slot_in_group", "table", "text_of"]

# Broadcast sides are counted first; above this many (narrow) rows the join shuffles.
BROADCAST_ROWS = 200_000
# Target number of rows of one hash slice of a group.
SLICE_ROWS = 20_000


# Texts looked at together inside a batch by operators with wide temporaries.
PIECE_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def is_held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the given remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def row_hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)


def join_small(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner", count: int | None = None) -> DataFrame:
    """Join a table that is usually small: broadcast when its counted rows allow it, else shuffled (adaptive skew join)."""
    n = facts.count() if count is None else count
    side = facts.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in facts.columns])
    side = F.broadcast(side) if n <= BROADCAST_ROWS else side
    test = F.lit(True)
    for c in on:
        test = test & rows[c].eqNullSafe(side[f"__r_{c}"])
    return rows.join(side, test, how).drop(*[f"__r_{c}" for c in on])


def slot_in_group(df: DataFrame, group: list[str], hashed: str, ties: list[str], name: str, rows: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of (hash, ties).

    A group may hold a third of all rows, so no task sorts a whole group: the
    hash range is cut into slices of about ``SLICE_ROWS`` rows, slices are
    counted (one small row each), and a row's number is the size of the slices
    before its own plus its place within the slice.
    """
    bits = max(0, min(40, (max(rows, 1) // SLICE_ROWS).bit_length()))
    high = F.shiftright(F.col(hashed), 64 - bits) if bits else F.lit(0).cast("long")
    sliced = df.withColumn("__slice", high)
    sizes = sliced.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    place = W.partitionBy(*group, "__slice").orderBy(hashed, *ties)
    placed = sliced.withColumn("__place", F.row_number().over(place) - 1)
    joined = join_small(placed, offsets, [*group, "__slice"])
    return joined.withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__before", "__place", "__slice")


def first_by_hash(rows: DataFrame, group: str, sizes: dict, most: int) -> DataFrame:
    """At most ``most`` rows of each group, the first by (__h, __t); ``sizes`` holds the rows of each group.

    Only rows whose hash lies in the share that holds about twice the wanted
    number are ranked, so no task ranks a whole large group.
    """
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(group) == value, F.lit(min(1.0, 2.0 * most / max(n, 1)))).otherwise(share)
    near = rows.filter(F.pmod("__h", F.lit(1 << 20)) < share * (1 << 20))
    order = W.partitionBy(group).orderBy(F.pmod("__h", F.lit(1 << 20)), "__h", "__t")
    return near.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= most).drop("__rank")
