"""Line differences of two versions of many notes, as tables.

Lines that occur once in both versions are anchors; of these the longest run
that keeps its order on both sides stays. Anchors cut both versions into
stretches of the same number, in which equal lines at the front and at the back
are set aside. What is left was removed or added. The script always leads from
the old version to the new one, but is not always the shortest.

``rows`` has one row per ``path`` with ``old_content`` and ``content``; a null
version is an empty one. Equal versions have no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import let, unnest


def increasing(values: list[int]) -> list[bool]:
    """Which values form a longest increasing run."""
    tails, ends, before = [], [], []
    for at, value in enumerate(values):
        size = bisect_left(tails, value)
        before.append(ends[size - 1] if size else -1)
        tails[size : size + 1] = [value]
        ends[size : size + 1] = [at]
    kept = [False] * len(values)
    at = ends[-1] if ends else -1
    while at >= 0:
        kept[at] = True
        at = before[at]
    return kept


# A pair of places is one long.
PLACE_BITS = 31


@F.arrow_udf(T.ArrayType(T.LongType()))
def in_order(pairs: pa.Array) -> pa.Array:
    """Pairs (old place, new place), sorted by the old one, of a longest run that keeps the order of the new one."""
    mask = (1 << PLACE_BITS) - 1
    out = []
    for own in pairs:
        packed = own.as_py()
        out.append(list(compress(packed, increasing([p & mask for p in packed]))))
    return pa.array(out, pa.list_(pa.int64()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def unique_pairs(old: Column, new: Column) -> Column:
    """Places of the lines that occur once in both versions, packed, in the order of the old one.

    The lines of both are sorted together: such a line has one neighbour equal to it, behind it and of the other version.
    """

    def marked(lines: Column, is_new: bool) -> Column:
        return F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.lit(is_new).alias("new"), i.alias("at")))

    def pairs(s: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            after = F.get(s, i + 1)
            alone = ~x["new"] & after["new"] & (after["line"] == x["line"])
            # The place before the first is none: an index below zero gives null.
            alone = alone & ~F.get(s, i - 1)["line"].eqNullSafe(x["line"]) & ~F.get(s, i + 2)["line"].eqNullSafe(x["line"])
            return F.when(alone, F.shiftleft(x["at"].cast("long"), PLACE_BITS) + after["at"])

        return F.sort_array(F.filter(F.transform(s, pair), lambda p: p.isNotNull()))

    return let(F.sort_array(F.concat(marked(old, False), marked(new, True))), pairs)


def _stretches(kept: Column, old: Column, new: Column) -> Column:
    """Bounds (from, before) of each stretch on both sides; an anchor begins the stretch behind it."""

    def ends(k: Column) -> Column:
        return F.transform(k, lambda p: F.struct(F.shiftright(p, PLACE_BITS).cast("int").alias("o"), p.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("n")))

    zero = F.array(F.struct(F.lit(0).alias("o"), F.lit(0).alias("n")))
    last = F.array(F.struct(F.size(old).alias("o"), F.size(new).alias("n")))
    return let(F.concat(zero, ends(kept), last), lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda x, i: F.struct(i.cast("bigint").alias("stretch"), x["o"].alias("o"), x["n"].alias("n"), F.get(e, i + 1)["o"].alias("o_end"), F.get(e, i + 1)["n"].alias("n_end"))))


def _upto(n: Column) -> Column:
    """0, 1 ... n - 1; no element where n is 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _changed(v: Column) -> Column:
    """Removed and added lines of a row with ``old``, ``new`` (lines) and its ``stretches``."""
    old, new = v["old"], v["new"]

    def first_difference(n: Column, differ: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.array_min(F.filter(_upto(n), differ)), n)

    def left(x: Column) -> Column:
        def cut(c: Column) -> Column:
            def side(lines: Column, kind: str, start: str, end: str) -> Column:
                count = x[end] - x[start] - c["front"] - c["back"]
                first = x[start] + c["front"]
                return F.transform(_upto(count), lambda j: F.struct(x["stretch"].alias("stretch"), F.lit(kind).alias("kind"), (first + j + 1).alias("line_number"), F.get(lines, first + j).alias("text")))

            return F.concat(side(old, "-", "o", "o_end"), side(new, "+", "n", "n_end"))

        def with_back(front: Column) -> Column:
            # A line must not count for the front and for the back.
            back = first_difference(shorter - front, lambda j: F.get(old, x["o_end"] - 1 - j) != F.get(new, x["n_end"] - 1 - j))
            return let(F.struct(front.alias("front"), back.alias("back")), cut)

        shorter = F.least(x["o_end"] - x["o"], x["n_end"] - x["n"])
        return let(first_difference(shorter, lambda j: F.get(old, x["o"] + j) != F.get(new, x["n"] + j)), with_back)

    return F.flatten(F.transform(v["stretches"], left))


def line_changes(rows: DataFrame) -> DataFrame:
    """Removed (``-``) and added (``+``) lines: ``path, stretch, kind, line_number, text``, numbers from 1 in their own version.

    All of it happens inside the row, so nothing is shuffled; the work grows with the lines (and their sorting).
    """
    # An update that changes nothing needs no lines.
    differing = rows.filter(~F.coalesce("old_content", F.lit("")).eqNullSafe(F.coalesce("content", F.lit(""))))
    # Each generator keeps what it gives a plain column: lines and pairs are found once, and the Python function stays out of the lambdas.
    split = unnest(differing, F.array(F.struct(_lines(F.col("old_content")).alias("old"), _lines(F.col("content")).alias("new"))), "path")
    paired = unnest(split, F.array(F.struct("old", "new", unique_pairs(F.col("old"), F.col("new")).alias("pairs"))), "path")
    kept = paired.select("path", "old", "new", in_order("pairs").alias("kept"))
    both = F.struct("old", "new", _stretches(F.col("kept"), F.col("old"), F.col("new")).alias("stretches"))
    return unnest(kept, let(both, _changed), "path")


def hunks(changes: DataFrame) -> DataFrame:
    """One row per changed stretch: the first and the number of its removed and added lines (null and 0 where there are none)."""
    cols = []
    for kind, name in (("-", "removed"), ("+", "added")):
        own = F.col("kind") == kind
        cols += [F.min(F.when(own, F.col("line_number"))).alias(f"{name}_from"), F.count_if(own).alias(f"n_{name}")]
    return changes.groupBy("path", "stretch").agg(*cols)
