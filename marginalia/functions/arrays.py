"""Array expressions of the JVM that stay linear in the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import let

STEP = 32


def _sum(array: Column, start: Column, length: Column) -> Column:
    return F.aggregate(F.slice(array, start, length), F.lit(0).cast("bigint"), lambda total, x: total + x)


def running(values: Column) -> Column:
    """For each element, the sum of those before it.

    A fold that appends to an array copies the array for every element. Here
    sums of 32 and of 1024 elements are formed first, so an element adds up at
    most 31 sums of either kind and one total for each 1024 elements before it.
    """

    return let(F.transform(values, lambda x: x.cast("bigint")), _running)


def _groups(array: Column) -> Column:
    """Sums of STEP elements each."""
    last = F.greatest(F.size(array) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.floor(last / STEP).cast("int")), lambda k: _sum(array, k * STEP + 1, F.lit(STEP)))


def _within(array: Column, base: Column) -> Column:
    """The sum before each element, from the sums before its group."""

    def before(_: Column, i: Column) -> Column:
        group = F.floor(i / STEP).cast("int")
        return F.get(base, group) + _sum(array, group * STEP + 1, i - group * STEP)

    return F.transform(array, before)


def _running(longs: Column) -> Column:
    def by_small(small: Column) -> Column:
        def by_large(large: Column) -> Column:
            totals = F.transform(large, lambda _, k: _sum(large, F.lit(1), k))
            return let(totals, lambda c2: let(_within(small, c2), lambda c1: _within(longs, c1)))

        return let(_groups(small), by_large)

    return let(_groups(longs), by_small)
