"""Approximate matching by edit distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import let, similarity

# Fixed value: least similarity when the caller gives none.
THRESHOLD = 0.6


def all_matches(candidates: DataFrame, text: str, queries: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Candidates similar to any of a few literal queries: ``query, <columns>, distance, similarity``.

    Repeated candidates are compared once: ``candidates`` should be distinct
    or grouped. The query list is a call argument, so the rows grow only with
    the candidates. A length test skips pairs that cannot reach the threshold.
    """
    wanted = candidates.select("*", F.explode(F.array(*[F.lit(q) for q in queries])).alias("query"))
    a, b = F.lower("query"), F.lower(text)
    longest = F.greatest(F.length(a), F.length(b))
    near = wanted.filter(F.abs(F.length(a) - F.length(b)) <= F.lit(1 - threshold) * longest + F.lit(1e-9))
    measured = near.withColumn("distance", F.levenshtein(a, b))
    return measured.withColumn("similarity", similarity(F.col("distance"), a, b)).filter(F.col("similarity") >= threshold)


def best_matches(
    candidates: DataFrame, text: str, queries: Sequence[str], order: str, threshold: float = THRESHOLD
) -> DataFrame:
    """Most similar candidate per query; ties go to the lowest ``order``."""
    found = all_matches(candidates, text, queries, threshold)
    rank = F.struct((-F.col("similarity")).alias("s"), F.col(order).alias("o"))
    return found.groupBy("query").agg(
        F.min_by(F.struct(F.col(text).alias("match"), "distance", "similarity"), rank).alias("b")
    ).select("query", "b.*")


def _cut(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """Start and size of the i-th of ``parts`` even pieces of n characters; the longer pieces come last."""
    size, extra = F.floor(n / parts).cast("int"), n % parts
    longer = F.greatest(i - (parts - extra), F.lit(0))
    return i * size + longer, F.when(i >= parts - extra, size + 1).otherwise(size)


def _partner_lengths(n: Column, threshold: float) -> Column:
    """Lengths that a text of the least similarity can have beside one of n characters."""
    return F.sequence(F.ceil(n * threshold - 1e-9).cast("int"), F.floor(n / threshold + 1e-9).cast("int"))


def _edits(a: Column, b: Column, threshold: float) -> Column:
    """Most edits between texts of a and b characters at the least similarity."""
    return F.floor(F.greatest(a, b) * (1 - threshold) + 1e-9).cast("int")


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Similar pairs of two tables of different lower-case texts (column ``low``): ``query, low, distance, similarity``.

    Of two texts within k edits, one cut into k + 1 pieces has a piece that
    stands whole in the other, moved by no more than the edits on its left and
    right allow. So each text of ``right`` is filed under its pieces, for each
    k its possible partners ask for, and each text of ``left`` looks up its
    substrings of that place and length: an equi-join on (length, k, piece
    number, piece). Pairs it finds are then measured; none is lost. Where a text
    is too short for k + 1 pieces, the empty piece joins by length alone.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    n = F.length("low")
    ks = F.array_distinct(F.transform(_partner_lengths(n, threshold), lambda m: _edits(n, m, threshold)))
    filed = right.select("low", n.alias("n"), F.explode_outer(ks).alias("k")).select("low", "n", "k", F.explode_outer(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    start, size = _cut(F.col("n"), F.col("k") + 1, F.col("i"))
    filed = filed.select("low", "n", "k", "i", F.substring("low", start + 1, size).alias("piece"))

    asked = left.select(F.col("low").alias("query"), F.length("low").alias("m"), F.explode_outer(_partner_lengths(n, threshold)).alias("n"))
    asked = asked.withColumn("k", _edits(F.col("m"), F.col("n"), threshold)).withColumn("i", F.explode_outer(F.sequence(F.lit(0), F.col("k"))))
    shift = F.col("m") - F.col("n")
    first = F.greatest(start + F.ceil((shift - F.col("k")) / 2).cast("int"), F.lit(0))
    last = F.least(start + F.floor((shift + F.col("k")) / 2).cast("int"), F.col("m") - size)
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    pieces = F.array_distinct(F.transform(places, lambda p: F.substring(F.col("query"), p + 1, size)))
    asked = asked.select("query", "m", "n", "k", "i", F.explode_outer(pieces).alias("piece")).filter("piece IS NOT NULL")

    met = asked.join(filed, ["n", "k", "i", "piece"]).select("query", "low", "k")
    near = met.withColumn("distance", F.levenshtein("query", "low")).filter(F.col("distance") <= F.col("k"))
    return near.select("query", "low", "distance").distinct().withColumn("similarity", similarity(F.col("distance"), F.col("query"), F.col("low")))


def join_similar(left: DataFrame, query: str, right: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of two tables whose texts are similar, ignoring case: all columns of both, ``distance`` and ``similarity``.

    Repeated texts are compared once. NULL texts meet nothing.
    """
    a, b = left.withColumn("__ql", F.lower(query)), right.withColumn("__tl", F.lower(text))
    found = similar_pairs(a.select(F.col("__ql").alias("low")).filter("low IS NOT NULL").distinct(), b.select(F.col("__tl").alias("low")).filter("low IS NOT NULL").distinct(), threshold)
    found = found.select(F.col("query").alias("__ql"), F.col("low").alias("__tl"), "distance", "similarity")
    return a.join(found, "__ql").join(b, "__tl").drop("__ql", "__tl")


def best_of(query: Column, options: Column, threshold: float = THRESHOLD) -> Column:
    """Most similar string of an array, the earliest on ties; NULL below the threshold."""
    q = F.lower(query)

    def rated(o: Column, i: Column) -> Column:
        low = F.lower(o)
        return F.struct((-similarity(F.levenshtein(q, low), q, low)).alias("s"), i.alias("i"), o.alias("o"))

    return let(
        F.array_min(F.transform(options, rated)), lambda best: F.when(best["s"] <= -threshold, best["o"])
    )
