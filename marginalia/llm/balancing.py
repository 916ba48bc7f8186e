"""Entropy balancing of sources: tilted document rates that meet token targets.

Each source gets a token target. Among all rates r with sum(r * size) = target
and 0 <= r <= 3, the ones closest to the corpus as it is (in relative entropy)
are r = min(3, exp(lambda * size / mean size)) with one multiplier per source.
The multipliers solve a convex dual; each Newton step is one aggregate over the
counts of documents by (source, size), never over rows. Rates are then rounded
into whole copies: per (source, size) by systematic rounding, with a last
correction by at most one copy of a few documents, and inside a cell by the
order of a hash of id and text.

Nulls: a null text has size 0, a null source is a source of its own and comes
last. Empty table: empty result. Rows equal in id and text are treated alike.
All results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import join_small, materialise, row_hash, slot_in_group, table, text_of

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
STEPS = 60
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """Targets of (source, source_size): weight shares of the total, none above ``most`` times its size.

    The excess of capped sources goes to the others by weight until none is
    above its cap. That is one level t with target = min(weight * t, cap); it is
    found in the order of cap / weight. Works on one row per source.
    """
    everything = W.partitionBy()
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(in_order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("__cap", F.col("source_size") * float(most))
    by_ratio = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    done = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(done), F.lit(0.0))) / F.sum("__w").over(rest)
    ranked = ranked.withColumn("__level", level).withColumn("__free", F.col("__level") <= F.col("__cap") / F.col("__w"))
    # The first free source decides; among equal ratios it is the one with the highest level.
    final = -F.min(F.when(F.col("__free"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), (-F.col("__level")).alias("l")))).over(everything)["l"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("__cap"), F.col("__w") * F.coalesce(final, F.lit(0.0))))
    return ranked.select("source", "source_size", target.alias("target"))


def tilt(cells: DataFrame, targets: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """Multiplier ``lam`` and mean size of each source by safeguarded Newton steps.

    ``cells`` has (source, size, n). A step outside the bracket of the root is
    replaced by its middle, so every step halves the bracket at least or is a
    Newton step. Sources at their cap need no root: all their rates are ``most``.
    """
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = join_small(targets, mean, ["source"]).select(
        "source", "source_size", "target", "mean",
        F.log(F.greatest(F.col("target"), F.lit(1e-9)) / F.greatest(F.col("source_size"), F.lit(1))).alias("lam"),
        F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"),
        (F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))).alias("full"),
    )
    state = materialise(state, "tilt")
    sources = state.count()
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(raw, F.lit(float(most)))
        moving = F.when(raw < most, raw * x).otherwise(0.0)
        sums = join_small(cells.filter("size > 0"), state.filter("NOT full"), ["source"], count=sources).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("__got"), F.sum(F.col("n") * F.col("size") * moving).alias("__slope")
        )
        error = F.col("__got") - F.col("target")
        lo = F.when(error < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(error > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - error / F.col("__slope")
        middle = (F.col("__lo") + F.col("__hi")) / 2
        step = F.when((F.col("__slope") > 0) & (newton > F.col("__lo")) & (newton < F.col("__hi")), newton).otherwise(middle)
        fresh = join_small(state, sums, ["source"], "left", sources).withColumn("__lo", lo).withColumn("__hi", hi)
        settled = F.col("full") | F.col("__got").isNull() | (F.abs(error) <= F.col("target") * TOLERANCE)
        fresh = fresh.withColumn("__done", settled).withColumn("__lam", F.when(settled, F.col("lam")).otherwise(step))
        fresh = materialise(fresh.select("source", "source_size", "target", "mean", F.col("__lam").alias("lam"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), "full", "__done"), "tilt")
        state = fresh.drop("__done")
        if fresh.filter("NOT __done").isEmpty():
            break
    return state


def copy_plan(cells: DataFrame, state: DataFrame, most: int = MAX_COPIES) -> DataFrame:
    """Whole copies per cell: ``base`` for every document and one more for the first ``extra`` of them.

    Systematic rounding in the order of size keeps the error of a source below
    half of its largest document. The correction then goes once from large to
    small sizes and gives or takes one copy of as many documents as still fit. The fold holds one
    entry per different size of a source.
    """
    raw = F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))
    rate = F.when(F.col("full"), F.lit(float(most))).when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.round(raw, 9), F.lit(float(most))))
    rated = join_small(cells, state, ["source"]).withColumn("rate", rate).withColumn("base", F.floor("rate"))
    upto = W.partitionBy("source").orderBy("size")
    total = F.sum(F.col("n") * (F.col("rate") - F.col("base")))
    after = F.floor(F.round(total.over(upto), 6) + 0.5)
    earlier = F.floor(F.coalesce(F.round(total.over(upto.rowsBetween(W.unboundedPreceding, -1)), 6), F.lit(0.0)) + 0.5)
    rounded = rated.withColumn("extra", F.least(F.greatest(after - earlier, F.lit(0)), F.col("n")))
    rounded = materialise(rounded.select("source", "size", "n", "target", "rate", "base", "extra"), "rounded")
    entry = F.struct((-F.col("size")).alias("k"), F.col("size"), F.col("base"), F.col("extra"), F.col("n"))
    folded = rounded.filter("size > 0").groupBy("source").agg(
        F.sort_array(F.collect_list(entry)).alias("cells"), (F.first("target") - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra")))).alias("short")
    )

    def step(acc: Column, c: Column) -> Column:
        copies = c["n"] * c["base"] + c["extra"]
        # A move is taken only while it shortens the distance: half a document counts as fitting.
        fits = F.floor(F.abs(acc["short"]) / c["size"] + 0.4999)
        up = F.least(c["n"], c["n"] * most - copies, fits)
        down = F.least(c["n"], copies, fits)
        move = F.when(acc["short"] > 0, up).otherwise(-down).cast("long")
        return F.struct(
            (acc["short"] - move * c["size"]).alias("short"),
            F.when(move == 0, acc["moves"]).otherwise(F.concat(acc["moves"], F.array(F.struct(c["size"].alias("size"), move.alias("move"))))).alias("moves"),
        )

    start = F.struct(F.col("short").cast("double").alias("short"), F.array().cast("array<struct<size:bigint,move:bigint>>").alias("moves"))
    moves = folded.select("source", F.explode(F.aggregate("cells", start, step)["moves"]).alias("m")).select("source", "m.size", "m.move")
    fixed = join_small(rounded, moves, ["source", "size"], "left")
    copies = F.col("n") * F.col("base") + F.col("extra") + F.coalesce("move", F.lit(0))
    return fixed.withColumn("__c", copies).select("source", "size", "n", "rate", F.floor(F.col("__c") / F.col("n")).alias("base"), F.pmod("__c", F.col("n")).alias("extra"))


def balance(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, size, source, __h): source_size, target, rate and copies; and the cut table by (source, size).

    The second table decides for any copy of the documents: ``base`` copies, one
    more where the row's hash is at most ``cut``.
    """
    text = text_of()
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), row_hash(F.col("doc_id"), F.crc32(text.cast("binary")), text).alias("__h"))
    narrow = materialise(narrow, "mix")
    cells = materialise(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    counted = cells.agg(F.sum("n").alias("n")).first()["n"] or 0
    targets = materialise(source_targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, most), "targets")
    plan = materialise(copy_plan(cells, tilt(cells, targets, most), most), "plan")
    partial = plan.filter("extra > 0 AND extra < n").select("source", "size", "extra")
    among = join_small(narrow.select("source", "size", "doc_id", "__h"), partial, ["source", "size"])
    numbered = slot_in_group(among, ["source", "size"], "__h", ["doc_id"], "slot", counted)
    cuts = numbered.filter(F.col("slot") == F.col("extra") - 1).select("source", "size", F.col("__h").alias("cut"))
    cut = F.when(F.col("extra") <= 0, F.lit(None).cast("long")).when(F.col("extra") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("cut"))
    cuts = materialise(join_small(plan, cuts, ["source", "size"], "left").withColumn("cut", cut).select("source", "size", "rate", "base", "cut"), "cuts")
    rated = join_small(join_small(narrow, cuts, ["source", "size"]), targets, ["source"])
    more = F.coalesce((F.col("__h") <= F.col("cut")).cast("long"), F.lit(0))
    return rated.withColumn("copies", (F.col("base") + more).cast("long")), cuts


def mix_digest(docs: DataFrame) -> DataFrame:
    rated, _ = balance(docs)
    return rated.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The mixed corpus: every document as often as its copies say, all columns kept."""
    _, cuts = balance(docs, weights, most)
    text = text_of()
    keyed = docs.withColumn("__size", word_count(text)).withColumn("__source", F.col("source").cast("string")).withColumn("__h", row_hash(F.col("doc_id"), F.crc32(text.cast("binary")), text))
    facts = cuts.select(F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("base").alias("__base"), F.col("cut").alias("__cut"))
    joined = join_small(keyed, facts, ["__source", "__size"])
    copies = (F.col("__base") + F.coalesce((F.col("__h") <= F.col("__cut")).cast("long"), F.lit(0))).cast("int")
    repeated = joined.withColumn("__copies", copies).filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(c) for c in docs.columns])


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))
