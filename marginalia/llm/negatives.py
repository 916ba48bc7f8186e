"""Hard-negative mining by a vertical scan of the vectors' dimensions.

Vectors are dealt into blocks that hold one column per dimension, with its
smallest and largest value. For one anchor a block is read dimension by
dimension, in descending order of the anchor's components. What the unread
dimensions can still add lies between known bounds, so each candidate's score
does too; candidates whose bounds cannot reach the result leave the bitmap, and
the scores of those that stay to the end are exact.

First scan: the best ``POSITIVES`` rows of the anchor's label. They set windows
``[LOW, HIGH]`` per cent of a positive's score. Second scan: the best
``NEGATIVES`` rows of other labels within each window. Each block sends a few
rows an anchor, which a ranked window cuts to the result.

Anchors are a stated set of rows (every hundredth id), and meet all rows in
blocks of both: neither a task nor the driver holds all anchors or all rows.

Rows with a null label or vector, or with a null or non-finite component, take
no part. A shorter vector counts as filled up with zeros. Ties go to the
smaller vec_id, a null vec_id last; a null vec_id is no anchor. Equal anchor
rows are one anchor, and rows with an anchor's own vec_id are neither positives
nor negatives of it; other repeated rows count one by one. An anchor without
positives, or a window without rows, gives no result row. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_batches, materialise, ship_package, table

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
SCALE = 256
BLOCK_ROWS, BLOCK_ANCHORS = 65_536, 1024
# Dimensions read between two looks at the bitmap.
STEP = 8
NO_ID = np.iinfo(np.int64).max


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): integer vectors of the rows that take part; every seventh id has its label moved on."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.col("label").cast("long")
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("vec"))


def _matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """rows x dims, zeros behind shorter vectors, in the smallest integer type that holds all values."""
    out = np.zeros((len(vectors), dims), np.int64)
    lengths = vectors.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(out)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    for kind in (np.int8, np.int16, np.int32):
        if not out.size or (out.min() >= np.iinfo(kind).min and out.max() <= np.iinfo(kind).max):
            return out.astype(kind)
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy().astype(np.int64)


PACKED = "ids binary, labels binary, dims int, kind string, matrix binary"


def _pack(name: str, group: int, rows: pa.Table, dims: int, vertical: bool) -> pa.Table:
    m = _matrix(rows["vec"], dims)
    data = np.ascontiguousarray(m.T if vertical else m)
    labels = rows["label"].to_numpy().astype(np.int64)
    return pa.table({name: pa.array([group], pa.int64()), "ids": [_ids(rows["vec_id"]).tobytes()], "labels": [labels.tobytes()], "dims": pa.array([dims], pa.int32()), "kind": [data.dtype.str], "matrix": [data.tobytes()]})


def blocks_of(rows: DataFrame, dims: int, blocks: int) -> DataFrame:
    """One row for each block of vectors, its dimensions stored one after the other."""
    # A null id is no help in dealing rows out.
    number = F.pmod(F.xxhash64(F.coalesce("vec_id", F.monotonically_increasing_id()), "vec_id"), F.lit(blocks))

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        return _pack("rb", key[0].as_py(), group, dims, True)

    return rows.withColumn("rb", number).groupBy("rb").applyInArrow(pack, f"rb bigint, {PACKED}")


def vertical_scan(columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, start: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the rows that ``wanted`` keeps to the end.

    ``wanted`` gets the lower and upper bounds of the candidates' scores and returns which of them stay.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[anchor[order] != 0]
    a, b = anchor * low, anchor * high
    most, least = np.maximum(a, b)[order], np.minimum(a, b)[order]
    rest_most, rest_least = most.sum(), least.sum()
    at, score = start, np.zeros(len(start), np.int64)
    whole = len(at) == columns.shape[1]
    for lo in range(0, len(order), STEP):
        for d in order[lo : lo + STEP]:
            score += anchor[d] * (columns[d] if whole else columns[d][at])
        rest_most -= most[lo : lo + STEP].sum()
        rest_least -= least[lo : lo + STEP].sum()
        stay = wanted(score + rest_least, score + rest_most)
        if not stay.all():
            at, score, whole = at[stay], score[stay], False
        if not len(at):
            break
    return at, score


def kth_largest(x: np.ndarray, k: int) -> int:
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else np.iinfo(np.int64).min


def best_rows(ids: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first k (score, id) by descending score, then id."""
    order = np.lexsort((ids[at], -score))[:k]
    return [(int(score[i]), int(ids[at[i]])) for i in order]


def positives_in(columns, low, high, ids, labels, anchor_id, anchor_label, anchor) -> list[tuple[int, int]]:
    start = np.flatnonzero((labels == anchor_label) & (ids != anchor_id))
    if not len(start):
        return []

    def wanted(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return most >= kth_largest(least, POSITIVES)

    return best_rows(ids, *vertical_scan(columns, low, high, anchor, start, wanted), POSITIVES)


def negatives_in(columns, low, high, ids, labels, anchor_id, anchor_label, anchor, scores: list[int]) -> list[list[tuple[int, int]]]:
    """For each positive's score, the best rows of other labels within its window."""
    start = np.flatnonzero((labels != anchor_label) & (ids != anchor_id))
    # 100 * score from LOW * positive to HIGH * positive, as whole numbers.
    windows = [(-(-LOW * s // 100), HIGH * s // 100) for s in scores]

    def wanted(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(least), bool)
        for lo, hi in windows:
            if lo <= hi:
                sure = least[(least >= lo) & (most <= hi)]
                stay |= (most >= max(lo, kth_largest(sure, NEGATIVES))) & (least <= hi)
        return stay

    if not len(start):
        return [[] for _ in windows]
    at, score = vertical_scan(columns, low, high, anchor, start, wanted)
    out = []
    for lo, hi in windows:
        inside = (score >= lo) & (score <= hi)
        out.append(best_rows(ids, at[inside], score[inside], NEGATIVES))
    return out


def _scan_pairs(blocks: DataFrame, anchors: DataFrame, count: int, second: bool) -> DataFrame:
    """Every block of vectors against every block of anchors; ``anchors`` has one row per anchor."""
    groups = max(1, -(-count // BLOCK_ANCHORS))
    fields = ["ak", "vec_id", "label", "vec", *(["scores"] if second else [])]
    # Anchors are gathered in groups of known size and sent to each block's number.
    numbered = anchors.select(F.pmod("ak", F.lit(groups)).alias("ab"), F.struct(*fields).alias("anchor")).groupBy("ab").agg(F.collect_list("anchor").alias("anchors"))
    keys = blocks.select("rb")
    pairs = numbered.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(keys.agg(F.max("rb")).first()[0] or 0).cast("long"))))
    joined = blocks.join(pairs, "rb").select("ids", "labels", "dims", "kind", "matrix", "anchors")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids = np.frombuffer(batch.column(0)[r].as_buffer(), np.int64)
                labels = np.frombuffer(batch.column(1)[r].as_buffer(), np.int64)
                dims = batch.column(2)[r].as_py()
                columns = np.frombuffer(batch.column(4)[r].as_buffer(), np.dtype(batch.column(3)[r].as_py())).reshape(dims, len(ids))
                low, high = columns.min(1).astype(np.int64), columns.max(1).astype(np.int64)
                out = []
                for x in batch.column(5)[r].as_py():
                    anchor = np.zeros(dims, np.int64)
                    anchor[: len(x["vec"])] = x["vec"]
                    facts = (columns, low, high, ids, labels, x["vec_id"], x["label"], anchor)
                    if second:
                        for k, found in enumerate(negatives_in(*facts, x["scores"])):
                            out += [(x["ak"], k + 1, s, i) for s, i in found]
                    else:
                        out += [(x["ak"], 0, s, i) for s, i in positives_in(*facts)]
                columns_out = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns_out[0], pa.int64()), pa.array(columns_out[1], pa.int32()), pa.array(columns_out[2], pa.int64()), pa.array([None if i == NO_ID else i for i in columns_out[3]], pa.int64())], ["ak", "k", "score", "id"]
                )

    return joined.mapInArrow(run, "ak bigint, k int, score bigint, id bigint")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("id")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("ak", "k").orderBy(*order))).filter(F.col("rank") <= most)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(vectors: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """RESULT rows for every anchor; by default the rows whose vec_id is divisible by 100."""
    spark = vectors.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    rows = materialise(usable(vectors), "vectors")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not facts["n"]:
        return spark.createDataFrame([], RESULT)
    # Blocks of bounded size, and enough of them for all cores.
    size = min(BLOCK_ROWS, max(1024, facts["n"] // (4 * spark.sparkContext.defaultParallelism)))
    blocks = materialise(blocks_of(rows, max(facts["dims"], 1), -(-facts["n"] // size)), "blocks")
    chosen = F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor
    anchors = materialise(rows.filter(chosen).distinct().withColumn("ak", F.xxhash64("vec_id", "label", "vec")), "anchors")
    count = anchors.count()
    positives = materialise(_ranked(_scan_pairs(blocks, anchors, count, False), POSITIVES), "positives")
    scores = positives.groupBy("ak").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    negatives = _ranked(_scan_pairs(blocks, materialise(anchors.join(scores, "ak"), "anchors"), count, True), NEGATIVES)
    known = positives.select("ak", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = negatives.join(known, ["ak", "k"]).join(anchors.select("ak", F.col("vec_id").alias("anchor_id")), "ak")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
