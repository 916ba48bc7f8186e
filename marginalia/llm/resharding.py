"""Resharding by minimum-cost flow: move the fewest bytes from old shards to new capacities.

The old shard sizes are one aggregate. The flow between shards is solved on the
driver over a graph of shards (never rows). Each old shard keeps a prefix of its
documents and hands the rest out as blocks of consecutive documents, one block
per receiving shard. Documents are ordered from large to small, so the borders
of the blocks fall between small documents and the new sizes are near equal.

Nulls: a null text has no bytes, a null id or old shard is a value of its own.
Empty table: empty result. Repeated rows are placed one by one. Ties in the
order are broken by hash, id and checksum; equal rows are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import SLICE_ROWS, join_small, materialise, row_hash, slot_in_group, table, text_of

SHARDS = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest transport of every byte of ``supply`` into ``capacity`` by successive shortest paths.

    ``cost(i, j)`` is the price of one byte from old shard i to new shard j.
    The graph has one node per shard on each side, so its size is the number of
    shards. Returns the bytes on each used edge.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append(len(edges))
        edges.append([b, room, price])
        graph[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost(i, j))
    left = sum(supply)
    if left > sum(capacity):
        raise ValueError("the new capacities are smaller than the data")
    while left:
        best = [float("inf")] * len(graph)
        best[source], via = 0, [-1] * len(graph)
        for _ in range(len(graph)):
            changed = False
            for a, out in enumerate(graph):
                for e in out if best[a] < float("inf") else []:
                    b, room, price = edges[e]
                    if room and best[a] + price < best[b]:
                        best[b], via[b], changed = best[a] + price, e, True
            if not changed:
                break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        moved = min(left, *(edges[e][1] for e in path))
        for e in path:
            edges[e][1] -= moved
            edges[e ^ 1][1] += moved
        left -= moved
    flow = {}
    for k, e in enumerate(range(first, len(edges), 2)):
        if edges[e ^ 1][1]:
            flow[divmod(k, m)] = edges[e ^ 1][1]
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def plan_blocks(sizes: dict[int, int], shards: int, capacity: list[int] | None = None, cost=None) -> list[tuple[int, int, int, int]]:
    """Byte intervals (old shard, from, to, new shard) that carry out the cheapest flow; the kept part comes first."""
    old = max([shards, *[k + 1 for k in sizes]])
    supply = [sizes.get(i, 0) for i in range(old)]
    capacity = capacity or even_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, capacity, cost or (lambda i, j: int(i != j)))
    blocks = []
    for i in range(old):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            blocks.append((i, at, at + flow[i, j], j))
            at += flow[i, j]
    return blocks


def assign_shards(docs: DataFrame, shards: int = SHARDS, capacity: list[int] | None = None) -> DataFrame:
    """Add ``shard`` to rows with ``__size`` (bytes, at least 1), ``__crc`` (checksum), ``__old`` (int) and ``__h`` (hash of the row).

    A document goes to the block that holds its middle byte. Places inside an
    old shard are prefix sums over slices of the order, so a shard with a third
    of all rows is spread over many tasks.
    """
    spark = docs.sparkSession
    totals = docs.groupBy("__old").agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    blocks = plan_blocks({r["__old"]: r["b"] for r in totals}, shards, capacity)
    rows = sum(r["n"] for r in totals)
    bits = max(0, min(24, (max(rows, 1) // SLICE_ROWS).bit_length()))
    rank = (F.lit(256) - F.floor(F.log2(F.col("__size").cast("double")) * 4)).cast("long")
    high = F.shiftrightunsigned(F.col("__h"), 64 - bits) if bits else F.lit(0).cast("long")
    sliced = docs.withColumn("__slice", rank * (1 << 24) + high)
    sums = sliced.groupBy("__old", "__slice").agg(F.sum("__size").alias("__b"))
    before = W.partitionBy("__old").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__b").over(before), F.lit(0))).drop("__b")
    inside = W.partitionBy("__old", "__slice").orderBy("__h", "doc_id", "__crc").rowsBetween(W.unboundedPreceding, -1)
    placed = sliced.withColumn("__at", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    placed = join_small(placed, sums, ["__old", "__slice"])
    middle = F.col("__before") + F.col("__at") + F.col("__size") / 2
    plan = spark.createDataFrame([(i, a, b, j) for i, a, b, j in blocks], "__o int, __from long, __to long, shard int")
    # At most old x new shards rows; one old shard has at most `shards` blocks.
    found = placed.join(F.broadcast(plan), (F.col("__old") == F.col("__o")) & (middle >= F.col("__from")) & (middle < F.col("__to")), "left")
    last = F.lit(blocks[-1][3] if blocks else 0)
    return found.withColumn("shard", F.coalesce("shard", last)).drop("__o", "__from", "__to", "__slice", "__before", "__at")


def by_source(shards: int) -> Column:
    """The assumed old shard of rows that are not stored in shards yet."""
    return F.pmod(row_hash(F.col("source")), F.lit(shards))


def measured(docs: DataFrame, old: Column, keep: list[str] | None = None) -> DataFrame:
    """The columns the operator works on: id, size, checksum, old shard, row hash; and ``keep``."""
    text = text_of()
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"),
        old.cast("int").alias("__old"),
        *[F.col(c) for c in keep or []],
    ).withColumn("__h", row_hash("doc_id", "__crc", "__size"))


def reshard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One narrow row per document: size, checksum, law, new shard and place in it."""
    narrow = materialise(measured(docs, by_source(shards)), "reshard")
    placed = assign_shards(narrow, shards)
    out = slot_in_group(placed, ["shard"], "__h", ["doc_id", "__crc"], "slot", narrow.count())
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("__old").alias("old_shard"))


def rewrite_shards(
    docs: DataFrame, path: str, shards: int = SHARDS, capacity: list[int] | None = None, files: int = 1, old: str | Column | None = None, old_shards: int | None = None
) -> DataFrame:
    """Reshard whole documents and write the shards that change below ``path`` as ``shard=<n>``.

    ``old`` is the present shard of a row, a number from 0 (null: in no shard
    yet); without it, rows are taken to lie in ``old_shards`` shards by source.
    Returns the placed documents; their ``shard`` and ``old_shard`` replace
    columns of those names. A shard that neither gives nor receives is not
    written: its old files stay valid. One left without rows is removed, after
    the others are written.
    """
    spark = docs.sparkSession
    own = by_source(old_shards or shards) if old is None else F.col(old) if isinstance(old, str) else old
    first, last = docs.agg(F.min(own.cast("int")), F.max(own.cast("int"))).first()
    if first is not None and first < 0:
        raise ValueError("old shards are numbered from 0")
    # Rows in no shard come from a number that is neither an old nor a new one, so all of them move.
    nowhere = max(shards, -1 if last is None else last + 1)
    keep = [c for c in docs.columns if c not in ("doc_id", "shard", "old_shard")]
    placed = materialise(assign_shards(measured(docs, F.coalesce(own.cast("int"), F.lit(nowhere)), keep), shards, capacity), "placed")
    pairs = [(r["__old"], r["shard"]) for r in placed.select("__old", "shard").distinct().collect()]
    changed = sorted({x for pair in pairs if pair[0] != pair[1] for x in pair})
    out = placed.drop("__h", "__size", "__crc").withColumn("__old", F.nullif("__old", F.lit(nowhere))).withColumnRenamed("__old", "old_shard")
    affected = out.filter(F.col("shard").isin(changed) if changed else F.lit(False))
    affected.repartition(max(1, shards * files), "shard", F.pmod(F.xxhash64("doc_id"), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    # Dynamic overwrite only replaces shards that have rows.
    for k in sorted(set(changed) - {new for _, new in pairs} - {nowhere}):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={k}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


def op9_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard_digest(table(spark, sf_dir, "documents"))
