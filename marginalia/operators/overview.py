"""Folder overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.paths import folder_of, visible

# Fixed value: folder depth when the caller gives none.
DEFAULT_DEPTH = 3


def folders(listing: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """``path, parent_path, depth, file_count, last_modified`` per visible folder.

    Counts and dates cover direct files only. Every file contributes a marker
    to each of its ancestor folders, so one grouped pass with map-side
    combining yields both the folders and their counts, however large one
    folder is. ``listing`` needs ``path`` and may have ``modified_at``.
    """
    stamp = F.col("modified_at") if "modified_at" in listing.columns else F.lit(None).cast("timestamp")
    parts = F.split("path", "/")
    depth_of_file = F.size(parts) - 1
    up_to = F.least(depth_of_file, F.lit(max_depth))
    ancestors = F.when(
        depth_of_file > 0,
        F.when(
            up_to > 0,
            F.transform(
                F.sequence(F.lit(1), up_to),
                lambda d: F.struct(F.array_join(F.slice(parts, 1, d), "/").alias("folder"), (d == depth_of_file).alias("direct")),
            ),
        ),
    ).otherwise(F.array(F.struct(F.lit(".").alias("folder"), F.lit(True).alias("direct"))))
    marks = (
        listing.filter(visible(F.col("path")))
        .select(stamp.alias("modified_at"), F.explode_outer(ancestors).alias("a"))
        .filter("a IS NOT NULL")
    )
    grouped = marks.groupBy(F.col("a.folder").alias("path")).agg(
        F.count_if(F.col("a.direct")).alias("file_count"),
        F.max(F.when(F.col("a.direct"), F.col("modified_at"))).alias("last_modified"),
    )
    root = F.col("path") == "."
    return grouped.select(
        "path",
        F.when(~root, folder_of(F.col("path"))).alias("parent_path"),
        F.when(root, F.lit(0)).otherwise(F.size(F.split("path", "/"))).alias("depth"),
        "file_count",
        "last_modified",
    )


def total_files(listing: DataFrame) -> DataFrame:
    """Visible notes at any depth."""
    return listing.filter(visible(F.col("path"))).agg(F.count(F.lit(1)).alias("total_files"))


def folder_tree(rows: DataFrame, max_depth: int = DEFAULT_DEPTH) -> DataFrame:
    """``path, tree``: one row per root of a table of :func:`folders`, with the folders below it nested as JSON.

    Levels are folded from the deepest up: each step groups the folders of one
    depth under their parents, so a row only ever holds one folder's subtree.
    Children stand in locale order. A folder whose parent is not in the table is
    a root.
    """
    known = rows.select(F.col("path").alias("_p")).distinct()
    placed = rows.join(known, rows["parent_path"] == known["_p"], "left").withColumn("root", F.col("_p").isNull()).drop("_p")
    below = None
    for depth in range(max_depth, -1, -1):
        level = placed.filter(F.col("depth") == depth)
        if below is not None:
            inner = F.transform(F.array_sort(F.collect_list(F.struct(F.collate("path", "UNICODE").alias("c"), F.col("path").alias("p"), "node"))), lambda x: x["node"])
            level = level.join(below.groupBy(F.col("parent_path").alias("_up")).agg(inner.alias("children")), F.col("path") == F.col("_up"), "left").drop("_up")
        else:
            level = level.withColumn("children", F.lit(None).cast("array<string>"))
        head = F.to_json(F.struct("path", "depth", "file_count", *(["last_modified"] if "last_modified" in rows.columns else [])), {"ignoreNullFields": "false"})
        node = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"children":['), F.coalesce(F.array_join("children", ","), F.lit("")), F.lit("]}"))
        level = level.select("path", "parent_path", "root", node.alias("node"))
        roots = level.filter("root").select("path", F.col("node").alias("tree"))
        out = roots if depth == max_depth else out.unionByName(roots)
        below = level.filter(~F.col("root"))
    return out


def in_folder_order(folders: DataFrame) -> DataFrame:
    """Folders by path in locale order: letters before case, accents after plain letters."""
    return folders.orderBy(F.collate("path", "UNICODE"), "path")


def nest(rows: list[dict], total: int) -> dict:
    """Nested form of a folder table for one response, in the order of the rows at each level.

    ``in_folder_order`` gives the rows in the order a reader expects.

    Folders hang below ``.`` only when the root itself holds notes.
    """
    by_path = {r["path"]: {**r, "children": []} for r in rows}
    roots = []
    for row in by_path.values():
        parent = by_path.get(row["parent_path"])
        (parent["children"] if parent else roots).append(row)
    return {"total_files": total, "folders": roots}
