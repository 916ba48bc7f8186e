"""A folder of markdown files as a table.

The folder must be reachable from every executor (a shared mount). Spark's own
file source is not used: it skips hidden folders, names with a leading dot or
underscore, and empty files, all of which are notes.
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from marginalia.errors import InvalidNotePath, NoteError, PathTraversal, VaultNotFound
from marginalia.functions.paths import directory_path
from marginalia.session import materialise

# Fixed value: how long a file must have been left alone before it is read.
SETTLE_MS = 100
# Bytes of notes that one reading task gets at most, on average.
TASK_BYTES = 64 << 20
# Entries of a listing, and bytes of notes, that leave a task together.
LISTED = 2_000
READ_BYTES = 1 << 20
LISTING = "path string, size_bytes long, modified_at timestamp"


def open_vault(root: str) -> str:
    if not os.path.isdir(root):
        raise VaultNotFound(root)
    return os.path.abspath(root)


def _walk(top: str) -> Iterator[os.DirEntry]:
    stack = [top]
    while stack:
        try:
            with os.scandir(stack.pop()) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        stack.append(entry.path)
                    elif entry.is_file(follow_symlinks=False) and entry.name.endswith(".md"):
                        yield entry
        except OSError:
            continue


ENTRIES = "path string, kind string, size_bytes long, modified_at timestamp, error string"


def walk(spark: SparkSession, root: str, tops: DataFrame) -> DataFrame:
    """Everything below the folders ``tops`` (column ``folder``, relative to the root): ``path, kind, size_bytes, modified_at, error``.

    ``kind`` is ``file`` for a note, ``folder``, or ``error`` for a folder or an
    entry that cannot be read. The frontier is a table and is expanded level by
    level, one job for each, so however the notes are spread over the tree, the
    folders of a level are dealt over all tasks. Symbolic links are not followed.
    """
    base = open_vault(root)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "kind", "size_bytes", "modified_at", "error"]
        for batch in batches:
            rows = chain.from_iterable(_entries(base, folder) for folder in batch["folder"])
            while part := list(islice(rows, LISTED)):
                yield pd.DataFrame(part, columns=columns)

    found, frontier = [], tops.select("folder").distinct()
    while True:
        tasks = spark.sparkContext.defaultParallelism * 4
        level = materialise(frontier.repartition(tasks, "folder").mapInPandas(scan, ENTRIES), "level")
        if level.isEmpty():
            break
        found.append(level)
        frontier = level.filter("kind = 'folder'").select(F.col("path").alias("folder"))
    out = found[0] if found else spark.createDataFrame([], ENTRIES)
    for level in found[1:]:
        out = out.unionByName(level)
    return out


def _entries(base: str, folder: str) -> Iterator[tuple]:
    """Notes and folders directly in one folder, and what could not be read; a folder is never held whole."""
    empty = (None, None)
    try:
        with os.scandir(os.path.join(base, folder)) as entries:
            for entry in entries:
                path = os.path.relpath(entry.path, base)
                try:
                    if entry.is_dir(follow_symlinks=False):
                        yield path, "folder", *empty, None
                    elif entry.is_file(follow_symlinks=False) and entry.name.endswith(".md"):
                        info = entry.stat(follow_symlinks=False)
                        yield path, "file", info.st_size, pd.Timestamp(info.st_mtime_ns // 1000, unit="us", tz="UTC"), None
                except OSError as exc:
                    yield path, "error", *empty, exc.strerror
    except OSError as exc:
        yield folder, "error", *empty, exc.strerror


def list_files(spark: SparkSession, root: str, directory: str | None = None) -> DataFrame:
    """``path, size_bytes, modified_at`` of all notes; :func:`walk` tells what could not be read."""
    top = spark.createDataFrame([(directory_path(directory),)], "folder string")
    return walk(spark, root, top).filter("kind = 'file'").select("path", "size_bytes", "modified_at")


def unreadable(contents: DataFrame) -> DataFrame:
    """Notes of :func:`read_files` that were listed and could not be read, with an error code."""
    return contents.filter(F.col("content").isNull()).select("path", F.lit("NOTE_UNREADABLE").alias("error_code"))


def _work_folders(top: str) -> list[tuple[str, bool]]:
    """Folders to scan and whether to descend: two levels one by one, subtrees below."""
    upper, frontier = [], [top]
    for _ in range(2):
        upper += frontier
        frontier = [e.path for f in frontier if os.path.isdir(f) for e in os.scandir(f) if e.is_dir(follow_symlinks=False)]
    return [(f, False) for f in upper] + [(f, True) for f in frontier]


def _flat(folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(folder) as entries:
            yield from (e for e in entries if e.is_file(follow_symlinks=False) and e.name.endswith(".md"))
    except OSError:
        return


def read_files(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """Add ``content``; NULL where a file cannot be read. Bad bytes become U+FFFD.

    Files are spread by path first, over a number of tasks that follows from the
    listed bytes: with a number given, adaptive execution does not join them again.
    """
    base = open_vault(root)
    columns = [f.simpleString().replace(":", " ", 1) for f in listing.schema.fields]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start, held, size = 0, [], 0
            for end, path in enumerate(batch["path"], 1):
                held.append(_content(base, path))
                size += len(held[-1] or "")
                if size >= READ_BYTES or end == len(batch):
                    yield batch.iloc[start:end].assign(content=held)
                    start, held, size = end, [], 0

    tasks = spark.sparkContext.defaultParallelism
    if "size_bytes" in listing.columns:
        tasks = max(tasks, math.ceil((listing.agg(F.sum("size_bytes")).first()[0] or 0) / TASK_BYTES))
    spread = listing.repartition(tasks, "path")
    return spread.mapInPandas(read, ", ".join([*columns, "content string"]))


def _content(base: str, path: str) -> str | None:
    try:
        with open(inside(base, path), "rb") as handle:
            return handle.read().decode("utf-8", "replace")
    except (OSError, NoteError):
        return None


def inside(base: str, path: str | None) -> str:
    """Absolute place of a note below ``base``; raises for paths that are empty, absolute or lead out of it."""
    if not path or "\0" in path:
        raise InvalidNotePath(path)
    target = os.path.normpath(os.path.join(base, path))
    if os.path.isabs(path) or target == base or os.path.commonpath([base, target]) != base:
        raise PathTraversal(path)
    return target


def write_files(root: str, notes: DataFrame, overwrite: bool = False, existing: DataFrame | None = None, order: str = "content") -> DataFrame:
    """Write ``path, content`` rows; gives ``path, error_code`` per row.

    Of several rows with one path, the first by ``order`` is written and the
    others get ``NOTE_ALREADY_EXISTS``; with ``overwrite`` the last one is
    written and the others count as overwritten. Paths that lead out of the
    root and rows without content get an error code.

    Without ``overwrite`` the caller passes the listing taken before, and
    existing paths are refused up front. Each file is replaced atomically, so
    a retried task simply writes the same bytes again.
    """
    base = open_vault(root)
    turn = Window.partitionBy("path").orderBy(F.desc(order) if overwrite else F.asc(order))
    todo = notes.withColumn("turn", F.row_number().over(turn)).select("path", "content", "turn")
    if not overwrite and existing is not None:
        todo = todo.join(existing.select("path", F.lit(True).alias("taken")), "path", "left")
    else:
        todo = todo.withColumn("taken", F.lit(None).cast("boolean"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, taken, turn in zip(batch["path"], batch["content"], batch["taken"], batch["turn"]):
                if taken is not None and taken == True or turn > 1:  # noqa: E712 - may be a numpy value
                    rows.append((path, None if overwrite else "NOTE_ALREADY_EXISTS"))
                    continue
                try:
                    target = inside(base, path)
                except NoteError as exc:
                    rows.append((path, exc.code))
                    continue
                if content is None:
                    rows.append((path, "INVALID_CONTENT"))
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                temp = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.tmp")
                try:
                    with open(temp, "wb") as handle:
                        handle.write(content.encode("utf-8"))
                    os.replace(temp, target)
                finally:
                    if os.path.exists(temp):
                        os.unlink(temp)
                rows.append((path, None))
            yield pd.DataFrame(rows, columns=["path", "error_code"])

    return todo.mapInPandas(write, "path string, error_code string")


def delete_files(root: str, paths: DataFrame) -> DataFrame:
    """Delete notes; a path that is not there gets ``NOTE_NOT_FOUND``."""
    base = open_vault(root)

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    os.unlink(inside(base, path))
                    rows.append((path, None))
                except NoteError as exc:
                    rows.append((path, exc.code))
                except OSError:
                    rows.append((path, "NOTE_NOT_FOUND"))
            yield pd.DataFrame(rows, columns=["path", "error_code"])

    return paths.select("path").distinct().mapInPandas(drop, "path string, error_code string")


class ChangeStream(DataSource):
    """Streaming source of notes changed since the last batch.

    Offsets are points in time, so they stay small however many notes there
    are, and every batch scans the folders in parallel for modification times
    between two of them. Files younger than ``settle_ms`` (100) wait for the
    next batch, so that half-written files are not read. Deletes leave no time
    stamp; they are found by comparing the stored index with a listing
    (:func:`removed_notes`).
    """

    @classmethod
    def name(cls) -> str:
        return "note_changes"

    def schema(self) -> str:
        return "path string, kind string, ts timestamp"

    def streamReader(self, schema):
        return _ChangeReader(self.options)


@dataclass
class _Span(InputPartition):
    folder: str
    deep: bool
    low: int
    high: int


class _ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root = open_vault(options["path"])
        self.first = int(options.get("since_ns", "0"))
        self.settle = int(options.get("settle_ms", SETTLE_MS)) * 1_000_000

    def initialOffset(self) -> dict:
        return {"ns": self.first}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        return [_Span(folder, deep, start["ns"], end["ns"]) for folder, deep in _work_folders(self.root)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for entry in _walk(partition.folder) if partition.deep else _flat(partition.folder):
            ns = entry.stat(follow_symlinks=False).st_mtime_ns
            if partition.low < ns <= partition.high:
                stamp = pd.Timestamp(ns // 1000, unit="us", tz="UTC").to_pydatetime()
                yield os.path.relpath(entry.path, self.root), "change", stamp


def removed_notes(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents of the index whose file is gone."""
    return index.select("doc_path").distinct().join(listing.select(F.col("path").alias("doc_path")), "doc_path", "left_anti")
