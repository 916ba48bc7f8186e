"""Stored vector index: Parquet snapshots, a change log, and a fingerprint.

``vectors/<snapshot>`` holds a full index. ``meta`` gets one row per snapshot,
written last, so a snapshot without its row does not exist for readers.
``changes/<snapshot>/writer=W/epoch=N`` holds what one batch replaced or removed
since that snapshot; a batch that is written again after a failure overwrites
itself.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import StartupFailed
from marginalia.functions.markdown import parse_chunks
from marginalia.operators.chunks import chunk_id, chunk_notes
from marginalia.operators.vectors import fit
from marginalia.sources.embedders import Embedder, embed_udf

VERSION = 1
VECTORS = "doc_path string, chunk_idx int, chunk_id string, embedding array<float>, text string, heading_path array<string>"
META = "version int, embedding_model string, dimensions int, saved_at timestamp, snapshot string, epoch long, chunks long"
COLUMNS = [c.split()[0] for c in VECTORS.split(", ")]


def build_index(notes: DataFrame, embedder: Embedder) -> DataFrame:
    """Chunk and embed every note. Notes without chunks have no rows."""
    rows = chunk_notes(notes.select("path", "content"))
    return rows.select(
        F.col("path").alias("doc_path"),
        "chunk_idx",
        chunk_id(F.col("heading_path")).alias("chunk_id"),
        fit(embed_udf(embedder)("text"), embedder.dimensions).alias("embedding"),
        "text",
        "heading_path",
    )


def build_changes(paths: DataFrame, notes: DataFrame, embedder: Embedder) -> DataFrame:
    """Index rows of the listed paths, and a ``removed`` row for each that is gone or has no chunks.

    One pass: every note is read, parsed and embedded once.
    """
    found = paths.select("path").join(notes.select("path", F.col("content")).hint("merge"), "path", "left")
    rows = found.select(F.col("path").alias("doc_path"), F.explode_outer(parse_chunks("content")).alias("c"))
    gone = F.col("c").isNull()
    vector = fit(embed_udf(embedder)(F.coalesce("c.text", F.lit(""))), embedder.dimensions)
    return rows.select(
        "doc_path",
        "c.chunk_idx",
        F.when(~gone, chunk_id(F.col("c.heading_path"))).alias("chunk_id"),
        F.when(~gone, vector).alias("embedding"),
        "c.text",
        "c.heading_path",
        gone.alias("removed"),
    )


class IndexStore:
    """A vector index under one shared folder."""

    def __init__(self, spark: SparkSession, root: str, model: str, dimensions: int) -> None:
        self.spark, self.root, self.model, self.dimensions = spark, root.rstrip("/"), model, dimensions

    def _meta(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(META).parquet(f"{self.root}/meta")
        except AnalysisException:
            return None

    def _latest(self):
        meta = self._meta()
        return None if meta is None else meta.orderBy(F.desc("saved_at")).first()

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], VECTORS)

    def save(self, vectors: DataFrame, epoch: int = -1) -> str:
        """Write a snapshot, sorted by note so that reads of one note prune row groups.

        Each snapshot has a change log of its own, so a new one covers all that
        was written before it and older log rows no longer count.
        """
        name = uuid.uuid4().hex
        target = f"{self.root}/vectors/{name}"
        # By hash: a range would sample its input, which embeds every chunk twice.
        vectors.select(*COLUMNS).repartition("doc_path").sortWithinPartitions("doc_path", "chunk_idx").write.parquet(target)
        count = self.spark.read.parquet(target).count()
        now = dt.datetime.now(dt.timezone.utc)
        row = [(VERSION, self.model, self.dimensions, now, name, epoch, count)]
        self.spark.createDataFrame(row, META).coalesce(1).write.mode("append").parquet(f"{self.root}/meta")
        return name

    def load(self) -> DataFrame:
        """Current index; empty when absent, of another model or size, or incomplete."""
        last = self._latest()
        if last is None or not self.matches(last):
            return self.empty()
        try:
            base = self.spark.read.schema(VECTORS).parquet(f"{self.root}/vectors/{last['snapshot']}")
            if base.count() < last["chunks"]:
                return self.empty()
        except (PySparkException, Py4JJavaError):
            return self.empty()  # absent or unreadable files
        return self._with_changes(base)

    def _log(self) -> str:
        last = self._latest()
        return f"{self.root}/changes/{'none' if last is None else last['snapshot']}"

    def _with_changes(self, base: DataFrame) -> DataFrame:
        try:
            log = self.spark.read.schema(VECTORS + ", removed boolean, seq long").parquet(self._log())
        except AnalysisException:
            return base
        newest = log.groupBy("doc_path").agg(F.max("seq").alias("seq"))
        current = log.join(newest, ["doc_path", "seq"], "left_semi").filter(~F.col("removed"))
        return base.join(newest, "doc_path", "left_anti").select(*COLUMNS).unionByName(current.select(*COLUMNS))

    def write_changes(self, epoch: int, rows: DataFrame, writer: str = "main") -> None:
        """Log one batch: the new chunks of changed notes, and a ``removed`` row per note without any.

        A repeated batch of one writer overwrites itself. Batches of all writers
        are ordered by the time of writing, so a stream that starts again at
        epoch 0 under another name neither hides nor loses earlier changes.
        """
        target = f"{self._log()}/writer={writer}/epoch={epoch}"
        rows.select(*COLUMNS, "removed", F.lit(time.time_ns()).alias("seq")).write.mode("overwrite").parquet(target)

    def has(self, doc_path: str) -> bool:
        """Whether the index holds chunks of a note."""
        return not self.load().filter(F.col("doc_path") == doc_path).isEmpty()

    def compact(self) -> str:
        """Fold the change log into a new snapshot, which starts an empty log."""
        return self.save(self.load())

    def matches(self, row) -> bool:
        return (row["version"], row["embedding_model"], row["dimensions"]) == (VERSION, self.model, self.dimensions)

    def check(self, allow_reset: bool = False) -> None:
        """Refuse to start on an index of another model or size, unless it may be rebuilt."""
        last = self._latest()
        if last is not None and not self.matches(last) and not allow_reset:
            raise StartupFailed(
                f"index was built with {last['embedding_model']} ({last['dimensions']} dimensions), "
                f"configured is {self.model} ({self.dimensions}); rebuild it or allow a reset"
            )
