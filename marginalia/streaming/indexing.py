"""Incremental re-indexing of changed notes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marginalia.sources.embedders import Embedder
from marginalia.sources.index_store import IndexStore, build_changes


def index_batch(store: IndexStore, embedder: Embedder, changed: DataFrame, read: Callable[[DataFrame], DataFrame], epoch: int, writer: str = "main") -> None:
    """Index one batch of changed paths.

    Each path is handled once, whatever the number of its events. ``read``
    gives ``path, content`` for the paths that still exist; the others, and
    notes that no longer yield chunks, are removed. An embedding failure fails
    the batch, which Spark then repeats, instead of being taken for a delete.
    """
    paths = changed.select("path").distinct()
    store.write_changes(epoch, build_changes(paths, read(paths), embedder), writer)


def start_indexing(
    changes: DataFrame,
    store: IndexStore,
    embedder: Embedder,
    read: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    after: Callable[[DataFrame, int], None] | None = None,
    **trigger,
) -> StreamingQuery:
    """Run :func:`index_batch` on every micro-batch of a change stream; ``after`` may update backlinks."""

    # Epochs count within one checkpoint, so the checkpoint names the writer.
    writer_name = hashlib.md5(checkpoint.encode()).hexdigest()

    def handle(batch: DataFrame, epoch: int) -> None:
        index_batch(store, embedder, batch, read, epoch, writer_name)
        if after:
            after(batch.select("path").distinct(), epoch)

    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def changed_contents(paths: DataFrame, notes: DataFrame) -> DataFrame:
    """Reader over a table of notes; only the changed rows survive the semi join."""
    return notes.join(paths, "path", "left_semi").select("path", "content")
