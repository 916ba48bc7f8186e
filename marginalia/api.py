"""Tool calls over one folder of notes: vault, edit, view, workflow, system.

A thin layer for interactive use. Each call plans a Spark job on the operators
and turns its (small) answer into JSON. Bulk work uses the operators directly.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from marginalia.errors import InvalidFrontmatter, NoteAlreadyExists, NoteError, NoteNotFound
from marginalia.functions.frontmatter import frontmatter_json
from marginalia.functions.paths import note_path
from marginalia.functions.text import round3
from marginalia.operators import edits, links, overview, vectors
from marginalia.operators.chunks import outline
from marginalia.operators.hints import envelope, error_text
from marginalia.operators.notes import bulk_read, create_from_template
from marginalia.operators.search import FRAGMENT_LIMIT, GLOBAL_LIMIT, fragment_search, global_search
from marginalia.operators.vectors import HYBRID_LIMIT
from marginalia.operators.workflow import PLACES, available, next_place
from marginalia.sources.embedders import Embedder, embed_query
from marginalia.sources.files import delete_files, list_files, open_vault, read_files, write_files
from marginalia.sources.index_store import IndexStore, build_index
from marginalia.streaming.indexing import index_batch

ITEM = "pos long, path string, heading string, heading_depth int"
OPS = "batch_id long, seq int, path string, " + ", ".join(f"{k} {v}" for k, v in edits.OP_TYPES.items())


class Workspace:
    """One folder of notes with its workflow state and, optionally, a vector index."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, index_root: str | None = None) -> None:
        self.spark, self.root, self.embedder = spark, open_vault(root), embedder
        self.place, self.log = PLACES[0], []
        self.store = IndexStore(spark, index_root, embedder.model, embedder.dimensions) if embedder and index_root else None

    # ---- data ----

    def listing(self, directory: str | None = None) -> DataFrame:
        return list_files(self.spark, self.root, directory)

    def notes(self, directory: str | None = None) -> DataFrame:
        return read_files(self.spark, self.root, self.listing(directory)).filter(F.col("content").isNotNull())

    def some(self, *paths: str) -> DataFrame:
        """The named notes that exist, without listing the folder."""
        rows = self.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
        return read_files(self.spark, self.root, rows).filter(F.col("content").isNotNull())

    def one(self, path: str) -> DataFrame:
        found = self.some(note_path(path))
        if found.isEmpty():
            raise NoteNotFound(path)
        return found

    def _write(self, notes: DataFrame) -> None:
        changed = [r.path for r in write_files(self.root, notes, overwrite=True).collect()]
        self._index(changed)

    def _index(self, paths: list[str]) -> None:
        if self.store and paths:
            rows = self.spark.createDataFrame([(p,) for p in paths], "path string")
            epoch = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1e6)
            index_batch(self.store, self.embedder, rows, lambda p: self.some(*[r.path for r in p.collect()]), epoch, "api")

    # ---- tools ----

    def call(self, tool: str, action: str, **args) -> tuple[str, bool]:
        """JSON answer and whether it is an error."""
        try:
            result = getattr(self, f"_{tool}")(action, args)
            return envelope(self.place, tool, result), False
        except (NoteError, ValueError) as exc:
            return error_text(exc), True

    def _vault(self, action: str, a: dict) -> object:
        if action == "list":
            return [r.path for r in self.listing(a.get("directory")).select("path").orderBy("path").collect()]
        raw = _need(a, "path", action)
        path = note_path(raw)
        if action == "read":
            return self.one(raw).first().content
        if action in ("create", "update"):
            content = _need(a, "content", action)
            if action == "create" and not self.some(path).isEmpty():
                raise NoteAlreadyExists(raw)
            self._write(self.spark.createDataFrame([(path, content)], "path string, content string"))
            return f"Note {'created' if action == 'create' else 'updated'}: {raw}"
        if action == "delete":
            if delete_files(self.root, self.spark.createDataFrame([(path,)], "path string")).first().error_code:
                raise NoteNotFound(raw)
            self._index([path])
            return f"Note deleted: {raw}"
        if action == "stat":
            folder = path.rpartition("/")[0]
            row = self.listing(folder).filter(F.col("path") == path).first()
            if row is None:
                raise NoteNotFound(raw)
            return {"sizeBytes": row.size_bytes, "modifiedAt": row.modified_at.isoformat(timespec="milliseconds") + "Z"}
        if action == "create_from_template":
            template = note_path(_need(a, "template_path", action))
            request = self.spark.createDataFrame(
                [(path, template, a.get("variables") or {})], "path string, template_path string, variables map<string,string>"
            )
            made = create_from_template(self.some(path, template).select("path", "content"), request).first()
            if made.error_code:
                raise NoteAlreadyExists(raw) if made.error_code == NoteAlreadyExists.code else NoteNotFound(a["template_path"])
            self._write(self.spark.createDataFrame([(path, made.content)], "path string, content string"))
            return f"Note created from template: {raw}"
        raise ValueError(f"Unknown vault action: {action}")

    def _edit(self, action: str, a: dict) -> object:
        """One edit, or ``action='batch'`` with ``operations`` (dicts with path, operation, ...)."""
        batch = a.get("operations") if action == "batch" else [{**a, "operation": action}]
        edits.check_batch_size(len(batch))
        rows = []
        for seq, op in enumerate(batch):
            if op.get("content") is None:
                raise ValueError("content is required for single edit")
            rows.append((0, seq, note_path(_need(op, "path", "edit")), *[op.get(f) for f in edits.OP_TYPES]))
        ops = self.spark.createDataFrame(rows, OPS)
        dry = bool(a.get("dry_run"))
        done = edits.batch_edit(self.some(*[r[2] for r in rows]), ops, dry)
        results = sorted(done.collect(), key=lambda r: r.seq)
        last = {r.path: r.content for r in results if r.status == "success"}
        if last and not dry:
            self._write(self.spark.createDataFrame(list(last.items()), "path string, content string"))
        failed = [r for r in results if r.status == "error"]
        if action != "batch":
            if failed:
                raise NoteError(failed[0].error)
            verb = "dry-run" if dry else "Note patched"
            return {"message": f"{verb}: {results[0].path} ({action})", "diff": results[0].diff}
        return {
            "results": [{"index": r.seq, "path": r.path, "action": r.action, "status": r.status, "diff": r.diff, "error": r.error} for r in results],
            "totalRequested": len(batch),
            "totalSucceeded": len(results) - len(failed),
            "totalFailed": len(failed),
            "stoppedAtIndex": failed[0].seq if failed else None,
        }

    def _view(self, action: str, a: dict) -> object:
        if action == "search":
            found = fragment_search(self.one(_need(a, "path", action)), _need(a, "query", action), a.get("max_chunks") or FRAGMENT_LIMIT)
            return _scored(found.orderBy(F.desc("score"), "chunk_idx"), "heading_path", "text", "score", "word_count")
        if action == "global_search":
            found = global_search(self.notes(a.get("directory")), _need(a, "query", action), a.get("max_chunks") or GLOBAL_LIMIT)
            return _scored(found, "path", "heading_path", "text", "score", "word_count")
        if action == "semantic_search":
            if not self.store:
                raise ValueError("semantic_search needs an embedder and an index folder")
            query = _need(a, "query", action)
            index = self.store.load()
            found = vectors.hybrid_search(
                index.drop("text", "heading_path"), query, embed_query(self.embedder, query), a.get("max_chunks") or HYBRID_LIMIT, directory=a.get("directory"), texts=index.select("doc_path", "chunk_idx", "text", "heading_path")
            )
            return _scored(found, "doc_path", "heading_path", "text", "score", "vector_score", "lexical_score")
        if action == "outline":
            rows = outline(self.one(_need(a, "path", action))).orderBy("idx").collect()
            return [{"title": r.title, "depth": r.depth, "index": r.idx} for r in rows]
        if action == "read" and a.get("heading"):
            item = (0, note_path(_need(a, "path", action)), a["heading"], a.get("heading_depth"))
            row = bulk_read(self.one(item[1]), self.spark.createDataFrame([item], ITEM)).first()
            return {"content": row.content or "", "found": row.found}
        if action == "read":
            return self.one(_need(a, "path", action)).first().content
        if action == "frontmatter_get":
            text = self.one(_need(a, "path", action)).select(frontmatter_json("content").alias("f")).first().f
            if text is None:
                raise InvalidFrontmatter("front matter is not valid YAML")
            return {"frontmatter": text}
        if action == "bulk_read":
            items = [(i, note_path(x["path"]), x.get("heading"), x.get("heading_depth")) for i, x in enumerate(a.get("items") or [])]
            if not items:
                return {"results": []}
            rows = bulk_read(self.some(*[x[1] for x in items]), self.spark.createDataFrame(items, ITEM)).orderBy("pos").collect()
            return {"results": [{k: v for k, v in r.asDict().items() if k != "pos" and v is not None} for r in rows]}
        if action == "backlinks":
            target = note_path(_need(a, "path", action))
            edges = links.backlinks_of(links.backlinks(self.notes(), self.listing()), target)
            rows = edges.orderBy("source_path", "line_number").drop("target_key").collect()
            return {"target": target, "backlinks": [r.asDict() for r in rows], "count": len(rows)}
        raise ValueError(f"Unknown view action: {action}")

    def _workflow(self, action: str, a: dict) -> object:
        if action == "status":
            return {"currentState": self.place, "availableTransitions": available(self.place)}
        if action == "transition":
            name = _need(a, "transition", action)
            before, self.place = self.place, next_place(self.place, name)
            stamp = dt.datetime.now(dt.timezone.utc).isoformat()
            self.log.append({"transition": name, "from": before, "to": self.place, "timestamp": stamp})
            return {"currentState": self.place, "firedTransition": name}
        if action == "history":
            return list(self.log)
        if action == "reset":
            self.place, self.log = PLACES[0], []
            return {"currentState": self.place}
        raise ValueError(f"Unknown workflow action: {action}")

    def _system(self, action: str, a: dict) -> object:
        if action == "status":
            size = vectors.index_size(self.store.load()).first() if self.store else Row(documents=0, chunks=0)
            targets = links.backlink_counts(links.backlinks(self.notes(), self.listing())).count()
            return {
                "vaultRoot": self.root,
                "indexedDocuments": size.documents,
                "indexedChunks": size.chunks,
                "backlinkIndexSize": targets,
                "workflowState": self.place,
            }
        if action == "reindex":
            if self.store:
                self.store.save(build_index(self.notes(), self.embedder), int(dt.datetime.now(dt.timezone.utc).timestamp() * 1e6))
            return {"message": "Re-indexing done"}
        if action == "overview":
            depth = a.get("max_depth")
            rows = overview.in_folder_order(overview.folders(self.listing(), overview.DEFAULT_DEPTH if depth is None else depth)).collect()
            total = overview.total_files(self.listing()).first().total_files
            return overview.nest([r.asDict() for r in rows], total)
        raise ValueError(f"Unknown system action: {action}")


def _need(args: dict, name: str, action: str) -> str:
    if not args.get(name):
        raise ValueError(f"{name} is required for {action}")
    return args[name]


def _scored(found: DataFrame, *columns: str) -> list[dict]:
    rounded = [round3(F.col(c)).alias(c) if c.endswith("score") else F.col(c) for c in columns]
    return [r.asDict() for r in found.select(*rounded).collect()]
