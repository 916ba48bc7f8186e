"""Reading and writing tables of notes (``path, content``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.markdown import parse_blocks
from marginalia.functions.paths import in_directory
from marginalia.functions.text import render_template
from marginalia.operators.chunks import section_text

# Fixed value: heading depth when a request names none.
DEFAULT_DEPTH = 2


def list_notes(notes: DataFrame, directory: str | None = None) -> DataFrame:
    return notes.filter(in_directory(F.col("path"), directory)).select("path")


def stat(notes: DataFrame) -> DataFrame:
    """Path and size in bytes; the modification time too when the table has one."""
    keep = ["modified_at"] if "modified_at" in notes.columns else []
    return notes.select("path", F.octet_length("content").cast("bigint").alias("size_bytes"), *keep)


def read_notes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """Requested paths with content, NULL content and an error code where missing."""
    wanted = notes.join(paths.select("path").distinct(), "path", "left_semi").select("path", "content")
    return paths.join(wanted.hint("merge"), "path", "left").withColumn(
        "error_code", F.when(F.col("content").isNull(), F.lit("NOTE_NOT_FOUND"))
    )


def bulk_read(notes: DataFrame, items: DataFrame) -> DataFrame:
    """Whole notes or single sections; a failing item reports its own error.

    ``items`` is ``pos, path, heading, heading_depth``. Only requested notes
    pass the semi join, and only notes asked for by section are parsed. The
    texts are shuffled, never broadcast, whatever their estimated size; a note
    that very many items ask for is split by the adaptive skew join.
    """
    asked = items.select("path").distinct()
    needed = notes.join(asked, "path", "left_semi").select("path", "content")
    joined = items.join(needed.hint("merge"), "path", "left")
    part = section_text(F.col("content"), F.col("blocks"), F.col("heading"), F.coalesce("heading_depth", F.lit(DEFAULT_DEPTH)))
    rows = joined.withColumn("blocks", parse_blocks(F.when(F.col("heading").isNotNull(), F.col("content")))).withColumn(
        "section", F.when(F.col("heading").isNull(), F.col("content")).otherwise(part)
    )
    error = F.when(F.col("content").isNull(), F.concat(F.lit("Note not found: "), "path")).when(
        F.col("section").isNull(), F.concat(F.lit('Heading "'), "heading", F.lit('" not found in '), "path")
    )
    return rows.select(
        "pos", "path", "heading", F.col("section").alias("content"), F.col("section").isNotNull().alias("found"), error.alias("error")
    )


def create_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Outcome per new note: existing paths get ``NOTE_ALREADY_EXISTS``."""
    taken = notes.select("path", F.lit("NOTE_ALREADY_EXISTS").alias("error_code"))
    return new.join(taken, "path", "left")


def upsert_notes(notes: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Next state of the table with ``new`` written over it.

    Of several rows with one path the last by ``order`` is written; without an
    order the greatest row, so that a path never stands twice.
    """
    rest = F.struct(*[c for c in notes.columns if c != "path"])
    by = F.col(order) if order else rest
    last = new.groupBy("path").agg(F.max_by(rest, by).alias("_n")).select("path", "_n.*")
    return delete_notes(notes, new).unionByName(last.select(*notes.columns))


def delete_notes(notes: DataFrame, paths: DataFrame) -> DataFrame:
    return notes.join(paths.select("path").distinct(), "path", "left_anti")


def missing(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """Requested paths that do not exist."""
    return paths.join(notes.select("path"), "path", "left_anti")


def create_from_template(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Render templates into new notes: ``path, content, error_code``.

    ``requests`` is ``path, template_path, variables``. An existing
    destination is reported before a missing template.
    """
    checked = create_notes(notes, requests)
    templates = notes.join(requests.select(F.col("template_path").alias("path")).distinct(), "path", "left_semi").select(
        F.col("path").alias("template_path"), F.col("content").alias("_template")
    )
    joined = checked.join(templates, "template_path", "left")
    code = F.coalesce("error_code", F.when(F.col("_template").isNull(), F.lit("NOTE_NOT_FOUND")))
    variables = F.coalesce("variables", F.create_map().cast("map<string,string>"))
    return joined.select(
        "path", F.when(code.isNull(), render_template(F.col("_template"), variables)).alias("content"), code.alias("error_code")
    )
