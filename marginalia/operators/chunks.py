"""Sections of a note: chunks, outline, reading one section.

All of these work on arrays inside a single note row, so they need no shuffle
and are indifferent to how notes are distributed over folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.markdown import parse_chunks, with_blocks
from marginalia.functions.text import let, unnest


def with_chunks(notes: DataFrame) -> DataFrame:
    """Add a ``chunks`` array to each note."""
    return notes.withColumn("chunks", parse_chunks(F.col("content")))


def chunk_notes(notes: DataFrame) -> DataFrame:
    """One row per chunk: the input columns except the content, plus the chunk."""
    keep = [c for c in notes.columns if c not in ("content", "blocks", "chunks")]
    source = notes if "chunks" in notes.columns else with_chunks(notes)
    return unnest(source, "chunks", *keep)


def chunk_id(heading_path: Column) -> Column:
    """Readable id of a chunk; not unique inside a note."""
    return F.coalesce(F.nullif(F.array_join(heading_path, " > "), F.lit("")), F.lit("root"))


def outline(notes: DataFrame) -> DataFrame:
    """Top-level headings with their position among all blocks."""
    source = notes if "blocks" in notes.columns else with_blocks(notes)
    numbered = F.transform("blocks", lambda b, i: F.struct(i.alias("idx"), b["depth"].alias("depth"), b["label"].alias("title"), b["kind"].alias("kind")))
    return unnest(source, numbered, "path").filter(F.col("kind") == "heading").drop("kind")


def find_heading(blocks: Column, title: Column, depth: Column) -> Column:
    """Position of the first heading of that depth and title, ignoring case."""
    marked = F.transform(
        blocks,
        lambda b, i: F.when(
            (b["kind"] == "heading") & (b["depth"] == depth) & (F.lower(b["label"]) == F.lower(title)), i
        ),
    )
    return F.array_min(marked)


def section_end(blocks: Column, at: Column, depth: Column) -> Column:
    """Position after the section: the next heading that is not deeper."""
    marked = F.transform(
        blocks, lambda b, i: F.when((i > at) & (b["kind"] == "heading") & (b["depth"] <= depth), i)
    )
    return F.coalesce(F.array_min(marked), F.size(blocks))


def find_block(blocks: Column, block_id: Column) -> Column:
    """Position of the first paragraph that ends in ``^id``."""
    marker = F.concat(F.lit("^"), block_id)
    marked = F.transform(
        blocks,
        lambda b, i: F.when((b["kind"] == "paragraph") & F.regexp_replace(b["label"], r"\s+\z", "").endswith(marker), i),
    )
    return F.array_min(marked)


def section_text(content: Column, blocks: Column, title: Column, depth: Column) -> Column:
    """Source text of a section with its heading; NULL when there is none."""

    def cut(at: Column) -> Column:
        start = F.get(blocks, at)["start_off"]
        stop = F.get(blocks, section_end(blocks, at, depth) - 1)["end_off"]
        return F.when(at.isNotNull(), F.concat(F.substring(content, start + 1, stop - start), F.lit("\n")))

    return let(find_heading(blocks, title, depth), cut)


def read_sections(notes: DataFrame, heading: Column, depth: Column | int = 2) -> DataFrame:
    """Read one section from every note: ``path, content, found``."""
    level = F.lit(depth) if isinstance(depth, int) else depth
    source = notes if "blocks" in notes.columns else with_blocks(notes)
    text = section_text(F.col("content"), F.col("blocks"), heading, level)
    return source.select("path", text.alias("section")).select(
        "path", F.coalesce("section", F.lit("")).alias("content"), F.col("section").isNotNull().alias("found")
    )
