"""Link extraction, name resolution and backlinks."""

from __future__ import annotations

import posixpath
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.arrays import running
from marginalia.functions.batches import by_pieces
from marginalia.functions.markdown import list_array, parse_note
from marginalia.functions.paths import file_name, path_key
from marginalia.functions.text import let, unnest
from marginalia.operators.skew import attach
from marginalia.session import materialise

# The wikilink form and what counts as an external address.
WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
NAME = r"\[\[([^\]]+)\]\]"
EXTERNAL = r"^(?i:[a-z]+://)|^mailto:|^#"
AROUND = 30
EXTERNAL_LINK = re.compile(EXTERNAL)

FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("link_type", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("target", T.StringType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("off", T.IntegerType()),
            T.StructField("context", T.StringType()),
        ]
    )
)


def _relative(source: str, link: str) -> str | None:
    clean = link.split("#")[0].split("?")[0]
    if not clean:
        return None
    joined = posixpath.normpath((posixpath.dirname(source) or ".") + "/" + clean)
    return joined + "/" if clean.endswith("/") and not joined.endswith("/") else joined


@F.arrow_udf(T.StringType())
def relative_target(source_path: pa.Array, url: pa.Array) -> pa.Array:
    """Vault path a relative link points to; NULL when only an anchor or query remains."""
    return pa.array([_relative(s, u) for s, u in zip(source_path.to_pylist(), url.to_pylist())], pa.string())


def _context(text: str, off: int, length: int) -> str:
    return text[max(off - AROUND, 0) : off + length + AROUND].replace("\n", " ")


def _links_of(path: str, text: str) -> list[tuple]:
    """Inline links of the parsed note that stay inside the vault."""
    found = []
    for url, at_line, off in (link for block in parse_note(text) for link in block.links):
        target = None if EXTERNAL_LINK.search(url) else _relative(path, url)
        if target:
            found.append(("markdown_link", url, target, at_line, off, _context(text, off, len(url) + 4)))
    return found


@F.arrow_udf(FOUND)
def scan_links(path: pa.Array, content: pa.Array) -> pa.Array:
    """Inline links of each note; a NULL text has none."""
    return by_pieces(_link_arrays, content, path)


def _link_arrays(contents: list[str | None], paths: list[str]) -> pa.Array:
    notes = [_links_of(p, c) if c else [] for p, c in zip(paths, contents)]
    flat = [link for links in notes for link in links]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate(types)]
    return list_array([len(x) for x in notes], pa.StructArray.from_arrays(columns, FOUND.elementType.names))


def wikilinks_in(content: Column) -> Column:
    """Wikilinks of a raw text (code and front matter included), an array like FOUND.

    The text is split at the links once; offsets and lines are running sums over
    the pieces, and a link's surroundings come from the ends of the pieces and
    links next to it, so the work grows with the text and not with its square.
    """
    none = F.array().cast(FOUND)
    # A link has five characters or more: this many links and pieces always hold the surroundings.
    beside = -(-AROUND // 5)

    def breaks(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def found(parts: Column) -> Column:
        # parts: per link the piece before it (p), the link (h), its target (t); the last entry has the rest of the text only.
        ends = F.transform(
            parts,
            lambda x: F.struct(
                F.length(x["p"]).alias("n"),
                (F.length(x["p"]) + F.coalesce(F.length(x["h"]), F.lit(0))).alias("size"),
                breaks(x["p"]).alias("lines"),
                (breaks(x["p"]) + F.coalesce(breaks(x["h"]), F.lit(0))).alias("all_lines"),
                F.left(x["p"], F.lit(AROUND)).alias("head"), F.right(x["p"], F.lit(AROUND)).alias("tail"),
                F.left(x["h"], F.lit(AROUND)).alias("h_head"), F.right(x["h"], F.lit(AROUND)).alias("h_tail"),
            ),
        )
        return let(ends, lambda e: let(running(F.transform(e, lambda x: x["size"])), lambda at: let(running(F.transform(e, lambda x: x["all_lines"])), lambda lines: rows(parts, e, at, lines))))

    def rows(parts: Column, e: Column, at: Column, lines: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            left = [t for j in range(beside, 0, -1) for t in (F.get(e, i - j)["tail"], F.get(e, i - j)["h_tail"])] + [F.get(e, i)["tail"]]
            right = [F.get(e, i + 1)["head"]] + [t for j in range(1, beside + 1) for t in (F.get(e, i + j)["h_head"], F.get(e, i + j + 1)["head"])]
            context = F.concat(F.right(F.concat_ws("", *left), F.lit(AROUND)), x["h"], F.left(F.concat_ws("", *right), F.lit(AROUND)))
            none_yet = F.lit(None).cast("string")
            return F.struct(
                F.lit("wikilink").alias("link_type"), none_yet.alias("url"), x["t"].alias("target"),
                (F.get(lines, i) + F.get(e, i)["lines"] + 1).cast("int").alias("line"), (F.get(at, i) + F.get(e, i)["n"]).cast("int").alias("off"),
                F.replace(context, F.lit("\n"), F.lit(" ")).alias("context"),
            )

        return F.transform(F.filter(parts, lambda x: x["h"].isNotNull()), row)

    hits = F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(0))
    targets = F.regexp_extract_all(content, F.lit(WIKILINK), F.lit(1))
    parts = F.zip_with(F.zip_with(F.split(content, WIKILINK, -1), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h"))), targets, lambda x, t: F.struct(x["p"].alias("p"), x["h"].alias("h"), t.alias("t")))
    return F.when(content.contains("[["), let(parts, found)).otherwise(none)


def all_links(notes: DataFrame) -> DataFrame:
    """One row per link: ``path, link_type, url, target, line, off, context``.

    Wikilinks are found in the JVM; only texts that may hold inline links go to
    the parser, the others are sent as NULL.
    """
    content = F.col("content")
    linked = notes.filter(content.contains("[[") | content.contains("](") | content.contains("<"))
    inline = scan_links("path", F.when(content.contains("](") | content.contains("<"), content))
    return unnest(linked, F.concat(wikilinks_in(content), inline), "path")


def wikilinks(notes: DataFrame) -> DataFrame:
    """``path, target, line, off, context``, without a Python worker."""
    linked = notes.filter(F.col("content").contains("[["))
    return unnest(linked, wikilinks_in(F.col("content")), "path").drop("link_type", "url")


def markdown_links(notes: DataFrame) -> DataFrame:
    """Inline links that stay inside the vault: ``path, url, target, line, off, context``."""
    return all_links(notes).filter(F.col("link_type") == "markdown_link").drop("link_type")


def _best(path: str = "file") -> Column:
    """Fewest segments first, then alphabetical in the root locale."""
    return F.min_by(path, F.struct(F.size(F.split(path, "/")), F.collate(path, "UNICODE")))


def wikilink_names(content: Column) -> Column:
    """Targets of all wikilinks of a text, without aliases: ``array<string>``."""
    inner = F.regexp_extract_all(content, F.lit(NAME), F.lit(1))
    return F.transform(inner, lambda x: F.split_part(x, F.lit("|"), F.lit(1)))


def target_name(target: Column) -> Column:
    """What a wikilink looks for: no anchor, no ``.md``, lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(target, r"\A[^#]*", 0), r"\.md\z", ""))


def resolve_names(names: DataFrame, listing: DataFrame) -> DataFrame:
    """Resolve distinct names (``name, n``) against the notes that exist: adds ``resolved``.

    A bare name matches a file name. A name with ``/`` matches the end of a
    path, at any character. For these, each path lists its endings of exactly
    the lengths that occur among such names (a subquery of the same plan, a set
    no larger than the longest path), which keeps this an equi-join
    rather than a comparison of all pairs and keeps equal file names, however
    common, from meeting in one task. Both sides of each join are distinct on
    the join key.
    """
    files = listing.select(F.col("path").alias("file")).withColumn("low", F.lower("file"))
    stem = F.regexp_replace(file_name(F.col("file")), r"(?<=.)\.md\z", "")
    by_base = files.groupBy(F.lower(stem).alias("name")).agg(_best().alias("resolved"))
    plain = names.filter(~F.col("name").contains("/")).join(by_base, "name", "left")

    partial = names.filter(F.col("name").contains("/")).withColumn("suffix", F.concat("name", F.lit(".md")))
    lengths = partial.agg(F.collect_set(F.length("suffix"))).scalar()
    fitting = F.filter("lengths", lambda n: n <= F.length("low"))
    endings = files.withColumn("lengths", lengths).select("file", "low", F.explode_outer(fitting).alias("n")).filter("n IS NOT NULL")
    by_suffix = endings.groupBy(F.right(F.col("low"), F.col("n")).alias("suffix")).agg(_best().alias("resolved"))
    return plain.unionByName(partial.join(by_suffix, "suffix", "left").drop("suffix"))


def resolve(links: DataFrame, listing: DataFrame, row_id: list[str]) -> DataFrame:
    """Add ``resolved`` (NULL when nothing matches) to rows that have a ``target``.

    Targets are reduced to distinct names before they meet the listing; the
    answers return to the rows through a skew-safe join, since one note may be
    the target of a large share of all links.
    """
    named = links.withColumn("name", target_name(F.col("target")))
    names = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return attach(named, resolve_names(names, listing), "name", "n", row_id, weights=names).drop("name")


def backlinks(notes: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Edges ``target_key, source_path, line_number, context, link_type``.

    Unresolved wikilinks keep their full text as the key. Links of a note to
    itself are left out. The links found are written to the shared folder
    first: they are needed twice, and the notes should be read only once.
    """
    return edges_of(materialise(all_links(notes), "links"), listing if listing is not None else notes)


def edges_of(found: DataFrame, listing: DataFrame) -> DataFrame:
    """Edges of a kept table of links (from :func:`all_links`) under the notes that exist now; parses nothing."""
    wiki = resolve(found.filter(F.col("link_type") == "wikilink"), listing, ["path", "off"])
    to_note = F.coalesce("resolved", F.concat("target", F.lit(".md")))
    inline = found.filter(F.col("link_type") == "markdown_link")
    edges = wiki.withColumn("target", to_note).select(*found.columns).unionByName(inline)
    key = path_key(F.col("target"))
    return edges.filter(key != path_key(F.col("path"))).select(
        key.alias("target_key"), F.col("path").alias("source_path"), F.col("line").alias("line_number"), "context", "link_type"
    )


def update_links(found: DataFrame, changed: DataFrame) -> DataFrame:
    """Kept table of links after changes (``path, content``; NULL content removes). Only changed notes are parsed.

    :func:`edges_of` then resolves all names against the new listing, so a link
    whose target appeared or vanished follows it, as in a full rebuild.
    """
    kept = found.join(changed.select("path").distinct(), "path", "left_anti")
    return materialise(kept.unionByName(all_links(changed.filter(F.col("content").isNotNull())).select(*kept.columns)), "links")


def backlinks_of_all(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges to any of the listed paths."""
    return edges.join(paths.select(path_key(F.col("path")).alias("target_key")).distinct(), "target_key", "left_semi")


def last_part(name: Column) -> Column:
    """The last segment of a name: equal to the file name, without ``.md``, of any path it can match (or to its end, if alone)."""
    return F.regexp_extract(name, r"[^/]*\z", 0)


def resolved_links(found: DataFrame, listing: DataFrame) -> DataFrame:
    """A kept table of links (from :func:`all_links`) with the name each wikilink looks for and what it resolves to now."""
    wiki = found.filter(F.col("link_type") == "wikilink")
    done = resolve(wiki, listing, ["path", "off"]).withColumn("name", target_name(F.col("target")))
    inline = found.filter(F.col("link_type") != "wikilink").withColumn("resolved", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string"))
    return done.select(*found.columns, "resolved", "name").unionByName(inline)


def follow_changes(kept: DataFrame, changed: DataFrame, appeared: DataFrame, vanished: DataFrame, listing: DataFrame) -> DataFrame:
    """:func:`resolved_links` after changes, without resolving everything again.

    ``changed`` has ``path, content`` (NULL content removes) of the notes whose
    text changed, new ones included; ``appeared`` and ``vanished`` are paths, and
    ``listing`` the notes that exist now. A name can only resolve differently
    if a note of its file name came or went: links of such names, and those of
    changed notes, are resolved; all others stay as they are.
    """
    columns = [c for c in kept.columns if c not in ("resolved", "name")]
    gone = changed.select("path").union(vanished.select("path")).distinct()
    fresh = all_links(changed.filter(F.col("content").isNotNull())).select(*columns)
    staying = kept.join(gone, "path", "left_anti").withColumn("last", last_part(F.col("name")))
    stem = F.regexp_replace(file_name(F.lower("path")), r"\.md\z", "")
    touched = appeared.select("path").union(vanished.select("path")).select(stem.alias("last")).distinct()
    again = staying.join(touched, "last", "left_semi").select(*columns)
    quiet = staying.join(touched, "last", "left_anti").select(*kept.columns)
    return materialise(quiet.unionByName(resolved_links(materialise(fresh.unionByName(again), "links"), listing)), "links")


def edges_from(kept: DataFrame) -> DataFrame:
    """Edges of a table of :func:`resolved_links`."""
    target = F.when(F.col("link_type") == "wikilink", F.coalesce("resolved", F.concat("target", F.lit(".md")))).otherwise(F.col("target"))
    key = path_key(target)
    return kept.filter(key != path_key(F.col("path"))).select(key.alias("target_key"), F.col("path").alias("source_path"), F.col("line").alias("line_number"), "context", "link_type")


def backlinks_of(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter(F.col("target_key") == path_key(F.lit(path)))


def backlink_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target_key").agg(F.count(F.lit(1)).alias("n"))


def update_sources(edges: DataFrame, changed: DataFrame, listing: DataFrame) -> DataFrame:
    """Replace the edges of changed notes (``path, content``; NULL content removes).

    Edges of other notes keep their resolution; keep the links with
    :func:`update_links` where targets may appear or vanish.
    """
    kept = edges.join(changed.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_anti")
    return kept.unionByName(backlinks(changed.filter(F.col("content").isNotNull()), listing))


def orphans(listing: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes that nothing links to."""
    linked = edges.select("target_key").distinct()
    return listing.withColumn("target_key", path_key(F.col("path"))).join(linked, "target_key", "left_anti").select("path")
