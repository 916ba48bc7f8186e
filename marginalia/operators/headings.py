"""Headings and their trails as Spark expressions, without a parser.

Finds ATX and underlined headings outside front matter and fenced code. The
note is one row while its lines are looked at; the trail above a heading comes
from windows over the headings alone, the last one of each level. Containers are
not opened: an indented heading that belongs to a list item counts as one of
the note, and trailing spaces in a title of several lines are no line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.arrays import running
from marginalia.functions.text import let, unnest

# The forms of markdown that matter for headings.
FRONT = r"\A---[ \t]*\n(?:[\s\S]*?\n)?---[ \t]*(?=\n|\z)"
FENCE = r"(?md)^ {0,3}(?:(`{3,})[^`\n]*$|(~{3,})[^\n]*$)[\s\S]*?(?:\n {0,3}(?:\1`*|\2~*)[ \t]*$|\z)"
ATX = r"^ {0,3}(#{1,6})(?:[ \t]+(.*)|)$"
ATX_TAIL = r"(?:^|[ \t]+)#+[ \t]*$"
EQUALS, DASHES = r"^ {0,3}=+[ \t]*$", r"^ {0,3}-+[ \t]*$"
# Lines that open a list item, quote, block of HTML, table row, definition or rule: what follows them is no title.
OPENS = r"^ {0,3}(?:[-+*](?:[ \t]|$)|\d{1,9}[.)](?:[ \t]|$)|>|<|\||\[[^\]]+\]:|([*_])[ \t]*(?:\1[ \t]*){2,}$)"
LEVELS = 6


def _blanked(text: Column, pattern: str) -> Column:
    """The text with every match emptied but for its line breaks."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.regexp_replace(h, r"[^\n]", ""))
    pieces = F.zip_with(F.split(text, pattern, -1), hits, lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def headings_in(content: Column) -> Column:
    """``array<struct<line int, depth int, title string>>`` of a note; a title keeps its markup.

    A paragraph of several lines above an underline is one title, its lines
    joined by line breaks. An underline needs a line of text right above it; a
    row of dashes without one is a rule.
    """
    plain = F.regexp_replace(F.coalesce(content, F.lit("")), r"\r\n?", "\n")
    return let(plain, lambda t: let(_blanked(t, FRONT), lambda u: let(F.split(_blanked(u, FENCE), "\n", -1), _found)))


def _found(lines: Column) -> Column:
    def kind(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^[ \t]*$"), "blank").when(x.rlike(ATX), "atx").when(x.rlike(EQUALS), "equals")
            .when(x.rlike(DASHES), "dashes").when(x.rlike(OPENS), "opens").otherwise("text")
        )

    def with_kinds(kinds: Column) -> Column:
        # Equals signs without text above are text.
        ends = F.transform(kinds, lambda k, i: ~((k == "text") | ((k == "equals") & (F.coalesce(F.get(kinds, i - 1), F.lit("blank")) != "text"))))
        return let(ends, lambda e: let(running(F.transform(e, lambda x: x.cast("int"))), lambda before: let(_places(e), lambda at: rows(kinds, before, at))))

    def rows(kinds: Column, before: Column, at: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            k = F.get(kinds, i)
            hashes = F.regexp_extract(x, ATX, 1)
            title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, ATX, 2), ATX_TAIL, ""), r"^[ \t]+|[ \t]+$", ""))
            atx = F.struct((i + 1).alias("line"), F.length(hashes).alias("depth"), title.alias("title"))
            # The paragraph above begins after the last line before this one that is no text.
            last = F.get(at, F.get(before, i).cast("int") - 1)
            first = F.coalesce(last + 1, F.lit(0))
            above = F.array_join(F.transform(F.slice(lines, first + 1, F.greatest(i - first, F.lit(0))), lambda y: F.regexp_replace(y, r"^[ \t]+|[ \t]+$", "")), "\n")
            under = F.struct((first + 1).alias("line"), F.when(k == "equals", 1).otherwise(2).alias("depth"), above.alias("title"))
            closed = F.coalesce(F.get(kinds, last), F.lit("blank")) == "opens"
            fits = ((k == "equals") | (k == "dashes")) & (F.coalesce(F.get(kinds, i - 1), F.lit("blank")) == "text") & ~closed & ~F.get(lines, first).rlike(r"^(?: {4}| {0,3}\t)")
            return F.when(k == "atx", atx).when(fits, under)

        return F.filter(F.transform(lines, row), lambda h: h.isNotNull())

    return let(F.transform(lines, kind), with_kinds)


def _places(flags: Column) -> Column:
    """Places of the true elements."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def heading_trails(notes: DataFrame) -> DataFrame:
    """``path, line, depth, title, heading_path``: every heading with the open headings above it and itself."""
    rows = unnest(notes, headings_in(F.col("content")), "path")
    earlier = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    for level in range(1, LEVELS):
        own = F.when(F.col("depth") == level, F.struct("line", "title"))
        rows = rows.withColumn(f"_l{level}", F.last(own, ignorenulls=True).over(earlier))
    open_ = []
    for level in range(1, LEVELS):
        at = F.col(f"_l{level}.line")
        closer = [F.coalesce(F.col(f"_l{m}.line"), F.lit(-1)) for m in range(1, level)]
        alive = at > (F.greatest(*closer) if len(closer) > 1 else closer[0]) if closer else F.lit(True)
        open_.append(F.when((F.col("depth") > level) & alive, F.col(f"_l{level}.title")))
    trail = F.concat(F.array_compact(F.array(*open_)), F.array("title"))
    return rows.select("path", "line", "depth", "title", trail.alias("heading_path"))
