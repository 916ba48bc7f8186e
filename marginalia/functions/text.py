"""Text expressions. Everything here is a built-in Column expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The separator classes that decide what a token and a word are.
TOKEN = "[a-z0-9_]+"
WORD_SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
PLACEHOLDER = r"\{\{\s*([a-zA-Z0-9_]+)\s*\}\}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A lambda variable is bound once per row, whereas a shared sub-expression
    inside a higher-order function would be evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def unnest(df: DataFrame, array: str | Column, *keep: str) -> DataFrame:
    """One row per struct of ``array``, its fields as columns beside ``keep``.

    The outer form is used on purpose: for the inner form the optimiser adds a
    size filter on the array and pushes it down, which would run the parser (or
    the scoring) a second time below any repartitioning.
    """
    rows = df.select(*keep, F.explode_outer(array).alias("_e"))
    return rows.filter(F.col("_e").isNotNull()).select(*keep, "_e.*")


def tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens; any other character separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def term_count(text: Column, term: str) -> Column:
    """Occurrences of a query token as a whole token, without building the token list."""
    return F.regexp_count(F.lower(text), F.lit(f"{term}(?![a-z0-9_])(?<![a-z0-9_]{term})"))


def query_terms(query: str) -> list[str]:
    """Tokens of a literal query, repeats kept."""
    return re.findall("[a-z0-9_]+", query.lower())


def mentions_any(text: Column, terms: Sequence[str]) -> Column:
    """Cheap necessary condition for holding a query term, used before tokenising."""
    lowered = F.lower(text)
    test = F.lit(False)
    for term in dict.fromkeys(terms):
        test = test | lowered.contains(term)
    return test


def word_count(text: Column) -> Column:
    """Words separated by Unicode white space."""
    return F.size(F.array_remove(F.split(text, WORD_SPACE + "+"), ""))


def term_frequency(count: Column, n_tokens: Column) -> Column:
    return F.when(n_tokens > 0, count.cast("double") / n_tokens).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    """``ln(n/df)`` without smoothing; 0 when nothing holds the term."""
    return F.when(df > 0, F.ln(n.cast("double") / df)).otherwise(F.lit(0.0))


def term_hits(toks: Column, terms: Sequence[str]) -> Column:
    """Positions of query terms only: ``array<struct<p,t>>`` in token order."""
    wanted = list(dict.fromkeys(terms))
    marked = F.transform(toks, lambda x, i: F.when(x.isin(wanted), F.struct(i.alias("p"), x.alias("t"))))
    return F.filter(marked, lambda h: h.isNotNull())


def hit_count(hits: Column, term: str) -> Column:
    return F.size(F.filter(hits, lambda h: h["t"] == term))


def _closest(hits: Column, a: str, b: str) -> Column:
    """Smallest distance between a hit of ``a`` and one of ``b``; NULL if either is missing."""
    if a == b:
        return F.when(hit_count(hits, a) > 0, F.lit(0))
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("a"), none.alias("b"), none.alias("best"))

    def step(s: Column, h: Column) -> Column:
        is_a, is_b = h["t"] == a, h["t"] == b
        gap = F.when(is_a, h["p"] - s["b"]).when(is_b, h["p"] - s["a"])
        return F.struct(
            F.when(is_a, h["p"]).otherwise(s["a"]).alias("a"),
            F.when(is_b, h["p"]).otherwise(s["b"]).alias("b"),
            F.least(s["best"], gap).alias("best"),
        )

    return F.aggregate(hits, start, step, lambda s: s["best"])


def proximity(hits: Column, terms: Sequence[str]) -> Column:
    """Inverse of the mean closest distance between consecutive query terms.

    ``hits`` comes from :func:`term_hits`; each pair is found in one pass over
    it. A missing term or a mean distance of zero gives 0, as does a query of
    fewer than two terms.
    """
    if len(terms) < 2:
        return F.lit(0.0)
    total = _closest(hits, terms[0], terms[1])
    for a, b in zip(terms[1:], terms[2:]):
        total = total + _closest(hits, a, b)
    mean = total.cast("double") / F.lit(float(len(terms) - 1))
    return let(mean, lambda avg: F.when(avg > 0, F.lit(1.0) / avg).otherwise(F.lit(0.0)))


def normalise(value: Column, top: Column) -> Column:
    """Divide by the largest value of the scope; all zero when that is zero."""
    return F.when(top == 0, F.lit(0.0)).otherwise(value / top)


def round3(x: Column) -> Column:
    """Three digits, halves towards plus infinity."""
    return F.floor(x * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def similarity(distance: Column, a: Column, b: Column) -> Column:
    """``1 - distance / longest``; two empty strings are identical."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - distance.cast("double") / longest)


def replace_first(text: Column, search: Column, new: Column) -> Column:
    at = F.instr(text, search)
    return F.when(at == 0, text).otherwise(
        F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(search), F.length(text)))
    )


def render_template(text: Column, variables: Column) -> Column:
    """Fill ``{{ name }}`` placeholders from a map, in one pass.

    Values are never scanned again; unknown names stay as they are.
    """
    pieces = F.split(text, PLACEHOLDER, -1)
    marks = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))
    values = F.zip_with(marks, names, lambda m, k: F.coalesce(F.try_element_at(variables, k), m))
    return F.array_join(
        F.zip_with(pieces, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), ""
    )
