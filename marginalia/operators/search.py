"""Keyword search: TF-IDF blended with word proximity.

Scores are relative to a scope. For notes the scope is the note, which is one
row, so document frequencies and maxima are computed inside the row without a
shuffle. For tables with one row per chunk, the scope statistics are grouped
first and joined back through a skew-safe join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.paths import in_directory
from marginalia.functions.text import (
    hit_count,
    idf,
    let,
    mentions_any,
    normalise,
    proximity,
    query_terms,
    term_count,
    term_frequency,
    term_hits,
    token_count,
    tokens,
    unnest,
)
from marginalia.operators.chunks import with_chunks
from marginalia.operators.skew import attach
from marginalia.session import materialise

# Result sizes, weight and threshold when the caller gives none.
FRAGMENT_LIMIT = 5
GLOBAL_LIMIT = 20
TFIDF_WEIGHT = 0.7
MIN_SCORE = 0.01


def _tfidf(counts: Column, n_tokens: Column, n: Column, dfs: Column, terms: Sequence[str]) -> Column:
    """Sum over the query terms in query order, so that doubles add up the same way."""
    slot = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    total = F.lit(0.0)
    for term in terms:
        i = F.lit(slot[term])
        total = total + term_frequency(F.get(counts, i), n_tokens) * idf(n, F.get(dfs, i))
    return total


def _df(ms: Column, i: int) -> Column:
    return F.size(F.filter(ms, lambda m: F.get(m["k"], F.lit(i)) > 0))


def score_array(chunks: Column, query: str, tfidf_weight: float = TFIDF_WEIGHT, every: bool = False) -> Column:
    """Scored chunks of one note; chunks without any query term are left out unless ``every`` is set.

    Left-out chunks would score 0, and both the document frequencies and the
    maxima depend on matching chunks only, so dropping them early is exact.
    """
    terms = query_terms(query)
    unique = list(dict.fromkeys(terms))

    def measured(c: Column) -> Column:
        return let(
            tokens(c["text"]),
            lambda tk: let(
                term_hits(tk, terms),
                lambda hits: F.struct(
                    c.alias("c"),
                    F.size(tk).alias("n"),
                    F.array(*[hit_count(hits, t) for t in unique]).alias("k"),
                    hits.alias("hits"),
                ),
            ),
        )

    def rate(note: Column) -> Column:
        ms, n = note["ms"], note["n"]
        dfs = F.array(*[_df(ms, i) for i in range(len(unique))])
        return let(
            dfs,
            lambda d: F.transform(
                ms,
                lambda m: F.struct(
                    m["c"].alias("c"),
                    _tfidf(m["k"], m["n"], n, d, terms).alias("tfidf"),
                    proximity(m["hits"], terms).alias("proximity"),
                ),
            ),
        )

    def blend(rows: Column) -> Column:
        tops = F.struct(
            F.array_max(F.transform(rows, lambda r: r["tfidf"])).alias("t"),
            F.array_max(F.transform(rows, lambda r: r["proximity"])).alias("p"),
        )
        return let(
            tops,
            lambda top: F.transform(
                rows,
                lambda r: F.struct(
                    r["c"].alias("c"),
                    r["tfidf"].alias("tfidf"),
                    r["proximity"].alias("proximity"),
                    _blended(r["tfidf"], top["t"], r["proximity"], top["p"], tfidf_weight).alias("score"),
                ),
            ),
        )

    if every:
        matched = F.transform(chunks, measured)
    else:
        matched = F.filter(
            F.transform(F.filter(chunks, lambda c: mentions_any(c["text"], terms)), measured),
            lambda m: F.exists(m["k"], lambda k: k > 0),
        )
    return let(let(F.struct(matched.alias("ms"), F.size(chunks).alias("n")), rate), blend)


def _blended(tfidf: Column, top_t: Column, prox: Column, top_p: Column, weight: float) -> Column:
    return F.lit(weight) * normalise(tfidf, top_t) + F.lit(1 - weight) * normalise(prox, top_p)


FRONT = r"\A---[ \t]*\r?\n(?:(?s).*?\r?\n)??---[ \t]*(?:\r?\n|\z)"
MARKED_HEADING = r"(?:\A|[\r\n]) {0,3}#{1,6}[ \t][^\r\n]*[*_~`\[<!]"
UNDERLINED_HEADING = r"[^\r\n](?:\r\n|\r|\n) {0,3}(?:=+|-+)[ \t]*(?:[\r\n]|\z)"


def may_match(content: Column, query: str) -> Column:
    """Necessary condition on the raw note, tested before it is parsed.

    A token of a chunk is a substring of the source, with three exceptions: an
    entity or a backslash escape takes part in it, or it comes from a heading
    whose markup is dropped without leaving a gap. Notes with any of these
    always pass.
    """
    body = F.regexp_replace(content, FRONT, "")
    return (
        mentions_any(content, query_terms(query))
        | content.contains("&")
        | content.contains("\\")
        | content.rlike(MARKED_HEADING)
        | body.rlike(UNDERLINED_HEADING)
    )


def _matches(notes: DataFrame, query: str, tfidf_weight: float, min_score: float) -> DataFrame:
    """Notes with ``m``: the qualifying scored chunks of each. A limit of 0 or less keeps chunks without a term too."""
    every = min_score <= 0
    if "chunks" not in notes.columns:
        wanted = notes if every else notes.filter(may_match(F.col("content"), query))
        notes = with_chunks(wanted.select("path", "content"))
    scored = notes.select("path", score_array(F.col("chunks"), query, tfidf_weight, every).alias("m"))
    return scored.select("path", F.filter("m", lambda r: r["score"] >= min_score).alias("m"))


RESULT = ["path", "chunk_idx", "heading_path", "text", "score", "word_count"]


def _flatten(matches: DataFrame) -> DataFrame:
    return unnest(matches, "m", "path").select("path", "c.*", "score").select(*RESULT)


def _none(notes: DataFrame) -> DataFrame:
    schema = "path string, chunk_idx int, heading_path array<string>, text string, score double, word_count int"
    return notes.sparkSession.createDataFrame([], schema)


def global_search(
    notes: DataFrame,
    query: str,
    max_results: int = GLOBAL_LIMIT,
    directory: str | None = None,
    tfidf_weight: float = TFIDF_WEIGHT,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Best chunks over all notes. ``notes`` has ``content``, or a stored ``chunks`` array."""
    if not query_terms(query):
        return _none(notes)
    scope = notes.filter(in_directory(F.col("path"), directory))
    found = _flatten(_matches(scope, query, tfidf_weight, min_score))
    return found.orderBy(F.desc("score"), "path", "chunk_idx").limit(max_results)


def fragment_search(
    notes: DataFrame,
    query: str,
    max_chunks: int = FRAGMENT_LIMIT,
    tfidf_weight: float = TFIDF_WEIGHT,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Best chunks of each note, ranked inside its row."""
    if not query_terms(query):
        return _none(notes)
    keyed = F.transform("m", lambda r: F.struct((-r["score"]).alias("k"), r["c"]["chunk_idx"].alias("i"), r.alias("r")))
    best = F.transform(F.slice(F.array_sort(keyed), 1, max_chunks), lambda x: x["r"])
    return _flatten(_matches(notes, query, tfidf_weight, min_score).select("path", best.alias("m")))


def score_rows(
    rows: DataFrame,
    scope: str | None,
    text: str,
    row_id: Sequence[str],
    query: str,
    tfidf_weight: float = TFIDF_WEIGHT,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The same scores for a table with one row per chunk and any scope key.

    The texts are read once: the counts of the matching rows are written as a
    narrow table, and the scope sizes need the key column only. Frequencies and
    maxima are grouped with map-side combining and return to the rows through
    skew-safe joins. Without a scope all rows count together; then the
    statistics are single values and need no join.
    """
    terms = query_terms(query)
    unique = list(dict.fromkeys(terms))
    cols = list(dict.fromkeys([*([scope] if scope else []), *row_id, *keep]))
    if not terms:
        return rows.select(*cols, *[F.lit(0.0).alias(c) for c in ("tfidf", "proximity", "score")]).limit(0)
    body = F.col(text)
    counted = rows.select(
        *cols, text, *[F.when(mentions_any(body, [t]), term_count(body, t)).alias(f"_k{i}") for i, t in enumerate(unique)]
    )
    has = [F.col(f"_k{i}") > 0 for i in range(len(unique))]
    near = F.when(reduce(and_, has), proximity(term_hits(tokens(body), terms), terms)).otherwise(F.lit(0.0))
    narrow = materialise(
        counted.filter(reduce(or_, has)).select(
            *cols,
            F.array(*[F.coalesce(F.col(f"_k{i}"), F.lit(0)) for i in range(len(unique))]).alias("_k"),
            token_count(body).alias("_t"),
            near.alias("proximity"),
        ),
        "scores",
    )
    dfs = F.array(*[F.count_if(F.get("_k", F.lit(i)) > 0) for i in range(len(unique))]).alias("_df")
    if scope is None:
        n, found = F.lit(rows.count()), narrow.agg(dfs).first()["_df"]
        raw = narrow.withColumn("tfidf", _tfidf(F.col("_k"), F.col("_t"), n, F.array(*map(F.lit, found)), terms))
        top = raw.agg(F.max("tfidf").alias("t"), F.max("proximity").alias("p")).first()
        score = _blended(F.col("tfidf"), F.lit(top["t"]), F.col("proximity"), F.lit(top["p"]), tfidf_weight)
        return raw.select(*cols, "tfidf", "proximity", score.alias("score"))
    sizes = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("_n"))
    stats = narrow.groupBy(scope).agg(dfs, F.count(F.lit(1)).alias("_w"))
    raw = attach(narrow, stats.join(sizes, scope), scope, "_w", list(row_id), weights=stats.select(scope, "_w")).select(
        *cols, _tfidf(F.col("_k"), F.col("_t"), F.col("_n"), F.col("_df"), terms).alias("tfidf"), "proximity"
    )
    tops = raw.groupBy(scope).agg(
        F.max("tfidf").alias("_mt"), F.max("proximity").alias("_mp"), F.count(F.lit(1)).alias("_w")
    )
    score = _blended(F.col("tfidf"), F.col("_mt"), F.col("proximity"), F.col("_mp"), tfidf_weight)
    best = attach(raw, tops, scope, "_w", list(row_id), weights=stats.select(scope, "_w"))
    return best.select(*cols, "tfidf", "proximity", score.alias("score"))
