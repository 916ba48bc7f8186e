"""Keyword, vector and hybrid search against a plain-Python computation."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions.markdown import note_chunks, parse_note
from marginalia.functions.text import round3, similarity, word_count
from marginalia.operators import vectors
from marginalia.operators.search import fragment_search, global_search, score_rows
from marginalia.operators.skew import attach
from marginalia.sources.embedders import HashingEmbedder

VAULT = {
    "physics/quantum.md": "# Quantum\n\nQuantum entanglement links particles.\n\n## Basics\n\nParticles have spin.\n",
    "cooking/recipes.md": "# Recipes\n\nPasta with quantum amounts of cheese.\n\n## Soup\n\nBoil water and entanglement of noodles.\n",
    "programming/typescript.md": "# TypeScript\n\nTypes and interfaces.\n\n## Generics\n\nGeneric types.\n",
    "flat.md": "Just plain text without any headings or structure.",
}


def toks(text):
    return re.findall("[a-z0-9_]+", text.lower())


def expected(texts, query, w=0.7):
    terms = toks(query)
    lists = [toks(t) for t in texts]
    tfidf, prox = [], []
    for tk in lists:
        s = 0.0
        for q in terms:
            df = sum(q in x for x in lists)
            s += (tk.count(q) / len(tk) if tk else 0.0) * (math.log(len(lists) / df) if df else 0.0)
        tfidf.append(s)
        gaps = []
        for a, b in zip(terms, terms[1:]):
            pairs = [abs(i - j) for i, x in enumerate(tk) if x == a for j, y in enumerate(tk) if y == b]
            gaps.append(min(pairs) if pairs else None)
        ok = gaps and None not in gaps and sum(gaps) > 0
        prox.append(len(gaps) / sum(gaps) if ok else 0.0)
    mt, mp = max(tfidf, default=0), max(prox, default=0)
    return [w * (a / mt if mt else 0) + (1 - w) * (b / mp if mp else 0) for a, b in zip(tfidf, prox)]


def brute(vault, query, k, w=0.7):
    rows = []
    for path, content in vault.items():
        chunks = note_chunks(parse_note(content))
        for i, s in enumerate(expected([c[1] for c in chunks], query, w)):
            if s >= 0.01:
                rows.append((-s, path, i))
    return [(p, i, round(-s, 9)) for s, p, i in sorted(rows)[:k]]


def got(df):
    return [(r.path, r.chunk_idx, round(r.score, 9)) for r in df.collect()]


@pytest.mark.parametrize("query", ["quantum entanglement", "plain text", "types", "particles particles", "water missing", "and of the"])
def test_global_matches_brute_force(make, query):
    assert got(global_search(make(VAULT), query)) == brute(VAULT, query, 20)


def test_random_vault(make):
    rng = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta eta".split()
    vault = {}
    for n in range(25):
        parts = [f"## S{i}\n\n{' '.join(rng.choices(words, k=rng.randint(1, 12)))}\n" for i in range(rng.randint(1, 6))]
        vault[f"d{n % 3}/n{n:02}.md"] = "# N\n\n" + "\n".join(parts)
    for query in ("alpha beta", "beta gamma alpha", "zeta", "eta eta"):
        for k in (1, 5, 50):
            assert got(global_search(make(vault), query, k)) == brute(vault, query, k)
    scores = [r.score for r in global_search(make(vault), "alpha beta", 500).collect()]
    assert all(0 < s <= 1 + 1e-9 for s in scores)


def test_directory_and_blank_query(make):
    notes = make(VAULT)
    assert {r.path for r in global_search(notes, "quantum entanglement", directory="cooking").collect()} == {"cooking/recipes.md"}
    assert global_search(notes, "quantum", directory="cook").count() == 0
    assert global_search(notes, "?!").count() == 0


def test_single_chunk_note_needs_two_words(make):
    notes = make({"flat.md": VAULT["flat.md"]})
    assert fragment_search(notes, "plain").count() == 0
    row = fragment_search(notes, "plain text").first()
    assert round(row.score, 9) == 0.3


def test_escapes_and_entities_are_searched(make):
    notes = make({"a.md": "# T\n\nfoo\\_bar here\n\n## U\n\nother\n\n## V\n\n&#97;bc\n"})
    assert fragment_search(notes, "foo_bar").count() == 1
    assert fragment_search(notes, "abc").count() == 1


@pytest.mark.parametrize(
    "head",
    ["# foo**bar**", "#\tfoo`x`bar", "## foo[bar](u) #", "foo*bar*\n===", "foo  \nbar\n---", "---\nt: 1\n---\nfoo_ba_ r\n# fo<b>o</b>bar", "x\r\n\r\n# foo~~bar~~"],
)
def test_words_joined_by_heading_markup_are_found(make, head):
    vault = {"n.md": head + "\n\nbody words\n\n# Other\n\nmore\n", "m.md": "# Plain\n\nnothing here\n\n# B\n\nb\n"}
    for query in ("foobar", "foobar body", "words"):
        assert got(global_search(make(vault), query)) == brute(vault, query, 20)


def test_front_matter_does_not_force_parsing(spark, make):
    from marginalia.operators.search import may_match

    notes = make({"a.md": "---\ntitle: x\n---\n\n# Plain\n\nnothing\n", "b.md": "---\na: 1\n---\nhead\n---\n", "c.md": "needle"})
    passed = notes.filter(may_match(F.col("content"), "needle")).select("path")
    assert {r.path for r in passed.collect()} == {"b.md", "c.md"}


def test_fragment_limit_and_weights(make):
    notes = make(VAULT)
    assert fragment_search(notes, "quantum particles", 1).groupBy("path").count().filter("count > 1").count() == 0
    assert got(global_search(notes, "quantum entanglement", tfidf_weight=0.2)) == brute(VAULT, "quantum entanglement", 20, 0.2)


def test_rows_with_hot_scope(spark):
    """A scope that holds most rows gives the same scores as a plain computation."""
    rng = random.Random(3)
    data = []
    for i in range(300):
        scope = 0 if i % 3 else i
        data.append((scope, i, " ".join(rng.choices("a b c d e f g".split(), k=rng.randint(1, 8)))))
    rows = spark.createDataFrame(data, "scope long, line long, text string")
    found = {(r.scope, r.line): r.score for r in score_rows(rows, "scope", "text", ["line"], "a b").collect()}
    want = {}
    for scope in {d[0] for d in data}:
        part = [d for d in data if d[0] == scope]
        for d, s in zip(part, expected([d[2] for d in part], "a b")):
            if {"a", "b"} & set(toks(d[2])):
                want[scope, d[1]] = s
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_attach_keeps_every_row(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 7, id) AS k")
    facts = rows.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("m"))
    joined = attach(rows, facts, "k", "w", ["id"])
    assert joined.count() == 1000
    assert joined.filter("k = 7").select("m").distinct().count() == 1


def test_vectors(spark):
    store = spark.createDataFrame(
        [("a", 0, [1.0, 0.0, 0.0]), ("b", 0, [0.9, 0.1, 0.0]), ("b", 1, [0.0, 1.0, 0.0]), ("c", 0, [0.0, 0.0, 1.0]), ("z", 0, [0.0, 0.0, 0.0])],
        "doc_path string, chunk_idx int, embedding array<float>",
    )
    rows = vectors.top_k(store, [1.0, 0.0, 0.0], 3).collect()
    assert [(r.doc_path, r.chunk_idx) for r in rows] == [("a", 0), ("b", 0), ("b", 1)]
    assert rows[0].similarity == 1.0 and rows[2].similarity == 0.0
    new = spark.createDataFrame([("b", 0, [0.5]), ("n", 0, [1.0, 2.0, 3.0, 4.0])], store.schema)
    state = {(r.doc_path, r.chunk_idx): r.embedding for r in vectors.upsert(store, new, 3).collect()}
    assert state["b", 0] == [0.5, 0.0, 0.0] and ("b", 1) not in state and state["n", 0] == [1.0, 2.0, 3.0]
    assert vectors.upsert(vectors.upsert(store, new, 3), new, 3).count() == len(state)
    assert vectors.delete(store, spark.createDataFrame([("b",), ("x",)], "doc_path string")).count() == 3
    assert vectors.index_size(store).first() == (4, 5)
    ragged = spark.createDataFrame([("r", 0, [1.0]), ("s", 0, None)], store.schema)
    assert [r.similarity for r in vectors.top_k(ragged, [1.0, 0.0], 5).collect()] == [1.0, 0.0]


def hybrid_store(spark):
    rows = [
        ("recipes/pasta.md", 0, "r", [1.0, 0.0], "pasta with cheese", ["Pasta"]),
        ("rec.md", 0, "r", [0.8, 0.6], "cheese cheese", []),
        ("tech/a.md", 0, "r", [0.0, 1.0], "types", []),
    ]
    return spark.createDataFrame(rows, "doc_path string, chunk_idx int, chunk_id string, embedding array<float>, text string, heading_path array<string>")


def test_hybrid(spark):
    store = hybrid_store(spark)
    rows = vectors.hybrid_search(store, "cheese", [1.0, 0.0]).collect()
    assert [r.doc_path for r in rows] == ["rec.md", "recipes/pasta.md", "tech/a.md"]
    only_vector = vectors.hybrid_search(store, "cheese", [1.0, 0.0], vector_weight=1.0).collect()
    assert [r.doc_path for r in only_vector] == ["recipes/pasta.md", "rec.md", "tech/a.md"]
    assert {r.doc_path for r in vectors.hybrid_search(store, "x", [1.0, 0.0], directory="rec").collect()} == {"rec.md", "recipes/pasta.md"}
    assert len(vectors.hybrid_search(store, "x", [1.0, 0.0], 1).collect()) == 1
    assert vectors.hybrid_search(store, "x", [1.0, 0.0], directory="none").count() == 0


def test_directory_filter_comes_after_the_pool(spark):
    near = [(f"near/{i:02}.md", 0, [1.0, 0.01 * i], "t") for i in range(25)]
    store = spark.createDataFrame(near + [("far/x.md", 0, [0.0, 1.0], "t")], "doc_path string, chunk_idx int, embedding array<float>, text string")
    assert vectors.hybrid_search(store, "t", [1.0, 0.0], 5, directory="far").count() == 0
    assert vectors.hybrid_search(store, "t", [1.0, 0.0], 5, directory="far", prefilter=True).count() == 1


def test_negative_similarities_flip(spark):
    store = spark.createDataFrame([("a", 0, [-1.0, 0.0], "t"), ("b", 0, [-1.0, 1.0], "t")], "doc_path string, chunk_idx int, embedding array<float>, text string")
    assert [r.doc_path for r in vectors.hybrid_search(store, "q", [1.0, 0.0]).collect()] == ["a", "b"]


def test_embedder_is_deterministic_and_unit():
    a, b = HashingEmbedder(16).embed_batch(["Alpha beta", "alpha BETA"])
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-5
    assert HashingEmbedder(8).embed_batch([""]) == [[0.0] * 8]


def test_small_functions(spark):
    row = spark.createDataFrame([(-0.0005, 1.2345, "a b  c", "", "")], "x double, y double, t string, e string, f string").select(
        round3(F.col("x")).alias("x"),
        round3(F.col("y")).alias("y"),
        word_count(F.col("t")).alias("w"),
        similarity(F.lit(0), F.col("e"), F.col("f")).alias("s"),
    ).first()
    assert (row.x, row.y, row.w, row.s) == (0.0, 1.235, 3, 1.0)


def test_semantic_search_matches_brute_force(make):
    """Index, embed and re-rank a small vault by hand."""
    import numpy as np

    from marginalia.sources.embedders import embed_query
    from marginalia.sources.index_store import build_index

    embedder, query, k = HashingEmbedder(12), "quantum types of cheese", 3
    index = build_index(make(VAULT), embedder)
    rows = []
    for path, content in VAULT.items():
        for i, c in enumerate(note_chunks(parse_note(content))):
            a, b = (np.array(embedder.embed_batch([t])[0]) for t in (query, c[1]))
            rows.append((path, i, c[1], float(a @ b / np.sqrt((a @ a) * (b @ b)))))
    rows.sort(key=lambda r: (-r[3], r[0], r[1]))
    pool = rows[: max(3 * k, 20)]
    lists, terms = [toks(r[2]) for r in pool], toks(query)
    lex = []
    for tk in lists:
        df = {q: sum(q in x for x in lists) for q in terms}
        lex.append(sum(tk.count(q) / len(tk) * (math.log(len(lists) / df[q]) if df[q] else 0.0) for q in terms))
    best = [0.6 * r[3] / pool[0][3] + 0.4 * x / max(lex) for r, x in zip(pool, lex)]
    want = sorted(range(len(pool)), key=lambda i: (-round(best[i], 9), i))[:k]
    found = vectors.hybrid_search(index, query, embed_query(embedder, query), k).collect()
    assert [(r.doc_path, r.chunk_idx) for r in found] == [pool[i][:2] for i in want]
    assert all(abs(r.score - best[i]) < 1e-6 for r, i in zip(found, want))
    texts = index.select("doc_path", "chunk_idx", "text")
    again = vectors.hybrid_search(index.drop("text"), query, embed_query(embedder, query), k, texts=texts).collect()
    assert [(r.doc_path, r.chunk_idx, r.score) for r in again] == [(r.doc_path, r.chunk_idx, r.score) for r in found]


def test_limit_zero_keeps_chunks_without_a_term(make):
    notes = make({"n.md": "# A\n\nalpha beta\n\n# B\n\nnothing here\n\n# C\n\nalpha\n", "m.md": "# D\n\nother text\n"})
    rows = fragment_search(notes, "alpha beta", min_score=0.0).collect()
    assert sorted((r["path"], r["chunk_idx"]) for r in rows) == [("m.md", 0), ("n.md", 0), ("n.md", 1), ("n.md", 2)]
    assert {r["path"] for r in fragment_search(notes, "alpha beta").collect()} == {"n.md"}


def test_rows_of_a_null_scope_keep_their_facts(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, i int")
    facts = spark.createDataFrame([(None, 2, "none"), ("a", 1, "one")], "k string, w long, fact string")
    got = sorted((r["i"], r["fact"]) for r in attach(rows, facts, "k", "w", ["i"]).collect())
    assert got == [(1, "none"), (2, "none"), (3, "one")]
