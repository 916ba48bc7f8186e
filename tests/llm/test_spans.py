"""Places, overlaps and replacements of spans in texts with very many of them."""

import random
import time

from pyspark.sql import functions as F

from marginalia.llm import licenses, pii

SPAN = "array<struct<start:int,kind:int,end:int>>"


def plain_redact(text, spans):
    out, at = "", 0
    for start, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_overlaps_and_replacements_match_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("abé漢😀 \n") for _ in range(rng.choice([40, 600, 3000])))
        spans = lambda n: sorted((s, rng.randrange(4), min(len(text), s + rng.randint(1, 30))) for s in (rng.randrange(len(text) - 1) for _ in range(n)))  # noqa: B023, E731
        rows.append((i, text, spans(rng.randrange(40)), spans(rng.randrange(40))))
    df = spark.createDataFrame(rows, f"id int, text string, a {SPAN}, b {SPAN}")
    got = df.select("id", pii.without_overlap(F.col("a"), F.col("b")).alias("free"), pii.replaced(F.col("text"), F.col("b")).alias("clean")).collect()
    for r, (_, text, a, b) in zip(sorted(got), rows, strict=True):
        assert [tuple(x) for x in r.free] == [x for x in a if not any(y[0] < x[2] and x[0] < y[2] for y in b)]
        assert r.clean == plain_redact(text, b)


def test_many_matches_of_one_text_take_linear_time(spark):
    n = 30_000
    text = " ".join(f"u{i}@ex{i % 7}.com 10.0.0.{i % 200}" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "mail a@b.com"), (3, None)], "doc_id int, text string")
    started = time.time()
    rows = pii.decided(pii.described(docs, ["doc_id", "text"]), pii.Classifier({}, {}, []))
    got = {r.doc_id: r for r in rows.select("doc_id", F.size("base").alias("n"), pii.replaced(F.coalesce("text", F.lit("")), F.col("all")).alias("clean")).collect()}
    assert time.time() - started < 40
    assert [got[i].n for i in (1, 2, 3)] == [2 * n, 1, 0]
    assert [got[i].clean for i in (1, 2, 3)] == [" ".join(["[EMAIL] [IP]"] * n), "mail [EMAIL]", ""]


def test_wider_forms_are_candidates_in_full(spark):
    texts = ["write to jane [at] mail.example.com now", "host 2001:db8::7 up", "std::vector and a::b::c", "write to joe (at) a (dot) b (dot) org"]
    rows = pii.described(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), ["doc_id"]).collect()
    found = {r.doc_id: [texts[r.doc_id][c.start : c.end] for c in r.cands if c.wider] for r in rows}
    assert found == {0: ["jane [at] mail.example.com"], 1: ["2001:db8::7"], 2: [], 3: ["joe (at) a (dot) b (dot) org"]}


def test_places_of_a_very_frequent_phrase(spark):
    n = 20_000
    text = "x under the mit license y " * n
    started = time.time()
    row = licenses.digest(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert time.time() - started < 60
    assert (row.n_base, row.first_word, row.last_word) == (n, 1, 6 * (n - 1) + 1)
