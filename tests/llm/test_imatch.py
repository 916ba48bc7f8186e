"""Fingerprints against a plain version that treats both texts and every subset apart, and the size of their plan."""

import re

from pyspark.sql import functions as F

from marginalia.llm import imatch

ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(spark):
    """Few words in many texts, so that the lexicon is not empty; also texts of rare words, empty and null ones."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 211}" for j in range(i % 40 + 3)), "en", "a", 0) for i in range(120)]
    return spark.createDataFrame([*rows, (200, "", "en", "a", 0), (201, None, "en", "a", 0), (202, "rare999 rare998", "en", "a", 0), (203, "W1 w1, Ümlaut-w2", "en", "b", 0)], ROWS)


def planned(monkeypatch, docs):
    """The plans that fingerprints() writes, by label."""
    plans, write = {}, imatch.materialise

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(imatch, "materialise", seen)
    imatch.fingerprints(docs).count()
    return plans


def test_fingerprints_equal_plain_version(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    masks = {r["term"]: r["mask"] for r in imatch.lexicon(docs, len(texts)).collect()}
    assert masks
    ids, wanted = sorted(texts), []
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        wanted += [(i, "fingerprint", text), (i, "edited_fingerprint", text[: len(text) - half] + following[:half])]
    named = spark.createDataFrame(wanted, "doc_id bigint, side string, text string")
    terms = {(r["doc_id"], r["side"]): r["t"] for r in named.select("doc_id", "side", imatch.term_hashes(F.col("text")).alias("t")).collect()}
    parts = []
    for (i, side), own in terms.items():
        known = sorted(t for t in own if t in masks)
        parts += [(i, side, j, bool(known), sorted(own), [t for t in known if masks[t] >> j & 1]) for j in range(imatch.SUBSETS)]
    parts = spark.createDataFrame(parts, "doc_id bigint, side string, j int, known boolean, own array<bigint>, part array<bigint>")
    code = F.when(~F.col("known"), F.concat(F.lit("x"), F.lower(F.hex(F.xxhash64("own"))))).when(F.size("part") == 0, F.lit("-"))
    code = code.otherwise(F.lower(F.lpad(F.hex(F.xxhash64("part").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    plain = {}
    for r in parts.select("doc_id", "side", "j", code.alias("c")).collect():
        plain.setdefault((r["doc_id"], r["side"]), {})[r["j"]] = r["c"]
    assert len(got) == len(texts)
    for (i, side), codes in plain.items():
        assert got[i][side] == ",".join(codes[j] for j in range(imatch.SUBSETS)), (i, side)
    assert any(r["fingerprint"] != r["edited_fingerprint"] for r in got.values())


def test_plan_has_no_expression_for_each_subset(spark, monkeypatch):
    """Its size was 24 times that of one subset, for each of two texts, in one generated method."""
    plan = planned(monkeypatch, corpus(spark))["fingerprints"]
    assert len(re.findall(r"\bfilter\(", plan)) < imatch.SUBSETS
    assert len(re.findall(r"Generate", plan)) == 1
