"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import balancing, decontamination, hostquality, imatch, langid, licenses, neardup, periodic, pieces, pii, resharding, toxicity


def language(docs):
    return langid.identify(docs, langid.learn(docs.select("doc_id", "text", "lang")), ["doc_id"])


def toxic(docs):
    labels = docs.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    return toxicity.score(docs, toxicity.learn(docs.select("doc_id", "text"), labels), ["doc_id"])


OPERATORS = {
    "op1": toxic,
    "op2": pii.digest,
    "op3": licenses.digest,
    "op4": lambda d: neardup.classes(d).select("doc_id", "class_id"),
    "op5": pieces.encode,
    "op6": language,
    "op7": hostquality.judge,
    "op8": imatch.digest,
    "op9": resharding.reshard_digest,
    "op10": balancing.mix_digest,
    "op11": periodic.digest,
    "op13": lambda d: decontamination.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(odd_docs, name):
    out = OPERATORS[name](odd_docs)
    got = out.select("doc_id").collect()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got)
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd_docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_and_take_empty_tables(spark, odd_docs, no_docs, name, stage):
    out = stage(spark, odd_docs, "")
    if name != "pieces":
        assert out.columns == odd_docs.columns
        assert {r["kind"] for r in out.select("kind").collect()} == {"mine"}
    assert out.count() > 0
    assert stage(spark, no_docs, "").count() == 0


def test_stage_results(spark, odd_docs):
    texts = lambda df: [r["text"] for r in df.select("text").collect()]
    language = corpus_pipeline.identify_language(spark, odd_docs, "")
    assert None not in texts(language) and "12345 !!! ###" not in texts(language) and len(texts(language)) == 6
    unique = corpus_pipeline.drop_near_duplicates(spark, odd_docs, "")
    # Equal texts are one group: the repeated row and one of the null and empty texts stay once.
    assert sum(1 for t in texts(unique) if t and t.startswith("The cat")) == 1
    assert sum(1 for t in texts(unique) if not t) == 1
    clean = {r["doc_id"]: r for r in corpus_pipeline.remove_personal_data(spark, odd_docs, "").collect()}
    assert clean[7]["text"] == "Mail [EMAIL] or [PHONE], card [CARD] at [IP]" and clean[7]["n_chars"] == 44
    assert clean[2]["text"] is None and clean[3]["text"] == ""
