"""One document of each class: repeated rows, null ids, and how often whole rows are shuffled."""

from marginalia.llm import neardup

ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG + " more"


def table(spark):
    texts = [(5, LONG), (5, LONG), (3, NEAR), (None, LONG), (None, NEAR), (None, "alone without an id"), (None, "alone without an id"), (7, None), (8, ""), (None, None), (9, "another text"), (10, "another text")]
    return spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(texts)], ROWS)


def test_one_row_of_each_class_stays(spark):
    kept = neardup.keep_one(table(spark))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, NEAR), (None, "alone without an id"), (7, None), (9, "another text")], key=str)


def test_whole_rows_are_shuffled_once(spark):
    """The join that also matched nulls and the grouping after it had different partitions: texts moved twice."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = neardup.keep_one(table(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "__t1" in line]
    assert len([line for line in moved if "doc_id" in line]) == 1, plan
    # Rows without an id have a branch of their own.
    assert len(moved) == 2
