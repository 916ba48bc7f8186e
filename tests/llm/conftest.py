import pytest

ROWS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that results and work columns also use.
CLASHES = ["size", "shard", "score", "kind", "base", "spans", "key", "copies", "node", "ids", "kept", "n", "all"]


@pytest.fixture(autouse=True)
def nothing_stays_cached(spark):
    """The session is shared with the rest of the suite, whose plans must not meet cached tables."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and clashing extra columns."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i % 977} de la casa" for i in range(20_000))
    rows = [
        (1, "The cat sat on the mat and looked at the moon for a long time.", "en", "a", 0),
        (1, "The cat sat on the mat and looked at the moon for a long time.", "en", "a", 0),
        (2, None, "en", "a", 0),
        (3, "", None, "b", 0),
        (None, "El gato mira la luna y la luna mira al gato.", "es", None, None),
        (None, None, None, None, None),
        (4, "12345 !!! ###", "de", "b", 13),
        (5, long, "es", "c", len(long)),
        (6, "   \n\n  ", "es", "c", 7),
        (7, "Mail bob@site.com or +1 (017) 555-7713, card 4111 1111 1111 1111 at 10.0.0.1", "en", "c", 0),
        (8, "Released under the MIT License.", "en", "c", 0),
    ]
    docs = spark.createDataFrame(rows, ROWS)
    for name in CLASHES:
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
