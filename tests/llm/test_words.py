"""The words of the decontamination are those of its contract, character by character."""

from pyspark.sql import functions as F

from marginalia.llm.decontamination import RAW_WORD, WORD

CONTRACT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTRACT_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def test_patterns_match_the_same_characters(spark):
    codes = [*range(1, 0x3000), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    rows = spark.createDataFrame([(chr(c),) for c in codes], "t string")
    for own, contract in ((WORD, CONTRACT), (RAW_WORD, CONTRACT_RAW)):
        assert rows.filter(F.col("t").rlike(own) != F.col("t").rlike(contract)).count() == 0
    text = spark.createDataFrame([("".join(map(chr, codes)) + "Éa \U0001f600x-b\nC3 d",)], "t string")
    assert text.filter(F.regexp_extract_all("t", F.lit(RAW_WORD), F.lit(0)) != F.regexp_extract_all("t", F.lit(CONTRACT_RAW), F.lit(0))).count() == 0


def test_characters_are_looked_up_not_compared(spark):
    # Ranges of ASCII and complements make each character cost several tests: ten times the seconds.
    for pattern in (WORD, RAW_WORD):
        assert "^" not in pattern and "a-z" not in pattern and "\\x2F" not in pattern
