"""Language identification with bit-sliced Bloom filters of character n-grams.

Every position of the filter holds a word with one bit per language. Adding an
n-gram of a language sets that language's bit at each of its positions; the
bitwise AND of an n-gram's positions has the bits of all languages that contain
it, found with one look-up for all languages. A text's n-grams are looked up,
set bits are counted per language, the counts are corrected for the filter's
measured false positives of each language, and the largest share decides.

Learning uses at most ``SAMPLE_DOCS`` documents of each language, the first in
the order of a hash of the id, with their whole texts; n-gram counts come from a
distributed aggregate. Prediction reads every text whole.

Null texts and texts without a letter are ``und`` with score 0. If no n-gram is
known, the language with most training documents is predicted with score 0.
Ties go to the language that comes first by code point. Without training rows
every text is ``und``. Repeated rows are predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm import textscan as ts
from marginalia.llm.common import PIECE_BYTES, bounded_batches, first_by_hash, is_held_out, materialise, row_hash, ship_package, table

SAMPLE_DOCS = 4000
SIZES = (3, 4, 5)
# At most so many n-grams of a language and size enter the filter, the most frequent ones.
GRAMS_PER_LANGUAGE = 30_000
MIN_COUNT = 2
# A language contains an n-gram if its share there is at least this part of the largest share.
SHARE = 0.2
HASHES = 3
BITS_PER_GRAM = 16
MODULUS, REMAINDER = 4, 2
LETTER = r"\p{L}"

# Bytes of letters: ASCII letters (texts come in lower case) and all beyond ASCII; the rest is a space.
_CODES = np.full(256, 0x20, np.uint8)
_CODES[0x61:0x7B] = np.arange(0x61, 0x7B)
_CODES[0x80:] = np.arange(0x80, 0x100)


def gram_values(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``size`` bytes as integers, and their rows; none reaches over a row or holds an inner space."""
    letters = _CODES[data]
    n = len(letters) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    space = letters == 0x20
    good = np.ones(n, bool)
    for i in range(size):
        value = (value << np.uint64(8)) | letters[i : i + n].astype(np.uint64)
        if 0 < i < size - 1:
            good &= ~space[i : i + n]
    good &= ~(space[:n] & space[size - 1 :]) if size < 3 else True
    cut = offsets[1:-1]
    for i in range(1, size):
        at = cut - i
        good[at[(at >= 0) & (at < n)]] = False
    kept = np.flatnonzero(good)
    return value[kept] | np.uint64(size << 56), ts.owner(kept, offsets)


@dataclass
class Filter:
    """Words of language bits. ``slices`` has one array for every 64 languages; up to 32 languages take shorter words."""

    languages: list[str]
    common: int
    bits: int
    slices: list[np.ndarray]
    false_rate: np.ndarray

    def positions(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        hashed = ts.mix(grams)
        step = (hashed >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield (hashed + np.uint64(i) * step) & np.uint64((1 << self.bits) - 1)

    def add(self, language: int, grams: np.ndarray) -> None:
        words = self.slices[language // 64]
        for at in self.positions(grams):
            np.bitwise_or.at(words, at, words.dtype.type(1 << (language % 64)))

    def lookup(self, grams: np.ndarray) -> list[np.ndarray]:
        """For each slice, the bits of the languages that contain each n-gram."""
        found = None
        for at in self.positions(grams):
            got = [words[at] for words in self.slices]
            found = got if found is None else [a & b for a, b in zip(found, got, strict=True)]
        return found

    def measure_false_positives(self) -> None:
        """Share of n-grams outside all languages that the filter reports for each one."""
        probes = np.random.default_rng(7).integers(1 << 60, 1 << 63, 200_000, dtype=np.uint64)
        counts = self.popcounts(probes, np.zeros(len(probes), np.int64), 1)[0]
        self.false_rate = counts / len(probes)

    def popcounts(self, grams: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Per row and language, the number of n-grams whose bit is set."""
        out = np.zeros((n, len(self.languages)))
        for s, words in enumerate(self.lookup(grams)):
            seen = np.flatnonzero(words)
            words, at = words[seen], rows[seen]
            for j in range(min(64, len(self.languages) - 64 * s)):
                out[:, 64 * s + j] = np.bincount(at, (words >> words.dtype.type(j)) & words.dtype.type(1), n)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row."""
        n = len(offsets) - 1
        counts, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for size in SIZES:
            grams, rows = gram_values(data, offsets, size)
            if len(grams):
                counts += self.popcounts(grams, rows, n)
                total += np.bincount(rows, minlength=n)
        right = np.maximum(counts - total[:, None] * self.false_rate, 0) / (1 - self.false_rate)
        best = right.argmax(1)
        top = right[np.arange(n), best]
        best[top == 0] = self.common
        second = np.partition(right, -2, axis=1)[:, -2] if right.shape[1] > 1 else np.zeros(n)
        return best, np.where(top > 0, top / np.maximum(top + second, 1e-12), 0.0)


def word_type(languages: int) -> type:
    """The shortest word with a bit for each language, 64 bits at most."""
    return next((kind for bits, kind in ((8, np.uint8), (16, np.uint16), (32, np.uint32)) if languages <= bits), np.uint64)


def learn(training: DataFrame, text: str = "text", lang: str = "lang") -> Filter | None:
    """Fit the filter. ``training`` has doc_id, text and lang."""
    spark = training.sparkSession
    ship_package(spark)
    bounded_batches(spark)
    rows = training.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), row_hash("doc_id").alias("__h"), F.crc32(F.col(text).cast("binary")).alias("__t"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes, key=lambda x: x.encode())
    index = {x: i for i, x in enumerate(languages)}
    sample = first_by_hash(rows, "lang", sizes, SAMPLE_DOCS).select("lang", "text")
    # The rank leaves one task per language; deal the sampled texts out again.
    sample = sample.repartition(max(spark.sparkContext.defaultParallelism, 4))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, data, offsets in ts.text_chunks(pc.utf8_lower(batch.column(1)), PIECE_BYTES):
                for size in SIZES:
                    grams, at = gram_values(data, offsets, size)
                    who = owners[lo:hi][at]
                    for k in np.unique(who):
                        value, n = np.unique(grams[who == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(value), k, np.int32)), pa.array(np.full(len(value), size, np.int32)), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))],
                            ["k", "size", "gram", "n"],
                        )

    counts = sample.mapInArrow(count, "k int, size int, gram bigint, n bigint").groupBy("k", "size", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter(F.col("n") >= MIN_COUNT), "grams")
    totals = counts.groupBy("k", "size").agg(F.sum("n").alias("t"))
    shares = counts.join(F.broadcast(totals), ["k", "size"]).withColumn("share", F.col("n") / F.col("t"))
    best = shares.groupBy("size", "gram").agg(F.max("share").alias("best"))
    known = shares.join(best, ["size", "gram"]).filter(F.col("share") >= SHARE * F.col("best"))
    by_count = W.partitionBy("k", "size").orderBy(F.desc("n"), "gram")
    chosen = known.withColumn("__rank", F.row_number().over(by_count)).filter(F.col("__rank") <= GRAMS_PER_LANGUAGE).select("k", "gram")
    # Bounded by languages x sizes x GRAMS_PER_LANGUAGE, whatever the input.
    found: pd.DataFrame = chosen.toPandas()
    distinct = max(1, found["gram"].nunique())
    bits = max(10, int(np.ceil(np.log2(distinct * BITS_PER_GRAM))))
    common = index[max(languages, key=lambda x: (sizes[x], -index[x]))]
    made = Filter(languages, common, bits, [np.zeros(1 << bits, word_type(len(languages))) for _ in range((len(languages) + 63) // 64)], np.zeros(len(languages)))
    for k, part in found.groupby("k"):
        made.add(int(k), part["gram"].to_numpy(np.int64).view(np.uint64))
    made.measure_false_positives()
    return made


def identify(docs: DataFrame, model: Filter | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with lang_pred and score for every row."""
    spark = docs.sparkSession
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*[F.col(c) for c in keep], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    ship_package(spark)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    # The text crosses to Python once: with the kept columns if it is one of them.
    kept = [F.col(c) for c in keep]
    where = keep.index("text") if "text" in keep and dict(docs.dtypes)["text"] == "string" else len(keep) + 1
    narrow = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(LETTER).alias("__letter"), *([] if where < len(keep) else [F.col("text").cast("string").alias("__text")]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[: len(keep)])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool: Filter = shared.value
        names = pa.array([*tool.languages, "und"])
        for batch in batches:
            for lo, hi, data, offsets in ts.text_chunks(pc.utf8_lower(batch.column(where)), PIECE_BYTES):
                best, score = tool.predict(data, offsets)
                letters = batch.column(at).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                best = np.where(letters, best, len(tool.languages))
                score = np.where(letters, score, 0.0)
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*columns, names.take(pa.array(best)), pa.array(score)], [*keep, "lang_pred", "score"])

    return narrow.mapInArrow(run, (schema + ", " if schema else "") + "lang_pred string, score double")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~is_held_out("doc_id", MODULUS, REMAINDER)).select("doc_id", "text", "lang")


def keep_known(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Documents in a learned language, with ``lang`` set to the prediction; ``und`` documents go."""
    predicted = identify(docs, learn(training), [*docs.columns])
    known = predicted.filter("lang_pred <> 'und'")
    return known.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(training_rows(docs))
    return identify(docs.withColumn("held_out", is_held_out("doc_id", MODULUS, REMAINDER)), model, ["doc_id", "held_out"])
