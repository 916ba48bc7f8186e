"""Toxicity by compression distance: one zstandard dictionary per class, compared window by window.

A window is a word with its borders, written as UTF-16 so that short words are
long enough to match, behind a fixed pad that both dictionaries hold. Its score
is the compressed length with the dictionary of ordinary text minus the length
with the dictionary of toxic text. A document is described by how many of its
different words reach each of several length differences, once for all words
and once for those that the toxic dictionary holds whole; a logistic model
calibrates these counts into a probability with the threshold 0.5.

The dictionaries are trained on labelled text: ordinary words by frequency, and
those words of toxic documents that hold a character n-gram which toxic
documents have significantly more often (likelihood ratio above ``MIN_RATIO``).
Learning uses at most ``SAMPLE_DOCS`` labelled documents of each class, the
first by a hash of the id, with their whole texts. Scoring reads every text
whole.

Null and empty texts get the score of a text without windows. With one class
missing, every score is the share of toxic labels in training (0 without any).
Repeated rows are scored one by one; rows with several labels count once each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import first_by_hash, is_held_out, materialise, row_hash, ship_package, table, text_of

SAMPLE_DOCS = 6000
MODULUS, REMAINDER = 5, 0
GRAMS = (4, 5, 6)
MIN_RATIO = 20.0
TOXIC_BYTES, ORDINARY_BYTES = 16_384, 65_536
LEVELS = (3, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20)
PAD = b"~" * 8 + b"^" * 8
RIDGE = 0.1
CACHE_WORDS = 1_000_000
CHUNK_ROWS = 256
WORD = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    """All words of a text, in lower case."""
    return WORD.findall(text.lower())


def framed(word: str) -> bytes:
    return f" {word} ".encode("utf-16-le", "surrogatepass")


def grams_of(word: str) -> set[str]:
    w = f" {word} "
    return {w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)}


class Meter:
    """Length difference of windows under two dictionaries, with a cache per process."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as zstd

        def compressor(content: bytes):
            known = zstd.ZstdCompressionDict(PAD + content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            how = zstd.ZstdCompressionParameters.from_level(
                12, dict_size=ORDINARY_BYTES, source_size=64, min_match=4, strategy=zstd.STRATEGY_BTLAZY2, search_log=5, target_length=32,
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            known.precompute_compress(compression_params=how)
            return zstd.ZstdCompressor(dict_data=known, compression_params=how)

        self._toxic, self._ordinary = compressor(toxic), compressor(ordinary)
        held = toxic.decode("utf-16-le", "ignore")
        # The toxic dictionary can save something only with a match of several characters.
        self._starts = {held[i : i + 3] for i in range(len(held) - 2)}
        self._cache: dict[str, tuple[int, bool]] = {}
        # Most words of the dictionary are one match, so their middle length tells what one match takes.
        self._least = int(np.median([len(self._toxic.compress(PAD + framed(w))) for w in held.split()] or [0]))

    def difference(self, word: str) -> tuple[int, bool]:
        """The length difference of a window, and whether the toxic dictionary holds it whole (one match)."""
        value = self._cache.get(word)
        if value is None:
            w, starts = f" {word} ", self._starts
            value = 0, False
            if any(w[i : i + 3] in starts for i in range(len(w) - 2)):
                window = PAD + framed(word)
                length = len(self._toxic.compress(window))
                value = len(self._ordinary.compress(window)) - length, length <= self._least
            if len(self._cache) >= CACHE_WORDS:
                self._cache.clear()
            self._cache[word] = value
        return value

    def features(self, text: str) -> list[float]:
        words = set(windows(text))
        found = [v for v in map(self.difference, words) if v[0] >= LEVELS[0]]
        part = np.array([d for d, _ in found], np.int64)
        whole = np.array([d for d, w in found if w], np.int64)
        out = [float(np.log1p((x >= k).sum())) for x in (part, whole) for k in LEVELS]
        return [*out, float(np.log1p(len(words))), float(part.max(initial=0)), float(whole.max(initial=0))]


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    constant: float | None = None
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def scores(self, meter: Meter | None, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = (np.array([meter.features(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        z = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


_meters: dict[tuple[int, int], Meter] = {}


def meter_of(model: Model) -> Meter | None:
    if model.constant is not None:
        return None
    key = (hash(model.toxic), hash(model.ordinary))
    if key not in _meters:
        _meters.clear()
        _meters[key] = Meter(model.toxic, model.ordinary)
    return _meters[key]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        gradient = z.T @ (p - y) + RIDGE * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w, mean, scale


def choose_words(words: DataFrame, grams: DataFrame, n_toxic: int, n_ordinary: int) -> tuple[list[str], list[str]]:
    """Words for the toxic and the ordinary dictionary, rarest first (late content is cheaper to reach).

    ``words`` and ``grams`` count documents per class in columns t and o. Both
    results are bounded by the dictionary sizes.
    """
    n = F.col("t") + F.col("o")
    expected = n * (n_toxic / (n_toxic + n_ordinary))
    ratio = 2 * (F.col("t") * F.log(F.col("t") / expected) + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / (n - expected))).otherwise(0.0))
    marked = grams.filter((F.col("t") >= 2) & (F.col("t") * float(n_ordinary) > F.col("o") * (2.0 * n_toxic))).select("gram", ratio.alias("ratio")).filter(F.col("ratio") > MIN_RATIO)
    rare = words.filter((F.col("t") > 0) & (F.col("o") * (2.0 * n_toxic) <= F.col("t") * float(n_ordinary)))

    def cuts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substring("w", i, F.lit(n)))

    spread = F.flatten(F.array(*map(cuts, GRAMS)))
    held = rare.withColumn("w", F.concat(F.lit(" "), "word", F.lit(" "))).select("word", "t", F.explode(spread).alias("gram"))
    weight = held.join(marked, "gram").groupBy("word").agg((F.first("t") * F.max("ratio")).alias("weight"))
    toxic = [r["word"] for r in weight.orderBy(F.desc("weight"), "word").limit(TOXIC_BYTES // 6).collect()]
    common = [r["word"] for r in words.filter("o > 0").orderBy(F.desc("o"), "word").limit(ORDINARY_BYTES // 6).collect()]
    return toxic, common


def _content(words: list[str], size: int) -> bytes:
    """The words from the least to the most important one, at most ``size`` bytes."""
    out, used = [], 0
    for w in words:
        one = framed(w)
        if used + len(one) > size:
            break
        out.append(one)
        used += len(one)
    return b"".join(reversed(out))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on documents (doc_id, text) whose labels (doc_id, toxic 0 or 1) are given.

    The sample is chosen among ids alone; at most 2 * SAMPLE_DOCS ids are then
    sent to the texts, so no text is shuffled but those of the sample.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.filter(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    ids = docs.select("doc_id").distinct().join(known, "doc_id").select("doc_id", "y", row_hash("doc_id").alias("__h"), F.lit(0).alias("__t"))
    per_class = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = first_by_hash(ids, "y", per_class, SAMPLE_DOCS).select("doc_id", "y")
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")
    sample = materialise(sample.repartition(max(spark.sparkContext.defaultParallelism, 4)), "toxic-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(constant=float(1 in sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t: dict[tuple[bool, str], list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(windows(text))
                grams = set().union(*map(grams_of, words)) if words else set()
                for kind, values in ((True, words), (False, grams)):
                    for v in values:
                        t.setdefault((kind, v), [0, 0])[y] += 1
            keys = list(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.bool_()), pa.array([v for _, v in keys], pa.string()), pa.array([t[k][1] for k in keys], pa.int64()), pa.array([t[k][0] for k in keys], pa.int64())],
                ["is_word", "value", "t", "o"],
            )

    counts = sample.mapInArrow(count, "is_word boolean, value string, t bigint, o bigint").groupBy("is_word", "value").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    counts = materialise(counts, "toxic-counts")
    words = counts.filter("is_word").select(F.col("value").alias("word"), "t", "o")
    grams = counts.filter("NOT is_word").select(F.col("value").alias("gram"), "t", "o")
    toxic, common = choose_words(words, grams, sizes[1], sizes[0])
    if not toxic:
        return Model(constant=sizes[1] / (sizes[0] + sizes[1]))
    model = Model(_content(toxic, TOXIC_BYTES), _content(common, ORDINARY_BYTES))
    shared = spark.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = meter_of(shared.value)
        for batch in batches:
            x = [meter.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    # At most 2 * SAMPLE_DOCS rows of a few numbers.
    found = sample.mapInArrow(describe, "y int, x array<double>").toPandas()
    x, y = np.array(found["x"].tolist()), found["y"].to_numpy(float)
    order = np.lexsort([*x.T, y])
    w, mean, scale = _logistic(x[order], y[order])
    model.weights, model.mean, model.scale = w.tolist(), mean.tolist(), scale.tolist()
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with score and predicted for every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("score", "predicted")]
    narrow = docs.select(*[F.col(c) for c in keep], text_of().alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = meter_of(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(lo, CHUNK_ROWS)
                p = shared.value.scores(meter, batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return narrow.mapInArrow(run, (schema + ", " if schema else "") + "score double, predicted int")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~is_held_out("doc_id", MODULUS, REMAINDER)).select("doc_id", "text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(training_rows(docs), table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", is_held_out("doc_id", MODULUS, REMAINDER)), model, ["doc_id", "held_out"])
