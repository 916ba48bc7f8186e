"""Quality rules decided per host: document rules, shrunk host rates, verdicts joined back.

Rules of a document are computed from its whole text. Failures are added up per
host (``source``), each host's rate is shrunk by a beta prior that is estimated
from all hosts by the method of moments, and the host's rate beside the prior's
mean decides how strictly its documents are judged: a document is kept if it
passes the base rules and the strict rules, whose limits are wider on hosts that
fail less often than the mean, up to twice as wide.

Nulls and empty texts have no words and fail. A null host is a host of its own.
Empty table: empty result. Repeated rows count and are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import textscan as ts
from marginalia.llm.common import join_small, materialise, ship_package, table, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
# Strict rules: symbols per word, repeated lines, word length. Hosts that fail less often than the prior's mean get wider limits.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINES = 0.3
MEAN_WORD = (2.0, 15.0)
WIDEST = 2.0
# A host is reported as bad above this rate.
HOST_LIMIT = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def _duplicates(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, key) pairs: whether the pair is not the first of its kind, and whether it occurs more than once."""
    joint = ts.mix(keys ^ ts.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(joint, kind="stable")
    again = np.zeros(len(joint), bool)
    same = joint[order][1:] == joint[order][:-1]
    again[1:] = same
    any_ = again.copy()
    any_[:-1] |= same
    later, repeated = np.zeros(len(joint), bool), np.zeros(len(joint), bool)
    later[order], repeated[order] = again, any_
    return later, repeated


def count_rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a chunk of texts."""
    n = len(offsets) - 1
    inside = ts.NOT_WHITE[data]
    starts, ends = ts.runs(inside, offsets)
    rows = ts.owner(starts, offsets)
    out = {"n_words": np.bincount(rows, minlength=n)}
    totals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside & ((data & 0xC0) != 0x80), out=totals[1:])
    out["word_chars"] = totals[offsets[1:]] - totals[offsets[:-1]]
    at = np.flatnonzero(_IS_SYMBOL[data])
    out["n_symbols"] = np.bincount(ts.owner(at, offsets), minlength=n)
    words = ts.span_hashes(data, starts, ends)

    breaks = np.flatnonzero(data == 0x0A)
    first = np.union1d(breaks + 1, offsets[:-1][np.diff(offsets) > 0])
    first = first[first < len(data)]
    stop = np.append(first[1:], len(data))
    # A line ends before its newline, or where the row ends.
    stop = np.where((stop > 0) & (data[np.maximum(stop - 1, 0)] == 0x0A) & (stop > first), stop - 1, stop)
    filled = np.searchsorted(starts, stop) > np.searchsorted(starts, first)
    first, stop = first[filled], stop[filled]
    owners = ts.owner(first, offsets)
    out["n_lines"] = np.bincount(owners, minlength=n)
    later, _ = _duplicates(ts.span_hashes(data, first, stop), owners)
    out["n_dup_lines"] = _per_row(later, owners, n)

    grams, at = ts.window_hashes(words, rows, 3)
    covered = np.zeros(len(words), bool)
    if len(grams):
        _, repeated = _duplicates(grams, rows[at])
        hit = at[repeated]
        for i in range(3):
            covered[hit + i] = True
    out["n_repeat_words"] = _per_row(covered, rows, n)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with the counts of the rules; texts are read once, in Arrow batches."""
    ship_package(docs.sparkSession)
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_of().alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in ts.text_chunks(batch.column(2)):
                counts = count_rules(data, offsets)
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)]
                columns += [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", *COUNTS])

    return narrow.mapInArrow(run, f"doc_id {id_type}, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def strict_failed(width: Column | float = 1.0) -> Column:
    """Whether a strict rule fails; ``width`` stretches the limits."""
    width = F.lit(width) if isinstance(width, float) else width
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    return (
        (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * width * words)
        | (F.col("n_dup_lines") > MAX_DUP_LINES * width * F.greatest(F.col("n_lines"), F.lit(1)))
        | (mean < MEAN_WORD[0] / width)
        | (mean > MEAN_WORD[1] * width)
    )


def host_verdicts(flagged: DataFrame) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and the width of the strict limits.

    ``flagged`` has source and failed (boolean). The prior beta(a, b) has the
    mean of the host rates and their variance beyond sampling noise, with a + b
    between 1 and 1000; a host with few documents is drawn to that mean. The
    prior is one row, computed from one row per host. A host that fails as often
    as the mean, or more often, has the strict limits themselves; the limits
    of a better one are wider by the ratio, up to twice as wide.
    """
    hosts = flagged.groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(
        F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_docs")).alias("u")
    )
    m = F.least(F.greatest(F.col("m"), F.lit(1e-6)), F.lit(1 - 1e-6))
    spread = F.greatest(F.col("v") - m * (1 - m) * F.col("u"), F.lit(1e-9))
    strength = F.least(F.greatest(m * (1 - m) / spread - 1, F.lit(1.0)), F.lit(1000.0))
    prior = moments.select((m * strength).alias("__a"), strength.alias("__s"))
    # The prior is a single aggregate row: this join adds two constants.
    shrunk = hosts.join(F.broadcast(prior), F.lit(True))
    host_rate = (F.col("host_failed") + F.col("__a")) / (F.col("host_docs") + F.col("__s"))
    width = F.least(F.greatest(F.col("__a") / F.col("__s") / host_rate, F.lit(1.0)), F.lit(WIDEST))
    return shrunk.select("source", "host_docs", "host_failed", host_rate.alias("host_rate"), width.alias("host_width"), (host_rate > HOST_LIMIT).alias("host_bad"))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    counts = materialise(measure(docs), "rules")
    flags = counts.withColumn("base_failed", base_failed()).withColumn("strict_failed", strict_failed())
    hosts = host_verdicts(flags.select("source", (F.col("base_failed") | F.col("strict_failed")).alias("failed")))
    joined = join_small(flags, hosts.select("source", "host_rate", "host_width"), ["source"])
    kept = ~F.col("base_failed") & ~strict_failed(F.col("host_width"))
    return joined.withColumn("kept", kept)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))
