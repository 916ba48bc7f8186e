"""Benchmark decontamination by winnowed fingerprints, with exact extension.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with
A-Z lower-cased. A text of ``WINDOW`` words or more is fingerprinted: of every
``SPAN`` consecutive runs of ``GRAM`` words the one with the smallest hash is
kept (the leftmost of equal ones). ``SPAN + GRAM - 1 = WINDOW``, so any shared
stretch of ``WINDOW`` words holds a fingerprint that both texts keep. Documents
whose fingerprints meet the benchmark's are read again, and every hit is
extended: the windows that reach over the hit run of words are compared, word
for word, with the windows of the items. Items shorter than a window are one
window of their own length and meet all runs of that length.

Groups stay linear: a fingerprint is tested for membership only, a document
window meets at most one distinct benchmark window, copies of a text are
extended once, and the items of a set of windows are gathered once for all
texts that hold the same set.

Null and empty texts have no words: zero counts, the hash of the empty string,
not contaminated. Repeated documents get a row each; a repeated item_id is one
item with the windows of all its texts; a null item_id is an item with an empty
name. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import BROADCAST_ROWS, join_small, materialise, table, text_of

WINDOW, GRAM = 10, 5
# Fingerprints (one long each) up to this number are broadcast, some 64 MB; more are joined by a shuffle.
BROADCAST_PRINTS = 2_000_000
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Characters of words, one by one: Java looks single ones up in a table, and tests ranges and complements one after the other.
BEYOND_ASCII = r"\x{80}-\x{10FFFF}"
WORD = f"[{LOWER}{DIGITS}{BEYOND_ASCII}]+"
# The same words in a text whose capital letters still stand.
RAW_WORD = f"[{LOWER}{UPPER}{DIGITS}{BEYOND_ASCII}]+"
# A fingerprint is packed with its place: no text has more than 2^30 words.
PLACE_BITS = 30


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def text_key() -> list[Column]:
    """Two hashes that stand for a text."""
    return [F.xxhash64(text_of()).alias("t1"), F.crc32(text_of().cast("binary")).alias("t2")]


def hashed_words(text: Column) -> Column:
    """A hash of each word. Words are lower-cased one by one, which keeps words equal that are equal with A-Z lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def winnowed(df: DataFrame, hashes: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add ``prints``: the selected (hash, place) of each row, packed into longs; empty below ``window`` words."""
    span = window - gram + 1

    def packed(x: Column, i: Column) -> Column:
        grams = F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, gram)])
        return F.shiftleft(grams, PLACE_BITS).bitwiseOR(i.cast("long"))

    enough = F.size(hashes) >= window
    df = df.withColumn("__grams", F.when(enough, F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - (gram - 1)), packed)))
    least = F.transform(F.slice("__grams", F.lit(1), F.size("__grams") - (span - 1)), lambda x, i: F.least(x, *[F.get("__grams", i + j) for j in range(1, span)]))
    chosen = F.when(F.col("__grams").isNotNull(), F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("prints", chosen).drop("__grams")


def runs_of_words(hashes: str, n: int) -> Column:
    """A hash of every n consecutive words."""
    return F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - (n - 1)), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, n)]))


def print_of(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def place_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, wid, length, window): every different window of every item."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_of()).alias("ws")).filter(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("ws") - length + 1)
    flat = words.select("item", length.alias("length"), F.explode(F.transform(starts, lambda s: F.array_join(F.slice("ws", s, length), " "))).alias("window"))
    return flat.distinct().withColumn("wid", F.md5("window"))


def _meeting(docs: DataFrame, benchmark: DataFrame, windows: DataFrame, window: int, gram: int) -> DataFrame:
    """(t1, t2, rep, starts): texts with windows to compare, and where those (start, length) begin; rep is one document of the text."""
    # The outer form of explode: the inner one would have Spark test the array's size on the inlined expression first.
    keyed = docs.select("doc_id", *text_key(), hashed_words(text_of()).alias("__hs"))
    prints = winnowed(benchmark.select(hashed_words(text_of()).alias("__hs")), "__hs", window, gram)
    prints = materialise(prints.select(F.explode_outer("prints").alias("p")).select(print_of(F.col("p")).alias("print")).filter("print IS NOT NULL").distinct(), "prints")
    small = F.broadcast(prints) if prints.count() <= BROADCAST_PRINTS else prints
    flat = winnowed(keyed, "__hs", window, gram).select("doc_id", "t1", "t2", F.explode_outer("prints").alias("p"))
    flat = flat.select("doc_id", "t1", "t2", print_of(F.col("p")).alias("print"), place_of(F.col("p")).alias("at"))
    met = flat.join(small, "print", "left_semi").select("doc_id", "t1", "t2", "at", F.lit(window).alias("length"))
    # Items shorter than a window: at most window - 1 different lengths.
    short = materialise(windows.filter(F.col("length") < window).select("length", F.split("window", " ").alias("ws")).distinct(), "short")
    for n in sorted(r["length"] for r in short.select("length").distinct().collect()):
        wanted = short.filter(F.col("length") == n).select(F.xxhash64(*[F.xxhash64(F.lower(F.get("ws", F.lit(j)))) for j in range(n)]).alias("print")).distinct()
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_PRINTS else wanted
        runs = keyed.filter(F.size("__hs") >= n).select("doc_id", "t1", "t2", F.posexplode_outer(runs_of_words("__hs", n)).alias("at", "print"))
        met = met.union(runs.join(wanted, "print", "left_semi").select("doc_id", "t1", "t2", "at", F.lit(n).alias("length")))
    return materialise(met.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.collect_set(F.struct("at", "length")).alias("places")), "met")


def hit_windows(docs: DataFrame, benchmark: DataFrame, windows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(t1, t2, start, length, wid): every place of a document text where a benchmark window stands."""
    met = _meeting(docs, benchmark, windows, window, gram)
    one = docs.select("doc_id", *text_key(), text_of().alias("__text"))
    sides = met.select(F.col("t1").alias("__m1"), F.col("t2").alias("__m2"), "rep", "places")
    sides = F.broadcast(sides) if met.count() <= BROADCAST_ROWS and _bytes(met) <= 64 << 20 else sides
    test = (F.col("t1") == F.col("__m1")) & (F.col("t2") == F.col("__m2")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    found = one.join(sides, test).select("t1", "t2", "places", words_of(F.col("__text")).alias("ws"))
    # A hit run of GRAM words is extended to the windows that reach over it.
    back = window - gram

    def reach(p: Column) -> Column:
        first = F.when(p["length"] == window, F.greatest(p["at"] - back, F.lit(0))).otherwise(p["at"])
        last = F.when(p["length"] == window, F.least(p["at"], F.size("ws") - window)).otherwise(p["at"])
        return F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("start"), p["length"].alias("length")))

    starts = F.array_distinct(F.flatten(F.transform("places", reach)))
    texts = found.select("t1", "t2", F.explode_outer(F.transform(starts, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), F.array_join(F.slice("ws", s["start"] + 1, s["length"]), " ").alias("window")))).alias("s"))
    texts = texts.select("t1", "t2", "s.start", "s.length", "s.window")
    known = windows.select("window", "wid").distinct()
    return materialise(join_small(texts, known, ["window"]).select("t1", "t2", "start", "length", "wid"), "hits")


def _bytes(places: DataFrame) -> int:
    """Bytes of the listed places, some eight each."""
    return (places.agg(F.sum(F.size("places"))).first()[0] or 0) * 8


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = materialise(item_windows(benchmark, window), "windows")
    hits = hit_windows(docs, benchmark, windows, window, gram)
    before = W.partitionBy("t1", "t2").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    covered = hits.withColumn("__end", F.col("start") + F.col("length"))
    fresh = F.col("__end") - F.greatest(F.col("start"), F.coalesce(F.max("__end").over(before), F.lit(0)))
    counted = covered.withColumn("__new", F.greatest(fresh, F.lit(0)))
    texts = counted.groupBy("t1", "t2").agg(F.sum("__new").alias("n_hit"), F.sort_array(F.collect_set("wid")).alias("wids"))
    texts = materialise(texts.withColumn("set_id", F.sha2(F.array_join("wids", ","), 256)), "texts")
    sets = texts.groupBy("set_id").agg(F.first("wids").alias("wids")).select("set_id", F.explode("wids").alias("wid"))
    listed = join_small(sets, windows.select("wid", "item"), ["wid"]).groupBy("set_id").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = listed.select("set_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    facts = materialise(texts.drop("wids").join(named, "set_id").drop("set_id"), "facts")
    rows = docs.select("doc_id", *text_key(), F.regexp_count(text_of(), F.lit(RAW_WORD)).cast("long").alias("n_words"))
    joined = join_small(rows, facts, ["t1", "t2"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
