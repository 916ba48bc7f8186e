"""I-Match fingerprints with several randomised lexicons, all in DataFrame functions.

Terms are runs of ASCII letters (lower-cased), digits and characters beyond
ASCII, held as 64-bit hashes. The lexicon keeps the terms whose document
frequency lies in a band, so neither noise nor common words count. Every lexicon
term belongs to random subsets; subset j takes a share 2**-(3 + j mod 8) of the
terms, so that short and long texts both have subsets with a few of their terms.
A fingerprint is the list of hashes of a text's distinct terms of each subset,
sorted. Likeness is the share of equal entries among those that are not empty
in both.

A band from a share x of all documents holds at most (mean distinct terms) / x
terms, whatever the number of documents, so the lexicon can be broadcast; its
size is counted first, and beyond the limit the join shuffles.

Null texts are empty texts. A text without a lexicon term (and an empty text)
has the fingerprint of its own distinct terms in every entry. Ties in doc_id are
ordered by a hash of the text, null ids come last. The only document is its own
next document. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import join_small, materialise, table, text_of

SUBSETS = 24
SCALES, DENSEST = 8, 3
# Document frequency band, as shares of all documents; a term of the lexicon is in two documents at least.
LOW, HIGH = 0.0005, 0.2
LEXICON_ROWS = 1_000_000
BUCKET_ROWS = 2_000
COARSE = 128
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text as 64-bit hashes."""
    words = F.array_remove(F.split(F.lower(text), _SEPARATORS), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, rows: int) -> DataFrame:
    """(term, mask): the terms inside the band with one bit for each subset that holds them."""
    counts = docs.select(F.explode(term_hashes(text_of())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter((F.col("df") >= max(2.0, LOW * rows)) & (F.col("df") <= HIGH * max(rows, 10)))
    mask = F.lit(0)
    for j in range(SUBSETS):
        inside = F.shiftrightunsigned(F.xxhash64("term", F.lit(j)), 64 - SCALES - DENSEST) < (1 << (SCALES - j % SCALES))
        mask = mask.bitwiseOR(F.when(inside, F.lit(1 << j)).otherwise(F.lit(0)))
    return materialise(band.select("term", mask.cast("int").alias("mask")), "lexicon")


def in_order(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id and text with a bucket of the id order and ``next_text``, the text of the next document.

    Buckets are cut by quantiles of the id and evenly inside them, so no task
    orders more than a bucket. Each bucket gets one extra row, the first
    document of the next bucket, which closes it.
    """
    base = docs.select("doc_id", text_of().alias("text")).withColumn("__h", F.xxhash64("text"))
    shares = [i / COARSE for i in range(1, COARSE)]
    found = base.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()
    low = found["lo"] if found["lo"] is not None else 0
    bounds = sorted({low, *(found["q"] or [])}) + [(found["hi"] if found["hi"] is not None else 0) + 1]
    fine = max(1, rows // (COARSE * BUCKET_ROWS))
    edges = F.array(*[F.lit(b).cast("double") for b in bounds])
    place = F.greatest(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))), F.lit(1))
    a, b = F.element_at(edges, place), F.element_at(edges, F.least(place + 1, F.size(edges)))
    inner = F.least(F.floor((F.col("doc_id") - a) / F.greatest(b - a, F.lit(1.0)) * fine), F.lit(fine - 1))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(1 << 40) + F.shiftright("__h", 58)).otherwise(place * fine + inner).cast("long")
    base = base.withColumn("__bucket", bucket)
    key = F.struct(F.col("doc_id"), F.col("__h"))
    firsts = materialise(base.groupBy("__bucket").agg(F.min(key).alias("k")), "firsts")
    # One row per bucket: rows / BUCKET_ROWS of them.
    follow = firsts.withColumn("__to", F.lag("__bucket").over(W.orderBy("__bucket")))
    wrap = F.max("__bucket").over(W.partitionBy())
    follow = follow.withColumn("__to", F.coalesce("__to", wrap)).select(F.col("k.doc_id").alias("id"), F.col("k.__h").alias("h"), "__to")
    follow = materialise(follow, "follow")
    small = F.broadcast(follow) if follow.count() <= 100_000 else follow
    closing = base.join(small, base["doc_id"].eqNullSafe(small["id"]) & (base["__h"] == small["h"])).select("doc_id", "text", "__h", F.col("__to").alias("__bucket")).dropDuplicates(["__bucket"])
    both = base.withColumn("__end", F.lit(0)).unionByName(closing.withColumn("__end", F.lit(1)))
    order = W.partitionBy("__bucket").orderBy("__end", "doc_id", "__h")
    led = both.withColumn("next_text", F.lead("text").over(order)).withColumn("__row", F.row_number().over(order))
    return led.filter("__end = 0").drop("__end", "__h")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by the beginning of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint(terms: Column, present: Column, own: Column) -> Column:
    """Entries of a sorted array of (term, mask); ``own`` stands in where no lexicon term is present.

    One nested transform over the subsets: an expression for each subset would
    be compiled into one method of thousands of lines.
    """
    subsets = F.array(*[F.lit(1 << j) for j in range(SUBSETS)])
    parts = F.transform(subsets, lambda bit: F.transform(F.filter(terms, lambda t: t["mask"].bitwiseAND(bit) != 0), lambda t: t["term"]))
    entries = F.transform(parts, lambda part: F.when(F.size(part) > 0, _code(part)).otherwise(F.lit("-")))
    return F.when(present, F.array_join(entries, ",")).otherwise(own)


def _code(part: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(part).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints among those not empty in both."""
    pairs = F.zip_with(F.split(a, ","), F.split(b, ","), lambda x, y: F.when((x == "-") & (y == "-"), F.lit(None)).otherwise((x == y).cast("int")))
    known = F.filter(pairs, lambda p: p.isNotNull())
    return F.when(F.size(known) == 0, F.lit(0.0)).otherwise(F.aggregate(known, F.lit(0), lambda s, p: s + p) / F.size(known))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, hash of its edited text, both fingerprints, and its place in the id order."""
    rows = docs.count()
    words = lexicon(docs, rows)
    size = words.count()
    changed = in_order(docs, rows).withColumn("__edited", edited(F.col("text"), F.col("next_text")))
    # Terms are columns of their own, so that each text is split once.
    split = changed.select("__bucket", "__row", "doc_id", F.length("text").alias("n_chars"), F.sha2("__edited", 256).alias("sha"), term_hashes(F.col("text")).alias("a"), term_hashes(F.col("__edited")).alias("b"))
    # Both texts share most terms: a term is one row, with a bit for each text that has it. The first row carries the facts.
    owns = [F.xxhash64(F.sort_array(c)).alias(f"own_{c}") for c in ("a", "b")]

    def items(terms: Column, bits: int) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(bits).alias("bits")))

    sides = [items(F.array_intersect("a", "b"), 3), items(F.array_except("a", "b"), 1), items(F.array_except("b", "a"), 2)]
    item = F.concat(F.array(F.struct(F.lit(None).cast("bigint").alias("term"), F.lit(0).alias("bits"))), *sides)
    facts = ["doc_id", "n_chars", "sha", "own_a", "own_b"]
    flat = split.select("__bucket", "__row", "doc_id", "n_chars", "sha", *owns, F.explode(item).alias("i"))
    flat = flat.select("__bucket", "__row", "i.term", "i.bits", *[F.when(F.col("i.bits") == 0, F.col(c)).alias(c) for c in facts])
    known = words.select(F.col("term").alias("__t"), "mask")
    known = F.broadcast(known) if size <= LEXICON_ROWS else known
    met = flat.join(known, flat["term"] == known["__t"], "left").filter("mask IS NOT NULL OR bits = 0")
    # Terms of no subset count as present and are not listed.
    listed = met.groupBy("__bucket", "__row").agg(
        F.sort_array(F.collect_list(F.when(F.col("mask") != 0, F.struct("term", "mask", "bits")))).alias("terms"), F.bit_or("bits").alias("present"), *[F.max(c).alias(c) for c in facts]
    )

    def has(bits: Column, bit: int) -> Column:
        return bits.bitwiseAND(F.lit(bit)) != 0

    def printed(side: str, bit: int) -> Column:
        own = F.array_join(F.array_repeat(F.concat(F.lit("x"), F.lower(F.hex(f"own_{side}"))), SUBSETS), ",")
        return fingerprint(F.filter("terms", lambda t: has(t["bits"], bit)), has(F.col("present"), bit), own)

    both = listed.select("__bucket", "__row", "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), printed("a", 1).alias("fingerprint"), printed("b", 2).alias("edited_fingerprint"))
    return materialise(both, "fingerprints")


def digest(docs: DataFrame) -> DataFrame:
    printed = fingerprints(docs)
    # Global place: rows of earlier buckets plus the place in the bucket. One small row per bucket.
    sizes = printed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = printed.count()
    placed = join_small(printed, starts, ["__bucket"]).withColumn("__at", F.col("__before") + F.col("__row") - 1)
    following = placed.select(F.pmod(F.col("__at") - 1, F.lit(max(rows, 1))).alias("__at"), F.col("fingerprint").alias("next_fingerprint"))
    joined = placed.join(following, "__at")
    return joined.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
