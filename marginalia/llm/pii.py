"""Personal data by weak supervision, in DataFrame functions only.

Spans of the four base kinds come from fixed patterns with a check. Further
candidates come from wider patterns (masked e-mail addresses, phone numbers
without a plus sign, IPv6 addresses). Five labelers vote -1, 0 or +1 on every
candidate and base match: strict pattern, usual shape, gazetteer (domains, card
issuers, calling codes, reserved networks), context words, and borders.
Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is for each kind. Its posteriors are the soft labels of a
final classifier, naive Bayes over features of the span. Wider candidates with a
probability of at least ``KEEP`` that overlap no base span are added.

All patterns run in linear time and without recursion on texts of any length:
runs start only at their first character (or where the last match ended), and
repeated groups have a fixed width or a bound (a domain has at most 127 labels).
Places, overlaps and replacements are found by running sums, so a text costs no
more than its length times the logarithm of its matches. Offsets are code points.

Null and empty texts have no spans. Repeated rows give repeated results. With
no candidates at all the classifier adds nothing. Empty table: empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.arrays import running
from marginalia.functions.text import let
from marginalia.llm.common import materialise, table, text_of

KINDS = ("email", "ip", "card", "phone")
KEEP = 0.9
STEPS = 25
BEFORE, AFTER = 40, 1
BLOCK = 512

# Fixed values of the base definition, written so that no text makes them slow:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+ (14 to 19 digits)              phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.\.))*(?<!\.)",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-])){12,}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++){1,126}",
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
# A cheap test that no text with a match of the kind fails.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{12}", "phone": r"\+[0-9]"}
WIDER_HINTS = {"email": r"[(\[]at[)\]]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:", "phone": r"[0-9]{3}[.-][0-9]{4}"}

# Gazetteers.
TOP_DOMAINS = "com org net edu gov io info biz de fr es uk eu it nl ch at ca us au".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 61 64 65 81 82 86 90 91".split()
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED = r"^(?:0|10|127|255|169\.254|192\.168)\."
CONTEXT = {
    "email": r"mail|contact|write to|reach",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|credit|payment|debit",
    "phone": r"phone|tel\b|call|fax|mobile|cell",
}
AGAINST = r"version|token|key|hash|isbn|order|sku|serial|build"

_SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,wider:boolean,hit:string,before:string,after:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(number)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The check of a base match."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = digits(hit)
        return F.length(n).between(14, 19) & F.when(F.length(n).between(14, 19), luhn(n)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    return F.lit(True)


def matches(text: Column, kind: str, pattern: str, hint: str, wider: bool) -> Column:
    """All leftmost matches that do not overlap, with their places and surroundings; linear in the text."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    # A match with the piece before it; the last piece has no match.
    joined = F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    code = KINDS.index(kind)

    def spans(parts: Column, at: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = F.get(at, i) + F.length(x["p"])
            following = F.get(parts, i + 1)
            good = F.lit(False) if wider else F.coalesce(passes(kind, x["h"]), F.lit(False))
            after = F.concat(F.left(following["p"], F.lit(AFTER)), F.coalesce(F.left(following["h"], F.lit(AFTER)), F.lit("")))
            return F.struct(
                F.lit(code).alias("kind"), start.cast("int").alias("start"), (start + F.length(x["h"])).cast("int").alias("end"), good.alias("base"), F.lit(wider).alias("wider"),
                x["h"].alias("hit"), F.right(x["p"], F.lit(BEFORE)).alias("before"), F.left(after, F.lit(AFTER)).alias("after"),
            )

        return F.transform(F.slice(parts, 1, F.size(parts) - 1), span)

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["h"]), F.lit(0)))
        return let(running(sizes), lambda at: spans(parts, at))

    return F.when(text.rlike(hint), let(joined, placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def found_spans(text: Column) -> Column:
    """Base matches (passing or not) and wider candidates of all kinds."""
    every = [matches(text, k, BASE[k], HINTS[k], False) for k in KINDS]
    every += [matches(text, k, WIDER[k], WIDER_HINTS[k], True) for k in KINDS if k in WIDER]
    return F.concat(*every)


def by_kind(kind: Column, **values: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(KINDS):
        out = F.when(kind == k, values.get(name, F.lit(0))).otherwise(out)
    return out


def vote(good: Column, bad: Column | None = None) -> Column:
    return F.when(good, F.lit(1)).when(bad if bad is not None else ~good, F.lit(-1)).otherwise(F.lit(0))


def votes(s: Column) -> list[Column]:
    """The five labelers: 1 for personal data, -1 against, 0 without an opinion."""
    hit, before, after = F.lower(s["hit"]), F.lower(s["before"]), s["after"]
    number = digits(hit)
    strict = F.when(s["wider"], F.lit(0)).when(s["base"], F.lit(1)).otherwise(F.lit(-1))
    shape = by_kind(
        s["kind"],
        email=vote(hit.rlike(r"(?:\.|dot[)\]]\x20?)[a-z]{2,24}$")),
        ip=vote(hit.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$") | hit.contains(":"), hit.rlike(r"[0-9]{4}")),
        card=vote(hit.rlike(r"^(?:[0-9]{15,16}|(?:[0-9]{4}[\x20-]){3}[0-9]{4})$"), F.length(number) > 19),
        phone=vote(hit.rlike(r"[\x20().-]"), F.length(number) > 15),
    )
    gazetteer = by_kind(
        s["kind"],
        email=vote(F.regexp_extract(hit, r"([a-z0-9-]+)$", 1).isin(TOP_DOMAINS)),
        ip=vote(~hit.rlike(RESERVED)),
        card=vote(number.rlike(ISSUER)),
        phone=vote(F.coalesce(*[F.when(number.startswith(c), F.lit(True)) for c in CALLING_CODES], F.lit(False)) & hit.startswith("+"), F.lit(False)),
    )
    near = by_kind(s["kind"], **{k: vote(before.rlike(CONTEXT[k]), before.rlike(AGAINST)) for k in KINDS})
    border = vote(~before.rlike(r"[\p{L}\p{N}_]$") & ~after.rlike(r"^[\p{L}\p{N}_]"))
    return [strict, shape, gazetteer, near, border]


def features(s: Column) -> Column:
    """What the final classifier sees of a span."""
    number = digits(s["hit"])
    return F.array(
        F.concat(F.lit("length "), F.least(F.floor(F.length(s["hit"]) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits "), F.least(F.length(number), F.lit(20)).cast("string")),
        F.concat(F.lit("first "), F.when(s["hit"].rlike("^[0-9]"), F.lit("digit")).when(s["hit"].rlike("^[A-Za-z]"), F.lit("letter")).otherwise(F.substring(s["hit"], 1, 1))),
        F.concat(F.lit("separators "), F.least(F.length(F.regexp_replace(s["hit"], "[A-Za-z0-9]", "")), F.lit(8)).cast("string")),
        F.concat(F.lit("left "), F.when(s["before"] == "", F.lit("edge")).when(s["before"].rlike(r"\s$"), F.lit("space")).when(s["before"].rlike(r"[\p{L}\p{N}_]$"), F.lit("word")).otherwise(F.lit("sign"))),
        F.concat(F.lit("right "), F.when(s["after"] == "", F.lit("edge")).when(s["after"].rlike(r"^\s"), F.lit("space")).when(s["after"].rlike(r"^[\p{L}\p{N}_]"), F.lit("word")).otherwise(F.lit("sign"))),
    )


LABELERS = 5


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``cands``: (kind, start, end, base, wider, votes, features) of every match."""
    spans = docs.select(*keep, found_spans(text_of()).alias("spans"))
    return spans.select(
        *keep,
        F.transform(
            "spans",
            lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["wider"].alias("wider"), F.array(*votes(s)).alias("votes"), features(s).alias("features")),
        ).alias("cands"),
    )


class Classifier:
    """Naive Bayes log odds per kind and feature, and the estimated labeler reliabilities."""

    def __init__(self, prior: dict[int, float], odds: dict[tuple[int, str], float], reliability: list[tuple[int, int, float]]):
        self.prior, self.odds, self.reliability = prior, odds, reliability

    def probability(self, cand: Column) -> Column:
        if not self.prior:
            return F.lit(0.0)
        known = F.create_map(*[x for (k, f), v in sorted(self.odds.items()) for x in (F.lit(f"{k} {f}"), F.lit(v))])
        start = F.create_map(*[x for k, v in sorted(self.prior.items()) for x in (F.lit(k), F.lit(v))])
        logit = F.aggregate(cand["features"], F.coalesce(start[cand["kind"]], F.lit(-10.0)), lambda s, f: s + F.coalesce(known[F.concat_ws(" ", cand["kind"].cast("string"), f)], F.lit(0.0)))
        return 1 / (1 + F.exp(-logit))


def learn(described_rows: DataFrame) -> Classifier:
    """Expectation-maximisation over vote patterns, then soft naive Bayes over features.

    The pattern table has at most kinds x 3**labelers rows and the feature table
    a few hundred, so what reaches the driver is bounded; the sums run in Spark.
    """
    rows = described_rows.select(F.explode("cands").alias("c")).select("c.kind", "c.votes", "c.features")
    patterns = materialise(rows.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "patterns")
    votes_only = materialise(patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).coalesce(1), "votes")
    total = F.aggregate("votes", F.lit(0), lambda s, v: s + v).cast("double")
    posterior = 1 / (1 + F.exp(-total))
    tables: dict[int, dict] = {}
    for _ in range(STEPS):
        weighed = votes_only.withColumn("p", posterior)
        sums = [F.sum(F.col("n") * F.col("p")).alias("pos"), F.sum(F.col("n") * (1 - F.col("p"))).alias("neg")]
        for j in range(LABELERS):
            for v in (-1, 0, 1):
                is_v = (F.col("votes")[j] == v).cast("double") * F.col("n")
                sums += [F.sum(is_v * F.col("p")).alias(f"p{j}{v + 1}"), F.sum(is_v * (1 - F.col("p"))).alias(f"q{j}{v + 1}")]
        new = {r["kind"]: r.asDict() for r in weighed.groupBy("kind").agg(*sums).collect()}
        if not new:
            return Classifier({}, {}, [])
        moved = max((abs(new[k][c] - tables.get(k, {}).get(c, 0.0)) / max(1.0, new[k]["pos"] + new[k]["neg"]) for k in new for c in new[k]), default=0)
        tables = new
        logit = F.lit(0.0)
        for k, t in tables.items():
            own = F.lit(math.log((t["pos"] + 1) / (t["neg"] + 1)))
            for j in range(LABELERS):
                ratio = [math.log((t[f"p{j}{v}"] + 0.5) / (t["pos"] + 1.5)) - math.log((t[f"q{j}{v}"] + 0.5) / (t["neg"] + 1.5)) for v in range(3)]
                own = own + F.element_at(F.array(*map(F.lit, ratio)), F.col("votes")[j] + 2)
            logit = F.when(F.col("kind") == k, own).otherwise(logit)
        posterior = 1 / (1 + F.exp(-logit))
        if moved < 1e-7:
            break
    reliability = [(k, j, (t[f"p{j}2"] + t[f"q{j}0"]) / max(1e-9, t[f"p{j}2"] + t[f"q{j}0"] + t[f"p{j}0"] + t[f"q{j}2"])) for k, t in sorted(tables.items()) for j in range(LABELERS)]
    soft = patterns.withColumn("p", posterior)
    prior = {r["kind"]: math.log((r["a"] + 1) / (r["b"] + 1)) for r in soft.groupBy("kind").agg(F.sum(F.col("n") * F.col("p")).alias("a"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b")).collect()}
    found = soft.select("kind", "n", "p", F.explode("features").alias("f")).groupBy("kind", "f").agg(F.sum(F.col("n") * F.col("p")).alias("a"), F.sum(F.col("n") * (1 - F.col("p"))).alias("b")).collect()
    odds = {}
    for r in found:
        a, b = tables[r["kind"]]["pos"], tables[r["kind"]]["neg"]
        odds[r["kind"], r["f"]] = math.log((r["a"] + 1) / (a + 8)) - math.log((r["b"] + 1) / (b + 8))
    return Classifier(prior, odds, reliability)


def without_overlap(cands: Column, spans: Column) -> Column:
    """Those of ``cands`` that share no character with any of ``spans``.

    As many spans end at or before the start of a free candidate as start before its end. Both numbers are running
    sums over the sorted borders of all.
    """

    def mark(at: Column, order: int, query: Column, starts: int, ends: int) -> Column:
        return F.struct(at.alias("at"), F.lit(order).alias("order"), query.cast("int").alias("query"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"))

    marks = F.array_sort(
        F.concat(
            F.transform(spans, lambda b: mark(b["start"], 1, F.lit(-1), 1, 0)),
            F.transform(spans, lambda b: mark(b["end"], 0, F.lit(-1), 0, 1)),
            F.transform(cands, lambda c, i: mark(c["start"], 1, 2 * i, 0, 0)),
            F.transform(cands, lambda c, i: mark(c["end"], 0, 2 * i + 1, 0, 0)),
        )
    )

    def answered(m: Column, ended: Column, started: Column) -> Column:
        value = lambda x, j: F.struct(x["query"].alias("query"), F.when(x["query"] % 2 == 0, F.get(ended, j)).otherwise(F.get(started, j)).alias("n"))
        numbers = F.array_sort(F.filter(F.transform(m, value), lambda x: x["query"] >= 0))
        return let(numbers, lambda n: F.filter(cands, lambda c, i: F.get(n, 2 * i)["n"] == F.get(n, 2 * i + 1)["n"]))

    def counted(m: Column) -> Column:
        # Ends sort before starts of the same place, so spans that touch a candidate do not overlap it.
        ended, started = running(F.transform(m, lambda x: x["ends"])), running(F.transform(m, lambda x: x["starts"]))
        return let(ended, lambda e: let(started, lambda s: answered(m, e, s)))

    return F.when((F.size(cands) > 0) & (F.size(spans) > 0), let(marks, counted)).otherwise(cands)


def decided(rows: DataFrame, model: Classifier) -> DataFrame:
    """Add ``base`` and ``all`` spans (kind, start, end), each in the order of (start, kind)."""
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("cands", lambda c: c["base"]), plain))
    likely = F.transform(F.filter("cands", lambda c: c["wider"] & (model.probability(c) >= KEEP)), plain)
    with_base = rows.withColumn("base", base).withColumn("__likely", likely)
    free = without_overlap(F.col("__likely"), F.col("base"))
    return with_base.withColumn("all", F.array_sort(F.concat("base", free))).drop("__likely")


def spelled(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base spans, hash of the base spans and all spans of every document."""
    rows = materialise(described(docs, ["doc_id"]), "spans")
    done = decided(rows, learn(rows))
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return done.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("all").alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def covered(spans: Column) -> Column:
    """Merged spans (start, kind, end), each with the kind of its first; spans that only touch stay apart."""
    marks = F.array_sort(
        F.concat(
            F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("step"), s["kind"].alias("kind"))),
            F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(-1).alias("step"), s["kind"].alias("kind"))),
        )
    )

    def merged(m: Column, held: Column) -> Column:
        opening = F.filter(m, lambda x, j: (x["step"] == 1) & (F.get(held, j) == 0))
        closing = F.filter(m, lambda x, j: (x["step"] == -1) & (F.get(held, j) == 1))
        return F.zip_with(opening, closing, lambda a, b: F.struct(a["at"].alias("start"), a["kind"].alias("kind"), b["at"].alias("end")))

    return let(marks, lambda m: let(running(F.transform(m, lambda x: x["step"])), lambda held: merged(m, held)))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every merged span replaced by its kind in brackets.

    The text is cut into blocks once, so that no piece is looked up from the start of the text.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def between(blocks: Column, first: Column, last: Column) -> Column:
        low = F.floor(first / BLOCK).cast("int")
        near = F.array_join(F.slice(blocks, low + 1, F.floor(last / BLOCK).cast("int") - low + 1), "")
        return F.substring(near, first - low * BLOCK + 1, last - first)

    def joined(blocks: Column, groups: Column) -> Column:
        ended = lambda i: F.coalesce(F.get(groups, i - 1)["end"], F.lit(0))
        parts = F.transform(groups, lambda g, i: F.concat(between(blocks, ended(i), g["start"]), F.element_at(names, g["kind"] + 1)))
        return F.concat(F.array_join(parts, ""), between(blocks, ended(F.size(groups)), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(blocks, lambda b: let(covered(spans), lambda g: joined(b, g)))


def redact(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; n_chars follows. Overlapping spans are replaced once."""
    model = learn(described(docs, ["doc_id"]))
    whole_row = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text"), text_of().alias("__text"))
    rows = decided(described(whole_row, ["__row", "__text", "text"]), model)
    found = F.size("all") > 0
    clean = rows.withColumn("__clean", F.when(found, replaced(F.col("__text"), F.col("all"))).otherwise(F.col("text")))
    own = {c: F.col("__row")[c] for c in docs.columns}
    own["text"] = F.col("__clean")
    if "n_chars" in own:
        own["n_chars"] = F.when(found, F.length("__clean").cast("long")).otherwise(own["n_chars"])
    return clean.select(*[own[c].alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
