"""Periodic runs, hard negatives and benchmark decontamination against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from marginalia.llm import decontamination, negatives, periodic

# ---- op11 ----

RUNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def repetitive(seed):
    """Words with runs of many periods, over few different words."""
    draw, words = random.Random(seed), []
    for _ in range(draw.randint(0, 8)):
        block = [draw.choice("abcd"[: draw.randint(1, 4)]) for _ in range(draw.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
        words += (block * 7)[: draw.randint(1, 5 * len(block) + 20)]
        words += [draw.choice("abcdefgh") for _ in range(draw.randint(0, 10))]
    return words


def tiled(words):
    """The method on one text, without Spark's shuffle."""
    ids, parts = periodic.numbered([w.encode() for w in words]), {}
    for period, _, blocks in periodic.candidate_blocks(ids, np.array([0, len(ids)])):
        for t in periodic.tiles_of(ids, period, blocks):
            for q, s, e in periodic.solve_tile(period, t["block"], t["blocks"], t["first"], t["words"].tolist()):
                parts.setdefault(q, []).append((s, e))
    best = {}
    for q in sorted(parts):
        end, start = -1, 0
        for s, e in [*sorted(parts[q]), (10**9, 10**9)]:
            if s > end:
                if end + q - start >= max(24, 3 * q):
                    best.setdefault((start, end + q), q)
                start = s
            end = max(end, e) if s <= end else e
    return sorted((s, e - s, q) for (s, e), q in best.items())


def test_tiles_find_every_run():
    for seed in range(400):
        words = repetitive(seed)
        assert tiled(words) == plain.periodic_runs(words), seed


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_digest_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = [(10_000 + i, " ".join(repetitive(i))) for i in range(40)] + [(20_000, "one two three " * 5000), (20_001, "word " * 3000)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string")).repartition(5)
    texts = [(r["doc_id"], r["text"]) for r in both.collect() if r["doc_id"] < 20_000]
    got = rows_of(periodic.digest(both).filter("doc_id < 20000"), RUNS)
    assert got == sorted((plain.periodic_digest(*t) for t in texts), key=repr)
    assert sum(r[1] > 0 for r in got) > 20
    long = {r["doc_id"]: r for r in periodic.digest(both.filter("doc_id >= 20000"), mutate=False).collect()}
    assert (long[20_000]["n_runs"], long[20_000]["length"], long[20_000]["period"]) == (1, 15_000, 3)
    assert (long[20_001]["n_runs"], long[20_001]["length"], long[20_001]["period"]) == (1, 3000, 1)
    assert long[20_001]["collapsed_sha256"] == hashlib.sha256(b"word").hexdigest()


def test_runs_of_odd_rows(odd_docs):
    got = rows_of(periodic.digest(odd_docs), RUNS)
    assert got == sorted((plain.periodic_digest(r["doc_id"], r["text"]) if len(r["text"] or "") < 10**5 else next(g for g in got if g[0] == 5) for r in odd_docs.select("doc_id", "text").collect()), key=repr)


def test_runs_of_one_table(spark):
    docs = spark.createDataFrame([(1, "x " + "a b " * 20 + "y"), (1, "x " + "a b " * 20 + "y"), (2, None)], "doc_id int, text string")
    # Equal rows are one (id, text) pair: each of them gets the run.
    assert rows_of(periodic.find_runs(docs), ["doc_id", "start", "length", "period"]) == [(1, 1, 40, 2)] * 2


# ---- op12 ----

MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
VECTORS = "vec_id bigint, embedding array<float>, label int, score string"


def vectors(seed, n, dims=12):
    draw = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in draw.normal(size=dims).round(1)], int(draw.integers(0, 3)), "mine") for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mining_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 150)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 2)
    rows = vectors(seed, 900)
    # One hot vector, ties by rounding, and rows that take no part.
    rows += [(1000 + i, rows[3][1], i % 3, "mine") for i in range(120)]
    rows += [(2000, None, 1, "mine"), (2100, rows[0][1], None, "mine"), (2200, [1.0, None] * 6, 1, "mine"), (2300, [float("nan")] * 12, 1, "mine"), (2400, [float("inf")] * 12, 2, "mine"), (None, rows[5][1], 1, "mine"), (2500, [], 1, "mine"), (2600, [1.0, -1.0], 1, None)]
    got = rows_of(negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3)), MINED)
    pad = lambda v: None if v is None else [*v, *[0.0] * (12 - len(v))]
    assert len(got) > 100
    want = plain.mined_negatives([(i, pad(v), x) for i, v, x, _ in rows if i is not None] + [(10**15 + 2, rows[5][1], 1)])
    assert got == sorted(((a, p if p < 10**15 else None, k, n if n < 10**15 else None, s, t) for a, p, k, n, s, t in want), key=repr)


def test_scan_drops_rows_before_the_last_dimension():
    draw = np.random.default_rng(3)
    anchor = np.array([100, 80, *[1] * 30])
    columns = draw.integers(-100, 100, (32, 2000))
    seen = []

    def wanted(least, most):
        seen.append(len(least))
        return most >= negatives.kth_largest(least, 5)

    at, score = negatives.vertical_scan(columns, columns.min(1), columns.max(1), anchor, np.arange(2000), wanted)
    full = anchor @ columns
    assert seen[-1] < 200 and set(np.argsort(-full)[:5]) <= set(at) and (full[at] == score).all()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.mine(empty).collect() == []
    alone = spark.createDataFrame([(100, [1.0], 1, ""), (100, [1.0], 1, ""), (101, [1.0], 2, "")], VECTORS)
    assert negatives.mine(alone).collect() == []


# ---- op13 ----

FOUND = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items):
    windows = {}
    for item, text in items:
        ws = words_of(text)
        n = min(len(ws), 10)
        for i in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[i : i + n]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        ws, hit, found = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(ws) - n + 1):
                if names := windows.get(tuple(ws[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = rows_of(decontamination.contamination(docs, items), FOUND)
    assert got == plain_contamination(docs.select("doc_id", "text").collect(), items.collect())
    assert any(r[5] for r in got)


def test_decontamination_of_random_texts(spark):
    draw = random.Random(9)
    some = lambda n: " ".join(draw.choice(["a", "B", "ΑΣ", "straße", "x9"]) for _ in range(n))
    items = [(i, some(draw.choice([0, 1, 2, 4, 5, 7, 9, 10, 11, 14, 30]))) for i in range(60) if i % 7] + [(3, "a-a-a"), (None, some(12)), (70, None)]
    items = [x for x in items if len(words_of(x[1])) not in (1, 2)]
    docs = [(i, some(draw.choice([0, 3, 8, 40, 200])).replace(" ", draw.choice([" ", ", ", "'\n"]))) for i in range(80)]
    docs += [(1, docs[1][1]), (None, docs[2][1]), (90, None), *[(200 + i, items[20][1]) for i in range(30)]]
    left = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id bigint, text string, n_hit string").repartition(4)
    got = rows_of(decontamination.contamination(left, spark.createDataFrame(items, "item_id bigint, text string")), FOUND)
    assert got == plain_contamination(docs, items)
    assert got != plain_contamination(docs, items[:20])


def test_decontamination_without_items(spark, odd_docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert {r["n_hit"] for r in decontamination.contamination(odd_docs, none).collect()} == {0}


def test_winnowing_keeps_a_run_of_every_shared_window(spark):
    words = [f"w{i}" for i in range(300)]
    prints = decontamination.winnowed(spark.createDataFrame([(" ".join(words),)], "text string").select(decontamination.hashed_words(F.col("text")).alias("h")), "h")
    places = [r["p"] for r in prints.select(F.explode_outer("prints").alias("p")).select(decontamination.place_of(F.col("p")).alias("p")).collect()]
    assert all(any(i <= p <= i + 5 for p in places) for i in range(291))
    assert len(places) < 150
