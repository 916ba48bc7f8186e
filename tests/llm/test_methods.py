"""Operators against brute force on a whole small table, and the pieces of their methods."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import balancing, components, imatch, langid, licenses, neardup, pieces, pii, resharding, textscan, toxicity
from marginalia.llm.hostquality import host_verdicts, judge
from marginalia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ---- op1 ----


def test_compression_tells_toxic_words(spark):
    calm, bad = [f"quiet river walk stone{i % 9} tree" for i in range(120)], [f"quiet river vermin{i % 5} stone{i % 9} tree" for i in range(120)]
    rows = [(i, t, 0) for i, t in enumerate(calm)] + [(1000 + i, t, 1) for i, t in enumerate(bad)]
    labelled = spark.createDataFrame(rows, "doc_id int, text string, toxic int")
    model = toxicity.learn(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    probe = spark.createDataFrame([(1, "stone1 and vermin3 by the river"), (2, "a quiet walk by the river"), (3, "")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in toxicity.score(probe, model, ["doc_id"]).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and 0 <= got[3]["score"] <= 1


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    scored = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    rank = scored["score"].rank()
    y = scored["toxic"] == 1
    auc = (rank[y].mean() - rank[~y].mean()) / len(scored) + 0.5
    assert auc > 0.97
    assert ((scored["predicted"] == 1) & ~y).sum() < 0.02 * (~y).sum()


# ---- op2 ----

BASE = {k: re.compile(v) for k, v in {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()}


def luhn(number):
    worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 * (v > 9) for v in worth) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


HARD = [
    "a@b.c%d@e.f x@y..z q@w.e.r. aa@b@c.d", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 4111--1111 4111-1111-1111-1111- " + "4" * 23,
    "+1 (017) 555-7713 +1+1 234 567 8901 é漢 +33 1.22-33(44)5566", "x" * 50_000 + "@", "1" * 60_000, "a." * 30_000 + "@b.c", "@a" + ".b" * 30_000, "1 " * 30_000, "+" * 20_000 + "1" * 20, "", None,
]


def test_base_spans_match_plain_patterns(spark, docs):
    hard = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string")
    rows = docs.select("doc_id", "text").unionByName(hard)
    got = {r["doc_id"]: r for r in pii.digest(rows).collect()}
    for r in rows.collect():
        spans = base_spans(r["text"] or "")
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(filter(None, spans.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))


def test_weak_supervision_adds_likely_spans(spark):
    rows = [(i, f"please call +1 (017) 555-{7000 + i} today") for i in range(60)] + [(100 + i, f"please call (017) 555-{7000 + i} today") for i in range(60)]
    rows += [(200 + i, f"build +{i:03d} 11 22 and +12 {i} 5") for i in range(40)]
    got = {r["doc_id"]: r for r in pii.digest(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(got[i]["spans"].startswith("phone:12:") for i in range(60)) and all(got[i]["spans"] == "" for i in range(200, 240))
    assert all(got[i]["spans"] == "phone:12:26" and got[i]["n_phone"] == 0 for i in range(100, 160))


# ---- op3 ----


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_scan_matches_brute_force(spark, docs):
    filler = " ".join(f"w{i}" for i in range(100))
    extra = [f"{filler} {t} {filler}" for _, t in licenses.TEMPLATES] + [f"{filler} " + " ".join(t.split()[1:]) for _, t in licenses.TEMPLATES] + ["under the mit license under the MIT-license", "cc by nc"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in licenses.digest(rows).collect()}
    blocks = defaultdict(set)
    for r in licenses.license_blocks(rows).collect():
        blocks[r["doc_id"]].add((r["start"], r["template"], round(r["score"], 9)))
    for r in rows.collect():
        words, row = words_of(r["text"]), got[r["doc_id"]]
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        expected = set()
        for k, (_, text) in enumerate(licenses.TEMPLATES):
            t = set(words_of(text))
            for s in range(0, max(len(words) - 33, 0) + 1, 32):
                both = len(t & set(words[s : s + 64]))
                if both >= math.ceil(0.8 * len(t) - 1e-9):
                    expected.add((s, k, round(both / len(t), 9)))
        assert blocks[r["doc_id"]] == expected
    assert got[20_003]["labels"] == "gpl-3"


def test_license_digest_keeps_every_notice_of_a_block(spark):
    rows = {
        1: ("Released under the MIT License, or licensed under the Apache License 2.0", "apache-2,mit"),
        2: ("This work is licensed under the GNU General Public License, version 3; docs licensed under CC BY SA 4.0", "cc-by-sa,gpl-3"),
        3: ("licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
        4: ("Licensed under CC BY SA 4.0", "cc-by-sa"),
    }
    got = licenses.digest(spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id int, text string"))
    assert {r["doc_id"]: r["labels"] for r in got.collect()} == {i: labels for i, (_, labels) in rows.items()}


# ---- op4 ----


def runs(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else None


def brute_classes(texts):
    sets, parent = {i: runs(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, empty = defaultdict(list), {}
    for i in sorted(texts):
        shared = Counter(j for s in sets[i] or () for j in index[s])
        for s in sets[i] or ():
            index[s].append(i)
        links = [j for j, k in shared.items() if k / (len(sets[i]) + len(sets[j]) - k) >= 0.8]
        if sets[i] is None:
            links = [empty.setdefault(texts[i] or "", i)]
        for j in links:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_classes_equal_brute_force(spark, texts):
    rng = np.random.default_rng(3)
    more = dict(texts)
    base = [f"t{x}" for x in rng.integers(0, 5000, 160)]
    for i in range(120):  # a large group of near copies, each with a few changes
        copy = list(base)
        for at in rng.integers(0, len(copy), rng.integers(0, 5)):
            copy[at] = f"u{rng.integers(0, 10**6)}"
        more[50_000 + i] = " ".join(copy)
    passage = " ".join(f"p{x}" for x in range(60))
    for i in range(80):  # a shared passage in documents that are no near copies
        more[60_000 + i] = passage + " " + " ".join(f"q{x}" for x in rng.integers(0, 10**6, 60))
    more |= {70_000: "", 70_001: None, 70_002: "...", 70_003: "a b", 70_004: "A, b!"}
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(more.items()), "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute_classes(more)


def test_signatures_estimate_weighted_jaccard():
    u = textscan.mix(np.arange(1, 301, dtype=np.uint64))
    elements, rows = np.concatenate([u[:200], u[20:220]]), np.repeat([0, 1], 200)
    same = lambda s: float((s[0] == s[1]).mean())
    assert abs(same(neardup.signatures(elements, rows, 2, k=4000)) - 180 / 220) < 0.03
    weights = np.repeat([2.5, 1.0], 200)
    assert abs(same(neardup.signatures(elements, rows, 2, weights, k=4000)) - 180 / 520) < 0.03
    tiny = neardup.signatures(u[:1], np.zeros(1, np.int64), 2)
    assert (tiny[0] > 0).all() and (tiny[1] == 0).all()


def test_components(spark):
    path = [(i, i + 1) for i in range(100)] + [(200, 201), (203, 201), (300, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[203] == got[201] == 200 and 300 not in got


# ---- op5 ----


def test_codec_parity_and_round_trip(spark, docs, texts):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoded = pieces.encode(docs).cache()
    for r in encoded.collect():
        assert r["ids"] == plain.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()}
    assert back == texts


def test_unigram_model_is_rebuilt(tmp_path):
    """The public BPE pieces as a unigram model: scores, byte fallback and the marker must survive."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    codec, plain = pieces.Codec(str(path)), SentencePieceProcessor(model_file=str(path))
    samples = ["Hello wide  world", "naïve 漢字 ☃", "", "a  b", "tabs\tand\nlines"]
    assert codec.encode(samples) == [plain.encode(s) for s in samples]
    assert codec.decode(codec.encode(samples)) == samples


# ---- op6 ----


def test_language_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language"](spark, sf).join(truth, "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()


def test_bloom_filter_returns_all_languages():
    made = langid.Filter(["a", "b", "c"], 0, 12, [np.zeros(1 << 12, np.uint64)], np.zeros(3))
    grams = np.arange(1, 101, dtype=np.uint64)
    made.add(0, grams[:60])
    made.add(2, grams[40:])
    bits = made.lookup(grams)[0]
    assert ((bits & 1) > 0)[:60].all() and ((bits & 4) > 0)[40:].all() and not (bits & 2).any()
    made.measure_false_positives()
    assert made.false_rate[1] == 0 and made.false_rate.max() < 0.01


# ---- op7 ----


def test_rules_match_plain_counts(docs, texts):
    got = {r["doc_id"]: r for r in judge(docs).collect()}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_small_hosts_are_drawn_to_the_prior(spark):
    rows = [("big", i < 100) for i in range(1000)] + [("small", True)] + [(f"h{k}", i < 10) for k in range(20) for i in range(100)] + [("bad", i < 900) for i in range(1000)]
    got = {r["source"]: r for r in host_verdicts(spark.createDataFrame(rows, "source string, failed boolean")).collect()}
    assert got["bad"]["host_bad"] and not got["big"]["host_bad"]
    assert got["small"]["host_rate"] < 0.75 and abs(got["big"]["host_rate"] - 0.1) < 0.02


# ---- op8 ----


def test_edits_and_fingerprints(docs, texts):
    got = {r["doc_id"]: r for r in imatch.digest(docs).collect()}
    ids = sorted(texts)
    prints = defaultdict(set)
    for k, i in enumerate(ids):
        text, following, r = texts[i], texts[ids[(k + 1) % len(ids)]], got[i]
        half = len(text) // 2
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[text].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])


# ---- op9 ----


def test_flow_moves_the_fewest_bytes():
    flow = resharding.min_cost_flow([50, 0, 10], [20, 20, 20], lambda i, j: int(i != j))
    assert sum(v for (i, j), v in flow.items() if i != j) == 30 and sum(flow.values()) == 60
    near = resharding.min_cost_flow([30, 0, 0], [10, 10, 10], lambda i, j: abs(i - j))
    assert near == {(0, 0): 10, (0, 1): 10, (0, 2): 10}


def test_shards_are_even_and_gapless(docs, tmp_path):
    rows = resharding.reshard_digest(docs).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 8
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    placed = resharding.rewrite_shards(docs, str(tmp_path / "shards"))
    written = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    changed = {r["shard"] for r in placed.filter("shard <> old_shard").collect()} | {r["old_shard"] for r in placed.filter("shard <> old_shard").collect()}
    assert {r["shard"] for r in written.select("shard").distinct().collect()} == changed & {r["shard"] for r in rows}
    assert written.count() == placed.filter(F.col("shard").isin(list(changed))).count()


@pytest.mark.parametrize(("shards", "capacity"), [(3, None), (9, None), (5, [0, 10_000, 10_000, 10_000, 10_000])])
def test_rewriting_real_shards_keeps_each_row_once(spark, tmp_path, shards, capacity):
    path, n = str(tmp_path / "shards"), 300
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("mine").alias("size"), F.lit("own").alias("text_crc32"))
    rows.withColumn("shard", (F.col("doc_id") % 5).cast("int")).write.partitionBy("shard").parquet(path)
    resharding.rewrite_shards(spark.read.parquet(path), path, shards, capacity, old="shard")
    got = spark.read.parquet(path).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(n))
    assert {(r["text"], r["size"], r["text_crc32"]) for r in got} == {(f"text {i}", "mine", "own") for i in range(n)}
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == (set(range(shards)) if capacity is None else {1, 2, 3, 4}) and max(sizes.values()) - min(sizes.values()) < 0.3 * n / len(sizes) + (n if capacity else 0)
    new = spark.createDataFrame([(n, "late", None)], "doc_id long, text string, shard int")
    placed = resharding.rewrite_shards(new, str(tmp_path / "more"), 2, old="shard").first()
    assert placed["old_shard"] is None and spark.read.parquet(str(tmp_path / "more")).count() == 1


# ---- op10 ----


def targets(sizes):
    """Iterated by hand: share by weight, cap at three times, reshare the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        w = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / w for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 3, "é": 70, None: 40}  # b and c have equal ratios
    got = {r["source"]: r["target"] for r in balancing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix_meets_its_targets(spark, docs):
    first, again = (sorted(map(tuple, balancing.mix_digest(docs.repartition(n)).select("doc_id", "size", "source_size", "target", "taken").collect())) for n in (3, 5))
    assert first == again
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, wanted, least = Counter(), Counter(), {}, defaultdict(lambda: 10**9)
    for i, size, _, target, t in first:
        s = source[i]
        sizes[s] += size
        taken[s] += t
        wanted[s] = target
        least[s] = min(least[s], size or 10**9)
        assert t <= 3 * size
    assert wanted == pytest.approx(targets(sizes))
    assert all(abs(taken[s] - wanted[s]) <= max(0.02 * wanted[s], least[s]) for s in sizes)
    assert balancing.mix_documents(docs).count() == sum(t // s for _, s, _, _, t in first if s) + balancing.mix_documents(docs).filter("text is null or text = ''").count()


# ---- pipeline ----


def test_pipeline_matches_plain_stages(spark, docs, texts):
    """Each stage on its own input against a plain version of its decision."""
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, SF)
    assert {r["doc_id"] for r in known.select("doc_id").collect()} == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    left = {r["doc_id"]: r["text"] for r in known.collect()}
    unique = stages["near-duplicates"](spark, known, SF)
    assert {r["doc_id"] for r in unique.select("doc_id").collect()} == set(brute_classes(left).values())
    clean = stages["personal-data"](spark, unique, SF).cache()
    assert clean.count() == unique.count()
    assert all(base_spans(r["text"]) == "" for r in clean.collect())
    mixed = stages["mixing"](spark, clean, SF)
    rates = {r["doc_id"]: r["copies"] for r in balancing.mix_digest(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == Counter({i: c for i, c in rates.items() if c})
    encoded = stages["pieces"](spark, mixed, SF)
    assert encoded.count() == mixed.count() and encoded.filter("NOT round_trip").count() == 0
