"""Detection of periodic runs of words, tile by tile for each scale of periods.

A run is a longest stretch of words with smallest period q and at least
``max(LEAST, 3 * q)`` words. It is the stretch of places i whose word equals
word i + q, and that stretch has at least 2q places. Periods are dealt into
octaves [P, 2P), the first being [1, 8). In the octave of P every such stretch
holds a whole block of P aligned places (8 in the first octave), so:

1. each document's words become numbers; blocks that equal none of the blocks
   at the octave's distances are left out by comparing block hashes (equal
   blocks have equal hashes, so none is lost);
2. the other blocks of an octave are exploded into tiles of up to
   ``TILE_BLOCKS`` blocks that overlap their neighbours;
3. tiles are dealt over the cluster and solved alone: Z-functions forwards and
   backwards from each block boundary give, for all periods of the octave at
   once, how far the words agree;
4. fragments are shuffled by document and period and stitched to whole
   stretches; of runs over the same words the smallest period stays.

The work is n log n in the words of a text. A tile holds a few times its largest
period, so a document of any length is many rows, except where one period
itself spans a large part of it.

Null and empty texts have no words and no runs; they collapse to the empty
text. Equal rows are searched once and reported each. A null doc_id is allowed
and leaves the text as it is. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm import textscan as ts
from marginalia.llm.common import bounded_batches, materialise, ship_package, table, text_of

LEAST = 24
FIRST = 8
TILE_BLOCKS = 8
# Words looked at together when blocks are compared; a longer text is looked at alone.
CHUNK_WORDS = 1 << 18


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, different words different ones."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def planted(words: list, doc_id: int | None) -> list:
    """The digest's rule: some documents, chosen by a checksum of the id, repeat a part of their words to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def candidate_blocks(ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each octave: P, documents and block numbers of the blocks that may repeat at a distance of the octave.

    ``ids`` are the word numbers of several documents in a row, ``offsets`` where each begins.
    """
    lengths = np.diff(offsets)
    value = np.zeros(len(ids) + 1, np.uint64)
    powers = np.full(len(ids) + 1, ts.BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(ids) + 1, ts.INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    np.cumsum(ts.mix(ids.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=value[1:])
    period = 1
    while True:
        block = max(period, FIRST)
        # A run has at least LEAST words, and three times its period.
        live = np.flatnonzero(lengths >= max(LEAST, 3 * period))
        if not len(live):
            return
        count = lengths[live] - block + 1
        doc = np.repeat(live, count)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        if period < FIRST:
            anchor = at // block * block
            keep = at > anchor
        else:
            anchor = (at // block - 1) * block
            keep = anchor >= 0
        doc, at, anchor = doc[keep], at[keep] + offsets[doc[keep]], anchor[keep]
        left = anchor + offsets[doc]
        same = (value[at + block] - value[at]) * inverse[at] == (value[left + block] - value[left]) * inverse[left]
        if same.any():
            found = np.unique(np.stack([doc[same], anchor[same] // block]), axis=1)
            yield period, found[0], found[1]
        period = FIRST if period < FIRST else 2 * period


def _top(period: int) -> int:
    """The end of an octave of periods."""
    return 2 * period if period >= FIRST else FIRST


def tiles_of(ids: np.ndarray, period: int, blocks: np.ndarray) -> Iterator[dict]:
    """Overlapping tiles of one document around its candidate blocks: first block, number of blocks, first word and words."""
    block = max(period, FIRST)
    cuts = np.flatnonzero(np.diff(blocks) != 1) + 1
    for group in np.split(blocks, cuts):
        for lo in range(0, len(group), TILE_BLOCKS):
            part = group[lo : lo + TILE_BLOCKS]
            start = max(0, (int(part[0]) - 1) * block)
            # Places up to two blocks beyond the last one's start are compared, with words up to two periods further.
            end = min(len(ids), (int(part[-1]) + 2) * block + _top(period))
            yield {"octave": period, "block": int(part[0]), "blocks": len(part), "first": start, "words": ids[start:end]}


def z_function(s: list[int]) -> list[int]:
    """For each place, how many elements from there on equal those from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(period: int, block_no: int, blocks: int, first: int, words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(q, start, end): places start to end whose word equals the one q further, around each matched block."""
    block = max(period, FIRST)
    top, n = _top(period), len(words)
    for k in range(blocks):
        at = (block_no + k) * block - first
        ahead = words[at : at + 2 * block + top]
        forward = z_function(ahead)
        reach = min(len(ahead), top)
        hits = [q for q in range(period, reach) if forward[q] >= block]
        if not hits:
            continue
        # Backwards from the boundary: the words before it against the words before it plus q. Reversed, the part
        # from the boundary to top words further comes first, then the block before the boundary.
        before = words[max(0, at - block) : at][::-1]
        if before:
            beyond = words[at : min(n, at + top)]
            joined = before + [-1] + beyond[::-1] + before
            back = z_function(joined)
            shift = len(before) + 1 + len(beyond)
        for q in hits:
            agree = min(back[shift - q], len(before)) if before else 0
            yield q, first + at - agree, first + at + min(forward[q], 2 * block)


def joined(found: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Fragments of one tile, which come in the order of their blocks, joined where they touch."""
    last: dict[int, list[int]] = {}
    for q, s, e in found:
        have = last.get(q)
        if have and s <= have[1]:
            have[1] = max(have[1], e)
        else:
            if have:
                yield q, have[0], have[1]
            last[q] = [s, e]
    for q, (s, e) in last.items():
        yield q, s, e


TILE = "struct<octave:int,block:int,blocks:int,first:int,words:array<int>>"


def scanned(docs: DataFrame, mutate: bool) -> DataFrame:
    """Per row: doc_id, t1, t2, n, plain (hash of all words), tiles, and the text where there are tiles."""
    ship_package(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    narrow = docs.select("doc_id", F.xxhash64(text_of()).alias("t1"), F.crc32(text_of().cast("binary")).alias("t2"), text_of().alias("__text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("octave", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = batch.column(3), batch.column(0).to_pylist()
            lo = 0
            while lo < len(texts):
                rows, plain, held = [], [], 0
                while lo + len(rows) < len(texts) and (held < CHUNK_WORDS or not rows):
                    words = texts[lo + len(rows)].as_py().encode().split()
                    words = planted(words, doc_ids[lo + len(rows)]) if mutate else words
                    plain.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    rows.append(numbered(words))
                    held += len(words)
                tiles: list[list[dict]] = [[] for _ in rows]
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
                for period, doc, block in candidate_blocks(np.concatenate(rows), offsets):
                    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
                        tiles[doc[part[0]]].extend(tiles_of(rows[doc[part[0]]], period, block[part]))
                n = len(rows)
                kept = pa.array([texts[lo + i].as_py() if t else None for i, t in enumerate(tiles)], pa.string())
                columns = [batch.column(i).slice(lo, n) for i in range(3)]
                counts = pa.array([len(r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(plain), pa.array(tiles, kind), kept], ["doc_id", "t1", "t2", "n", "plain", "tiles", "text"])
                lo += n

    return narrow.mapInArrow(run, f"doc_id {id_type}, t1 bigint, t2 bigint, n bigint, plain string, tiles array<{TILE}>, text string")


def fragments(tiles: DataFrame) -> DataFrame:
    """(key, q, s, e): the matched places of every tile, blocks that touch joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), [[], [], [], []]
            fixed = [batch.column(i).to_pylist() for i in range(1, 5)]
            for row in range(batch.num_rows):
                for q, s, e in joined(solve_tile(*[c[row] for c in fixed], batch.column(5)[row].as_py())):
                    for column, x in zip(out, (row, q, s, e), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0], pa.int64())), *[pa.array(x, pa.int32()) for x in out[1:]]], ["key", "q", "s", "e"])

    return tiles.mapInArrow(run, "key binary, q int, s int, e int")


def key() -> Column:
    """Sixteen bytes that stand for an (id, text) pair."""
    return F.unhex(F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("t1"), F.hex("t2"))))


def runs_of(rows: DataFrame) -> DataFrame:
    """(key, start, length, period) of every run of the rows of ``scanned``."""
    tiles = rows.filter(F.size("tiles") > 0).select(key().alias("key"), F.explode("tiles").alias("t")).select("key", "t.*")
    # Tiles of a long document spread over the tasks; repeated rows meet again and count once.
    dealt = tiles.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key", "octave", "block")
    found = fragments(dealt.select("key", "octave", "block", "blocks", "first", "words"))
    order = W.partitionBy("key", "q").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = found.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
    islands = fresh.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = islands.groupBy("key", "q", "island").agg(F.min("s").alias("start"), (F.max("e") + F.col("q")).alias("end"))
    long = whole.filter(F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST), 3 * F.col("q")))
    best = long.groupBy("key", "start", "end").agg(F.min("q").alias("period"))
    return best.select("key", "start", (F.col("end") - F.col("start")).alias("length"), "period")


SUMMARY = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places that stay when each run keeps only its first period."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.flatnonzero(np.cumsum(drop[:-1]) == 0)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length to period, then the first one, then the smallest period; exact."""
    best = runs[0]
    for r in runs[1:]:
        more = r[1] * best[2] - best[1] * r[2]
        if more > 0 or (more == 0 and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def summarised(rows: DataFrame, mutate: bool) -> DataFrame:
    """``rows`` has doc_id, text, runs (array of start, length, period, or NULL) and plain: one row each with the columns of SUMMARY."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            doc_ids, texts, runs, plain = batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)
            for row in range(batch.num_rows):
                if not runs[row].is_valid:
                    for column, x in zip(out, (0, None, None, None, None, hashlib.sha256(b"").hexdigest(), plain[row].as_py()), strict=True):
                        column.append(x)
                    continue
                words = texts[row].as_py().encode().split()
                words = planted(words, doc_ids[row]) if mutate else words
                found = sorted((r["start"], r["length"], r["period"]) for r in runs[row].as_py())
                start, length, period = strongest(found)
                listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
                kept = b" ".join(words[i] for i in collapsed(len(words), found))
                values = (len(found), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            arrays = [pa.array(x, pa.int64() if i < 5 else pa.string()) for i, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return rows.select("doc_id", "text", "runs", "plain").mapInArrow(run, f"doc_id {id_type}, {SUMMARY}")


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of the texts as they are; repeated rows give repeated runs."""
    rows = materialise(scanned(docs, False), "scan")
    return rows.select("doc_id", key().alias("key")).join(runs_of(rows), "key").select("doc_id", "start", "length", "period")


def digest(docs: DataFrame, mutate: bool = True) -> DataFrame:
    """One row per row of ``docs``: the columns of SUMMARY. ``mutate`` applies the rule of ``planted`` first."""
    rows = materialise(scanned(docs, mutate), "scan")
    # A run list belongs to one text and has fewer entries than the text has words.
    listed = runs_of(rows).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    listed = materialise(listed, "runs")
    # Only texts with tiles can have runs and are joined. The lists grow with the input, so they are never broadcast.
    tiled = rows.filter("text IS NOT NULL").select("doc_id", "plain", "text", key().alias("key")).join(listed.hint("merge"), "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    nothing = [F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")]
    none = rows.filter("text IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *nothing, F.lit(empty).alias("runs_sha256"), F.col("plain").alias("collapsed_sha256"))
    return none.unionByName(summarised(tiled, mutate))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
