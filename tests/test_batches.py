"""What a task holds of its Arrow batch: bounded by bytes, whatever the number of rows."""

import tracemalloc

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions.batches import PIECE_BYTES, by_pieces, pieces
from marginalia.functions.markdown import parse_blocks, parse_chunks
from marginalia.operators import edits
from marginalia.session import BATCH_BYTES
from marginalia.sources import files


def notes(n):
    return pa.array(["# A\n\n" + "\n".join(f"## Part {i}\n\nsome words [[doc-{j}]] and more of them\n" for i in range(60)) for j in range(n)])


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_batches_end_by_bytes(spark):
    width = 20_000
    texts = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), width).alias("t"))

    @F.arrow_udf("long")
    def rows_at_once(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int64())

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    most = BATCH_BYTES // width + 1
    assert texts.select(rows_at_once("t").alias("n")).agg(F.max("n")).first()[0] <= most
    assert texts.mapInPandas(sizes, "n long").agg(F.max("n")).first()[0] <= most


def test_pieces_cover_all_rows():
    texts = pa.array(["a" * 5, None, "b" * 7, "", "c" * 30, "d"])
    assert list(pieces(texts, 12)) == [(0, 4), (4, 1), (5, 1)]
    assert by_pieces(lambda xs: pa.array(xs, pa.string()), texts).equals(texts)
    assert len(by_pieces(lambda xs: pa.array(xs, pa.string()), texts.slice(0, 0))) == 0


@pytest.mark.parametrize("parse", [parse_blocks, parse_chunks])
def test_parsing_does_not_hold_the_batch(parse):
    small, large = notes(100), notes(400)
    assert peak(lambda: parse.func(large)) < 2 * peak(lambda: parse.func(small))
    assert parse.func(large)[:100].equals(parse.func(small))


def test_steps_of_a_batch_leave_by_pieces():
    ops = [{f: None for f in edits.OP_FIELDS} | {"seq": i, "operation": "append", "content": "x"} for i in range(5)]
    texts = notes(400)
    rows = (pa.array([f"n{i}" for i in range(400)]), texts, pa.array([ops] * 400))
    parts = list(edits._fold(False).func(iter([rows])))
    assert sum(len(p) for p in parts) == 400 and len(parts) >= texts.nbytes // PIECE_BYTES
    assert parts[0][0].as_py()[4]["content"] == texts[0].as_py().rstrip() + "\n\nx" * 5 + "\n"


def test_listing_a_folder_holds_no_list(tmp_path):
    for i in range(30):
        (tmp_path / f"n{i}.md").write_text("x")
    entries = files._entries(str(tmp_path), "")
    assert next(entries)[1] == "file" and len(list(entries)) == 29


def test_files_leave_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "READ_BYTES", 100_000)
    for i in range(40):
        (tmp_path / f"n{i}.md").write_text(f"{i} " + "x" * 50_000)
    (tmp_path / "bad.md").write_bytes(b"\xff")
    listing = files.list_files(spark, str(tmp_path)).coalesce(1)
    got = {r.path: r.content for r in files.read_files(spark, str(tmp_path), listing.unionByName(listing.limit(1).withColumn("path", F.lit("gone.md")))).collect()}
    assert len(got) == 42 and got["gone.md"] is None and got["bad.md"] == "�" and got["n7.md"] == "7 " + "x" * 50_000
