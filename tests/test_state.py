"""Paths, files, index store, workflow, debounce and streams, tool calls."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from marginalia import errors
from marginalia.api import Workspace
from marginalia.functions.paths import clean_path, directory_path, note_path
from marginalia.operators import notes, workflow
from marginalia.sources import files
from marginalia.sources.embedders import HashingEmbedder, ServiceEmbedder, create_embedder
from marginalia.sources.index_store import IndexStore, build_changes, build_index
from marginalia.sources.watch import Watch, start_watching
from marginalia.streaming import debounce
from marginalia.streaming.indexing import changed_contents, start_indexing
from marginalia.streaming.workflow_state import folded, workflow_states


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a", "a.md"),
        ("a.md", "a.md"),
        ("/x/a", "x/a.md"),
        ("x\\a.md", "x/a.md"),
        ("x%2Fa", "x/a.md"),
        ("x%252Fa", "x/a.md"),
        ("./x//a", "x/a.md"),
        ("..a", "..a.md"),
        ("ünï", "ünï.md"),
    ],
)
def test_note_path(raw, clean):
    assert note_path(raw) == clean


@pytest.mark.parametrize("raw", ["../a", "a/../b", "%2e%2e/a", "%252e%252e%252fa", "..\\a", "a/.."])
def test_traversal(raw):
    with pytest.raises(errors.PathTraversal):
        note_path(raw)


@pytest.mark.parametrize("raw", ["", "  ", "a\0b", "100% done", "%ff", "/", "%00"])
def test_invalid(raw):
    with pytest.raises(errors.InvalidNotePath):
        note_path(raw)


def test_directory_path():
    assert directory_path(None) == directory_path(" ") == directory_path("/") == ""
    assert directory_path("a/b/") == "a/b"
    assert clean_path("//a") == "a"


def test_error_codes():
    assert errors.HeadingNotFound("x", 2).code == "HEADING_NOT_FOUND"
    assert str(errors.InvalidTransition("idle", "save")) == 'Invalid state transition from "idle" to "save"'


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    for path, text in {
        "hello.md": "# Hello\n\nWorld [[2024-01-01]].\n\n## More\n\nText about apples.\n",
        "daily/2024-01-01.md": "---\ntags: [d]\n---\n\n# Day\n\nWent to [hello](../hello.md).\n",
        "a/b/c/deep.md": "deep words here\n",
        ".hidden/x.md": "x\n",
        "_tpl/.dot.md": "{{name}}\n",
        "empty.md": "",
        "skip.txt": "no",
        "UP.MD": "no",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    (root / "bad.md").write_bytes(b"ok \xff\xfe")
    os.symlink(root / "hello.md", root / "link.md")
    return str(root)


def test_files(spark, vault):
    found = sorted(r.path for r in files.list_files(spark, vault).collect())
    assert found == [".hidden/x.md", "_tpl/.dot.md", "a/b/c/deep.md", "bad.md", "daily/2024-01-01.md", "empty.md", "hello.md"]
    assert [r.path for r in files.list_files(spark, vault, "a").collect()] == ["a/b/c/deep.md"]
    assert files.list_files(spark, vault, "nowhere").count() == 0
    texts = {r.path: r.content for r in files.read_files(spark, vault, files.list_files(spark, vault)).collect()}
    assert texts["bad.md"] == "ok ��" and texts["empty.md"] == ""
    gone = spark.createDataFrame([("zz.md",)], "path string")
    assert files.read_files(spark, vault, gone).first().content is None
    with pytest.raises(errors.VaultNotFound):
        files.open_vault(vault + "/nope")


def test_write_and_delete(spark, vault, make):
    listing = files.list_files(spark, vault)
    out = files.write_files(vault, make({"hello.md": "x", "new/n.md": "é"}), existing=listing).collect()
    assert {r.path: r.error_code for r in out} == {"hello.md": "NOTE_ALREADY_EXISTS", "new/n.md": None}
    assert open(vault + "/new/n.md", encoding="utf-8").read() == "é"
    files.write_files(vault, make({"hello.md": "x"}), overwrite=True).collect()
    assert open(vault + "/hello.md").read() == "x"
    assert not [n for n in os.listdir(vault) if n.endswith(".tmp")]
    out = files.delete_files(vault, make({"hello.md": "", "q.md": ""}).select("path")).collect()
    assert {r.path: r.error_code for r in out} == {"hello.md": None, "q.md": "NOTE_NOT_FOUND"}


def test_index_store(spark, make, tmp_path):
    embedder = HashingEmbedder(8)
    store = IndexStore(spark, str(tmp_path / "ix"), embedder.model, 8)
    assert store.load().count() == 0
    store.check()
    vectors = build_index(make({"a.md": "# A\n\none\n\n## B\n\ntwo\n", "b.md": "plain\n", "e.md": ""}), embedder)
    assert {(r.doc_path, r.chunk_idx, r.chunk_id) for r in vectors.collect()} == {("a.md", 0, "A"), ("a.md", 1, "A > B"), ("b.md", 0, "root")}
    store.save(vectors)
    assert store.load().count() == 3
    other = IndexStore(spark, str(tmp_path / "ix"), "other", 8)
    assert other.load().count() == 0
    with pytest.raises(errors.StartupFailed):
        other.check()
    other.check(allow_reset=True)
    paths = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",)], "path string")
    for _ in range(2):
        store.write_changes(0, build_changes(paths, make({"a.md": "changed\n", "c.md": " "}), embedder))
    assert {(r.doc_path, r.text) for r in store.load().collect()} == {("a.md", "changed")}
    store.write_changes(1, build_changes(paths.filter("path = 'b.md'"), make({"b.md": "back\n"}), embedder))
    store.compact()
    assert {(r.doc_path, r.text) for r in store.load().collect()} == {("a.md", "changed"), ("b.md", "back")}


def test_truncated_snapshot_is_ignored(spark, make, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"), "hashing", 8)
    name = store.save(build_index(make({f"n{i}.md": "word\n" for i in range(40)}), HashingEmbedder(8)))
    folder = tmp_path / "ix/vectors" / name
    parts = sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))
    os.unlink(folder / parts[0])
    assert IndexStore(spark, str(tmp_path / "ix"), "hashing", 8).load().count() == 0


def test_embedder_choice():
    assert isinstance(create_embedder({"OLLAMA_URL": "http://x/", "OLLAMA_DIMENSIONS": "5"}), ServiceEmbedder)
    assert create_embedder({"OLLAMA_URL": "http://x", "OLLAMA_DIMENSIONS": "5"}).dimensions == 5
    assert create_embedder({}).dimensions == 384


# ---- workflow ----


def walk(names):
    place, ok, bad, trail = "idle", 0, 0, []
    for n in names:
        before = place
        if n == workflow.HARD_RESET:
            place, ok, bad = "idle", 0, 0
            trail.append((before, place, True))
            continue
        try:
            place = workflow.next_place(place, n)
            ok += 1
            trail.append((before, place, True))
        except errors.InvalidTransition:
            bad += 1
            trail.append((before, place, False))
    return place, ok, bad, trail


def random_events(seed, hot):
    rng = random.Random(seed)
    names = sorted({t[0] for t in workflow.TRANSITIONS}) + ["bogus", workflow.HARD_RESET]
    return [(0 if rng.random() < hot else rng.randint(1, 9), i, rng.choice(names)) for i in range(900)]


@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_workflow_fold(spark, hot):
    data = random_events(5, hot)
    events = spark.createDataFrame(data, "user long, seq long, name string").repartition(5)
    want = {u: walk([n for v, _, n in data if v == u]) for u in {d[0] for d in data}}
    got = {r.user: (r.final_place, r.n_ok, r.n_rejected) for r in workflow.final_state(events, "user", ["seq"], "name").collect()}
    assert got == {u: w[:3] for u, w in want.items()}
    rows = workflow.history(events, "user", ["seq"], "name").orderBy("user", "seq").collect()
    assert len(rows) == len(data)
    for u, w in want.items():
        assert [(r.from_place, r.to_place, r.accepted) for r in rows if r.user == u] == w[3]


def test_workflow_rules():
    assert workflow.next_place("idle", "search") == "exploring"
    assert workflow.available("reviewing") == ["done", "open_note", "search"]
    with pytest.raises(errors.InvalidTransition, match="save"):
        workflow.next_place("idle", "save")


# ---- debounce ----


def plain_firings(data, gap):
    out = set()
    for p in {d[0] for d in data}:
        times = sorted(t for q, t in data if q == p)
        out |= {(p, t) for t, n in zip(times, times[1:] + [None]) if n is None or n - t > gap}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_debounce(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "b"]), rng.randint(-50, 400) * 100_000) for _ in range(300)]
    events = spark.createDataFrame(data, "path string, t long")
    got = {(r.path, r.last_micros) for r in debounce.firings(events, "path", "t", 500).collect()}
    assert got == plain_firings(data, 500_000)


def test_queue_keeps_deletes(spark):
    events = spark.createDataFrame([("a", 0, "change"), ("a", 100, "change"), ("a", 200, "unlink")], "path string, t long, kind string")
    got = debounce.queue_entries(events, "path", "t", F.col("kind") == "unlink", 1).collect()
    assert {(r.path, r.at_micros, r.kind) for r in got} == {("a", 1100, "change"), ("a", 200, "unlink")}
    assert debounce.queue(events, "path", "t").first().first_micros == 0


def test_drained_stream_keeps_open_bursts_and_late_rows(spark, tmp_path):
    rng = random.Random(7)
    data = [(rng.choice("aab"), rng.randint(1, 400) * 100_000) for _ in range(300)]
    # The newest rows come first, so that a watermark would drop the later files.
    for k, part in enumerate(sorted(data, key=lambda d: -d[1])[i : i + 100] for i in (0, 100, 200)):
        rows = spark.createDataFrame(part, "path string, t long").select("path", F.timestamp_micros("t").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05 * k)
    stream = spark.readStream.schema("path string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = debounce.drained(stream, "path", "ts", str(tmp_path / "work"), 500, "1 hour").collect()
    events = spark.createDataFrame(data, "path string, t long")
    fired = {(r.path, r.last_micros) for r in debounce.firings(events, "path", "t", 500).collect()}
    assert fired == plain_firings(data, 500_000)
    assert {(r.path, r.last_micros) for r in got} == fired
    assert len(got) == len(fired) and sum(r.n_events for r in got) == len(data)


def test_deletes_pass_an_open_burst(spark, tmp_path):
    rows = [("a", 0, "change"), ("a", 100, "unlink"), ("a", 300, "change"), ("b", 0, "unlink"), (None, 5, "change"), ("c", 9000, "change")]
    at = F.timestamp_micros((F.col("ms") + 1000) * 1000).alias("ts")
    spark.createDataFrame(rows[:4], "path string, ms long, kind string").select("path", at, "kind").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, ts timestamp, kind string").parquet(str(tmp_path / "in"))

    def run():
        out = debounce.drained(stream, "path", "ts", str(tmp_path / "work"), 500, is_delete=F.col("kind") == "unlink")
        return sorted((r.path, r.kind, r.last_micros // 1000 - 1000, r.n_events) for r in out.collect())

    first = [("a", "change", 300, 2), ("a", "unlink", 100, 1), ("b", "unlink", 0, 1)]
    assert run() == first
    # A further call goes on from there.
    spark.createDataFrame(rows[4:], "path string, ms long, kind string").select("path", at, "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == sorted([*first, ("c", "change", 9000, 1)])


# ---- listing ----


def test_one_deep_folder_is_listed_by_many_tasks(spark, tmp_path):
    for i in range(40):
        os.makedirs(tmp_path / "top/second" / f"f{i}")
        (tmp_path / "top/second" / f"f{i}" / "n.md").write_text("x")
    tops = spark.createDataFrame([("top",), ("absent",)], "folder string")
    found = files.walk(spark, str(tmp_path), tops)
    assert sorted((r.kind, r.n) for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()) == [("error", 1), ("file", 40), ("folder", 41)]
    assert found.filter("kind = 'file'").select(F.input_file_name().alias("f")).distinct().count() > 1
    assert [r.path for r in found.filter("kind = 'error'").collect()] == ["absent"]


def test_lost_notes_are_reported(spark, vault):
    listing = files.list_files(spark, vault)
    os.unlink(f"{vault}/hello.md")
    assert [(r.path, r.error_code) for r in files.unreadable(files.read_files(spark, vault, listing)).collect()] == [("hello.md", "NOTE_UNREADABLE")]


def test_upsert_keeps_the_last_of_repeated_paths(spark):
    old = spark.createDataFrame([("a", "old"), ("b", "old")], "path string, content string")
    new = spark.createDataFrame([("a", "first", 1), ("a", "second", 2), ("c", "only", 1)], "path string, content string, seq int")
    got = sorted((r.path, r.content) for r in notes.upsert_notes(old, new, "seq").collect())
    assert got == [("a", "second"), ("b", "old"), ("c", "only")]
    assert notes.upsert_notes(old, new.select("path", "content")).filter("path = 'a'").count() == 1


# ---- watching ----


def settled():
    return dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=5)


def test_watch_reports_adds_changes_and_deletes(spark, vault, tmp_path):
    watch = Watch(spark, str(tmp_path / "watch"))
    look = lambda: files.list_files(spark, vault)
    assert watch.advance(look(), settled()) == 0 and watch.changes().count() == 0
    os.unlink(f"{vault}/hello.md")
    with open(f"{vault}/empty.md", "w") as f:
        f.write("now some text")
    # A file that comes with an old time is new all the same.
    with open(f"{vault}/old.md", "w") as f:
        f.write("x")
    os.utime(f"{vault}/old.md", (1_000_000, 1_000_000))
    # Equal size, other time.
    os.utime(f"{vault}/daily/2024-01-01.md", (2_000_000, 2_000_000))
    assert watch.advance(look(), settled()) == 1
    seen = {(r.path, r.kind, r.step) for r in watch.changes().collect()}
    assert seen == {("hello.md", "unlink", 1), ("empty.md", "change", 1), ("old.md", "add", 1), ("daily/2024-01-01.md", "change", 1)}
    assert watch.advance(look(), settled()) == 2 and watch.changes().count() == 4
    assert [r.folder[-6:] for r in watch.forget().collect()] == ["step=0"]


def test_watch_waits_for_files_being_written(spark, tmp_path):
    watch = Watch(spark, str(tmp_path / "watch"))
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, tzinfo=dt.timezone.utc)
    table = lambda rows: spark.createDataFrame(rows, "path string, size_bytes long, modified_at timestamp")
    watch.advance(table([("a", 1, at(1)), ("b", 1, at(1))]), at(5))
    watch.advance(table([("a", 2, at(9)), ("b", 1, at(1)), ("c", 1, at(9))]), at(8))
    assert watch.changes().count() == 0
    watch.advance(table([("a", 2, at(9)), ("b", 1, at(1)), ("c", 1, at(9))]), at(10))
    assert {(r.path, r.kind) for r in watch.changes().collect()} == {("a", "change"), ("c", "add")}


def test_watch_takes_up_a_step_cut_short(spark, tmp_path, monkeypatch):
    watch = Watch(spark, str(tmp_path / "watch"))
    table = lambda *paths: spark.createDataFrame([(p, 1, None) for p in paths], "path string, size_bytes long, modified_at timestamp")
    watch.advance(table("a", "b"), settled())
    with monkeypatch.context() as m:
        m.setattr(Watch, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            watch.advance(table("b", "c"), settled())
    assert Watch(spark, watch.base).advance(table("b", "c", "d"), settled()) == 2
    assert {(r.path, r.kind, r.step) for r in watch.changes().collect()} == {("a", "unlink", 1), ("c", "add", 1), ("d", "add", 2)}


def test_watch_feeds_the_debounced_queue(spark, tmp_path):
    watch = Watch(spark, str(tmp_path / "watch"))
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s, tzinfo=dt.timezone.utc)
    table = lambda rows: spark.createDataFrame(rows, "path string, size_bytes long, modified_at timestamp")
    watch.advance(table([("a", 1, at(0)), ("gone", 1, at(0))]), at(1))
    watch.advance(table([("a", 2, at(2))]), at(3))
    out = debounce.drained(watch.stream(), "path", "ts", str(tmp_path / "queue"), is_delete=F.col("kind") == "unlink").collect()
    assert {(r.path, r.kind) for r in out} == {("a", "change"), ("gone", "unlink")}


def test_watch_on_a_clock(spark, vault, tmp_path):
    watch = Watch(spark, str(tmp_path / "watch"))
    query = start_watching(watch, lambda: files.list_files(spark, vault), settle_ms=0)
    try:
        limit = time.time() + 60
        while watch._state()[0] < 0 and time.time() < limit:
            time.sleep(0.3)
        os.unlink(f"{vault}/hello.md")
        while not watch.changes().count() and time.time() < limit:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r.path, r.kind) for r in watch.changes().collect()] == [("hello.md", "unlink")]


# ---- streams ----


def test_change_stream_indexes_a_folder(spark, vault, tmp_path):
    spark.dataSource.register(files.ChangeStream)
    embedder = HashingEmbedder(8)
    store = IndexStore(spark, str(tmp_path / "ix"), embedder.model, 8)
    store.save(store.empty())

    def run():
        stream = spark.readStream.format("note_changes").option("path", vault).load()
        query = start_indexing(
            stream, store, embedder, lambda p: files.read_files(spark, vault, p), str(tmp_path / "cp"), availableNow=True
        )
        query.awaitTermination()

    time.sleep(0.2)
    run()
    docs = {r.doc_path for r in store.load().collect()}
    assert "hello.md" in docs and "empty.md" not in docs
    time.sleep(0.05)
    with open(vault + "/hello.md", "w") as f:
        f.write("replaced text\n")
    time.sleep(0.2)
    run()
    assert [r.text for r in store.load().filter("doc_path = 'hello.md'").collect()] == ["replaced text"]
    os.unlink(vault + "/hello.md")
    gone = files.removed_notes(store.load(), files.list_files(spark, vault))
    assert [r.doc_path for r in gone.collect()] == ["hello.md"]


def test_table_stream(spark, make, tmp_path):
    make({"a.md": "alpha\n", "b.md": "beta\n"}).write.parquet(str(tmp_path / "notes"))
    events = spark.createDataFrame([("a.md", "change"), ("a.md", "change"), ("gone.md", "unlink")], "path string, kind string")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    store = IndexStore(spark, str(tmp_path / "ix"), "hashing", 8)
    store.save(store.empty())
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    seen = []
    query = start_indexing(
        stream,
        store,
        HashingEmbedder(8),
        lambda p: changed_contents(p, spark.read.parquet(str(tmp_path / "notes"))),
        str(tmp_path / "cp"),
        after=lambda paths, epoch: seen.extend(sorted(r.path for r in paths.collect())),
        availableNow=True,
    )
    query.awaitTermination()
    assert [(r.doc_path, r.text) for r in store.load().collect()] == [("a.md", "alpha")]
    assert seen == ["a.md", "gone.md"]


def test_workflow_stream(spark, tmp_path):
    data = random_events(9, 0.4)
    events = spark.createDataFrame(data, "user long, seq long, name string")
    for i in range(3):
        events.filter(f"seq >= {i * 300} AND seq < {(i + 1) * 300}").coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        time.sleep(0.01)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    last = {}

    def keep(batch, epoch):
        last.update({r.user: (r.final_place, r.n_ok, r.n_rejected) for r in batch.collect()})

    query = workflow_states(stream, "user", ["seq"], "name").writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert last == {u: walk([n for v, _, n in data if v == u])[:3] for u in {d[0] for d in data}}


def test_busy_key_reaches_its_state_as_few_rows(spark):
    events = spark.createDataFrame([(1, i, ["search", "open_note", "hard_reset"][i % 3]) for i in range(3000)], "user long, seq long, name string")
    runs = folded(events, "user", ["seq"], "name").collect()
    assert 1 < len(runs) <= 8 and all(r.cleared for r in runs)
    assert [r.place for r in sorted(runs, key=lambda r: r.seq)][-1] == [0] * 4


# ---- tools ----


def test_tool_calls(spark, vault, tmp_path):
    space = Workspace(spark, vault, HashingEmbedder(16), str(tmp_path / "ix"))

    def call(tool, action, **args):
        text, failed = space.call(tool, action, **args)
        assert not failed, text
        return json.loads(text)["result"]

    assert "hello.md" in call("vault", "list") and call("vault", "list", directory="a") == ["a/b/c/deep.md"]
    assert call("vault", "create", path="n/new", content="# New\n\nfresh apples\n") == "Note created: n/new"
    assert space.call("vault", "create", path="n/new", content="x") == ("[NOTE_ALREADY_EXISTS] Note already exists: n/new", True)
    assert space.call("vault", "read", path="zz") == ("[NOTE_NOT_FOUND] Note not found: zz", True)
    assert space.call("vault", "read", path="../x")[0].startswith("[PATH_TRAVERSAL]")
    assert call("vault", "stat", path="n/new")["sizeBytes"] == 20
    assert call("vault", "create_from_template", path="t", template_path="_tpl/.dot", variables={"name": "Ann"}).endswith(": t")
    assert call("vault", "read", path="t") == "Ann\n"
    assert call("edit", "append", path="hello", heading="Mor", content="Added.")["message"].startswith("Note patched")
    assert call("vault", "read", path="hello").endswith("Text about apples.\n\nAdded.\n")
    diff = call("edit", "string_replace", path="hello", search_text="World", content="All", dry_run=True)["diff"]
    assert "-World" in diff and "World" in call("vault", "read", path="hello")
    batch = call("edit", "batch", operations=[
        {"path": "t", "operation": "append", "content": "B"},
        {"path": "t", "operation": "string_replace", "content": "x", "search_text": "nope"},
        {"path": "t", "operation": "append", "content": "C"},
    ])
    assert (batch["totalSucceeded"], batch["totalFailed"], batch["stoppedAtIndex"]) == (1, 1, 1)
    assert call("vault", "read", path="t") == "Ann\n\nB\n"
    assert call("view", "search", path="hello", query="apples")[0]["score"] == 0.7
    assert call("view", "global_search", query="about apples")[0]["path"] == "hello.md"
    call("system", "reindex")
    assert call("view", "semantic_search", query="fresh apples")[0]["doc_path"] == "n/new.md"
    assert call("view", "outline", path="hello")[1] == {"title": "More", "depth": 2, "index": 2}
    assert call("view", "read", path="hello", heading="more")["found"]
    assert json.loads(call("view", "frontmatter_get", path="daily/2024-01-01")["frontmatter"]) == {"tags": ["d"]}
    assert [r["found"] for r in call("view", "bulk_read", items=[{"path": "t"}, {"path": "q"}])["results"]] == [True, False]
    assert call("view", "backlinks", path="hello")["count"] == 1
    assert call("workflow", "transition", transition="search")["currentState"] == "exploring"
    assert space.call("workflow", "transition", transition="save")[0].startswith("[INVALID_STATE_TRANSITION]")
    assert len(call("workflow", "history")) == 1 and call("workflow", "reset") == {"currentState": "idle"}
    assert call("vault", "delete", path="t") == "Note deleted: t"
    status = call("system", "status")
    assert status["backlinkIndexSize"] == 2 and status["indexedDocuments"] > 3
    assert call("system", "overview")["total_files"] == 6


def test_files_outside_the_root_are_refused(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    (tmp_path / "secret.md").write_text("x")
    rows = spark.createDataFrame([("../escaped.md", "a"), ("/tmp/abs.md", "b"), ("ok.md", "c"), ("ok.md", "d"), (None, "e"), ("empty.md", None)], "path string, content string")
    got = {(r["path"], r["error_code"]) for r in files.write_files(str(root), rows).collect()}
    assert got == {("../escaped.md", "PATH_TRAVERSAL"), ("/tmp/abs.md", "PATH_TRAVERSAL"), ("ok.md", None), ("ok.md", "NOTE_ALREADY_EXISTS"), (None, "INVALID_NOTE_PATH"), ("empty.md", "INVALID_CONTENT")}
    assert not (tmp_path / "escaped.md").exists() and (root / "ok.md").read_text() == "c"
    asked = spark.createDataFrame([("../secret.md",), ("ok.md",)], "path string")
    assert {r["path"]: r["content"] for r in files.read_files(spark, str(root), asked).collect()} == {"../secret.md": None, "ok.md": "c"}
    gone = {r["path"]: r["error_code"] for r in files.delete_files(str(root), asked).collect()}
    assert gone == {"../secret.md": "PATH_TRAVERSAL", "ok.md": None} and (tmp_path / "secret.md").exists()


def test_many_files_use_more_than_one_task(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"n{i}.md").write_text("text")
    rows = files.read_files(spark, str(tmp_path), files.list_files(spark, str(tmp_path)))
    tasks = rows.selectExpr("spark_partition_id() AS p").distinct().count()
    assert tasks > 1 and rows.count() == 300


def test_reindexing_starts_a_new_log(spark, make, tmp_path):
    embedder = HashingEmbedder(8)
    store = IndexStore(spark, str(tmp_path / "ix"), embedder.model, 8)
    paths = spark.createDataFrame([("a.md",)], "path string")
    texts = lambda: {(r.doc_path, r.text) for r in store.load().collect()}
    store.save(build_index(make({"a.md": "one\n"}), embedder))
    store.write_changes(5, build_changes(paths, make({"a.md": "two\n"}), embedder), "old")
    store.save(build_index(make({"a.md": "three\n"}), embedder))
    assert texts() == {("a.md", "three")}
    store.write_changes(10**15, build_changes(paths, make({"a.md": "four\n"}), embedder), "api")
    store.write_changes(0, build_changes(paths, make({"a.md": "five\n"}), embedder), "stream")
    assert texts() == {("a.md", "five")} and store.has("a.md") and not store.has("b.md")
    for part in (tmp_path / "ix/vectors" / store._latest()["snapshot"]).glob("*.parquet"):
        part.write_bytes(b"broken")
    assert store.load().count() == 0
