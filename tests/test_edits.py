"""Edits, batches, front matter, templates and note tables."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.errors import BatchLimitExceeded
from marginalia.functions.frontmatter import dump_yaml, frontmatter_json, load_yaml, merge_frontmatter, set_frontmatter
from marginalia.functions.text import render_template
from marginalia.operators import edits, notes

SAMPLE = "\n".join(f"line {i}" for i in range(1, 9))
NOTE = "# Title\n\nIntro.\n\n## Section A\n\nContent A.\n\n### A.1\n\nDeep.\n\n## Section B\n\nContent B. ^blk\n"


def lines(spark, start, end, new):
    row = spark.range(1).select(edits.line_replace(F.lit(SAMPLE), F.lit(start), F.lit(end), F.lit(new)).alias("r")).first().r
    return row.content, row.error


def test_line_replace(spark):
    assert lines(spark, 2, 3, "a\nb\nc")[0].split("\n")[:5] == ["line 1", "a", "b", "c", "line 4"]
    assert lines(spark, 1, 8, "only") == ("only", None)
    assert lines(spark, 0, 99, "x")[1].endswith("startLine must be >= 1, got 0")
    assert lines(spark, 9, 9, "x")[1].endswith("endLine 9 exceeds file length (8 lines)")
    assert lines(spark, 3, 2, "x")[1].endswith("startLine (3) must be <= endLine (2)")


def test_string_replace(spark):
    def run(text, search, new, every=False):
        row = spark.range(1).select(edits.string_replace(F.lit(text), F.lit(search), F.lit(new), F.lit(every)).alias("r")).first().r
        return row.content or row.error

    assert run("a.b a.b", "a.b", "$1\\x") == "$1\\x a.b"
    assert run("a.b a.b", "a.b", "c", True) == "c c"
    assert run("axb", "a.b", "c") == 'Freeform edit failed: Search string not found: "a.b"'


PATCHES = [
    ("append", {"heading": "Section A"}, "### A.1\n\nDeep.\n\nNEW\n\n## Section B"),
    ("prepend", {"heading": "Section A"}, "## Section A\n\nNEW\n\nContent A."),
    ("replace", {"heading": "Section A"}, "## Section A\n\nNEW\n\n## Section B"),
    ("append", {"heading": "Sectoin B"}, "Content B. ^blk\n\nNEW\n"),
    ("append", {"block_id": "blk"}, "^blk\n\nNEW\n"),
    ("prepend", {"block_id": "blk"}, "## Section B\n\nNEW\n\nContent B. ^blk\n"),
    ("replace", {"block_id": "blk"}, "## Section B\n\nNEW\n"),
    ("append", {}, "^blk\n\nNEW\n"),
    ("prepend", {}, "NEW\n\n# Title"),
    ("replace", {}, "NEW\n"),
]


@pytest.mark.parametrize(("operation", "target", "part"), PATCHES)
def test_patch(make, operation, target, part):
    cols = {k: F.lit(v) for k, v in target.items()}
    row = edits.patch(make({"n.md": NOTE}), operation, F.lit("NEW\n"), **cols).first()
    assert row.error_code is None and part in row.content
    op = {f: None for f in edits.OP_FIELDS} | {"operation": operation, "content": "NEW\n"} | target
    assert edits.apply_operation(NOTE, op) == row.content


def test_patch_same_in_both_forms(make):
    rng = random.Random(1)
    bodies = {}
    for n in range(12):
        parts = [f"{'#' * rng.randint(1, 3)} H{rng.randint(0, 3)}\n\n{'text ' * rng.randint(0, 3)}\n" for _ in range(rng.randint(0, 5))]
        bodies[f"n{n}.md"] = ("---\na: 1\n---\n\n" if n % 3 == 0 else "") + "\n".join(parts)
    for operation in ("append", "prepend", "replace"):
        for target in ({"heading": "H1"}, {}):
            cols = {k: F.lit(v) for k, v in target.items()}
            op = {f: None for f in edits.OP_FIELDS} | {"operation": operation, "content": "x\n\ny"} | target
            for row in edits.patch(make(bodies), operation, F.lit("x\n\ny"), **cols).collect():
                try:
                    assert edits.apply_operation(bodies[row.path], op) == row.content
                except edits.HeadingNotFound:
                    assert row.error_code == "HEADING_NOT_FOUND"


def test_patch_missing_targets(make):
    notes_ = make({"n.md": NOTE, "f.md": "---\nk: v\n---\n\nBody.\n"})
    codes = {r.path: r.error_code for r in edits.patch(notes_, "append", F.lit("x"), heading=F.lit("Zzzzzz")).collect()}
    assert codes == {"n.md": "HEADING_NOT_FOUND", "f.md": "HEADING_NOT_FOUND"}
    assert edits.patch(notes_, "append", F.lit("x"), block_id=F.lit("q")).first().error_code == "BLOCK_NOT_FOUND"
    after = {r.path: r.content for r in edits.patch(notes_, "prepend", F.lit("Top.")).collect()}
    assert after["f.md"] == "---\nk: v\n---\n\nTop.\n\nBody.\n"


def ops_table(spark, rows):
    fields = "batch_id long, seq int, path string, operation string, content string, search_text string, start_line int, end_line int"
    return spark.createDataFrame(rows, fields)


def test_batch(spark, make):
    base = make({"a.md": "one two\n", "b.md": "three\n"})
    rows = [
        (1, 0, "a.md", "string_replace", "ONE", "one", None, None),
        (1, 1, "b.md", "append", "more", None, None, None),
        (1, 2, "a.md", "string_replace", "TWO", "two", None, None),
        (2, 0, "a.md", "string_replace", "x", "one", None, None),
        (2, 1, "b.md", "line_replace", "x", None, 5, 9),
        (2, 2, "b.md", "append", "never", None, None, None),
        (3, 0, "gone.md", "append", "x", None, None, None),
        (4, 0, "a.md", "frontmatter_set", "{bad", None, None, None),
        (5, 0, "a.md", "line_replace", "x", None, None, None),
    ]
    ops = ops_table(spark, rows)
    done = edits.batch_edit(base, ops)
    got = {(r.batch_id, r.seq): (r.status, r.error) for r in done.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0), (4, 0), (5, 0)}
    assert got[2, 1][1].startswith("Freeform edit failed: endLine 9")
    assert got[3, 0] == ("error", "Note not found: gone.md")
    assert got[4, 0] == ("error", "Invalid frontmatter payload: content is not valid JSON")
    assert got[5, 0][1] == "startLine and endLine are required for line_replace"
    after = {(r.batch_id, r.path): r.content for r in edits.final_contents(done).collect()}
    assert after == {(1, "a.md"): "ONE TWO\n", (1, "b.md"): "three\n\nmore\n", (2, "a.md"): "x two\n"}
    totals = {r.batch_id: (r.total_requested, r.total_succeeded, r.total_failed, r.stopped_at) for r in edits.batch_summary(done, ops).collect()}
    assert totals[1] == (3, 3, 0, None) and totals[2] == (3, 1, 1, 1)


def test_batch_dry_run_and_limit(spark, make):
    base = make({"a.md": "one two\n"})
    rows = [(1, i, "a.md", "string_replace", "X", w, None, None) for i, w in enumerate(["one", "two"])]
    rows += [(9, i, "a.md", "append", "x", None, None, None) for i in range(51)]
    got = edits.batch_edit(base, ops_table(spark, rows), dry_run=True).orderBy("batch_id", "seq").collect()
    assert [r.content for r in got[:2]] == ["X two\n", "one X\n"]
    assert "-one two" in got[0].diff and "+X two" in got[0].diff
    assert [r.error for r in got[2:]] == ["Batch limit exceeded: 51 operations requested, max 50 allowed"]
    with pytest.raises(BatchLimitExceeded):
        edits.check_batch_size(51)


def test_diff_of_nothing():
    assert edits.diff_text("n.md", "same\n", "same\n") == ""
    assert "\\ No newline at end of file" in edits.diff_text("n.md", "a", "b")


def test_yaml_rules():
    data = load_yaml("a: yes\nb: true\nc: 012\nd: 2024-01-02\ne: 1.5\nf: ~\ng: [1, x]\nh: 1:30\n")
    assert data["a"] == "yes" and data["b"] is True and data["c"] == 12 and data["e"] == 1.5 and data["f"] is None
    assert data["g"] == [1, "x"] and data["h"] == "1:30"
    assert dump_yaml({"t": ["a", "b"], "s": "true", "n": 1, "é": "ü"}) == "t:\n  - a\n  - b\ns: 'true'\nn: 1\né: ü"
    assert load_yaml("just text") == {}


def test_frontmatter(spark, make):
    base = make({"y.md": "---\ntags: [a]\nd: 2024-01-02\n---\n\nBody *kept*.\n", "n.md": "Body.\n", "bad.md": "---\na: [\n---\n", "e.md": "---\n---\n"})
    got = {r.path: r.f for r in base.select("path", frontmatter_json("content").alias("f")).collect()}
    assert got["y.md"] == '{"tags": ["a"], "d": "2024-01-02T00:00:00.000Z"}'
    assert got["n.md"] == "{}" and got["e.md"] == "{}" and got["bad.md"] is None
    assert merge_frontmatter("---\na: 1\nb: 2\n---\n\nBody *kept*.\n", {"b": 3, "c": [1]}) == "---\na: 1\nb: 3\nc:\n  - 1\n---\n\nBody *kept*.\n"
    assert merge_frontmatter("Body.\n", {"a": 1}) == "---\na: 1\n---\n\nBody.\n"
    codes = base.filter("path = 'n.md'").select(set_frontmatter("content", F.lit("{nope")).alias("r")).first().r
    assert codes.error_code == "INVALID_FRONTMATTER_PAYLOAD"
    codes = base.filter("path = 'bad.md'").select(set_frontmatter("content", F.lit("{}")).alias("r")).first().r
    assert codes.error_code == "AST_PATCH_FAILED"


def test_template(spark):
    def render(text, **values):
        pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
        variables = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return spark.createDataFrame([(text,)], "t string").select(render_template(F.col("t"), variables).alias("r")).first().r

    assert render("{{a}} and {{ b }}!", a="1", b="2") == "1 and 2!"
    assert render("{{a}}{{a}}{{c}}", a="{{c}}", c="$0") == "{{c}}{{c}}$0"
    assert render("{{toString}} {{x y}}") == "{{toString}} {{x y}}"
    assert render("") == ""


def test_note_tables(spark, make):
    base = make({"a.md": "A\n\n## H\n\nx\n", "b.md": "B"})
    items = spark.createDataFrame(
        [(0, "b.md", None, None), (1, "a.md", "h", None), (2, "a.md", "zz", None), (3, "q.md", "h", None), (4, "b.md", None, None)],
        "pos long, path string, heading string, heading_depth int",
    )
    rows = notes.bulk_read(base, items).orderBy("pos").collect()
    assert [r.content for r in rows] == ["B", "## H\n\nx\n", None, None, "B"]
    assert [r.error for r in rows] == [None, None, 'Heading "zz" not found in a.md', "Note not found: q.md", None]
    new = make({"b.md": "new", "c.md": "C"})
    assert {r.path: r.error_code for r in notes.create_notes(base, new).collect()} == {"b.md": "NOTE_ALREADY_EXISTS", "c.md": None}
    state = notes.upsert_notes(base, new)
    assert {r.path: r.content for r in state.collect()}["b.md"] == "new" and state.count() == 3
    assert [r.path for r in notes.delete_notes(base, new).collect()] == ["a.md"]
    assert [r.path for r in notes.missing(base, new.select("path")).collect()] == ["c.md"]
    read = notes.read_notes(base, new.select("path")).collect()
    assert {r.path: r.error_code for r in read} == {"b.md": None, "c.md": "NOTE_NOT_FOUND"}


def test_unknown_operations_and_missing_content_are_row_errors(spark, make):
    notes = make({"a.md": "# A\n\ntext\n"})
    ops = spark.createDataFrame([(1, 1, "a.md", "explode", "new"), (2, 1, "a.md", "append", None), (3, 1, "a.md", "append", "more")], "batch_id int, seq int, path string, operation string, content string")
    got = {r["batch_id"]: r for r in edits.batch_edit(notes, ops).collect()}
    assert "unknown operation explode" in got[1]["error"] and got[2]["error"] == "content is required"
    assert got[1]["content"] is None and got[3]["status"] == "success"
