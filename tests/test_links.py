"""Link extraction, resolution, backlinks, overview and fuzzy matching."""

import datetime as dt
import random
import re
import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from marginalia.functions.arrays import running
from marginalia.operators import fuzzy, links, overview
from marginalia.operators.links import backlinks, backlinks_of, resolve, update_sources

FILES = [
    "inbox/note.md",
    "projects/alpha/architecture.md",
    "projects/beta/architecture.md",
    "daily/2024-01-01.md",
    "archive/old/deep/architecture.md",
    "ab/note.md",
    "templates/readme.md",
    "readme.md",
]


@pytest.mark.parametrize(
    ("target", "expected"),
    [
        ("2024-01-01", "daily/2024-01-01.md"),
        ("README", "readme.md"),
        ("architecture", "projects/alpha/architecture.md"),
        ("beta/architecture", "projects/beta/architecture.md"),
        ("Beta/Architecture.md", "projects/beta/architecture.md"),
        ("note#heading", "ab/note.md"),
        ("note.md#^block", "ab/note.md"),
        ("b/note", "ab/note.md"),
        ("x/note", "inbox/note.md"),
        ("q/note", None),
        ("missing", None),
        ("#only-anchor", None),
        ("/readme", "templates/readme.md"),
    ],
)
def test_resolution(spark, target, expected):
    listing = spark.createDataFrame([(f,) for f in FILES], "path string")
    rows = spark.createDataFrame([(1, target)], "id long, target string")
    assert resolve(rows, listing, ["id"]).first().resolved == expected


def test_resolution_matches_brute_force(spark):
    files = [f"{a}/{b}/n{i}.md" for i in range(4) for a in ("x", "yx", "Z") for b in ("p", "qp")]
    targets = [f"{d}n{i}" for i in range(5) for d in ("", "p/", "x/qp/", "X/P/", "q/")]

    def best(target):
        if "/" in target:
            found = [f for f in files if f.lower().endswith(target.lower() + ".md")]
        else:
            found = [f for f in files if f.rsplit("/", 1)[1].lower() == target.lower() + ".md"]
        return min(found, key=lambda f: (f.count("/"), f.lower())) if found else None

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(targets * 3)], "id long, target string")
    listing = spark.createDataFrame([(f,) for f in files], "path string")
    got = resolve(rows, listing, ["id"]).collect()
    assert len(got) == len(targets) * 3
    assert all(r.resolved == best(r.target) for r in got)


def edges(df):
    return sorted((r.target_key, r.source_path, r.line_number, r.link_type) for r in df.collect())


def test_backlinks(make):
    notes = make(
        {
            "a.md": "# A\n\ntext\n\nsee [[B]] and [[b|alias]] or [b doc](b.md)\n",
            "B.md": "self [[b]] and [up](sub/../A.md#x) ![img](a.md) [ext](https://x.org) [m](mailto:x@y.z)\n",
            "sub/c.md": "```\n[[a]] [no](../a.md)\n```\n\n[yes](../a.md?q) [[ghost#part]] [[#h]]\n",
        }
    )
    assert edges(backlinks(notes)) == [
        ("#h", "sub/c.md", 5, "wikilink"),
        ("a", "B.md", 1, "markdown_link"),
        ("a", "sub/c.md", 2, "wikilink"),
        ("a", "sub/c.md", 5, "markdown_link"),
        ("b", "a.md", 5, "markdown_link"),
        ("b", "a.md", 5, "wikilink"),
        ("b", "a.md", 5, "wikilink"),
        ("ghost#part", "sub/c.md", 5, "wikilink"),
    ]
    found = backlinks_of(backlinks(notes), "B.md")
    assert found.count() == 3
    assert "see [[B]] and" in found.filter("link_type = 'wikilink'").orderBy("context").collect()[0].context


def test_link_positions_inside_containers(make):
    text = "# T\n\n* one\n  * two [x](p.md)\n\n> quote [y](q.md)\n\n| [z](r.md) | b |\n|---|---|\n"
    rows = links.markdown_links(make({"n.md": text})).collect()
    assert [(r.url, r.line) for r in rows] == [("p.md", 4), ("q.md", 6), ("r.md", 8)]
    assert all(text[r.off :].startswith("[") for r in rows)


def test_many_links_in_one_note(make):
    text = "\n".join(f"line {i} [[n{i % 7}]]" for i in range(500))
    rows = links.wikilinks(make({"big.md": text})).collect()
    assert [r.line for r in rows] == list(range(1, 501))
    assert all(text[r.off :].startswith(f"[[{r.target}]]") for r in rows)


def test_update_sources(spark, make):
    notes = make({"a.md": "[[b]] [[c]]\n", "b.md": "[[a]]\n", "c.md": "[[a]]\n"})
    changed = spark.createDataFrame([("a.md", "[[c]]\n"), ("b.md", None)], "path string, content string")
    assert edges(update_sources(backlinks(notes), changed, notes)) == [("a", "c.md", 1, "wikilink"), ("c", "a.md", 1, "wikilink")]
    assert [r.path for r in links.orphans(notes.select("path"), backlinks(make({"a.md": "[[b]]", "b.md": ""}))).collect()] == ["a.md", "c.md"]


def stamp(day):
    return dt.datetime(2024, 1, day)


def test_overview(spark):
    rows = [
        ("root.md", stamp(1)),
        ("l1/a.md", stamp(2)),
        ("l1/b.md", stamp(3)),
        ("l1/l2/l3/l4/deep.md", stamp(4)),
        (".obsidian/x.md", stamp(5)),
        ("node_modules/y.md", stamp(6)),
    ]
    listing = spark.createDataFrame(rows, "path string, modified_at timestamp")
    found = {r.path: (r.parent_path, r.depth, r.file_count, r.last_modified) for r in overview.folders(listing).collect()}
    assert found == {
        ".": (None, 0, 1, stamp(1)),
        "l1": (".", 1, 2, stamp(3)),
        "l1/l2": ("l1", 2, 0, None),
        "l1/l2/l3": ("l1/l2", 3, 0, None),
    }
    assert overview.total_files(listing).first().total_files == 4
    tree = overview.nest([r.asDict() for r in overview.in_folder_order(overview.folders(listing)).collect()], 4)
    assert [f["path"] for f in tree["folders"]] == ["."] and tree["folders"][0]["children"][0]["path"] == "l1"
    rootless = overview.folders(listing.filter("path <> 'root.md'"))
    assert [f["path"] for f in overview.nest([r.asDict() for r in rootless.collect()], 3)["folders"]] == ["l1"]
    assert overview.folders(listing, 0).collect()[0].path == "."


def test_fuzzy(spark):
    titles = ["Introduction", "Getting Started", "Installation", "Configuration", "API Reference", "FAQ"]
    table = spark.createDataFrame(list(enumerate(titles)), "pos long, text string")

    def best(q, t=0.6):
        row = fuzzy.best_matches(table, "text", [q], "pos", t).first()
        return row and (row["match"], row["distance"])

    assert best("Introducton") == ("Introduction", 1)
    assert best("getting startd") == ("Getting Started", 1)
    assert best("faq") == ("FAQ", 0)
    assert best("xyz") is None
    assert best("Instalation", 0.99) is None
    found = fuzzy.all_matches(spark.createDataFrame([("cat",), ("car",), ("bat",), ("cart",)], "t string"), "t", ["cat"], 0.6).collect()
    assert {r.t: r.distance for r in found} == {"cat": 0, "car": 1, "bat": 1, "cart": 1}
    row = spark.range(1).select(fuzzy.best_of(F.lit("prt 0"), F.array(F.lit("Part 1"), F.lit("Part 0"))).alias("m")).first()
    assert row.m == "Part 0"


def test_folders_come_in_locale_order(spark):
    rows = spark.createDataFrame([(f"{d}/x.md", 1) for d in ("b", "A", "é", "a", "_z", "B")], "path string, size_bytes long").selectExpr("path", "size_bytes", "timestamp'2024-01-01' AS modified_at")
    got = [r["path"] for r in overview.in_folder_order(overview.folders(rows)).collect() if r["path"] != "."]
    assert got == ["_z", "a", "A", "b", "B", "é"]


def test_kept_links_follow_targets_like_a_full_rebuild(spark, make):
    before = {"a.md": "see [[new]] and [[b]]\n", "b.md": "[a](a.md) [[gone]]\n", "gone.md": "x\n"}
    after = {"a.md": before["a.md"], "b.md": "only [[gone]] now\n", "sub/new.md": "back to [[a]]\n"}
    changed = spark.createDataFrame([("b.md", after["b.md"]), ("gone.md", None), ("sub/new.md", after["sub/new.md"])], "path string, content string")
    kept = links.update_links(links.all_links(make(before)), changed)
    got = sorted(map(tuple, links.edges_of(kept, make(after)).collect()))
    assert got == sorted(map(tuple, links.backlinks(make(after)).collect()))
    assert ("sub/new", "a.md") in {(x[0], x[1]) for x in got}


def test_wikilinks_equal_a_plain_scan(spark):
    draw, form = random.Random(3), re.compile(links.WIKILINK)
    parts = ["[[", "]]", "|", "a", "b\n", "x y ", "ü", "𝒳", "[[n]]", "[[a|b]]", "]"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(300)] + ["", None]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    found = links.wikilinks(rows)
    got = sorted((int(r.path), r.off, r.line, r.target, r.context) for r in found.collect())
    want = [
        (i, m.start(), t.count("\n", 0, m.start()) + 1, m.group(1), t[max(m.start() - 30, 0) : m.end() + 30].replace("\n", " "))
        for i, t in enumerate(texts) for m in form.finditer(t or "")
    ]
    assert got == want and len(got) > 1000
    assert "ArrowEvalPython" not in found._jdf.queryExecution().toString()


def test_many_links_in_one_note(spark):
    text = "".join(f"line {i} [[note {i}|x]] more\n" for i in range(100_000))
    started = time.time()
    row = links.wikilinks(spark.createDataFrame([("b", text)], "path string, content string")).agg(F.count("*").alias("n"), F.max("off").alias("off"), F.max("line").alias("line")).first()
    assert (row.n, row.off, row.line) == (100_000, text.rfind("[["), 100_000) and time.time() - started < 60


def test_running_sums(spark):
    rows = [(n, [(7 * i) % 11 for i in range(n)]) for n in (0, 1, 31, 32, 33, 1023, 1024, 1025, 5000)]
    for r in spark.createDataFrame(rows, "n int, x array<int>").select("x", running(F.col("x")).alias("s")).collect():
        assert r.s == [0, *accumulate(r.x)][: len(r.x)]


def test_kept_links_follow_their_targets(spark):
    """Random changes: links of touched names only are resolved again, and the result equals a full rebuild."""
    draw = random.Random(8)
    make = lambda notes: spark.createDataFrame(sorted(notes.items()), "path string, content string")
    folders, names = ["", "a/", "b/", "a/c/"], ["n1", "n2", "N3", "x.y"]
    text = lambda: " ".join(f"[[{draw.choice(['', 'a/', 'c/', 'zz/'])}{draw.choice(names)}{draw.choice(['', '#h', '.md'])}]]" for _ in range(3)) + " [t](a/n1.md)"
    notes = {f + n + ".md": text() for f in folders for n in names if draw.random() < 0.5}
    listing = lambda: make(notes).select("path")
    kept = links.resolved_links(links.all_links(make(notes)), listing())
    rows = lambda edges: sorted(tuple(r) for r in edges.collect())
    for _ in range(3):
        every = [f + n + ".md" for f in folders for n in names]
        vanished = [p for p in sorted(notes) if draw.random() < 0.3]
        appeared = [p for p in every if p not in notes and draw.random() < 0.3]
        edited = [p for p in sorted(notes) if p not in vanished and draw.random() < 0.2]
        notes = {p: t for p, t in notes.items() if p not in vanished} | {p: text() for p in appeared + edited}
        changed = spark.createDataFrame([(p, notes[p]) for p in appeared + edited] + [(p, None) for p in vanished], "path string, content string")
        paths = lambda x: spark.createDataFrame([(p,) for p in x], "path string")
        kept = links.follow_changes(kept, changed, paths(appeared), paths(vanished), listing())
        assert rows(links.edges_from(kept)) == rows(links.backlinks(make(notes)))


def test_similar_join_equals_all_pairs(spark):
    draw = random.Random(4)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 9))) for _ in range(160)]
    left = spark.createDataFrame([(w, i) for i, w in enumerate([*words[:70], None, words[0]])], "q string, i int")
    right = spark.createDataFrame([(w.upper(),) for w in words[70:]] + [(None,)], "t string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for threshold in (0.3, 0.6, 1.0):
        got = sorted((r.q, r.i, r.t, r.distance) for r in fuzzy.join_similar(left, "q", right, "t", threshold).collect())
        pairs = [(a, i, b.upper(), distance(a, b)) for i, a in enumerate([*words[:70], None, words[0]]) if a is not None for b in words[70:]]
        assert got == sorted(p for p in pairs if p[3] <= (1 - threshold) * max(len(p[0]), len(p[2])) + 1e-9)
    plan = fuzzy.join_similar(left, "q", right, "t")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        fuzzy.join_similar(left, "q", right, "t", 0)
