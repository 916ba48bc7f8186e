"""Line differences as tables, applied back to the old version."""

import random
from itertools import combinations

from marginalia.operators.diff import hunks, increasing, line_changes


def applied(old, changes):
    """The new version from the old one: removed lines go, added ones take their places."""
    lines = (old or "").split("\n")
    gone = {r.line_number: r.text for r in changes if r.kind == "-"}
    assert all(lines[n - 1] == text for n, text in gone.items())
    out = [x for n, x in enumerate(lines, 1) if n not in gone]
    for r in sorted((r for r in changes if r.kind == "+"), key=lambda r: r.line_number):
        out.insert(r.line_number - 1, r.text)
    return "\n".join(out)


def test_longest_increasing_run():
    rng = random.Random(3)
    for _ in range(60):
        values = rng.sample(range(9), rng.randrange(9))
        kept = [v for v, k in zip(values, increasing(values), strict=True) if k]
        best = next(n for n in range(len(values), -1, -1) if any(list(c) == sorted(c) for c in combinations(values, n)))
        assert kept == sorted(kept) and len(kept) == best


def test_changes_lead_from_old_to_new(spark):
    rng = random.Random(11)
    rows = [("same", "a\nb", "a\nb"), ("null", None, "x"), ("gone", "x\ny", None), ("nulls", None, ""), ("tail", "a\n", "a"), ("swap", "a\nb\nc", "c\nb\na")]
    for i in range(80):
        old = [rng.choice("abcdefghij" if i % 2 else "ab") for _ in range(rng.randrange(30))]
        new = list(old)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = [rng.choice("abxyz") for _ in range(rng.randrange(3))]
        rows.append((f"r{i}", "\n".join(old), "\n".join(new)))
    got = line_changes(spark.createDataFrame(rows, "path string, old_content string, content string")).collect()
    for path, old, new in rows:
        own = [r for r in got if r.path == path]
        assert applied(old, own) == (new or ""), path
        assert bool(own) == ((old or "") != (new or ""))


def test_hunks_of_a_small_edit(spark):
    old = "\n".join(f"line {i}" for i in range(40))
    new = old.replace("line 5\n", "five\nfive and a half\n").replace("line 30\n", "")
    changes = line_changes(spark.createDataFrame([("n", old, new)], "path string, old_content string, content string"))
    got = sorted((r.n_removed, r.removed_from, r.n_added, r.added_from) for r in hunks(changes).collect())
    assert got == [(1, 6, 2, 6), (1, 31, 0, None)]


def test_lines_are_not_shuffled(spark):
    rows = spark.createDataFrame([("n", "a\nb", "a\nc"), ("n", "x", "y")], "path string, old_content string, content string")
    changes = line_changes(rows)
    assert "Exchange" not in changes._jdf.queryExecution().executedPlan().toString()
    # Two versions of one path stay two differences.
    assert sorted((r.kind, r.text) for r in changes.collect()) == [("+", "c"), ("+", "y"), ("-", "b"), ("-", "x")]
