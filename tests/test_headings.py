"""Headings as Spark expressions against the parser, on random notes."""

import random
import time

import pytest

from marginalia.functions.markdown import parse_note
from marginalia.operators.headings import heading_trails


def parsed(text):
    trail, out = {}, []
    for block in parse_note(text):
        if block.kind == "heading":
            trail = {d: t for d, t in trail.items() if d < block.depth} | {block.depth: block.label}
            out.append((block.first.no, block.depth, block.label, list(trail.values())))
    return out


def note(seed):
    """Front matter, headings, fences of both kinds with headings inside, paragraphs and rules."""
    draw, lines = random.Random(seed), []
    if draw.random() < 0.3:
        lines += ["---", "title: x", "# not a heading", "---"]
    words = lambda: " ".join(draw.choice(["alpha", "beta", "gamma 1", "ü"]) for _ in range(draw.randint(1, 3)))
    for _ in range(draw.randint(0, 14)):
        pick = draw.randint(0, 8)
        if pick <= 2:
            lines.append(" " * draw.randint(0, 3) + "#" * draw.randint(1, 7) + draw.choice([" ", "  ", "\t", ""]) + words() + draw.choice(["", " #", " ## "]))
        elif pick == 3:
            lines += [words() for _ in range(draw.randint(1, 3))] + [draw.choice(["===", "---", "-", "=", "  ==  ", "----"])] + [""] * draw.randint(1, 2)
        elif pick == 4:
            mark = draw.choice(["```", "~~~", "````"])
            lines += [mark + draw.choice(["", "python"]), "# inside", "", "under", "===", draw.choice(["``", "~~", "x"])] + ([mark + draw.choice(["", " "])] if draw.random() < 0.9 else [])
        elif pick == 5:
            lines += ["", draw.choice(["---", "***", "- - -"]), ""]
        elif pick == 6:
            lines += [words(), words(), ""]
        elif pick == 7:
            lines += ["> quoted", "", "- item", "", "1. one", "", "words that close the list", "", "    # code", ""]
        else:
            lines.append("")
    return draw.choice(["\n", "\r\n"]).join(lines) + draw.choice(["", "\n"])


def test_headings_equal_the_parser(spark):
    texts = [note(seed) for seed in range(500)] + ["", "#", "# a", "a\n=", "---\n# x", "``` a`b\n# h", "~~~\n# h"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", None)], "path string, content string")
    got = {}
    for r in heading_trails(rows).collect():
        got.setdefault(r.path, []).append((r.line, r.depth, r.title, r.heading_path))
    wrong = {i: (t, sorted(got.get(str(i), [])), parsed(t)) for i, t in enumerate(texts) if sorted(got.get(str(i), [])) != parsed(t)}
    assert not wrong, (len(wrong), next(iter(wrong.values())))
    assert "none" not in got and sum(map(len, got.values())) > 1000


@pytest.mark.parametrize("text", ["".join(f"## Part {i}\n\ntext {i}\n\n" for i in range(50_000)), "".join(f"```\n# {i}\n```\n\ntitle\n===\n\n" for i in range(20_000))])
def test_long_notes(spark, text):
    started = time.time()
    n = heading_trails(spark.createDataFrame([("a", text)], "path string, content string")).count()
    assert n in (50_000, 20_000) and time.time() - started < 60
