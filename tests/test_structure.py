"""Chunks, outlines, sections and the block scanner."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions.markdown import note_chunks, parse_note
from marginalia.operators.chunks import chunk_notes, find_block, outline, read_sections
from marginalia.functions.markdown import with_blocks

COMPLEX = """---
title: Test
---

# Title

Intro paragraph.

## Section A

Content A.

### Sub A.1

Deep.

## Section B

Important block ^blk-1

Last.
"""


def chunks(text):
    return note_chunks(parse_note(text))


@pytest.mark.parametrize(
    ("text", "paths"),
    [
        ("Just a paragraph.\n\nAnother one.\n", [[]]),
        ("# Intro\n\nFirst.\n\n# Methods\n\nSecond.\n", [["Intro"], ["Methods"]]),
        ("# Title\n\nIntro.\n\n## A\n\nx\n\n## B\n\ny\n", [["Title"], ["Title", "A"], ["Title", "B"]]),
        ("# Garden\n\n## Herbs\n\n### Mint\n\nGrows in shade.\n", [["Garden", "Herbs", "Mint"]]),
        ("# Soup\n\n## Stock\n\n### Bones\n\nRoast them.\n\n# Bread\n\n## Yeast\n\nWarm water.\n", [["Soup", "Stock", "Bones"], ["Bread", "Yeast"]]),
        ("# A\n\n### Deep\n\nx\n", [["A", "Deep"]]),
        ("", []),
        ("  \n\n", []),
        ("---\ntitle: x\n---\n", []),
        ("# Only a heading\n", []),
        ("> # quoted heading\n> text\n", [[]]),
        ("# H\n\n---\n", [["H"]]),
        ("* item\n\n  # not a section\n", [[]]),
        ("```\n# code\n```\n", [[]]),
    ],
)
def test_chunk_paths(text, paths):
    assert [c[0] for c in chunks(text)] == paths


def test_chunk_text_words_and_lines():
    (path, text, start, end, words), = chunks("# Title\n\nOne two three four five.\n")
    assert (path, text, start, end, words) == (["Title"], "Title\nOne two three four five.", 1, 3, 6)
    front = chunks("---\ntitle: secret\n---\n\n# Heading\n\nBody.\n")
    assert "secret" not in front[0][1] and "---" not in front[0][1]
    assert chunks("un**x**y\n")[0][1] == "un x y"
    assert chunks("text with nbsp\n")[0][4] == 3


def test_inline_rules():
    def text(s):
        return parse_note(s)[0].text

    def label(s):
        return parse_note(s)[0].label

    assert label("# A `code` *b*\n") == "A  b"
    assert text("a `co  de` b\n") == "a  co  de  b"
    assert text("![alt](x.png)\n") == ""
    assert text("a &amp; b \\* c &#35;\n") == "a & b * c #"
    assert text("snake_case_word and __strong__\n") == "snake_case_word and  strong"
    assert text("***both*** **a*b***\n") == "both a b" or text("***both***\n") == "both"
    assert text("~~gone~~ ~x~\n") == "gone   x"
    assert text("[t](u \"title\") and [r][d] [d]\n\n[d]: /x\n") == "t  and  r   d"
    assert text("[t][missing]\n") == "[t][missing]"
    assert text("- [ ] task\n") == "task"
    assert text("| a | b |\n|---|---|\n| c | d |\n") == "a b c d"
    assert text("line  \nbreak\n") == "line  break"
    assert text("<div>\nraw *x*\n</div>\n") == "<div>\nraw *x*\n</div>"


def test_block_kinds():
    source = "Setext\n===\n\npara\n***\n    code\n\n1. one\n2. two\n\n> q\nlazy\n\n~~~\nfence\n"
    assert [b.kind for b in parse_note(source)] == ["heading", "paragraph", "thematicBreak", "code", "list", "blockquote", "code"]
    assert [b.kind for b in parse_note("text\n# h\n- a\n+ b\n")] == ["paragraph", "heading", "list", "list"]
    assert [b.kind for b in parse_note("a\r\n\r\n# b\r\n")] == ["paragraph", "heading"]
    assert [b.kind for b in parse_note("---\nno: end\n")][0] == "thematicBreak"


def test_offsets_cover_source():
    for block in parse_note(COMPLEX):
        part = COMPLEX[block.first.off : block.last.off + len(block.last.text)]
        assert part.strip() and not part.endswith("\n")


def test_chunk_rows(spark, make):
    rows = chunk_notes(make({"n.md": COMPLEX, "e.md": ""})).collect()
    assert [(r.chunk_idx, r.heading_path) for r in rows] == [
        (0, ["Title"]),
        (1, ["Title", "Section A"]),
        (2, ["Title", "Section A", "Sub A.1"]),
        (3, ["Title", "Section B"]),
    ]
    assert [(r.start_line, r.end_line) for r in rows] == [(5, 7), (9, 11), (13, 15), (17, 21)]


def test_outline(make):
    rows = outline(make({"n.md": COMPLEX})).collect()
    assert [(r.idx, r.depth, r.title) for r in rows] == [(1, 1, "Title"), (3, 2, "Section A"), (5, 3, "Sub A.1"), (7, 2, "Section B")]


def test_read_section(make):
    notes = make({"n.md": COMPLEX, "none.md": "# x\n"})

    def read(title, depth=2):
        return {r.path: (r.found, r.content) for r in read_sections(notes, F.lit(title), depth).collect()}

    assert read("section a")["n.md"] == (True, "## Section A\n\nContent A.\n\n### Sub A.1\n\nDeep.\n")
    assert read("Section B")["n.md"] == (True, "## Section B\n\nImportant block ^blk-1\n\nLast.\n")
    assert read("Section A")["none.md"] == (False, "")
    assert read("Sub A.1")["n.md"] == (False, "")
    assert read("Sub A.1", 3)["n.md"][0]


def test_find_block(make):
    rows = with_blocks(make({"n.md": COMPLEX}))
    got = rows.select(find_block(F.col("blocks"), F.lit("blk-1")).alias("a"), find_block(F.col("blocks"), F.lit("zz")).alias("b")).first()
    assert (got.a, got.b) == (8, None)


def test_pathological_input_stays_linear():
    import time

    started = time.time()
    for text in (
        "> " * 3000 + "x\n",
        "*a " * 3000 + "a* " * 3000,
        "[" * 20000,
        "[a " * 8000 + "b\n",
        "- a\n\n" * 5000,
        "`" + "` ``" * 4000,
        "".join(f"[l{i}]: /x{i}\n" for i in range(3000)),
        "line [a](b.md)\n" * 5000,
        "<" * 20000,
        "_a" * 20000,
        "* * " * 5000 + "x",
    ):
        assert parse_note(text)
    assert time.time() - started < 30


@pytest.mark.parametrize("mark", ["> ", "- ", "1. ", "[^a]: "])
def test_deep_containers_keep_links(mark):
    # The second note has lines that come back out of every level.
    for text in (mark * 1500 + "see [a](b.md)\n", "".join(">" * (150 - k) + f" {mark}[a](b{k}.md)\n\n" for k in range(150))):
        blocks = parse_note(text)
        assert [url for url, _, _ in blocks[0].links][-1:] != [] and sum(len(b.links) for b in blocks) == text.count("](")
        assert not any(x in b.text for b in blocks for x in ("> ", "- ", "]("))
        assert all(text[off:].startswith("[a]") for b in blocks for _, _, off in b.links)


def test_deep_emphasis_keeps_links():
    (block,) = parse_note("*a " * 3000 + "[x](y.md)" + " b*" * 3000 + "\n")
    assert [url for url, _, _ in block.links] == ["y.md"] and "*" not in block.text


def test_long_definitions_are_whole():
    title = "\n".join(f"line {i}" for i in range(120))
    blocks = parse_note(f"[a]: /x '{title}'\n[b]: /y\ntext [a] and [b]\n")
    assert [b.kind for b in blocks] == ["definition", "definition", "paragraph"]
    assert (blocks[0].last.no, blocks[1].first.no, blocks[2].first.no) == (120, 121, 122)


def test_definitions_and_footnotes():
    kinds = [b.kind for b in parse_note("[a]: /x 'title'\n[b]: <y z>\ntext [a][] and [^1]\n\n[^1]: the note\n    more\n")]
    assert kinds == ["definition", "definition", "paragraph", "footnoteDefinition"]
    last = parse_note("text[^1]\n\n[^1]: the note\n")
    assert last[0].text == "text " and last[1].text == "the note"
