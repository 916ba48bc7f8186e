"""Block structure of a markdown note, as an Arrow function.

This is the one place where text has to be parsed outside the JVM. It only
turns a note into a flat array of top-level blocks or of chunks; outlines,
sections, search and edits are built from those arrays with Spark expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Generator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.batches import by_pieces
from marginalia.functions.inline import body_text, label_key, link_nodes, parse_inline, plain_text

BLOCKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("heading_path", T.ArrayType(T.StringType())),
            T.StructField("start_line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
            T.StructField("start_off", T.IntegerType()),
            T.StructField("end_off", T.IntegerType()),
        ]
    )
)
CHUNKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk_idx", T.IntegerType()),
            T.StructField("heading_path", T.ArrayType(T.StringType())),
            T.StructField("text", T.StringType()),
            T.StructField("start_line", T.IntegerType()),
            T.StructField("end_line", T.IntegerType()),
            T.StructField("word_count", T.IntegerType()),
        ]
    )
)
# The white space that separates words and is trimmed.
TRIMMED = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD = re.compile(f"[^{TRIMMED}]+")

LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|\Z)")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*)|)$")
ATX_TAIL = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
QUOTE = re.compile(r" {0,3}> ?")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
TASK = re.compile(r"\[[ xX]\][ \t]+(?=\S)")
NOTE = re.compile(r" {0,3}\[\^[^\s\]]+\]:[ \t]*")
DEFINITION = re.compile(
    r" {0,3}\[(?!\^)((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)"
    r"(?:[ \t]*\n?[ \t]+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)"
)
ANY_LABEL = re.compile(r"^[ >\t]*\[((?:[^\[\]\\]|\\.)+)\]:", re.M)
DASHES = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
CELL = re.compile(r"(?<!\\)\|")
# Element names that start a block of raw HTML (CommonMark 0.31).
HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link "
    "main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead "
    "title tr track ul"
).split()
HTML_KINDS = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r" {0,3}</?(?:%s)(?:\s|/?>|$)" % "|".join(HTML_BLOCKS), re.I), None),
    (re.compile(r" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$"), None),
]


class Line(NamedTuple):
    text: str
    off: int
    no: int


class Block(NamedTuple):
    kind: str
    depth: int
    text: str
    label: str
    first: Line
    last: Line
    links: list


def split_lines(text: str) -> list[Line]:
    lines = [Line(m.group(1), m.start(), no) for no, m in enumerate(LINE.finditer(text), 1)]
    if len(lines) > 1 and not lines[-1].text:
        lines.pop()
    return lines


def _indent(text: str) -> int:
    width = 0
    for ch in text:
        if ch == " ":
            width += 1
        elif ch == "\t":
            width += 4 - width % 4
        else:
            return width
    return width


def _dedent(line: Line, width: int) -> Line:
    taken = cut = 0
    while taken < width and cut < len(line.text) and line.text[cut] in " \t":
        taken += 1 if line.text[cut] == " " else 4 - taken % 4
        cut += 1
    return Line(" " * (taken - width) + line.text[cut:], line.off + cut - max(taken - width, 0), line.no)


def _html_kind(text: str, in_paragraph: bool) -> int:
    if "<" not in text[:4]:
        return -1
    kinds = HTML_KINDS[:-1] if in_paragraph else HTML_KINDS
    return next((k for k, (start, _) in enumerate(kinds) if start.match(text)), -1)


def _interrupts(text: str) -> bool:
    """Does this line end a paragraph?"""
    lead = text.lstrip(" \t")[:1]
    if not lead:
        return True
    if _indent(text) > 3 or lead not in "#-*_+`~><0123456789":
        return False
    if ATX.match(text) or RULE.match(text) or FENCE.match(text) or QUOTE.match(text) or _html_kind(text, True) >= 0:
        return True
    item = ITEM.match(text)
    return bool(item and text[item.end() :].strip() and (item.group(2) in "-+*" or item.group(2)[:-1] == "1"))


def _inline_block(kind: str, depth: int, lines: list[Line], refs: set[str], content: list[Line] | None = None) -> Block:
    parts = [Line(x.text.lstrip(" \t"), x.off + len(x.text) - len(x.text.lstrip(" \t")), x.no) for x in content or lines]
    source = "\n".join(p.text for p in parts).rstrip(" \t")
    nodes = parse_inline(source, refs)
    return Block(kind, depth, body_text(nodes), plain_text(nodes), lines[0], lines[-1], _locate(nodes, parts))


def _locate(nodes: list, parts: list[Line]) -> list:
    """Line and source offset of each link of a paragraph."""
    found = link_nodes(nodes)
    if not found:
        return []
    starts = list(accumulate((len(p.text) + 1 for p in parts[:-1]), initial=0))
    out = []
    for url, pos in found:
        i = bisect_right(starts, pos) - 1
        out.append((url, parts[i].no, parts[i].off + pos - starts[i]))
    return out


def _container(kind: str, first: Line, last: Line, children: list[Block]) -> Block:
    links = [link for child in children for link in child.links]
    return Block(kind, 0, " ".join(c.text for c in children), "", first, last, links)


def _filled(lines: list[Line]) -> list[Line]:
    return [x for x in lines if x.text.strip()]


def _lazy(inner: list[Line], text: str) -> bool:
    """Can ``text`` continue the paragraph that ends ``inner``?"""
    prior = inner[-1].text if inner else ""
    return bool(prior.strip()) and not (ATX.match(prior) or RULE.match(prior) or FENCE.match(prior)) and not _interrupts(text)


def _take_item(lines: list[Line], i: int, inner: list[Line], width: int) -> int:
    """Collect the lines that belong to a container of the given indent."""
    i += 1
    while i < len(lines):
        text = lines[i].text
        if not text.strip():
            after = i
            while after < len(lines) and not lines[after].text.strip():
                after += 1
            if after == len(lines) or _indent(lines[after].text) < width:
                break
            inner.append(Line("", lines[i].off, lines[i].no))
        elif _indent(text) >= width:
            inner.append(_dedent(lines[i], width))
        elif _lazy(inner, text) and not ITEM.match(text):
            inner.append(lines[i])
        else:
            break
        i += 1
    return i


def _item(lines: list[Line], i: int) -> tuple[list[Line], int]:
    """The lines inside the list item that starts at ``i``, and the line behind it."""
    head = lines[i]
    m = ITEM.match(head.text)
    gap = _indent(m.group(3)) if head.text[m.end() :].strip() else 1
    width = len(m.group(1)) + len(m.group(2)) + (gap if 1 <= gap <= 4 else 1)
    cut = min(width, len(head.text))
    if task := TASK.match(head.text, cut):
        cut = task.end()
    inner = [Line(head.text[cut:], head.off + cut, head.no)]
    return inner, _take_item(lines, i, inner, width)


def _same_list(lines: list[Line], i: int, mark: str) -> bool:
    """Does line ``i`` start a further item of a list with this mark?"""
    m = ITEM.match(lines[i].text) if i < len(lines) else None
    return bool(m and m.group(2)[-1] == mark and not RULE.match(lines[i].text))


def _cells(text: str) -> list[str]:
    text = text.strip()
    text = text.removeprefix("|")
    if text.endswith("|") and not text.endswith("\\|"):
        text = text[:-1]
    return [c.strip() for c in CELL.split(text)]


def _table(lines: list[Line], i: int, refs: set[str]) -> tuple[Block, int] | None:
    if i + 1 >= len(lines) or "|" not in lines[i].text + lines[i + 1].text or not DASHES.match(lines[i + 1].text):
        return None
    columns = len(_cells(lines[i].text))
    if columns != len(_cells(lines[i + 1].text)):
        return None
    end = i + 2
    while end < len(lines) and not _interrupts(lines[end].text):
        end += 1
    rows, links = [], []
    for line in [lines[i], *lines[i + 2 : end]]:
        row = []
        for cell in _cells(line.text)[:columns]:
            nodes = parse_inline(cell.replace("\\|", "|"), refs)
            row.append(body_text(nodes))
            at = max(line.text.find(cell), 0)
            links += [(url, line.no, line.off + at + pos) for url, pos in link_nodes(nodes)]
        rows.append(" ".join(row))
    return Block("table", 0, " ".join(rows), "", lines[i], lines[end - 1], links), end


def _paragraph(lines: list[Line], i: int, refs: set[str], out: list[Block]) -> int:
    start = i
    i += 1
    while i < len(lines) and not _interrupts(lines[i].text):
        if SETEXT.match(lines[i].text):
            break
        i += 1
    body = lines[start:i]
    source, pos, taken = "", 0, 0
    while taken < len(body) and body[taken].text.lstrip().startswith("["):
        source = source or "\n".join(x.text for x in body)
        m = DEFINITION.match(source, pos)
        if not m or not m.group(1).strip():
            break
        used = m.group().rstrip("\n").count("\n") + 1
        out.append(Block("definition", 0, "", "", body[taken], body[taken + used - 1], []))
        pos += sum(len(x.text) + 1 for x in body[taken : taken + used])
        taken += used
    body = body[taken:]
    mark = SETEXT.match(lines[i].text) if body and i < len(lines) else None
    if mark and body:
        depth = 1 if mark.group(1)[0] == "=" else 2
        out.append(_inline_block("heading", depth, [*body, lines[i]], refs, body))
        return i + 1
    if body:
        out.append(_inline_block("paragraph", 0, body, refs))
    return i


def scan(lines: list[Line], refs: set[str]) -> list[Block]:
    """Blocks of a list of lines; containers are parsed inside and flattened.

    Containers can be nested to any depth: the steps wait on a stack of their own.
    """
    stack, value = [_scan(lines, refs, False)], None
    while stack:
        try:
            step = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(step)
            value = None
    return value


def _scan(lines: list[Line], refs: set[str], inside: bool) -> Generator[Generator, list[Block], list[Block]]:
    """A step of ``scan``: yields the steps of containers and is sent their blocks.

    ``inside`` a container only the order of texts and links counts. The blocks
    of one that reaches the last line then stand for it, and no step has to wait.
    """
    out: list[Block] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        text = line.text
        if not text.strip(" \t"):
            i += 1
            continue
        if _indent(text) > 3:
            j = i
            while j < n and (not lines[j].text.strip() or _indent(lines[j].text) > 3):
                j += 1
            body = lines[i:j]
            while not body[-1].text.strip():
                body.pop()
            value = "\n".join(_dedent(x, 4).text for x in body)
            out.append(Block("code", 0, value, "", line, body[-1], []))
            i = j
            continue
        kind = -1
        if m := ATX.match(text):
            title = ATX_TAIL.sub("", m.group(2) or "").strip(" \t")
            at = line.off + text.find(title, m.end(1)) if title else line.off
            out.append(_inline_block("heading", len(m.group(1)), [line], refs, [Line(title, at, line.no)]))
            i += 1
        elif m := FENCE.match(text):
            close = re.compile(r" {0,3}%s{%d,}[ \t]*$" % (re.escape(m.group(2)[0]), len(m.group(2))))
            j = i + 1
            while j < n and not close.match(lines[j].text):
                j += 1
            value = "\n".join(_dedent(x, len(m.group(1))).text for x in lines[i + 1 : j])
            out.append(Block("code", 0, value, "", line, lines[min(j, n - 1)], []))
            i = j + 1
        elif RULE.match(text):
            out.append(Block("thematicBreak", 0, "", "", line, line, []))
            i += 1
        elif QUOTE.match(text):
            inner: list[Line] = []
            j = i
            while j < n:
                m = QUOTE.match(lines[j].text)
                if not m and not _lazy(inner, lines[j].text):
                    break
                cut = m.end() if m else 0
                inner.append(Line(lines[j].text[cut:], lines[j].off + cut, lines[j].no))
                j += 1
            if inside and j == n and _filled(inner):
                lines, i, n = inner, 0, len(inner)
                continue
            out.append(_container("blockquote", line, lines[j - 1], (yield _scan(inner, refs, True))))
            i = j
        elif m := ITEM.match(text):
            mark = m.group(2)[-1]
            items: list[Block] = []
            while not items or _same_list(lines, i, mark):
                head = lines[i]
                inner, i = _item(lines, i)
                filled = _filled(inner)
                if inside and i == n and filled:
                    break
                last = filled[-1] if filled else head
                items.append(_container("listItem", head, last, (yield _scan(inner, refs, True))))
                ahead = i
                while ahead < n and not lines[ahead].text.strip():
                    ahead += 1
                if ahead < n and ahead > i and ITEM.match(lines[ahead].text):
                    i = ahead
            else:
                out.append(_container("list", line, last, items))
                continue
            out.extend(items)
            lines, i, n = inner, 0, len(inner)
        elif m := NOTE.match(text):
            inner = [Line(text[m.end() :], line.off + m.end(), line.no)]
            i = _take_item(lines, i, inner, 4)
            if inside and i == n and _filled(inner):
                lines, i, n = inner, 0, len(inner)
                continue
            out.append(_container("footnoteDefinition", line, lines[i - 1], (yield _scan(inner, refs, True))))
        elif (kind := _html_kind(text, False)) >= 0:
            stop = HTML_KINDS[kind][1]
            j = i
            while j < n and (lines[j].text.strip() if stop is None else not stop.search(lines[j].text)):
                j += 1
            if stop is not None:
                j = min(j + 1, n)
            out.append(Block("html", 0, "\n".join(x.text for x in lines[i:j]), "", line, lines[j - 1], []))
            i = j
        elif found := _table(lines, i, refs):
            out.append(found[0])
            i = found[1]
        else:
            i = _paragraph(lines, i, refs, out)
    return out


def frontmatter_end(lines: list[Line]) -> int:
    """Index of the closing fence of a YAML block at the very start, or -1."""
    if not lines or lines[0].text.rstrip(" \t") != "---":
        return -1
    return next((i for i, x in enumerate(lines[1:], 1) if x.text.rstrip(" \t") == "---"), -1)


def parse_note(content: str) -> list[Block]:
    lines = split_lines(content)
    end = frontmatter_end(lines)
    refs = {label_key(m) for m in ANY_LABEL.findall(content)} if "]:" in content else set()
    out = []
    if end >= 0:
        value = "\n".join(x.text for x in lines[1:end])
        out.append(Block("yaml", 0, value, "", lines[0], lines[end], []))
    return out + scan(lines[end + 1 :], refs)


def list_array(counts: list[int], values: pa.Array) -> pa.Array:
    offsets = [0]
    for c in counts:
        offsets.append(offsets[-1] + c)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _struct(**columns: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


@F.arrow_udf(BLOCKS)
def parse_blocks(content: pa.Array) -> pa.Array:
    """Top-level blocks of each note, with the heading trail at each block."""
    return by_pieces(_block_arrays, content)


def _block_arrays(contents: list[str | None]) -> pa.Array:
    notes = [parse_note(c or "") for c in contents]
    flat, trails = [], []
    for blocks in notes:
        trail: dict[int, str] = {}
        for block in blocks:
            if block.kind == "heading":
                trail = {d: t for d, t in trail.items() if d < block.depth} | {block.depth: block.label}
            flat.append(block)
            trails.append(list(trail.values()))
    values = _struct(
        kind=pa.array([b.kind for b in flat], pa.string()),
        depth=pa.array([b.depth for b in flat], pa.int32()),
        text=pa.array([b.text for b in flat], pa.string()),
        label=pa.array([b.label for b in flat], pa.string()),
        heading_path=pa.array(trails, pa.list_(pa.string())),
        start_line=pa.array([b.first.no for b in flat], pa.int32()),
        end_line=pa.array([b.last.no for b in flat], pa.int32()),
        start_off=pa.array([b.first.off for b in flat], pa.int32()),
        end_off=pa.array([b.last.off + len(b.last.text) for b in flat], pa.int32()),
    )
    return list_array([len(b) for b in notes], values)


def note_chunks(blocks: list[Block]) -> list[tuple]:
    """Chunks of one note: ``(heading_path, text, start_line, end_line, word_count)``.

    Headings delimit chunks. A heading with no body before the next heading
    gives none, nor does a chunk without words. The trail is part of the text.
    """
    out: list[tuple] = []
    trail: dict[int, str] = {}
    start, body = 1, []
    for block in [*blocks, None]:
        if block is not None and block.kind == "yaml":
            continue
        if block is not None and block.kind != "heading":
            body.append(block)
            continue
        if body:
            path = list(trail.values())
            text = "\n".join(b.text for b in body).strip(TRIMMED)
            text = f"{' — '.join(path)}\n{text}".strip(TRIMMED) if path else text
            words = len(WORD.findall(text))
            if words:
                out.append((path, text, start, body[-1].last.no, words))
        if block is not None:
            trail = {d: t for d, t in trail.items() if d < block.depth} | {block.depth: block.label}
            start, body = block.first.no, []
    return out


@F.arrow_udf(CHUNKS)
def parse_chunks(content: pa.Array) -> pa.Array:
    """Chunks of each note, cut at its headings."""
    return by_pieces(_chunk_arrays, content)


def _chunk_arrays(contents: list[str | None]) -> pa.Array:
    notes = [note_chunks(parse_note(c or "")) for c in contents]
    flat = [chunk for chunks in notes for chunk in chunks]
    values = _struct(
        chunk_idx=pa.array([i for chunks in notes for i in range(len(chunks))], pa.int32()),
        heading_path=pa.array([x[0] for x in flat], pa.list_(pa.string())),
        text=pa.array([x[1] for x in flat], pa.string()),
        start_line=pa.array([x[2] for x in flat], pa.int32()),
        end_line=pa.array([x[3] for x in flat], pa.int32()),
        word_count=pa.array([x[4] for x in flat], pa.int32()),
    )
    return list_array([len(chunks) for chunks in notes], values)


def with_blocks(notes: DataFrame, content: str = "content") -> DataFrame:
    return notes.withColumn("blocks", parse_blocks(F.col(content)))
