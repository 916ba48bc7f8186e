"""Inline markdown of one paragraph, reduced to what search and links need.

The result is a list of nodes ``(kind, value, children, url, pos)``: ``text``,
``code`` and ``html`` carry a value; ``link``, ``ref`` and ``em`` carry
children; ``image``, ``foot`` and ``break`` carry neither.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

SPECIAL = re.compile(r"[\\`<&\[\]!*_~\n]")
TICKS = re.compile(r"`+")
URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*)>")
EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~\-]+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?)>")
TAG = re.compile(
    r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.\-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?"
    r"|/[A-Za-z][A-Za-z0-9-]*\s*|!--(?:[^-]|-(?!->))*--|\?(?:[^?]|\?(?!>))*\?|![A-Za-z][^>]*|!\[CDATA\[(?:[^\]]|\](?!\]>))*\]\])>"
)
ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
TARGET = re.compile(
    r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.)*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?)"
    r"(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)"
)
LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
FOOTNOTE = re.compile(r"\[(\^[^\s\[\]]+)\]")
BARE = re.compile(
    r"(?<![A-Za-z])https?://[^\s<]+|(?<![^\s*_~(\[\]])www\.[^\s<]+"
    r"|(?<![A-Za-z0-9.+_\-])[A-Za-z0-9.+_\-]+@[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+(?<![_\-])",
    re.I,
)
ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def label_key(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def unescape(text: str) -> str:
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: "&#%d;" % ord(m.group(1)), text)
    return ENTITY.sub(lambda m: html.unescape(m.group()), text)


def _text(value: str) -> list:
    return ["text", value, None, None, 0]


def _spaced(ch: str) -> bool:
    return ch == "" or ch.isspace()


def _punctuated(ch: str) -> bool:
    return ch != "" and not ch.isalnum() and not ch.isspace()


def _run(s: str, i: int) -> list:
    """A run of ``*``, ``_`` or ``~`` with its ability to open and close."""
    ch, j = s[i], i
    while j < len(s) and s[j] == ch:
        j += 1
    before, after = s[i - 1 : i], s[j : j + 1]
    left = not _spaced(after) and (not _punctuated(after) or _spaced(before) or _punctuated(before))
    right = not _spaced(before) and (not _punctuated(before) or _spaced(after) or _punctuated(after))
    opens, closes = left, right
    if ch == "_":
        opens = left and (not right or _punctuated(before))
        closes = right and (not left or _punctuated(after))
    if ch == "~" and j - i > 2:
        opens = closes = False
    return ["run", ch, [j - i, opens, closes, j - i], None, i]


def _pair(opener: list, closer: list) -> bool:
    if opener[0] != "run" or opener[1] != closer[1] or not opener[2][1]:
        return False
    if closer[1] == "~":
        return opener[2][0] == closer[2][0]
    both = opener[2][2] or closer[2][1]
    total = opener[2][3] + closer[2][3]
    return not (both and total % 3 == 0 and (opener[2][3] % 3 or closer[2][3] % 3))


def _emphasis(nodes: list) -> list:
    """Match delimiter runs; whatever stays unmatched becomes text."""
    free: dict[str, int] = {}
    i = 0
    while i < len(nodes):
        node = nodes[i]
        if node[0] != "run":
            i += 1
            continue
        at = -1
        if node[2][2] and free.get(node[1], 0) > 0:
            at = next((j for j in range(i - 1, -1, -1) if _pair(nodes[j], node)), -1)
        if at < 0:
            free[node[1]] = free.get(node[1], 0) + bool(node[2][1])
            i += 1
            continue
        opener = nodes[at]
        used = node[2][0] if node[1] == "~" else min(2, opener[2][0], node[2][0])
        for inner in nodes[at + 1 : i]:
            if inner[0] == "run":
                free[inner[1]] -= bool(inner[2][1])
        nodes[at + 1 : i] = [["em", None, _merge(nodes[at + 1 : i]), None, opener[4]]]
        opener[2][0] -= used
        node[2][0] -= used
        i = at + 2
        if opener[2][0] == 0:
            free[opener[1]] -= 1
            del nodes[at]
            i -= 1
        if node[2][0] == 0:
            del nodes[i]
    return _merge(nodes)


def _merge(nodes: list) -> list:
    out: list = []
    for node in nodes:
        if node[0] == "run":
            node = _text(node[1] * node[2][0])
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = _text(out[-1][1] + node[1])
        elif node[0] != "text" or node[1]:
            out.append(node)
    return out


def _close_bracket(s: str, i: int, out: list, open_at: list, refs: set[str]) -> int:
    """Handle ``]`` at ``i``; returns the next position."""
    if not open_at:
        out.append(_text("]"))
        return i + 1
    index, image, pos, active = open_at.pop()
    url, end, kind = None, i + 1, None
    if active:
        target = TARGET.match(s, i + 1)
        label = LABEL.match(s, i + 1)
        own = label_key(s[pos + 1 + image : i])
        if target:
            kind, end = "link", target.end()
            url = unescape(target.group(1) if target.group(1) is not None else target.group(2) or "")
        elif label and label.group(1).strip() and label_key(label.group(1)) in refs:
            kind, end = "ref", label.end()
        elif own in refs:
            kind, end = "ref", label.end() if label and not label.group(1) else i + 1
    if kind is None:
        out.append(_text("]"))
        return i + 1
    inner = _emphasis(out[index + 1 :])
    out[index:] = [["image", None, None, None, pos] if image else [kind, None, inner, url, pos]]
    if kind == "link" and not image:
        for entry in open_at:
            entry[3] = entry[3] and entry[1]
    return end


def parse_inline(s: str, refs: set[str]) -> list:
    out: list = []
    open_at: list = []
    i, n = 0, len(s)
    no_ticks: set[int] = set()
    while i < n:
        found = SPECIAL.search(s, i)
        j = found.start() if found else n
        if j > i:
            out.append(_text(s[i:j]))
            i = j
            continue
        ch = s[i]
        if ch == "\\" and s[i + 1 : i + 2] in ESCAPABLE and i + 1 < n:
            out.append(_text(s[i + 1]))
            i += 2
        elif ch == "\\" and s[i + 1 : i + 2] == "\n":
            out.append(["break", None, None, None, i])
            i += 2
        elif ch == "`":
            fence = TICKS.match(s, i).group()
            close = None
            if len(fence) not in no_ticks:
                close = next((m for m in TICKS.finditer(s, i + len(fence)) if len(m.group()) == len(fence)), None)
            if close is None:
                no_ticks.add(len(fence))
                out.append(_text(fence))
                i += len(fence)
            else:
                value = s[i + len(fence) : close.start()].replace("\n", " ")
                if value.strip(" ") and value[0] == value[-1] == " ":
                    value = value[1:-1]
                out.append(["code", value, None, None, i])
                i = close.end()
        elif ch == "<" and (m := URI.match(s, i) or EMAIL.match(s, i)):
            url = m.group(1) if m.re is URI else "mailto:" + m.group(1)
            out.append(["link", None, [_text(m.group(1))], url, i])
            i = m.end()
        elif ch == "<" and (m := TAG.match(s, i)):
            out.append(["html", m.group(), None, None, i])
            i = m.end()
        elif ch == "&" and (m := ENTITY.match(s, i)):
            out.append(_text(html.unescape(m.group())))
            i = m.end()
        elif ch == "[" and (m := FOOTNOTE.match(s, i)) and label_key(m.group(1)) in refs:
            out.append(["foot", None, None, None, i])
            i = m.end()
        elif ch == "[" or (ch == "!" and s[i + 1 : i + 2] == "["):
            image = ch == "!"
            open_at.append([len(out), image, i, True])
            out.append(_text("![" if image else "["))
            i += 1 + image
        elif ch == "]":
            i = _close_bracket(s, i, out, open_at, refs)
        elif ch in "*_~":
            out.append(_run(s, i))
            i += out[-1][2][0]
        elif ch == "\n":
            spaces = 0
            if out and out[-1][0] == "text":
                kept = out[-1][1].rstrip(" \t")
                spaces = len(out[-1][1]) - len(out[-1][1].rstrip(" "))
                out[-1] = _text(kept)
            out.append(["break", None, None, None, i] if spaces >= 2 else _text("\n"))
            i += 1
        else:
            out.append(_text(ch))
            i += 1
    return _bare_links(_emphasis(out))


def _bare_links(nodes: list) -> list:
    """Turn web and mail addresses in text into links, as GFM does."""
    top: list = []
    work = [(nodes, top)]
    while work:
        nodes, out = work.pop()
        _bare_level(nodes, out, work)
    return top


def _bare_level(nodes: list, out: list, work: list) -> None:
    for node in nodes:
        if node[0] == "em" or node[0] == "ref":
            inner: list = []
            work.append((node[2], inner))
            node = [node[0], node[1], inner, node[3], node[4]]
        if node[0] != "text" or not ("@" in node[1] or "://" in node[1] or "www." in node[1].lower()):
            out.append(node)
            continue
        last = 0
        for m in BARE.finditer(node[1]):
            address = re.sub(r"[?!.,:*_~'\"]+$", "", m.group())
            while address.endswith(")") and address.count(")") > address.count("("):
                address = address[:-1]
            prefix = "" if "://" in address else "http://" if address.lower().startswith("www.") else "mailto:"
            if m.start() > last:
                out.append(_text(node[1][last : m.start()]))
            out.append(["link", None, [_text(address)], prefix + address, 0])
            last = m.start() + len(address)
        if last < len(node[1]):
            out.append(_text(node[1][last:]))


def _walk(nodes: list, opened: Callable[[list], bool]) -> Iterator[list]:
    """Nodes in order of the text, those below a node behind it if it is to be opened."""
    stack = [iter(nodes)]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        yield node
        if node[2] and opened(node):
            stack.append(iter(node[2]))


def body_text(nodes: list) -> str:
    """Values as they are; children joined with one space."""
    return " ".join(n[1] or "" for n in _walk(nodes, lambda n: n[1] is None) if n[1] is not None or not n[2])


def plain_text(nodes: list) -> str:
    """Only text nodes, nothing between them; inline code is left out."""
    return "".join(n[1] for n in _walk(nodes, lambda n: n[0] != "text") if n[0] == "text")


def link_nodes(nodes: list) -> list:
    return [(n[3], n[4]) for n in _walk(nodes, lambda n: True) if n[0] == "link"]
