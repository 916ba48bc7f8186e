"""YAML front matter, read and written with the YAML 1.2 core rules.

``yes`` and ``no`` stay strings, ``012`` is decimal, dates become ISO strings.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.errors import InvalidFrontmatter, PatchFailed
from marginalia.functions.markdown import frontmatter_end, split_lines

try:
    import yaml
except ImportError:  # pragma: no cover - the functions below then raise
    yaml = None

# How plain scalars are typed.
SCALARS = [
    ("null", r"^(?:~|null|Null|NULL|)$", "~nN\0"),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?(?:0b[01_]+|0o[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*)$", "-+0123456789"),
    ("float", r"^(?:[-+]?(?:[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?|\.[0-9_]+(?:[eE][-+]?[0-9]+)?)|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
    ("timestamp", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:(?:[Tt]|[ \t]+)[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]*)?(?:[ \t]*(?:Z|[-+][0-9]{1,2}(?::?[0-9]{2})?))?)?$", "0123456789"),
    ("merge", r"^<<$", "<"),
]

if yaml is not None:

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

    class Dumper(yaml.SafeDumper):
        yaml_implicit_resolvers: dict = {}

        def increase_indent(self, flow=False, indentless=False):
            return super().increase_indent(flow, False)

    def _int(loader, node):
        text = node.value.replace("_", "")
        return int(text, 0) if re.match(r"[-+]?0[box]", text) else int(text)

    Loader.add_constructor("tag:yaml.org,2002:int", _int)
    for _name, _pattern, _first in SCALARS:
        for _cls in (Loader, Dumper):
            _cls.add_implicit_resolver(f"tag:yaml.org,2002:{_name}", re.compile(_pattern), [c.replace("\0", "") for c in _first])


def _plain(value):
    """Values as JSON would show them."""
    if isinstance(value, dt.datetime):
        utc = value.astimezone(dt.timezone.utc) if value.tzinfo else value
        return utc.strftime("%Y-%m-%dT%H:%M:%S.") + f"{utc.microsecond // 1000:03d}Z"
    if isinstance(value, dt.date):
        return value.isoformat() + "T00:00:00.000Z"
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(_plain(k)): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def load_yaml(text: str) -> dict | list:
    """Parsed front matter, ``{}`` unless it is a mapping or a list; bad YAML raises PatchFailed."""
    if yaml is None:
        raise ImportError("PyYAML is needed for front matter")
    try:
        data = yaml.load(text, Loader=Loader)
    except (yaml.YAMLError, ValueError) as exc:
        raise PatchFailed(f"front matter is not valid YAML: {exc}") from None
    return data if isinstance(data, dict | list) else {}


def dump_yaml(data: dict) -> str:
    return yaml.dump(data, Dumper=Dumper, sort_keys=False, allow_unicode=True, width=2**30).rstrip()


def split_note(content: str) -> tuple[str | None, str]:
    """YAML text (or None) and the rest of the note."""
    lines = split_lines(content)
    end = frontmatter_end(lines)
    if end < 0:
        return None, content
    rest = lines[end + 1].off if end + 1 < len(lines) else len(content)
    return "\n".join(x.text for x in lines[1:end]), content[rest:]


def merge_frontmatter(content: str, payload: dict) -> str:
    """Set fields, keep the others, leave the body untouched."""
    text, body = split_note(content)
    current = load_yaml(text) if text else {}
    merged = (current if isinstance(current, dict) else dict(enumerate(current))) | payload
    gap = "\n" if text is None and body else ""
    return f"---\n{dump_yaml(merged)}\n---\n{gap}{body}"


def _json(content: str | None) -> str | None:
    try:
        text, _ = split_note(content or "")
        return json.dumps(_plain(load_yaml(text)) if text else {}, ensure_ascii=False)
    except PatchFailed:
        return None


@F.arrow_udf(T.StringType())
def frontmatter_json(content: pa.Array) -> pa.Array:
    """Front matter as JSON text; ``{}`` when there is none, NULL when it is not valid YAML."""
    return pa.array([_json(c) for c in content.to_pylist()], pa.string())


def _merged(content: str, payload: str) -> dict:
    try:
        fields = json.loads(payload)
        if not isinstance(fields, dict):
            raise ValueError
        return {"content": merge_frontmatter(content, fields), "error_code": None}
    except PatchFailed as exc:
        return {"content": None, "error_code": exc.code}
    except (ValueError, TypeError):
        return {"content": None, "error_code": InvalidFrontmatter.code}


@F.arrow_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("error_code", T.StringType())]))
def set_frontmatter(content: pa.Array, payload: pa.Array) -> pa.Array:
    """Merge a JSON object into the front matter; a bad payload gives an error code."""
    rows = [_merged(c, p) for c, p in zip(content.to_pylist(), payload.to_pylist())]
    return pa.array(rows, pa.struct([("content", pa.string()), ("error_code", pa.string())]))
