"""Vault-relative path rules."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.errors import InvalidNotePath, NoteError, PathTraversal

BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def clean_path(raw: str) -> str:
    """Decode, normalise separators and reject anything that leaves the vault."""
    if "\0" in raw or not raw.strip():
        raise InvalidNotePath(raw)
    path = raw
    while "%" in path:
        if BAD_ESCAPE.search(path):
            raise InvalidNotePath(raw)
        try:
            decoded = unquote_to_bytes(path).decode("utf-8")
        except UnicodeDecodeError:
            raise InvalidNotePath(raw) from None
        if decoded == path:
            break
        path = decoded
    path = path.replace("\\", "/")
    if ".." in path.split("/"):
        raise PathTraversal(raw)
    return path.lstrip("/")


def note_path(raw: str) -> str:
    """Relative path of a note; ``.md`` is added when missing."""
    path = clean_path(raw)
    if not path:
        raise InvalidNotePath(raw)
    path = posixpath.normpath(path if path.endswith(".md") else path + ".md")
    if "\0" in path:
        raise InvalidNotePath(raw)
    return path


def directory_path(raw: str | None) -> str:
    """Relative path of a folder; blank means the vault root."""
    if not raw or not raw.strip():
        return ""
    path = posixpath.normpath(clean_path(raw) or ".")
    return "" if path == "." else path


@F.arrow_udf(T.StructType([T.StructField("path", T.StringType()), T.StructField("error_code", T.StringType())]))
def safe_note_path(raw: pa.Array) -> pa.Array:
    """Column form of :func:`note_path`: the clean path, or an error code."""
    rows = []
    for value in raw.to_pylist():
        try:
            rows.append({"path": note_path(value or ""), "error_code": None})
        except NoteError as exc:
            rows.append({"path": None, "error_code": exc.code})
    return pa.array(rows, pa.struct([("path", pa.string()), ("error_code", pa.string())]))


def in_directory(path: Column, directory: str | None) -> Column:
    """True for notes in the subtree of ``directory`` (whole path segments)."""
    folder = directory_path(directory)
    return F.lit(True) if not folder else path.startswith(folder + "/")


def visible(path: Column) -> Column:
    """False when a path segment is hidden or a dependency folder."""
    return ~F.exists(F.split(path, "/"), lambda s: s.startswith(".") | (s == "node_modules"))


def path_key(path: Column) -> Column:
    """Case-insensitive key of a note: one trailing ``.md`` removed."""
    return F.lower(F.regexp_replace(path, r"\.md\z", ""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def folder_of(path: Column) -> Column:
    """Containing folder, ``.`` for notes at the root."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"\A(.*)/[^/]*\z", 1), F.lit("")), F.lit("."))
