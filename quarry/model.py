"""Schemas, limits and arguments of the navigation index."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import types as T

SCHEMA_VERSION = 5


def _schema(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(*(lambda n, k: (n, kinds[k], True))(*part.split())) for part in text.split(", ")])


REPOS = _schema("repo_id long, name string, root_path string")
FILES = _schema("file_id long, repo_id long, path string, language string, sha string, mtime_ns long, byte_size long, partial boolean")
SYMBOLS = _schema("symbol_id long, file_id long, kind string, name string, qualified string, start_row long, start_col long, end_row long, end_col long, signature string, docstring string")
REFS = _schema("ref_id long, file_id long, name string, start_row long, start_col long, end_row long, end_col long, context string")
RANGE = ["start_row", "start_col", "end_row", "end_col"]


class InvalidArguments(ValueError):
    """The request itself is wrong."""


@dataclass(frozen=True)
class Limits:
    """Paging limits; the defaults are fixed values of the public interface."""

    query_timeout_ms: int = 2000
    worktree_refresh_ms: int = 2000
    default_result_limit: int = 200
    max_result_limit: int = 300
    default_body_line_limit: int = 120
    max_body_line_limit: int = 1000
    capture_char_limit: int = 2000
    max_response_chars: int = 45000

    def results(self, asked: int | None) -> int:
        return max(1, min(self.default_result_limit if asked is None else asked, max(1, self.max_result_limit)))

    def body_lines(self, asked: int | None) -> int:
        return max(1, min(self.default_body_line_limit if asked is None else asked, max(1, self.max_body_line_limit)))


def from_json(kind: type, given: dict):
    """Arguments from a JSON object; unknown ones are refused."""
    known = {f.name for f in fields(kind)}
    if extra := sorted(set(given) - known):
        raise InvalidArguments(f"unknown argument: {', '.join(extra)}")
    try:
        return kind(**given)
    except TypeError as error:
        raise InvalidArguments(str(error)) from error


@dataclass(frozen=True)
class SymbolArgs:
    name: str | None = None
    names: list[str] = field(default_factory=list)
    repo: str | None = None
    kind: str | None = None
    file_glob: str | None = None
    include_body: bool = False
    context_lines: int = 0
    max_body_lines: int | None = None
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class OutlineArgs:
    file: str
    repo: str | None = None
    depth: int = 2
    include_signatures: bool = True
    include_docstrings: bool = True
    include_imports: bool = False
    include_bodies_for: list[str] = field(default_factory=list)
    max_body_lines: int | None = None
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class EnclosingArgs:
    file: str
    row: int | None = None
    rows: list[int] = field(default_factory=list)
    col: int | None = None
    repo: str | None = None
    include_body: bool = False
    context_lines: int = 0
    max_body_lines: int | None = None
    depth: int = 1
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class ReferenceArgs:
    name: str | None = None
    names: list[str] = field(default_factory=list)
    repo: str | None = None
    scope: str | None = None
    exclude_tests: bool = False
    include_declarations: bool = False
    counts_only: bool = False
    group_by_file: bool = True
    snippet_lines: int = 1
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class QueryArgs:
    query: str
    language: str | None = None
    languages: list[str] = field(default_factory=list)
    repo: str | None = None
    file_glob: str | None = None
    capture: str | None = None
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class ReplaceArgs:
    file: str
    name: str
    new_body: str
    repo: str | None = None
    kind: str | None = None
    qualified: str | None = None
    row: int | None = None
