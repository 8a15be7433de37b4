"""Scalar functions with the engine's semantics, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and places that mark test code.
TEST_PATH = r"(^|/)tests?/|_test\.(py|go|rs)$|(^|/)test_[^/]*\.py$|\.(spec|test)\.(ts|tsx|js|jsx)$"
GLOB_CHARS = "*?[{"


def lines(text: Column) -> Column:
    """Lines without their ends (LF or CRLF); a final end makes no empty line."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def slice_lines(all_lines: Column, start_row: Column, end_row: Column, context: int = 0) -> Column:
    """Rows start..end (0-based, inclusive) with lines around them, clamped to the text."""
    first = F.greatest(start_row - context, F.lit(0)).cast("int")
    last = F.least(end_row + context, F.size(all_lines) - 1).cast("int")
    return F.slice(all_lines, first + 1, F.greatest(last - first + 1, F.lit(0)))


def first_snippet(some: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    trimmed = F.transform(some, lambda x: F.trim(x))  # F.trim alone would be given each line's place as what to trim
    return F.coalesce(F.get(F.filter(trimmed, lambda x: x != ""), F.lit(0)), F.lit(""))


def elided(some: Column, most: int) -> Column:
    """At most ``most`` lines, with a marker for what is left out of the middle."""
    head, tail = most // 2, most - most // 2
    marker = F.concat(F.lit("… "), (F.size(some) - most).cast("string"), F.lit(" lines elided ("), F.size(some).cast("string"), F.lit(" total) …"))
    short = F.concat(F.slice(some, 1, head) if head else F.array().cast("array<string>"), F.array(marker), F.slice(some, F.size(some) - tail + 1, tail))
    return F.array_join(F.when(F.size(some) > most, short).otherwise(some), "\n")


def capped(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last of them an ellipsis; 0 is no limit."""
    if not most:
        return text
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def is_test_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(TEST_PATH)


def under(path: Column, prefix: str | Column) -> Column:
    """The path itself or anything below it; letter case counts."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == p) | F.startswith(path, F.concat(p, F.lit("/")))


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression; ``*`` and ``?`` also match ``/``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            n = len(re.match(r"\*+", glob[i:])[0])
            start = i == 0 or glob[i - 1] == "/"
            if n == 2 and start and glob[i + 2 : i + 3] == "/":
                out += "(?:.*/)?"
                n += 1
            elif n == 2 and i and glob[i - 1] == "/" and i + 2 == len(glob):
                out += ".+" if start else ".*"
            else:
                out += ".*"
            i += n
            continue
        if c == "?":
            out += "."
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise ValueError(f"unclosed character class in {glob!r}")
            body = glob[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:])
            out += f"[{'^' * negated}{body}]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in {glob!r}")
    return f"(?s)^{out}$"


def normal_path(path: str, root: str | None = None) -> str:
    """A path filter without ``.`` and ``..`` steps, relative to the root."""
    path = path.replace("\\", "/")
    if path.startswith("/"):
        top = (root or "").rstrip("/")
        if not root or not (path == top or path.startswith(top + "/")):
            raise ValueError(f"{path!r} lies outside the repository")
        path = path[len(top) :].lstrip("/")
    done: list[str] = []
    for step in path.split("/"):
        if step == "..":
            if not done:
                raise ValueError(f"{path!r} leaves the repository")
            done.pop()
        elif step not in ("", "."):
            done.append(step)
    return "/".join(done)


def path_filter(column: Column, pattern: str, root: str | None = None) -> Column:
    """A literal path (itself and all below it) or, with any of ``* ? [ {``, a glob."""
    if any(c in pattern for c in GLOB_CHARS):
        if pattern.startswith("/"):
            top = (root or "").rstrip("/") + "/"
            if not root or not pattern.startswith(top):
                raise ValueError(f"{pattern!r} lies outside the repository")
            pattern = pattern[len(top) :]
        return column.rlike(glob_regex(pattern.removeprefix("./")))
    literal = normal_path(pattern, root)
    return F.lit(True) if literal == "" else under(column, literal)


def occurrences(text: Column, needle: str) -> Column:
    """How often the needle stands in the text, without overlaps."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def slug(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]", "_")


def relative(path: Column, root: str) -> Column:
    """A path relative to the root, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^" + re.escape(root.rstrip("/") + "/"), "")


def byte_column(line: Column, chars: Column) -> Column:
    """Bytes of UTF-8 before a character of a line."""
    return F.octet_length(F.substring(line, F.lit(1), chars))


def crlf_majority(text: Column) -> Column:
    """True if more lines end in CRLF than in LF alone."""
    crlf = F.size(F.split(text, "\r\n")) - 1
    return crlf * 2 > F.size(F.split(text, "\n")) - 1


def is_repo_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.contains("..")


def is_url(url: Column) -> Column:
    return url.rlike(r"^(https?|ssh|git)://[^\s]+$|^[A-Za-z0-9._-]+@[^\s:]+:[^\s]+$")
