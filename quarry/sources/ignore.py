"""Ignore rules in the syntax of Git's ignore files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

#: Ignore files that are honoured in every folder; the last is this engine's own.
RULE_FILES = [".gitignore", ".ignore", ".quarryignore"]


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    negated: bool
    folders_only: bool


def rule_of(line: str) -> Rule | None:
    line = re.sub(r"(?<!\\)[ \t]+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return Rule(re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S), negated, folders)


class Rules:
    """Rules of a folder and of those above it; later rules and deeper folders win."""

    def __init__(self, above: Rules | None = None, base: str = "", lines: list[str] = ()):
        self.above, self.base = above, base
        self.rules = [r for r in map(rule_of, lines) if r]

    def ignored(self, path: str, folder: bool) -> bool:
        """path: relative to the walk's root."""
        level: Rules | None = self
        while level is not None:
            own = path[len(level.base) + 1 :] if level.base else path
            for r in reversed(level.rules):
                if (folder or not r.folders_only) and r.pattern.match(own):
                    return not r.negated
            level = level.above
        return False


def read_lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().split("\n")
    except OSError:
        return []


def top_rules(root: str, extra: list[str] = ()) -> Rules:
    """Global excludes, the repository's own excludes and configured rule files."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    rules = Rules(None, "", read_lines(os.path.join(home, "git", "ignore")))
    rules = Rules(rules, "", read_lines(os.path.join(root, ".git", "info", "exclude")))
    for path in extra:
        rules = Rules(rules, "", read_lines(path if os.path.isabs(path) else os.path.join(root, path)))
    return rules


def enter(rules: Rules, root: str, folder: str) -> Rules:
    lines = [x for name in RULE_FILES for x in read_lines(os.path.join(root, folder, name))]
    return Rules(rules, folder, lines) if lines else rules


def governed_folder(path: str) -> str | None:
    """The folder that a changed rule file governs."""
    path = path.replace("\\", "/")
    folder, _, name = path.rpartition("/")
    if path.endswith(".git/info/exclude"):
        return path[: -len(".git/info/exclude")].rstrip("/")
    return folder if name in RULE_FILES else None
