"""Linked checkouts of a repository, from Git's own files."""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass
from itertools import chain, count


@dataclass(frozen=True)
class Checkout:
    name: str
    path: str


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read().strip()
    except OSError:
        return None


def common_folder(root: str) -> str | None:
    """The folder that all checkouts share."""
    dot = os.path.join(root, ".git")
    if os.path.isdir(dot):
        return os.path.realpath(dot)
    link = _read(dot)
    if not link or not link.startswith("gitdir:"):
        return None
    folder = os.path.normpath(os.path.join(root, link.removeprefix("gitdir:").strip()))
    shared = _read(os.path.join(folder, "commondir"))
    return os.path.realpath(os.path.join(folder, shared)) if shared else os.path.realpath(folder)


def discover(root: str) -> list[Checkout]:
    """The main checkout and all linked ones that exist, by path, each once, with names of their own."""
    shared = common_folder(root)
    if shared is None:
        return []
    found: dict[str, str] = {}
    main = os.path.dirname(shared)
    if os.path.basename(shared) == ".git" and os.path.isdir(main):
        found[os.path.realpath(main)] = os.path.basename(main)
    folder = os.path.join(shared, "worktrees")
    for entry in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        link = _read(os.path.join(folder, entry, "gitdir"))
        if link:
            path = os.path.realpath(os.path.dirname(link if os.path.isabs(link) else os.path.join(folder, entry, link)))
            if os.path.isdir(path):
                found.setdefault(path, os.path.basename(path) + "\0" + entry)
    return named([(path, *(value.split("\0") + [""])[:2]) for path, value in sorted(found.items())])


def named(found: list[tuple[str, str, str]]) -> list[Checkout]:
    """(path, name, id): checkouts that share a name all get ``@id``; what still is taken then gets a number from 2 on."""
    often = Counter(name for _, name, _ in found)
    taken: set[str] = set()
    out = []
    for path, name, own in found:
        base = name if often[name] == 1 else f"{name}@{own or 'main'}"
        choice = next(c for c in chain([base], (f"{base}@{n}" for n in count(2))) if c not in taken)
        taken.add(choice)
        out.append(Checkout(choice, path))
    return out


def selected(checkouts: list[Checkout], wanted: str) -> Checkout:
    """By name or by absolute root."""
    for c in checkouts:
        if c.name == wanted or os.path.isabs(wanted) and os.path.realpath(wanted) == c.path:
            return c
    from ..model import InvalidArguments

    raise InvalidArguments(f"unknown checkout {wanted!r}; known: {', '.join(c.name for c in checkouts)}")
