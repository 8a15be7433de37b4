"""Syntax trees: what the extractors and the pattern matcher share."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(eq=False)
class Node:
    kind: str
    start: int  # bytes
    end: int
    children: list[Node] = field(default_factory=list)
    name: str | None = None  # the field that it has in its parent
    named: bool = True
    parent: Node | None = None

    def add(self, child: Node, name: str | None = None) -> Node:
        child.parent, child.name = self, name or child.name
        self.children.append(child)
        return child

    def field(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    def walk(self):
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))


class Source:
    """Bytes with their lines."""

    def __init__(self, data: bytes):
        self.data = data
        self.starts = [0] + [i + 1 for i, b in enumerate(data) if b == 10]

    def point(self, at: int) -> tuple[int, int]:
        row = bisect_right(self.starts, at) - 1
        return row, at - self.starts[row]

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].decode("utf-8", "replace")

    def of(self, node: Node) -> str:
        return self.text(node.start, node.end)

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        return (*self.point(start), *self.point(end))


@dataclass
class Tree:
    root: Node
    source: Source
    error: bool = False
