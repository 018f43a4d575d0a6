"""Syntax tree of the query dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    pass


@dataclass(frozen=True)
class Name(Node):
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Text(Node):
    value: str


@dataclass(frozen=True)
class Number(Node):
    raw: str

    @property
    def value(self) -> int | float:
        return float(self.raw) if any(c in self.raw for c in ".eE") else int(self.raw)


@dataclass(frozen=True)
class Null(Node):
    pass


@dataclass(frozen=True)
class Moment(Node):
    """DateTime(y, m, d[, h[, mi[, s]]]); without parts, today at midnight."""

    parts: tuple[int, ...] = ()


@dataclass(frozen=True)
class Star(Node):
    pass


@dataclass(frozen=True)
class Not(Node):
    body: Node


@dataclass(frozen=True)
class Negate(Node):
    body: Node


@dataclass(frozen=True)
class Logic(Node):
    op: str  # AND, OR
    left: Node
    right: Node


@dataclass(frozen=True)
class Compare(Node):
    op: str  # = != < <= > >=
    left: Node
    right: Node


@dataclass(frozen=True)
class Arith(Node):
    op: str  # + - * / % ||
    left: Node
    right: Node


@dataclass(frozen=True)
class Between(Node):
    body: Node
    low: Node
    high: Node


@dataclass(frozen=True)
class In(Node):
    body: Node
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Like(Node):
    body: Node
    pattern: str


@dataclass(frozen=True)
class IsNull(Node):
    body: Node


@dataclass(frozen=True)
class Method(Node):
    body: Node
    name: str
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Case(Node):
    subject: Node | None
    whens: tuple[tuple[Node, Node], ...]
    otherwise: Node | None


@dataclass(frozen=True)
class Item(Node):
    body: Node
    alias: str | None = None


@dataclass(frozen=True)
class Key(Node):
    body: Node
    descending: bool = False


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    table: str | None = None
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[Key, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


def show(node, depth: int = 0) -> str:
    """The tree as indented text, one node a line."""
    pad = "  " * depth
    if isinstance(node, tuple):
        return "".join(show(n, depth) for n in node)
    if not isinstance(node, Node):
        return f"{pad}{node!r}\n"
    values = {k: getattr(node, k) for k in node.__dataclass_fields__}
    plain = {k: v for k, v in values.items() if not isinstance(v, Node | tuple) and v not in (None, False)}
    head = f"{pad}{type(node).__name__}" + (f" {', '.join(f'{k}={v!r}' for k, v in plain.items())}" if plain else "") + "\n"
    return head + "".join(show(v, depth + 1) for v in values.values() if isinstance(v, Node | tuple) and v)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "dataclass", "field")]
