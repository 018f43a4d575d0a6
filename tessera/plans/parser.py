"""Lexer and recursive-descent parser of the query dialect.

    SELECT [DISTINCT] items [FROM table] [WHERE e] [GROUP BY es] [HAVING e]
    [ORDER BY keys] [LIMIT n] [OFFSET m]

Expressions, from weak to strong: OR, AND, NOT, comparison (also BETWEEN, IN, LIKE, IS
NULL), + - ||, * / %, unary minus, methods on a value (`name.Trim().StartsWith('x')`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import ast

_TOKEN = re.compile(
    r"""\s*(?:(?P<comment>--[^\n]*)
    |(?P<text>'(?:[^']|'')*')
    |(?P<quoted>"[^"]*"|`[^`]*`|\[[^\]]*\])
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![A-Za-z_]))
    |(?P<word>\w+)
    |(?P<mark><=|>=|<>|!=|==|\|\||[-=<>(),.*/%+;]))""",
    re.X,
)
_SPACE = re.compile(r"\s*")
RESERVED = {
    "SELECT", "FROM", "WHERE", "GROUP", "ORDER", "BY", "HAVING", "LIMIT", "OFFSET", "AND", "OR", "NOT", "IN",
    "BETWEEN", "LIKE", "IS", "NULL", "AS", "ASC", "DESC", "DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "END",
}


class QueryError(ValueError):
    """A query that can't be parsed or resolved."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while (at := _SPACE.match(sql, at).end()) < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            what = "Unterminated string" if sql[at] in "'\"" else f"Unexpected character {sql[at]!r}"
            raise QueryError(f"{what} at position {at}")
        if m.lastgroup != "comment":
            out.append(Token(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
        at = m.end()
    return out


class Parser:
    def __init__(self, sql: str, flat_logic: bool = False):
        self.tokens, self.at, self.flat = tokenize(sql), 0, flat_logic
        depth = 0
        for t in self.tokens:
            depth += (t.text == "(") - (t.text == ")") if t.kind == "mark" else 0
            if depth < 0:
                raise QueryError("Unexpected closing parenthesis")
        if depth:
            raise QueryError(f"Missing {depth} closing parenthes{'is' if depth == 1 else 'es'}")

    # Tokens.

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "end of query", -1)

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "word" and t.text.upper() in words

    def is_mark(self, *marks: str) -> bool:
        t = self.peek()
        return t.kind == "mark" and t.text in marks

    def take(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def mark(self, *marks: str) -> bool:
        if self.is_mark(*marks):
            self.at += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not (self.mark(what) or self.word(what)):
            t = self.peek()
            raise QueryError(f"Expected {what}, found {t.text!r}" + (f" at position {t.at}" if t.at >= 0 else ""))

    # Statement.

    def select(self) -> ast.Select:
        self.need("SELECT")
        distinct = self.word("DISTINCT")
        items = [self.item()]
        while self.mark(","):
            items.append(self.item())
        table = self.name() if self.word("FROM") else None
        where = self.expression() if self.word("WHERE") else None
        group: list[ast.Node] = []
        order: list[ast.Key] = []
        having, limit, offset = None, None, 0
        if self.word("GROUP"):
            self.need("BY")
            group.append(self.sum())
            while self.mark(","):
                group.append(self.sum())
        if self.word("HAVING"):
            having = self.expression()
        if self.word("ORDER"):
            self.need("BY")
            order.append(self.key())
            while self.mark(","):
                order.append(self.key())
        if self.word("LIMIT"):
            limit = self.count("LIMIT")
        if self.word("OFFSET"):
            offset = self.count("OFFSET")
        self.mark(";")
        self.finish()
        return ast.Select(tuple(items), table, where, tuple(group), having, tuple(order), limit, offset, distinct)

    def finish(self) -> None:
        t = self.peek()
        if t.kind != "end":
            raise QueryError(f"Unexpected {t.text!r} at position {t.at}")

    def name(self) -> str:
        t = self.take()
        if t.kind == "quoted":
            return t.text[1:-1]
        if t.kind != "word" or t.text.upper() in RESERVED:
            raise QueryError(f"Expected a name, found {t.text!r}")
        return t.text

    def count(self, what: str) -> int:
        t = self.take()
        if t.kind != "number" or not t.text.isdigit():
            raise QueryError(f"{what} needs a whole number, found {t.text!r}")
        return int(t.text)

    def item(self) -> ast.Item:
        if self.mark("*"):
            return ast.Item(ast.Star())
        body = self.sum()
        if self.word("AS"):
            return ast.Item(body, self.name())
        t = self.peek()
        if t.kind == "quoted" or t.kind == "word" and t.text.upper() not in RESERVED:
            return ast.Item(body, self.name())
        return ast.Item(body)

    def key(self) -> ast.Key:
        body = self.sum()
        descending = self.word("DESC")
        if not descending:
            self.word("ASC")
        return ast.Key(body, descending)

    # Expressions.

    def expression(self) -> ast.Node:
        left = self.negation() if self.flat else self.conjunction()
        while self.is_word("OR", "AND") if self.flat else self.is_word("OR"):
            op = self.take().text.upper()
            left = ast.Logic(op, left, self.negation() if self.flat else self.conjunction())
        return left

    def conjunction(self) -> ast.Node:
        left = self.negation()
        while self.word("AND"):
            left = ast.Logic("AND", left, self.negation())
        return left

    def negation(self) -> ast.Node:
        return ast.Not(self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> ast.Node:
        left = self.sum()
        if self.is_mark("=", "==", "!=", "<>", "<", "<=", ">", ">="):
            op = {"==": "=", "<>": "!="}.get(t := self.take().text, t)
            return ast.Compare(op, left, self.sum())
        if self.word("IS"):
            negative = self.word("NOT")
            self.need("NULL")
            return ast.Not(ast.IsNull(left)) if negative else ast.IsNull(left)
        negative = self.is_word("NOT") and self.is_word("IN", "LIKE", "BETWEEN", ahead=1) and self.word("NOT")
        found: ast.Node = left
        if self.word("BETWEEN"):
            low = self.sum()
            self.need("AND")
            found = ast.Between(left, low, self.sum())
        elif self.word("IN"):
            self.need("(")
            items = [self.sum()]
            while self.mark(","):
                items.append(self.sum())
            self.need(")")
            found = ast.In(left, tuple(items))
        elif self.word("LIKE"):
            t = self.take()
            if t.kind not in ("text", "quoted"):
                raise QueryError(f"LIKE needs a pattern, found {t.text!r}")
            found = ast.Like(left, t.text[1:-1].replace("''", "'"))
        return ast.Not(found) if negative else found

    def sum(self) -> ast.Node:
        left = self.product()
        while self.is_mark("+", "-", "||"):
            left = ast.Arith(self.take().text, left, self.product())
        return left

    def product(self) -> ast.Node:
        left = self.unary()
        while self.is_mark("*", "/", "%"):
            left = ast.Arith(self.take().text, left, self.unary())
        return left

    def unary(self) -> ast.Node:
        if self.mark("-"):
            body = self.unary()
            return ast.Number("-" + body.raw) if isinstance(body, ast.Number) and body.raw[0] != "-" else ast.Negate(body)
        return self.postfix()

    def postfix(self) -> ast.Node:
        body = self.primary()
        while self.mark("."):
            name = self.take().text
            self.need("(")
            body = ast.Method(body, name, self.arguments())
        return body

    def arguments(self) -> tuple[ast.Node, ...]:
        out = []
        if not self.mark(")"):
            out.append(self.sum())
            while self.mark(","):
                out.append(self.sum())
            self.need(")")
        return tuple(out)

    def primary(self) -> ast.Node:
        t = self.take()
        if t.kind == "text":
            return ast.Text(t.text[1:-1].replace("''", "'"))
        if t.kind == "number":
            return ast.Number(t.text)
        if t.kind == "quoted":
            return ast.Name(t.text[1:-1], quoted=t.text[0] == '"')
        if t.kind == "mark" and t.text == "(":
            body = self.expression()
            self.need(")")
            return body
        if t.kind == "word":
            upper = t.text.upper()
            if upper == "NULL":
                return ast.Null()
            if upper == "CASE":
                return self.case()
            if self.is_mark("(") and upper not in RESERVED:
                self.take()
                return self.moment() if upper == "DATETIME" else self.call(t.text)
            if upper not in RESERVED:
                return ast.Name(t.text)
        raise QueryError(f"Unexpected {t.text!r}" + (f" at position {t.at}" if t.at >= 0 else ""))

    def call(self, name: str) -> ast.Node:
        if self.mark("*"):
            self.need(")")
            return ast.Call(name.upper(), (ast.Star(),))
        distinct = self.word("DISTINCT")
        return ast.Call(name.upper(), self.arguments(), distinct)

    def moment(self) -> ast.Moment:
        parts = self.arguments()
        if not all(isinstance(p, ast.Number) for p in parts) or len(parts) not in (0, 3, 4, 5, 6):
            raise QueryError("DateTime needs year, month and day, or nothing")
        return ast.Moment(tuple(int(p.value) for p in parts))

    def case(self) -> ast.Case:
        subject = None if self.is_word("WHEN") else self.sum()
        whens = []
        while self.word("WHEN"):
            when = self.expression()
            self.need("THEN")
            whens.append((when, self.sum()))
        otherwise = self.sum() if self.word("ELSE") else None
        self.need("END")
        if not whens:
            raise QueryError("CASE without WHEN")
        return ast.Case(subject, tuple(whens), otherwise)


def parse(sql: str, flat_logic: bool = False) -> ast.Select:
    return Parser(sql, flat_logic).select()


def parse_condition(text: str, flat_logic: bool = False) -> ast.Node:
    """A WHERE clause by itself."""
    p = Parser(text, flat_logic)
    found = p.expression()
    p.finish()
    return found
