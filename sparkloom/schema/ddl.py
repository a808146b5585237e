"""Offline catalog: CREATE TABLE text to tables, columns and indexes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import SparkloomError

TOKEN = re.compile(r"\s+|--[^\n]*|#[^\n]*|/\*.*?\*/|'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`(?:[^`]|``)*`|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|.", re.S)


class DDLError(SparkloomError, ValueError):
    pass


@dataclass
class CatalogColumn:
    name: str
    type: str
    arguments: tuple[str, ...] = ()
    unsigned: bool = False
    nullable: bool = True
    generated: bool = False
    auto_random: bool = False
    has_default: bool = False


@dataclass
class CatalogIndex:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    primary: bool = False
    kind: str = ""


@dataclass
class CatalogTable:
    name: str
    columns: dict[str, CatalogColumn] = field(default_factory=dict)
    indexes: list[CatalogIndex] = field(default_factory=list)

    @property
    def primary(self) -> CatalogIndex | None:
        return next((i for i in self.indexes if i.primary), None)


def _tokens(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text) if not t.isspace() and not t.startswith(("--", "#", "/*"))]


def _name(token: str) -> str:
    return token[1:-1].replace("``", "`") if token[:1] == "`" else token


class _Reader:
    def __init__(self, tokens: list[str]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def word(self, ahead: int = 0) -> str:
        return self.peek(ahead).upper()

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise DDLError("the statement ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def accept(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, word: str) -> None:
        if self.next().upper() != word:
            raise DDLError(f"expected {word}, found {self.tokens[self.at - 1]!r}")

    def parenthesised(self) -> list[str]:
        """Tokens between a pair of parentheses, which may nest."""
        self.expect("(")
        depth, out = 1, []
        while depth:
            t = self.next()
            depth += (t == "(") - (t == ")")
            if depth:
                out.append(t)
        return out


def _split(tokens: list[str]) -> list[list[str]]:
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _key_columns(tokens: list[str]) -> tuple[str, ...]:
    return tuple(_name(p[0]) if p[0] != "(" else "" for p in _split(tokens))


def _column(tokens: list[str], table: CatalogTable) -> None:
    r = _Reader(tokens)
    c = CatalogColumn(_name(r.next()), r.next().upper())
    if c.name.lower() in map(str.lower, table.columns):
        raise DDLError(f"{table.name}: column {c.name} is declared twice")
    if r.peek() == "(":
        c.arguments = tuple(" ".join(p) for p in _split(r.parenthesised()))
    while r.peek():
        if r.accept("UNSIGNED"):
            c.unsigned = True
        elif r.accept("NOT", "NULL"):
            c.nullable = False
        elif r.accept("PRIMARY", "KEY"):
            c.nullable = False
            table.indexes.append(CatalogIndex("PRIMARY", (c.name,), True, True))
        elif r.accept("UNIQUE"):
            r.accept("KEY")
            table.indexes.append(CatalogIndex(c.name, (c.name,), True))
        elif r.accept("GENERATED", "ALWAYS", "AS") or r.accept("AS"):
            r.parenthesised()
            c.generated = True
        elif r.accept("AUTO_RANDOM"):
            c.auto_random = True
            if r.peek() == "(":
                r.parenthesised()
        elif r.accept("DEFAULT"):
            c.has_default = True
            r.next()
            if r.peek() == "(":
                r.parenthesised()
        elif r.peek() == "(":
            r.parenthesised()
        else:
            r.next()
    table.columns[c.name] = c


def _element(tokens: list[str], table: CatalogTable) -> None:
    r = _Reader(tokens)
    if r.accept("CONSTRAINT") and r.word() not in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
        r.next()
    if r.accept("PRIMARY", "KEY"):
        while r.peek() != "(":
            r.next()
        columns = _key_columns(r.parenthesised())
        if table.primary:
            raise DDLError(f"{table.name} has two primary keys")
        for c in columns:
            if c in table.columns:
                table.columns[c].nullable = False
        table.indexes.append(CatalogIndex("PRIMARY", columns, True, True))
    elif r.word() in ("UNIQUE", "KEY", "INDEX", "VECTOR", "FULLTEXT", "SPATIAL"):
        kind = r.next().upper()
        r.accept("KEY") or r.accept("INDEX")
        name = _name(r.next()) if r.peek() != "(" else ""
        while r.peek() != "(":
            r.next()
        table.indexes.append(CatalogIndex(name, _key_columns(r.parenthesised()), kind == "UNIQUE", kind="" if kind in ("UNIQUE", "KEY", "INDEX") else kind.lower()))
    elif r.word() in ("FOREIGN", "CHECK"):
        return
    else:
        _column(tokens, table)


def parse(text: str) -> dict[str, CatalogTable]:
    """Tables by name. Statements other than CREATE TABLE are passed over; CREATE TABLE LIKE and AS SELECT are errors."""
    catalog: dict[str, CatalogTable] = {}
    statement: list[str] = []
    for t in [*_tokens(text), ";"]:
        if t != ";":
            statement.append(t)
            continue
        r, statement = _Reader(statement), []
        if not r.accept("CREATE", "TABLE") and not r.accept("CREATE", "TEMPORARY", "TABLE"):
            continue
        r.accept("IF", "NOT", "EXISTS")
        name = _name(r.next())
        if r.peek() == ".":
            r.next()
            name = _name(r.next())
        if r.word() == "LIKE" or r.peek() == "(" and r.word(1) == "LIKE" or r.peek() != "(":
            raise DDLError(f"{name}: CREATE TABLE LIKE and AS SELECT aren't read")
        if name in catalog:
            raise DDLError(f"{name} is created twice")
        table = CatalogTable(name)
        parts = _split(r.parenthesised())
        keys = ("PRIMARY", "UNIQUE", "KEY", "INDEX", "CONSTRAINT", "FOREIGN", "CHECK", "VECTOR", "FULLTEXT", "SPATIAL")
        for part in sorted(parts, key=lambda p: p[0].upper() in keys):  # columns first
            _element(part, table)
        if "SELECT" in [t.upper() for t in r.tokens[r.at :]]:
            raise DDLError(f"{name}: AS SELECT isn't read")
        for i in table.indexes:
            for c in i.columns:
                if c and c not in table.columns:
                    raise DDLError(f"{name}: index {i.name} names no column {c}")
        catalog[name] = table
    return catalog
