"""Predicates: an immutable tree, validated against a model, compiled to a Column.

SQL's three-valued logic holds throughout. Has becomes an EXISTS subquery, which Catalyst plans as a
semi, anti or existence join according to where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BuildError, ModelError
from ..sources.tables import TableSource
from .model import Model


@dataclass(frozen=True)
class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Comparison(Predicate):
    field: str
    op: str
    values: tuple = ()


@dataclass(frozen=True)
class Logical(Predicate):
    op: str
    parts: tuple[Predicate, ...]


@dataclass(frozen=True)
class Existence(Predicate):
    relation: str
    parts: tuple[Predicate, ...]


def _some(value, what: str):
    if value is None:
        raise BuildError(f"{what} needs a value; use IsNull or IsNotNull for NULL")
    return value


def Equal(field: str, value) -> Predicate:
    return Comparison(field, "=", (_some(value, "Equal"),))


def NotEqual(field: str, value) -> Predicate:
    return Comparison(field, "<>", (_some(value, "NotEqual"),))


def GreaterThan(field: str, value) -> Predicate:
    return Comparison(field, ">", (_some(value, "GreaterThan"),))


def GreaterThanOrEqual(field: str, value) -> Predicate:
    return Comparison(field, ">=", (_some(value, "GreaterThanOrEqual"),))


def LessThan(field: str, value) -> Predicate:
    return Comparison(field, "<", (_some(value, "LessThan"),))


def LessThanOrEqual(field: str, value) -> Predicate:
    return Comparison(field, "<=", (_some(value, "LessThanOrEqual"),))


def In(field: str, values) -> Predicate:
    """An empty list matches nothing."""
    return Comparison(field, "in", tuple(_some(v, "In") for v in values))


def NotIn(field: str, values) -> Predicate:
    """An empty list matches everything, NULL too; otherwise NULL doesn't match."""
    return Comparison(field, "not in", tuple(_some(v, "NotIn") for v in values))


def IsNull(field: str) -> Predicate:
    return Comparison(field, "is null")


def IsNotNull(field: str) -> Predicate:
    return Comparison(field, "is not null")


def Between(field: str, low, high) -> Predicate:
    return Comparison(field, "between", (_some(low, "Between"), _some(high, "Between")))


def Contains(field: str, value: str) -> Predicate:
    return Comparison(field, "contains", (_some(value, "Contains"),))


def HasPrefix(field: str, value: str) -> Predicate:
    return Comparison(field, "prefix", (_some(value, "HasPrefix"),))


def HasSuffix(field: str, value: str) -> Predicate:
    return Comparison(field, "suffix", (_some(value, "HasSuffix"),))


def And(*parts: Predicate) -> Predicate:
    if len(parts) < 2:
        raise BuildError("And needs two predicates or more")
    return Logical("and", parts)


def Or(*parts: Predicate) -> Predicate:
    if len(parts) < 2:
        raise BuildError("Or needs two predicates or more")
    return Logical("or", parts)


def Not(part: Predicate) -> Predicate:
    return Logical("not", (part,))


def Has(relation: str, *parts: Predicate) -> Predicate:
    """At least one related row satisfies all parts."""
    return Existence(relation, parts)


TEXT = ("contains", "prefix", "suffix")


def compare(column: Column, op: str, values: tuple) -> Column:
    if op == "in":
        return column.isin(*values) if values else F.lit(False)
    if op == "not in":
        return ~column.isin(*values) if values else F.lit(True)
    return {
        "=": lambda: column == values[0],
        "<>": lambda: column != values[0],
        ">": lambda: column > values[0],
        ">=": lambda: column >= values[0],
        "<": lambda: column < values[0],
        "<=": lambda: column <= values[0],
        "is null": column.isNull,
        "is not null": column.isNotNull,
        "between": lambda: column.between(*values),
        "contains": lambda: column.contains(values[0]),
        "prefix": lambda: column.startswith(values[0]),
        "suffix": lambda: column.endswith(values[0]),
    }[op]()


def walk(p: Predicate) -> Iterator[Predicate]:
    yield p
    for part in getattr(p, "parts", ()):
        yield from walk(part)


def has_relation(p: Predicate) -> bool:
    return any(isinstance(x, Existence) for x in walk(p))


def validate(p: Predicate, model: Model, relations: bool = True) -> None:
    """Raises before anything runs if p can't be a predicate of the model."""
    if isinstance(p, Comparison):
        f = model.field(p.field)
        if f.kind == "vector" and p.op not in ("is null", "is not null"):
            raise BuildError(f"{model.name}.{p.field} is a vector: it can only be compared with NULL")
        if p.op in TEXT and (f.kind != "string" or not isinstance(p.values[0], str)):
            raise BuildError(f"{p.op} needs a string field and a string: {model.name}.{p.field}")
    elif isinstance(p, Logical):
        for part in p.parts:
            validate(part, model, relations)
    elif isinstance(p, Existence):
        if not relations:
            raise BuildError("relation predicates aren't allowed here")
        target = model.resolve(p.relation).target
        for part in p.parts:
            validate(part, target)
    else:
        raise BuildError(f"{p!r} isn't a predicate")


class Scope:
    """A model's rows under an alias of their own."""

    names = count()

    def __init__(self, model: Model, source: TableSource, alias: str | None = None) -> None:
        self.model, self.source = model, source
        self.alias = alias or f"t{next(Scope.names)}_{model.table}"

    def rows(self) -> DataFrame:
        return self.source.table(self.model.table).alias(self.alias)

    def column(self, column: str) -> Column:
        return F.col(f"{self.alias}.{column}")

    def of(self, name: str) -> Column:
        return self.column(self.model.field(name).column)

    def active(self) -> list[Column]:
        f = self.model.soft_delete
        return [self.column(f.column).isNull()] if f else []


def conjunction(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


def compile_predicate(p: Predicate, scope: Scope) -> Column:
    if isinstance(p, Comparison):
        return compare(scope.of(p.field), p.op, p.values)
    if isinstance(p, Existence):
        return related(p, scope).exists()
    assert isinstance(p, Logical)
    parts = [compile_predicate(x, scope) for x in p.parts]
    if p.op == "not":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), parts)


def related(p: Existence, scope: Scope) -> DataFrame:
    """The related rows that satisfy p's parts, tied to the enclosing row by outer references."""
    keys = scope.model.resolve(p.relation)
    to = Scope(keys.target, scope.source)
    rows = to.rows()
    conditions = [*to.active(), *[compile_predicate(x, to) for x in p.parts]]
    if keys.direct:
        conditions = [to.column(b) == scope.column(a).outer() for a, b in keys.direct] + conditions
    else:
        edge = f"{to.alias}_edge"
        on = conjunction([F.col(f"{edge}.{a}") == to.column(b) for a, b in keys.far])
        # the target's own conditions go first, below the join
        if (own := conjunction(conditions)) is not None:
            rows = rows.where(own)
        edges = scope.source.table(keys.edge_table).alias(edge)
        if keys.edge and keys.edge.soft_delete:
            edges = edges.where(F.col(f"{edge}.{keys.edge.soft_delete.column}").isNull())
        rows = edges.join(rows, on)
        conditions = [F.col(f"{edge}.{b}") == scope.column(a).outer() for a, b in keys.near]
    return rows.where(conjunction(conditions)).select(F.lit(1))


def filtered(df: DataFrame, scope: Scope, predicates: tuple[Predicate, ...], with_deleted: bool) -> DataFrame:
    """Soft-delete scope first, then the predicates in order."""
    if with_deleted and not scope.model.soft_delete:
        raise ModelError(f"{scope.model.name} has no soft-delete field")
    for c in [] if with_deleted else scope.active():
        df = df.where(c)
    for p in predicates:
        df = df.where(compile_predicate(p, scope))
    return df
