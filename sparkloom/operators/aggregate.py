"""Aggregates, and windows over their groups."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from ..errors import BuildError
from ..plans.inspect import Inspect
from ..plans.observe import observed
from ..plans.policy import Policy
from ..sources.tables import TableSource
from .model import Field as ModelField
from .model import Model
from .order import Order, check_orders, check_page, page
from .predicate import TEXT, Comparison, Existence, Logical, Predicate, Scope, compare, compile_predicate, conjunction, filtered, validate

ALIAS = re.compile(r"[A-Z][A-Za-z0-9_]{0,63}\Z")
KEYS = ("field", "date", "year_month")


@dataclass(frozen=True)
class Expression:
    """One output: a group key or a metric over a field."""

    kind: str
    path: str = ""
    predicate: Predicate | None = None
    alias: str = ""

    def As(self, alias: str) -> Expression:
        return replace(self, alias=alias)

    def over(self, spec: Spec) -> WindowExpression:
        """A window aggregate whose field is an aggregate output."""
        return WindowExpression(self.kind, self.path, spec, 0, "", self.predicate)

    @property
    def output(self) -> str:
        if self.alias:
            return self.alias
        words = {"count_all": "Count", "count": "Count", "count_distinct": "CountDistinct", "count_if": "CountIf", "sum": "Sum", "sum_if": "SumIf", "avg": "Avg", "min": "Min", "max": "Max", "date": "Date", "year_month": "YearMonth"}
        return self.path if self.kind == "field" else words[self.kind] + (self.path if self.kind != "count_all" else "")

    def shape(self) -> list:
        from ..plans.shape import predicate_shape

        return [self.kind, self.path, self.output, *([predicate_shape(self.predicate)] if self.predicate else [])]


def Field(path: str) -> Expression:
    """A group key: a field, or a field of a to-one relation by dotted path (which needs As)."""
    return Expression("field", path)


def Date(path: str) -> Expression:
    return Expression("date", path)


def YearMonth(path: str) -> Expression:
    """year * 100 + month; NULL stays NULL."""
    return Expression("year_month", path)


def CountAll() -> Expression:
    return Expression("count_all")


def Count(path: str) -> Expression:
    return Expression("count", path)


def CountDistinct(path: str) -> Expression:
    return Expression("count_distinct", path)


def CountIf(predicate: Predicate) -> Expression:
    return Expression("count_if", "", predicate)


def Sum(path: str) -> Expression:
    return Expression("sum", path)


def SumIf(path: str, predicate: Predicate) -> Expression:
    return Expression("sum_if", path, predicate)


def Avg(path: str) -> Expression:
    return Expression("avg", path)


def Min(path: str) -> Expression:
    return Expression("min", path)


def Max(path: str) -> Expression:
    return Expression("max", path)


UNBOUNDED = "unbounded"


@dataclass(frozen=True)
class Rows:
    start: int | str
    end: int | str


def RowsBetween(start: int | str, end: int | str) -> Rows:
    """Offsets from the current row (negative: before), or UNBOUNDED at either end."""
    if start != UNBOUNDED and end != UNBOUNDED and start > end:
        raise BuildError("a frame can't end before it starts")
    return Rows(start, end)


@dataclass(frozen=True)
class Spec:
    """Names of aggregate outputs. Without order the frame is the partition; with order it runs to the current row's peers."""

    partition_by: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()
    rows: Rows | None = None

    def window(self) -> WindowSpec:
        w = Window.partitionBy(*[F.col(n) for n in self.partition_by])
        if self.order_by:
            w = w.orderBy(*[o.over(F.col(o.name)) for o in self.order_by])
        if self.rows:
            w = w.rowsBetween(Window.unboundedPreceding if self.rows.start == UNBOUNDED else int(self.rows.start), Window.unboundedFollowing if self.rows.end == UNBOUNDED else int(self.rows.end))
        return w


def spec(partition_by=(), order_by=(), rows: Rows | None = None) -> Spec:
    return Spec(tuple(partition_by), tuple(order_by), rows)


@dataclass(frozen=True)
class WindowExpression:
    kind: str
    field: str = ""
    spec: Spec = Spec()
    offset: int = 0
    alias: str = ""
    predicate: Predicate | None = None

    def over(self, spec: Spec) -> WindowExpression:
        return replace(self, spec=spec)

    def As(self, alias: str) -> WindowExpression:
        return replace(self, alias=alias)

    def shape(self) -> list:
        rows = self.spec.rows
        return [self.kind, self.field, self.alias, list(self.spec.partition_by), [[o.name, o.descending] for o in self.spec.order_by], [rows.start, rows.end] if rows else []]


def RowNumber() -> WindowExpression:
    return WindowExpression("row_number")


def Rank() -> WindowExpression:
    return WindowExpression("rank")


def DenseRank() -> WindowExpression:
    return WindowExpression("dense_rank")


def Lag(output: str, offset: int = 1) -> WindowExpression:
    return WindowExpression("lag", output, offset=offset)


def Lead(output: str, offset: int = 1) -> WindowExpression:
    return WindowExpression("lead", output, offset=offset)


def FirstValue(output: str) -> WindowExpression:
    return WindowExpression("first_value", output)


def LastValue(output: str) -> WindowExpression:
    return WindowExpression("last_value", output)


RANKS = ("row_number", "rank", "dense_rank")
OVER = ("count_all", "count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Aggregate(Inspect):
    """Immutable builder. Where never multiplies source rows: Has is an existence test and dotted paths need a unique target key."""

    model: Model
    outputs: tuple[Expression, ...] = ()
    grouped: tuple[str, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    having_: tuple[Predicate, ...] = ()
    windows: tuple[WindowExpression, ...] = ()
    orders: tuple[Order, ...] = ()
    limited: int | None = None
    skipped: int = 0
    deleted: bool = False
    policy: Policy = Policy()

    def select(self, *outputs: Expression) -> Aggregate:
        return replace(self, outputs=self.outputs + outputs)

    def group_by(self, *names: str) -> Aggregate:
        return replace(self, grouped=self.grouped + names)

    def where(self, *predicates: Predicate) -> Aggregate:
        return replace(self, predicates=self.predicates + predicates)

    def having(self, *predicates: Predicate) -> Aggregate:
        return replace(self, having_=self.having_ + predicates)

    def window(self, *windows: WindowExpression) -> Aggregate:
        return replace(self, windows=self.windows + windows)

    def order_by(self, *orders: Order) -> Aggregate:
        return replace(self, orders=self.orders + orders)

    def limit(self, n: int) -> Aggregate:
        return replace(self, limited=n)

    def offset(self, n: int) -> Aggregate:
        return replace(self, skipped=n)

    def with_deleted(self) -> Aggregate:
        return replace(self, deleted=True)

    def read_from(self, engine: str) -> Aggregate:
        return replace(self, policy=replace(self.policy, engine=engine))

    def mpp(self, mode: str) -> Aggregate:
        return replace(self, policy=replace(self.policy, parallel=mode))

    def _path(self, path: str) -> tuple[tuple[str, ...], Model, ModelField]:
        *relations, name = path.split(".")
        model = self.model
        for i, r in enumerate(relations):
            relation, keys = model.relation(r), model.resolve(r)
            if relation.collection:
                raise BuildError(f"{path}: {r} is a collection")
            if not keys.target.is_unique({f.name for f in keys.target.fields if f.column in [b for _, b in keys.direct]}):
                raise BuildError(f"{path}: {keys.target.name}'s key for {'.'.join(relations[: i + 1])} isn't declared unique")
            model = keys.target
        return tuple(relations), model, model.field(name)

    def validate(self) -> Aggregate:
        if not self.outputs:
            raise BuildError("Select needs an expression")
        names: dict[str, Expression] = {}
        for o in self.outputs:
            if "." in o.path and not o.alias:
                raise BuildError(f"{o.path} needs As")
            if not ALIAS.match(o.output) and (o.alias or o.kind != "field"):
                raise BuildError(f"{o.output!r} can't be an output's name")
            if o.output.lower() in map(str.lower, names):
                raise BuildError(f"output {o.output} is named twice")
            names[o.output] = o
            if o.path:
                relations, _, f = self._path(o.path)
                if relations and o.kind not in KEYS:
                    raise BuildError(f"{o.kind} needs a field of {self.model.name} itself")
                if o.kind in ("date", "year_month") and f.kind != "time":
                    raise BuildError(f"{o.path} isn't a time")
                if o.kind in ("sum", "avg", "sum_if") and f.kind not in ("int", "uint", "float", "custom"):
                    raise BuildError(f"{o.path} isn't a number")
            if o.predicate is not None:
                validate(o.predicate, self.model)
        if len(set(self.grouped)) < len(self.grouped):
            raise BuildError("an output is grouped by twice")
        for g in self.grouped:
            if g not in names or names[g].kind not in KEYS:
                raise BuildError(f"GroupBy needs a selected Field, Date or YearMonth: {g}")
        keyed = {(names[g].kind, names[g].path) for g in self.grouped}
        for o in self.outputs:
            if o.kind in KEYS and (o.kind, o.path) not in keyed:
                raise BuildError(f"{o.output} must be grouped by")
        for p in self.predicates:
            validate(p, self.model)
        for p in self.having_:
            self._check_having(p, names)
        after = dict.fromkeys(names)
        for w in self.windows:
            self._check_window(w, names)
            if not ALIAS.match(w.alias) or w.alias.lower() in map(str.lower, after):
                raise BuildError(f"a window needs As with a new name: {w.alias!r}")
            after[w.alias] = None
        check_orders(self.orders)
        for o in self.orders:
            if o.name not in after:
                raise BuildError(f"OrderBy needs an output: {o.name}")
        check_page(self.limited, self.skipped)
        if self.deleted and not self.model.soft_delete:
            raise BuildError(f"{self.model.name} has no soft-delete field")
        self.policy.validate()
        return self

    def _check_having(self, p: Predicate, names: dict) -> None:
        if isinstance(p, Existence) or isinstance(p, Comparison) and (p.op in TEXT or p.field not in names):
            raise BuildError("Having compares outputs with values")
        for part in getattr(p, "parts", ()):
            self._check_having(part, names)

    def _check_window(self, w: WindowExpression, names: dict) -> None:
        s = w.spec
        if w.kind not in (*RANKS, "lag", "lead", "first_value", "last_value", *OVER) or w.predicate is not None:
            raise BuildError(f"{w.kind} can't be a window")
        if w.kind in (*RANKS, "lag", "lead"):
            if s.rows:
                raise BuildError(f"{w.kind} takes no frame")
        if w.kind not in OVER and not s.order_by or s.rows and not s.order_by:
            raise BuildError(f"{w.kind} needs OrderBy")
        if w.offset < 0:
            raise BuildError("an offset can't be negative")
        if w.kind not in (*RANKS, "count_all") and w.field not in names:
            raise BuildError(f"a window reads an output: {w.field!r}")
        if len(set(s.partition_by)) < len(s.partition_by):
            raise BuildError("an output is partitioned by twice")
        check_orders(s.order_by)
        for n in (*s.partition_by, *[o.name for o in s.order_by]):
            if n not in names:
                raise BuildError(f"a window reads outputs: {n}")

    def df(self, source: TableSource) -> DataFrame:
        self.validate()
        source = self.policy.source(source)
        scope = Scope(self.model, source)
        df = filtered(scope.rows(), scope, self.predicates, self.deleted)
        # existence tests of metrics become flags below the aggregate
        flags: dict[int, str] = {}
        for i, o in enumerate(self.outputs):
            if o.predicate is not None:
                flags[i] = f"flag_{i}_{scope.alias}"
                df = df.withColumn(flags[i], compile_predicate(o.predicate, scope))
        scopes: dict[tuple[str, ...], Scope] = {(): scope}
        for o in self.outputs:
            relations = self._path(o.path)[0] if o.path else ()
            for n in range(1, len(relations) + 1):
                if relations[:n] not in scopes:  # one join for each distinct path
                    near, keys = scopes[relations[: n - 1]], scopes[relations[: n - 1]].model.resolve(relations[n - 1])
                    to = scopes[relations[:n]] = Scope(keys.target, source)
                    on = conjunction([*[near.column(a) == to.column(b) for a, b in keys.direct], *to.active()])
                    df = df.join(to.rows(), on, "left")
        value = lambda o: scopes[self._path(o.path)[0]].of(self._path(o.path)[2].name)
        keys = {(o.kind, o.path): _key(o.kind, value(o)) for o in self.outputs if o.kind in KEYS}
        labels = {k: f"g{i}" for i, k in enumerate(keys)}
        metrics = [_metric(o, value(o) if o.path else None, F.col(flags[i]) if i in flags else None).alias(f"m{i}") for i, o in enumerate(self.outputs) if o.kind not in KEYS]
        groups = df.groupBy(*[c.alias(labels[k]) for k, c in keys.items()])
        df = groups.agg(*metrics) if metrics else df.select(*[c.alias(labels[k]) for k, c in keys.items()]).distinct()
        df = df.select(*[F.col(labels[o.kind, o.path] if o.kind in KEYS else f"m{i}").alias(o.output) for i, o in enumerate(self.outputs)])
        for p in self.having_:
            df = df.where(_having(p))
        if self.windows:
            df = df.select("*", *[_window(w).alias(w.alias) for w in self.windows])
        if self.orders:
            df = df.orderBy(*[o.over(F.col(o.name)) for o in self.orders])
        return page(df, self.limited, self.skipped)

    def all(self, source: TableSource) -> list[Row]:
        return observed("ScanAll", self, source, lambda: self.df(source).collect())

    def scan_all(self, source: TableSource, into: type | None = None) -> list:
        names = [o.output for o in self.outputs] + [w.alias for w in self.windows]
        if into is None:
            if len(names) != 1:
                raise BuildError("a scalar result needs exactly one output")
            return [r[0] for r in self.all(source)]
        return [into(**r.asDict()) for r in self.all(source)]

    def compare(self, source: TableSource, **options):
        """Runs under every read policy; see plans.compare."""
        from ..plans.compare import compare

        return compare(self, source, **options)

    def build(self, source: TableSource) -> tuple[str, dict]:
        from ..plans.shape import query_shape

        return self.df(source)._jdf.queryExecution().analyzed().toString(), query_shape(self)


def _key(kind: str, c: Column) -> Column:
    if kind == "date":
        return F.to_date(c)
    return (F.year(c) * 100 + F.month(c)).cast("long") if kind == "year_month" else c


def _metric(o: Expression, c: Column | None, flag: Column | None) -> Column:
    return {
        "count_all": lambda: F.count(F.lit(1)),
        "count": lambda: F.count(c),
        "count_distinct": lambda: F.count_distinct(c),
        "count_if": lambda: F.count(F.when(flag, 1)),
        "sum": lambda: F.sum(c),
        "sum_if": lambda: F.sum(F.when(flag, c)),
        "avg": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
    }[o.kind]()


def _having(p: Predicate) -> Column:
    if isinstance(p, Comparison):
        return compare(F.col(p.field), p.op, p.values)
    assert isinstance(p, Logical)
    parts = [_having(x) for x in p.parts]
    if p.op == "not":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if p.op == "and" else (lambda a, b: a | b), parts)


def _window(w: WindowExpression) -> Column:
    c = F.col(w.field) if w.field else F.lit(1)
    found = {
        "row_number": lambda: F.row_number(),
        "rank": lambda: F.rank(),
        "dense_rank": lambda: F.dense_rank(),
        "lag": lambda: F.lag(c, w.offset),
        "lead": lambda: F.lead(c, w.offset),
        "first_value": lambda: F.first_value(c),
        "last_value": lambda: F.last_value(c),
        "count_all": lambda: F.count(F.lit(1)),
        "count": lambda: F.count(c),
        "sum": lambda: F.sum(c),
        "avg": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
    }[w.kind]().over(w.spec.window())
    return found.cast("long") if w.kind in RANKS else found
