"""Scalar queries over a model."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import BuildError, MultipleRows, NoRows
from ..plans.inspect import Inspect
from ..plans.observe import observed
from ..plans.policy import Policy
from ..sources.tables import TableSource
from .model import Field, Model
from .order import Order, check_orders, check_page, page, seek
from .predicate import Predicate, Scope, filtered, validate
from .preload import Preload, attach, check_preload


@dataclass(frozen=True)
class Query(Inspect):
    """Immutable builder: every method returns a new query. Terminals take the TableSource to read from."""

    model: Model
    fields: tuple[str, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    orders: tuple[Order, ...] = ()
    limited: int | None = None
    skipped: int = 0
    cursor: tuple | None = None
    deleted: bool = False
    preloads: tuple[Preload, ...] = ()
    policy: Policy = Policy()
    rewrites: bool = True

    def select(self, *fields: str) -> Query:
        if not fields:
            raise BuildError("Select needs a field")
        return replace(self, fields=self.fields + fields)

    def where(self, *predicates: Predicate) -> Query:
        return replace(self, predicates=self.predicates + predicates)

    def order_by(self, *orders: Order) -> Query:
        return replace(self, orders=self.orders + orders)

    def limit(self, n: int) -> Query:
        return replace(self, limited=n)

    def offset(self, n: int) -> Query:
        return replace(self, skipped=n)

    def seek_after(self, *values) -> Query:
        return replace(self, cursor=values)

    def with_deleted(self) -> Query:
        return replace(self, deleted=True)

    def preload(self, path: str, *, fields: tuple[str, ...] = (), order_by: tuple[Order, ...] = (), with_deleted: bool = False) -> Query:
        return replace(self, preloads=(*self.preloads, Preload(path, tuple(fields), tuple(order_by), with_deleted)))

    def read_from(self, engine: str) -> Query:
        return replace(self, policy=replace(self.policy, engine=engine))

    def mpp(self, mode: str) -> Query:
        return replace(self, policy=replace(self.policy, parallel=mode))

    def force_index(self, name: str) -> Query:
        return replace(self, policy=replace(self.policy, index=name))

    def without_rewrites(self) -> Query:
        """Turns the metadata-proven rewrites off; results are the same."""
        return replace(self, rewrites=False)

    def projection(self) -> tuple[Field, ...]:
        return tuple(self.model.field(n) for n in self.fields) if self.fields else tuple(f for f in self.model.fields if not f.computed)

    def validate(self) -> Query:
        if len(set(self.fields)) < len(self.fields):
            raise BuildError("a field is selected twice")
        self.projection()
        for p in self.predicates:
            validate(p, self.model)
        check_orders(self.orders)
        for o in self.orders:
            self.model.field(o.name)
        check_page(self.limited, self.skipped)
        if self.deleted and not self.model.soft_delete:
            raise BuildError(f"{self.model.name} has no soft-delete field")
        self._check_cursor()
        for p in self.preloads:
            check_preload(self.model, p)
        self.policy.validate()
        return self

    def _check_cursor(self) -> None:
        if self.cursor is None:
            return
        names = {o.name for o in self.orders}
        if not self.orders or not self.model.pk or not {f.name for f in self.model.pk} <= names:
            raise BuildError("SeekAfter needs OrderBy over every primary key field")
        if self.skipped:
            raise BuildError("SeekAfter excludes Offset")
        if len(self.cursor) != len(self.orders):
            raise BuildError("SeekAfter needs a value for each OrderBy field")
        for o, v in zip(self.orders, self.cursor, strict=True):
            if v is None and not self.model.field(o.name).nullable:
                raise BuildError(f"{o.name} can't be NULL")

    def _matched(self, source: TableSource, scope: Scope) -> DataFrame:
        """Rows after soft deletion, predicates and cursor."""
        df = filtered(scope.rows(), scope, self.predicates, self.deleted)
        if self.cursor is not None:
            terms = [(scope.of(o.name), o.descending, self.model.field(o.name).nullable, v) for o, v in zip(self.orders, self.cursor, strict=True)]
            df = df.where(seek(terms))
        return df

    def _paged(self, source: TableSource, scope: Scope) -> DataFrame:
        from ..plans.rewrite import relation_top_n

        if self.rewrites and (found := relation_top_n(self, source, scope)) is not None:
            return found
        df = self._matched(source, scope)
        if self.orders:
            df = df.orderBy(*[o.over(scope.of(o.name)) for o in self.orders])
        return page(df, self.limited, self.skipped)

    def df(self, source: TableSource) -> DataFrame:
        """The lazy result: columns named by field, and one column for each preloaded relation."""
        self.validate()
        source = self.policy.source(source)
        scope = Scope(self.model, source)
        df = self._paged(source, scope)
        columns = [scope.column(f.column).alias(f.name) for f in self.projection()]
        return attach(df, scope, columns, self.preloads, source) if self.preloads else df.select(*columns)

    def all(self, source: TableSource) -> list[Row]:
        return observed("All", self, source, lambda: self.df(source).collect())

    def scan_all(self, source: TableSource, into: type | None = None) -> list:
        """Scalars of a one-column projection, or instances of a dataclass whose fields are the projection's."""
        if self.preloads:
            raise BuildError("ScanAll can't load relations")
        names = [f.name for f in self.projection()]
        if into is None or not dataclasses.is_dataclass(into):
            if len(names) != 1:
                raise BuildError("a scalar result needs exactly one selected field")
            return observed("ScanAll", self, source, lambda: [r[0] if into is None else into(r[0]) for r in self.df(source).collect()])
        if {f.name for f in dataclasses.fields(into)} != set(names):
            raise BuildError(f"{into.__name__} doesn't have the fields {names}")
        return observed("ScanAll", self, source, lambda: [into(**r.asDict()) for r in self.df(source).collect()])

    def first(self, source: TableSource) -> Row:
        rows = observed("First", self, source, lambda: replace(self, limited=min(1, 1 if self.limited is None else self.limited)).df(source).collect())
        if not rows:
            raise NoRows(self.model.name)
        return rows[0]

    def only(self, source: TableSource) -> Row:
        rows = observed("Only", self, source, lambda: replace(self, limited=min(2, 2 if self.limited is None else self.limited)).df(source).collect())
        if len(rows) != 1:
            raise (MultipleRows if rows else NoRows)(self.model.name)
        return rows[0]

    def exists_df(self, source: TableSource) -> DataFrame:
        """One row (Exists boolean). Projection and order are dropped; predicates, cursor and paging count."""
        self.validate()
        scope = Scope(self.model, source)
        df = page(self._matched(source, scope), 1 if self.limited is None else min(1, self.limited), self.skipped)
        return df.select(F.lit(1).alias("one")).agg((F.count(F.lit(1)) > 0).alias("Exists"))

    def exists(self, source: TableSource) -> bool:
        return observed("Exists", self, source, lambda: self.exists_df(source).collect()[0][0])

    def count_df(self, source: TableSource) -> DataFrame:
        """One row (Count long). With Limit or Offset it counts the page."""
        from ..plans.rewrite import relation_count

        self.validate()
        if self.rewrites and (found := relation_count(self, source)) is not None:
            return found
        scope = Scope(self.model, source)
        return page(self._matched(source, scope), self.limited, self.skipped).agg(F.count(F.lit(1)).alias("Count"))

    def count(self, source: TableSource) -> int:
        return observed("Count", self, source, lambda: self.count_df(source).collect()[0][0])

    def build(self, source: TableSource) -> tuple[str, dict]:
        """The analysed logical plan's text and the value-free shape; no job runs."""
        from ..plans.shape import query_shape

        return self.df(source)._jdf.queryExecution().analyzed().toString(), query_shape(self)
