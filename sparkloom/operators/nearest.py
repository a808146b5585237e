"""Vector top-k. Filters always come first; the scan is exact unless a built index is given to an approximate search."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import BuildError
from ..functions.vector import METRICS, Vector, distance
from ..plans.inspect import Diagnostic, Inspect
from ..plans.observe import observed
from ..plans.policy import Policy
from ..sources.tables import TableSource
from .model import Model
from .predicate import Predicate, Scope, filtered, validate
from .vector_index import VectorIndex, build_vector_index

__all__ = ["Nearest", "VectorIndex", "build_vector_index", "nearest"]


@dataclass(frozen=True)
class Nearest(Inspect):
    """`approximate` orders by distance alone and may be given a built index: then only the cells nearest to the vector are read,
    so neighbours in other cells are missed, and filters may leave fewer than k rows. NULL distances come first."""

    model: Model
    field: str
    vector: Vector
    metric: str
    k: int
    fields: tuple[str, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    distance_name: str = "Distance"
    deleted: bool = False
    approximate_: bool = False
    policy: Policy = Policy()
    index: VectorIndex | None = None
    probes: int | None = None

    def select(self, *fields: str) -> Nearest:
        return replace(self, fields=self.fields + fields)

    def where(self, *predicates: Predicate) -> Nearest:
        return replace(self, predicates=self.predicates + predicates)

    def distance_as(self, name: str) -> Nearest:
        return replace(self, distance_name=name)

    def with_deleted(self) -> Nearest:
        return replace(self, deleted=True)

    def approximate(self, index: VectorIndex | None = None, probes: int | None = None) -> Nearest:
        """`probes` is how many cells of the index are read at least; by default a quarter of them."""
        return replace(self, approximate_=True, index=index, probes=probes)

    def validate(self) -> Nearest:
        if self.model.field(self.field).kind != "vector":
            raise BuildError(f"{self.field} isn't a vector")
        if not self.vector or self.metric not in METRICS or not 1 <= self.k <= 2**32 - 1:
            raise BuildError("Nearest needs a vector with dimensions, a known metric and k from 1")
        if not self.approximate_ and not self.model.pk:
            raise BuildError("exact search needs a primary key to break ties")
        if (i := self.index) and (not i.folder or (i.table, i.column, i.metric) != (self.model.table, self.model.field(self.field).column, self.metric)):
            raise BuildError("the index isn't built, or it covers another table, column or metric")
        if self.probes is not None and self.probes < 1:
            raise BuildError("an index needs a probe")
        names = self.fields or [f.name for f in self.model.fields if not f.computed]
        if len(set(names)) < len(names) or self.distance_name.lower() in map(str.lower, names):
            raise BuildError("an output is named twice")
        for n in names:
            self.model.field(n)
        for p in self.predicates:
            validate(p, self.model)
        return self

    def df(self, source: TableSource) -> DataFrame:
        self.validate()
        scope = Scope(self.model, source)
        # relations back to this table still read the table itself
        rows = self.index.probed(source, list(self.vector), self.k, self.probes).alias(scope.alias) if self.index else scope.rows()
        df = filtered(rows, scope, self.predicates, self.deleted)
        fields = [self.model.field(n) for n in self.fields] or [f for f in self.model.fields if not f.computed]
        keys = [] if self.approximate_ else [scope.column(f.column) for f in self.model.pk]
        df = df.withColumn(f"d_{scope.alias}", distance(scope.of(self.field), self.vector, self.metric))
        df = df.orderBy(F.col(f"d_{scope.alias}").asc_nulls_first(), *keys).limit(self.k)
        return df.select(*[scope.column(f.column).alias(f.name) for f in fields], F.col(f"d_{scope.alias}").alias(self.distance_name))

    def all(self, source: TableSource) -> list[Row]:
        return observed("All", self, source, lambda: self.df(source).collect())

    def build(self, source: TableSource) -> tuple[str, dict]:
        from ..plans.shape import query_shape

        return self.df(source)._jdf.queryExecution().analyzed().toString(), query_shape(self)

    def index_usage(self) -> str:
        return "used" if self.index else "not_used"

    def diagnostics(self) -> list[Diagnostic]:
        """VEC003: an approximate search that scans the whole table."""
        return [Diagnostic("VEC003", "an approximate search without an index scans the table", self.model.name)] if self.approximate_ and not self.index else []


def nearest(model: Model, field: str, vector, metric: str, k: int) -> Nearest:
    return Nearest(model, field, vector if isinstance(vector, Vector) else Vector(vector), metric, k)
