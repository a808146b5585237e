"""Mutations as state transitions: DataFrame -> DataFrame.

`apply(df, ...)` gives the table's next state and `affected(df)` the number of matched rows. Files don't
change in place: `sources.store` commits a new version and swaps it in. Nothing is collected but counts
and duplicate checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BuildError, DuplicateKey
from ..sources.tables import TableSource
from .model import Field, Model
from .predicate import Predicate, Scope, compile_predicate, conjunction, validate


def _writable(model: Model) -> list[Field]:
    return [f for f in model.fields if not f.computed]


def rows_frame(spark: SparkSession, model: Model, values: Sequence[dict], fields: Sequence[Field]) -> DataFrame:
    """Rows of field values as a DataFrame of columns; unknown fields are errors."""
    known = {f.name for f in fields}
    for v in values:
        if unknown := set(v) - known:
            raise BuildError(f"{model.name} can't take {sorted(unknown)}")
    schema = T.StructType([T.StructField(f.column, f.spark_type, True) for f in fields])
    return spark.createDataFrame([tuple(v.get(f.name) for f in fields) for v in values], schema)


def _equal(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return conjunction([x == y for x, y in zip(a, b, strict=True)])  # type: ignore[return-value]


def _conflict(df: DataFrame, new: DataFrame, model: Model) -> None:
    for key in model.unique_keys:
        columns = [f.column for f in key]
        given = new.select(*columns).where(conjunction([F.col(c).isNotNull() for c in columns]))
        if given.groupBy(*columns).count().where("count > 1").limit(1).count() or df.select(*columns).join(given, columns, "left_semi").limit(1).count():
            raise DuplicateKey(f"{model.name}: {', '.join(f.name for f in key)}")


def _single(new: DataFrame, model: Model) -> None:
    for key in model.unique_keys:
        columns = [f.column for f in key]
        if new.where(conjunction([F.col(c).isNotNull() for c in columns])).groupBy(*columns).count().where("count > 1").limit(1).count():
            raise DuplicateKey(f"{model.name}: {', '.join(f.name for f in key)} is repeated")


@dataclass(frozen=True)
class Insert:
    """Adds rows; a duplicate of any declared key raises. Missing auto_random keys are allocated above the largest."""

    model: Model
    values: tuple[dict, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        if not self.values:
            return df
        fields, values = _writable(self.model), [dict(v) for v in self.values]
        if auto := next((f for f in fields if f.auto_random), None):
            missing = [v for v in values if v.get(auto.name) is None]
            if missing:
                top = df.agg(F.max(auto.column)).collect()[0][0] or 0
                given = [v[auto.name] for v in values if v.get(auto.name) is not None]
                for i, v in enumerate(missing, int(max([top, *given])) + 1):
                    v[auto.name] = i
        new = rows_frame(df.sparkSession, self.model, values, fields)
        _conflict(df, new, self.model)
        return df.unionByName(_typed(new, df), allowMissingColumns=True)

    def affected(self, df: DataFrame) -> int:
        return len(self.values)


def _typed(new: DataFrame, like: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in like.schema}
    return new.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in new.columns])


@dataclass(frozen=True)
class Upsert:
    """Inserts, or updates the row that has one of the declared keys; `fields` limits what is updated.

    Values are taken one after another: one that has a key of an earlier one updates that."""

    model: Model
    values: tuple[dict, ...]
    fields: tuple[str, ...] = ()

    def _new(self, df: DataFrame) -> DataFrame:
        if not self.model.unique_keys:
            raise BuildError(f"{self.model.name} has no key to conflict by")
        for f in self.fields:
            if self.model.field(f).pk:
                raise BuildError(f"{f} is a primary key field")
        return _typed(rows_frame(df.sparkSession, self.model, self._folded(), _writable(self.model)), df)

    def _folded(self) -> list[dict]:
        """The values with those that repeat a declared key folded into the first that has it."""
        changed = self.fields or tuple(f.name for f in _writable(self.model) if not f.pk)
        rows: list[dict] = []
        at: dict[tuple, int] = {}
        for v in self.values:
            keys = [k for i, key in enumerate(self.model.unique_keys) if None not in (k := (i, *(v.get(f.name) for f in key)))]
            place = next((at[k] for k in keys if k in at), None)
            if place is None:
                place = len(rows)
                rows.append(dict(v))
            else:
                rows[place] |= {name: v.get(name) for name in changed}
            row = rows[place]
            at |= {k: place for i, key in enumerate(self.model.unique_keys) if None not in (k := (i, *(row.get(f.name) for f in key)))}
        return rows

    def apply(self, df: DataFrame) -> DataFrame:
        return self.merge(df, self._new(df)) if self.values else df

    def merge(self, df: DataFrame, new: DataFrame) -> DataFrame:
        """The state after `new` (columns of the model, keys unique within it) is upserted.

        Keys are tried in declared order, as equi-joins, so a row is updated by its first conflict. The last key's
        join gives both what is updated and what is inserted. A key that is repeated in `new` raises."""
        _single(new, self.model)
        columns = [f.column for f in _writable(self.model)]
        changed = [self.model.field(n).column for n in self.fields] or [f.column for f in _writable(self.model) if not f.pk]
        state, left = df, new
        for i, key in enumerate(self.model.unique_keys):
            names, last = [f.column for f in key], i == len(self.model.unique_keys) - 1
            incoming = left.select(*[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("new_row"))
            on = _equal([F.col(n) for n in names], [F.col(f"new_{n}") for n in names])
            if last:
                known = state.withColumn("old_row", F.lit(True)).join(incoming, on, "full_outer")
                taken = lambda c: F.when(F.col("old_row").isNull(), F.col(f"new_{c}")).when(F.col("new_row"), F.col(f"new_{c}")).otherwise(F.col(c))
                kept = lambda c: F.when(F.col("old_row").isNull(), F.col(f"new_{c}")).otherwise(F.col(c))
                return known.select(*[(taken(c) if c in changed else kept(c) if c in columns else F.col(c)).alias(c) for c in df.columns])
            joined = state.join(incoming, on, "left")
            # NULL is a legal new value: whether a row matched decides, not whether the value is there
            updated = joined.select(*[F.when(F.col("new_row"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns])
            left = left.join(state.select(*names), names, "left_anti").select(*new.columns)
            state = updated
        return state

    def affected(self, df: DataFrame) -> int:
        return len(self.values)


@dataclass(frozen=True)
class UpdateMany:
    """Row-specific values by primary key; never inserts, touches active rows only."""

    model: Model
    values: tuple[dict, ...]
    fields: tuple[str, ...] = ()
    deleted: bool = False

    def with_deleted(self) -> UpdateMany:
        return replace(self, deleted=True)

    def validate(self) -> UpdateMany:
        m = self.model
        if not m.pk:
            raise BuildError(f"{m.name} has no primary key")
        keys = [tuple(v.get(f.name) for f in m.pk) for v in self.values]
        if any(None in k for k in keys) or len(set(keys)) < len(keys):
            raise DuplicateKey(f"{m.name}: keys must be given once each")
        for n in self.fields:
            if m.field(n).pk:
                raise BuildError(f"{n} is a primary key field")
        if self.deleted and not m.soft_delete:
            raise BuildError(f"{m.name} has no soft-delete field")
        return self

    def _joined(self, df: DataFrame) -> DataFrame:
        fields = [self.model.field(n) for n in self.fields] or [f for f in _writable(self.model) if not f.pk]
        every = [*self.model.pk, *fields]
        given = [{f.name: v.get(f.name) for f in every} for v in self.values]
        new = _typed(rows_frame(df.sparkSession, self.model, given, every), df)
        new = new.select(*[F.col(f.column).alias(f"new_{f.column}") for f in every], F.lit(True).alias("new_row"))
        on = [F.col(f.column) == F.col(f"new_{f.column}") for f in self.model.pk]
        if self.model.soft_delete and not self.deleted:
            on.append(F.col(self.model.soft_delete.column).isNull())
        return df.join(new, conjunction(on), "left")

    def apply(self, df: DataFrame) -> DataFrame:
        self.validate()
        if not self.values:
            return df
        changed = {self.model.field(n).column for n in self.fields} or {f.column for f in _writable(self.model) if not f.pk}
        return self._joined(df).select(*[F.when(F.col("new_row"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns])

    def affected(self, df: DataFrame) -> int:
        self.validate()
        return self._joined(df).where("new_row").count() if self.values else 0


def Update(model: Model, value: dict, *fields: str) -> UpdateMany:
    return UpdateMany(model, (value,), fields)


@dataclass(frozen=True)
class Assignment:
    field: str
    value: object
    add: bool = False


def Set(field: str, value) -> Assignment:
    return Assignment(field, value)


def Increment(field: str, delta) -> Assignment:
    if delta is None or isinstance(delta, bool):
        raise BuildError("Increment needs a number")
    return Assignment(field, delta, True)


def _matching(model: Model, df: DataFrame, predicates: tuple[Predicate, ...], deleted: bool) -> Column:
    """TRUE where every predicate is; unknown isn't a match."""
    if not predicates:
        raise BuildError("a predicate is needed")
    for p in predicates:
        validate(p, model, relations=False)
    scope = _Bare(model, TableSource(df.sparkSession))
    parts = [compile_predicate(p, scope) for p in predicates]
    if model.soft_delete and not deleted:
        parts.append(F.col(model.soft_delete.column).isNull())
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


class _Bare(Scope):
    """Columns without an alias."""

    def column(self, column: str) -> Column:
        return F.col(column)


@dataclass(frozen=True)
class UpdateWhere:
    model: Model
    assignments: tuple[Assignment, ...]
    predicates: tuple[Predicate, ...] = ()
    deleted: bool = False

    def where(self, *predicates: Predicate) -> UpdateWhere:
        return replace(self, predicates=self.predicates + predicates)

    def with_deleted(self) -> UpdateWhere:
        return replace(self, deleted=True)

    @property
    def assigned(self) -> tuple[str, ...]:
        return tuple(a.field for a in self.assignments)

    @property
    def added(self) -> tuple[str, ...]:
        return tuple(a.field for a in self.assignments if a.add)

    def validate(self) -> UpdateWhere:
        if not self.assignments or len(set(self.assigned)) < len(self.assignments):
            raise BuildError("UpdateWhere needs assignments, one for a field")
        for a in self.assignments:
            f = self.model.field(a.field)
            if f.pk or f.auto_random:
                raise BuildError(f"{a.field} is a primary key field")
            if a.add and f.kind not in ("int", "uint", "float", "custom"):
                raise BuildError(f"{a.field} isn't a number")
        if self.deleted and not self.model.soft_delete:
            raise BuildError(f"{self.model.name} has no soft-delete field")
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        self.validate()
        hit = _matching(self.model, df, self.predicates, self.deleted)
        types = {f.name: f.dataType for f in df.schema}
        new = {}
        for a in self.assignments:
            c = self.model.field(a.field).column
            new[c] = F.when(hit, F.col(c) + F.lit(a.value) if a.add else F.lit(a.value)).otherwise(F.col(c)).cast(types[c])
        return df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])

    def affected(self, df: DataFrame) -> int:
        return df.where(_matching(self.model, df, self.predicates, self.deleted)).count()


@dataclass(frozen=True)
class DeleteWhere:
    """Removes matching rows, or sets the soft-delete field of active ones."""

    model: Model
    predicates: tuple[Predicate, ...] = ()
    at: Column | None = None

    def where(self, *predicates: Predicate) -> DeleteWhere:
        return replace(self, predicates=self.predicates + predicates)

    def apply(self, df: DataFrame) -> DataFrame:
        hit = _matching(self.model, df, self.predicates, False)
        f = self.model.soft_delete
        if not f:
            return df.where(~hit)
        kind = next(x.dataType for x in df.schema if x.name == f.column)
        now = F.current_timestamp() if self.at is None else self.at
        return df.withColumn(f.column, F.when(hit, now.cast(kind)).otherwise(F.col(f.column)))

    def affected(self, df: DataFrame) -> int:
        return df.where(_matching(self.model, df, self.predicates, False)).count()


def Delete(model: Model, value: dict) -> DeleteWhere:
    from .predicate import Equal

    if not model.pk:
        raise BuildError(f"{model.name} has no primary key")
    return DeleteWhere(model, tuple(Equal(f.name, value.get(f.name)) for f in model.pk))


@dataclass(frozen=True)
class CompositeKey:
    values: tuple

    def __init__(self, *values) -> None:
        object.__setattr__(self, "values", values)


@dataclass(frozen=True)
class Links:
    """Adds or removes pairs of a pure junction. Keys are scalars, or CompositeKey."""

    model: Model
    relation: str

    def _junction(self):
        keys = self.model.resolve(self.relation)
        if not keys.near or keys.edge is not None:
            raise BuildError(f"{self.relation} has no junction of its own")
        return [b for _, b in keys.near], [a for a, _ in keys.far]

    def _pairs(self, df: DataFrame, source, targets: Sequence) -> DataFrame:
        near, far = self._junction()
        parts = lambda k: k.values if isinstance(k, CompositeKey) else (k,)
        rows = [(*parts(source), *parts(t)) for t in targets]
        if any(len(r) != len(near) + len(far) or None in r for r in rows):
            raise BuildError("a key doesn't fit the junction")
        kinds = {f.name: f.dataType for f in df.schema}
        return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(c, kinds[c]) for c in [*near, *far]]))

    def add(self, df: DataFrame, source, targets: Sequence, ignore_existing: bool = False) -> DataFrame:
        near, far = self._junction()
        if not targets:
            return df
        new = self._pairs(df, source, targets)
        known = df.join(F.broadcast(new), [*near, *far], "left_semi")  # the few pairs move, not the junction
        if ignore_existing:
            new = new.distinct().join(F.broadcast(known.select(*near, *far).distinct()), [*near, *far], "left_anti")
        elif new.distinct().count() < len(targets) or known.limit(1).count():
            raise DuplicateKey(f"{self.model.name}.{self.relation}")
        return df.unionByName(new)

    def remove(self, df: DataFrame, source, targets: Sequence) -> DataFrame:
        near, far = self._junction()
        return df.join(F.broadcast(self._pairs(df, source, targets)), [*near, *far], "left_anti").select(*df.columns) if targets else df

    def clear(self, df: DataFrame, source) -> DataFrame:
        near, _ = self._junction()
        values = source.values if isinstance(source, CompositeKey) else (source,)
        if len(values) != len(near) or None in values:
            raise BuildError("a key doesn't fit the junction")
        return df.where(~F.coalesce(conjunction([F.col(c) == v for c, v in zip(near, values, strict=True)]), F.lit(False)))
