"""Declared models: fields, keys, soft deletion and relations.

Relations and unique keys are contracts: rewrites rely on them, nothing enforces them. `sparkloom.schema.audit`
checks them against data.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import types as T

from ..errors import ModelError

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
KINDS = ("bool", "int", "uint", "float", "string", "bytes", "time", "custom", "vector")
MOST_DIMENSIONS = 16383
TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int": T.LongType(),
    "uint": T.DecimalType(20, 0),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
    "time": T.TimestampNTZType(),
    "custom": T.StringType(),
    "vector": T.ArrayType(T.FloatType(), containsNull=False),
}


def snake_case(name: str) -> str:
    """UserID -> user_id, HTTPServer -> http_server."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", spaced).lower()


@dataclass(frozen=True)
class Field:
    """One column. `kind` decides which predicates apply; `type` is its Spark type."""

    name: str
    column: str = ""
    kind: str = "int"
    type: T.DataType | None = None
    nullable: bool = False
    pk: bool = False
    auto_random: bool = False
    computed: bool = False
    soft_delete: bool = False
    unique: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "column", self.column or snake_case(self.name))
        for x in (self.name, self.column):
            if not IDENTIFIER.match(x):
                raise ModelError(f"{x!r} isn't an identifier")
        if self.kind not in KINDS:
            raise ModelError(f"{self.name}: unknown kind {self.kind!r}")
        if self.computed and (self.pk or self.auto_random or self.soft_delete or self.unique):
            raise ModelError(f"{self.name}: a computed field can't be a key or a soft-delete field")
        if self.pk and self.nullable:
            raise ModelError(f"{self.name}: a primary key field can't be nullable")
        if self.soft_delete and (self.kind != "time" or self.pk):
            raise ModelError(f"{self.name}: a soft-delete field is a nullable time and no key")
        if self.auto_random and not (self.pk and self.kind in ("int", "uint")):
            raise ModelError(f"{self.name}: auto_random needs an integer primary key")
        if self.soft_delete:
            object.__setattr__(self, "nullable", True)

    @property
    def spark_type(self) -> T.DataType:
        return self.type or TYPES[self.kind]

    @classmethod
    def tagged(cls, name: str, kind: str, tag: str = "", nullable: bool = False, type: T.DataType | None = None) -> Field | None:
        """A field from `[column][,option...]`; options pk, auto_random, computed, soft_delete, unique=<group>. `-` excludes it."""
        column, *options = [x.strip() for x in tag.split(",")]
        if column == "-":
            if options:
                raise ModelError(f"{name}: '-' can't be combined with options")
            return None
        known: dict = {"unique": ()}
        for option in options:
            if option.startswith("unique="):
                if not IDENTIFIER.match(group := option.removeprefix("unique=")):
                    raise ModelError(f"{name}: {option!r} names no group")
                if group in known["unique"]:
                    raise ModelError(f"{name}: option {option!r} is repeated")
                known["unique"] += (group,)
            elif option in ("pk", "auto_random", "computed", "soft_delete"):
                if option in known:
                    raise ModelError(f"{name}: option {option!r} is repeated")
                known[option] = True
            else:
                raise ModelError(f"{name}: unknown option {option!r}")
        return cls(name, column, kind, type, nullable, **known)


@dataclass(frozen=True)
class Junction:
    """A link table with the columns that hold the source's and the target's keys."""

    table: str
    source: tuple[str, ...]
    target: tuple[str, ...]


@dataclass(frozen=True)
class Relation:
    """`source` and `target` are field names of equal number. via: (collection of this model, to-one of its target)."""

    name: str
    kind: str
    of: Model | Callable[[], Model]
    source: tuple[str, ...] = ()
    target: tuple[str, ...] = ()
    junction: Junction | None = None
    via: tuple[str, str] | None = None

    @property
    def model(self) -> Model:
        return self.of if isinstance(self.of, Model) else self.of()

    @property
    def collection(self) -> bool:
        return self.kind in ("has_many", "many_to_many")


def belongs_to(name: str, of, source: tuple[str, ...] = (), target: tuple[str, ...] = ()) -> Relation:
    return Relation(name, "belongs_to", of, source, target)


def has_one(name: str, of, source: tuple[str, ...] = (), target: tuple[str, ...] = ()) -> Relation:
    return Relation(name, "has_one", of, source, target)


def has_many(name: str, of, source: tuple[str, ...] = (), target: tuple[str, ...] = ()) -> Relation:
    return Relation(name, "has_many", of, source, target)


def many_to_many(name: str, of, junction: Junction | None = None, via: str | None = None, source: tuple[str, ...] = (), target: tuple[str, ...] = ()) -> Relation:
    path = tuple(via.split(".")) if via else None
    if (junction is None) == (path is None) or path and len(path) != 2:
        raise ModelError(f"{name}: many_to_many needs a junction, or via 'Collection.ToOne'")
    return Relation(name, "many_to_many", of, source, target, junction, path)  # type: ignore[arg-type]


@dataclass(frozen=True)
class Keys:
    """A resolved relation: pairs of columns for each hop, and the edge's model for via."""

    target: Model
    direct: tuple[tuple[str, str], ...] = ()
    edge_table: str = ""
    edge: Model | None = None
    near: tuple[tuple[str, str], ...] = ()
    far: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True, eq=False)
class Model:
    name: str
    table: str
    fields: tuple[Field, ...]
    relations: tuple[Relation, ...] = field(default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        object.__setattr__(self, "relations", tuple(self.relations))
        names = [f.name for f in self.fields] + [r.name for r in self.relations]
        columns = [f.column.lower() for f in self.fields]
        if not self.fields:
            raise ModelError(f"{self.name} has no fields")
        if len(set(names)) < len(names) or len(set(columns)) < len(columns):
            raise ModelError(f"{self.name}: a field, relation or column is declared twice")
        if sum(f.soft_delete for f in self.fields) > 1:
            raise ModelError(f"{self.name}: more than one soft-delete field")

    @cached_property
    def by_name(self) -> dict[str, Field]:
        return {f.name: f for f in self.fields}

    @cached_property
    def pk(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.pk)

    @cached_property
    def soft_delete(self) -> Field | None:
        return next((f for f in self.fields if f.soft_delete), None)

    @cached_property
    def unique_keys(self) -> tuple[tuple[Field, ...], ...]:
        """The primary key, then each candidate key."""
        groups: dict[str, list[Field]] = {}
        for f in self.fields:
            for g in f.unique:
                groups.setdefault(g, []).append(f)
        return ((self.pk,) if self.pk else ()) + tuple(tuple(x) for x in groups.values())

    @cached_property
    def schema(self) -> T.StructType:
        """Column names and types; keys and flags are in the fields' metadata."""
        flags = ("pk", "auto_random", "computed", "soft_delete")
        return T.StructType([T.StructField(f.column, f.spark_type, f.nullable, {k: True for k in flags if getattr(f, k)} | ({"unique": list(f.unique)} if f.unique else {})) for f in self.fields])

    def field(self, name: str, stored: bool = True) -> Field:
        found = self.by_name.get(name)
        if found is None:
            raise ModelError(f"{self.name} has no field {name!r}")
        if stored and found.computed:
            raise ModelError(f"{self.name}.{name} is computed: only raw SQL fills it")
        return found

    def relation(self, name: str) -> Relation:
        for r in self.relations:
            if r.name == name:
                return r
        raise ModelError(f"{self.name} has no relation {name!r}")

    def is_unique(self, fields: set[str]) -> bool:
        """Whether some declared key is wholly among these field names, so that they identify one row at most."""
        return any({f.name for f in key} <= fields for key in self.unique_keys)

    def resolve(self, name: str) -> Keys:
        """The relation's column pairs: declared, or inferred by name for direct relations."""
        r = self.relation(name)
        target = r.model
        if r.via:
            edges, to = self.relation(r.via[0]), None
            edge = edges.model
            to = edge.relation(r.via[1])
            if edges.kind != "has_many" or to.kind != "belongs_to":
                raise ModelError(f"{self.name}.{name}: via needs a has_many followed by a belongs_to")
            if to.model is not target:
                raise ModelError(f"{self.name}.{name}: via leads to {to.model.name}")
            return Keys(target, edge_table=edge.table, edge=edge, near=self.resolve(edges.name).direct, far=edge.resolve(to.name).direct)
        if r.junction:
            own, other = self._key(r.source), target._key(r.target)
            j = r.junction
            if len(j.source) != len(own) or len(j.target) != len(other):
                raise ModelError(f"{self.name}.{name}: the junction's columns don't fit the keys")
            return Keys(target, edge_table=j.table, near=tuple(zip((f.column for f in own), j.source, strict=True)), far=tuple(zip(j.target, (f.column for f in other), strict=True)))
        source, to = r.source, r.target
        if r.kind == "belongs_to":
            to = to or tuple(f.name for f in target.pk)
            source = source or tuple(f"{r.name}{x}" for x in to)
        else:
            source = source or tuple(f.name for f in self.pk)
            to = to or tuple(f"{self.name}{x}" for x in source)
        if not source or len(source) != len(to):
            raise ModelError(f"{self.name}.{name}: source and target keys don't pair")
        return Keys(target, direct=tuple((self.field(a).column, target.field(b).column) for a, b in zip(source, to, strict=True)))

    def _key(self, names: tuple[str, ...]) -> tuple[Field, ...]:
        found = tuple(self.field(n) for n in names) if names else self.pk
        if not found:
            raise ModelError(f"{self.name} has no primary key to join by")
        return found
