"""Relation loading: every root row stays one row, with a struct for each to-one and an array for each collection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BuildError
from ..sources.tables import TableSource
from .model import Model
from .order import Order, check_orders
from .predicate import Scope, conjunction


@dataclass(frozen=True)
class Preload:
    """`order_by` may name `Edge.Field` for via relations."""

    path: str
    fields: tuple[str, ...] = ()
    order_by: tuple[Order, ...] = ()
    with_deleted: bool = False


@dataclass
class Node:
    name: str
    options: Preload
    children: dict[str, Node] = field(default_factory=dict)


def check_preload(model: Model, p: Preload) -> None:
    for part in p.path.split("."):
        relation, keys, owner = model.relation(part), model.resolve(part), model
        model = keys.target
        if not relation.collection and not model.is_unique({f.name for f in model.fields if f.column in [b for _, b in keys.direct]}):
            raise BuildError(f"{p.path}: {model.name}'s key for {part} isn't declared unique, so it could multiply rows")
    if len(set(p.fields)) < len(p.fields):
        raise BuildError(f"{p.path}: a field is selected twice")
    for f in p.fields:
        model.field(f)
    check_orders(p.order_by)
    if p.order_by and not relation.collection:
        raise BuildError(f"{p.path} isn't a collection: it has no order")
    for o in p.order_by:
        if o.name.startswith("Edge."):
            if not keys.edge:
                raise BuildError(f"{p.path} has no edge model")
            keys.edge.field(o.name.removeprefix("Edge."))
        else:
            model.field(o.name)
    if p.with_deleted and not model.soft_delete and not (keys.edge and keys.edge.soft_delete):
        raise BuildError(f"{owner.name}.{part} has no soft-delete field")


def tree(preloads: tuple[Preload, ...]) -> dict[str, Node]:
    """Paths merged, in the order they were asked for."""
    roots: dict[str, Node] = {}
    for p in preloads:
        level = roots
        parts = p.path.split(".")
        for i, part in enumerate(parts):
            node = level.setdefault(part, Node(part, Preload(".".join(parts[: i + 1]))))
            if i == len(parts) - 1:
                if node.options != Preload(p.path) and node.options != p:
                    raise BuildError(f"{p.path} is loaded twice with other options")
                node.options = p
            level = node.children
    return roots


def attach(df: DataFrame, scope: Scope, columns: list[Column], preloads: tuple[Preload, ...], source: TableSource) -> DataFrame:
    """The selected columns and a column for each relation."""
    roots = tree(preloads)
    # scope's alias survives joins, so columns of the root stay addressable
    names = []
    for node in roots.values():
        df, column = _join(df, scope, node, source)
        names.append(column.alias(node.name))
    return df.select(*columns, *names)


def _payload(df: DataFrame, scope: Scope, node: Node, source: TableSource) -> tuple[DataFrame, Column]:
    """The target's rows with their children loaded, and the struct that represents one."""
    model = scope.model
    fields = [model.field(f) for f in node.options.fields] or [f for f in model.fields if not f.computed]
    parts = [scope.column(f.column).alias(f.name) for f in fields]
    for child in node.children.values():
        df, column = _join(df, scope, child, source)
        parts.append(column.alias(child.name))
    return df, F.struct(*parts)


def _join(df: DataFrame, scope: Scope, node: Node, source: TableSource) -> tuple[DataFrame, Column]:
    keys, relation = scope.model.resolve(node.name), scope.model.relation(node.name)
    to = Scope(keys.target, source)
    rows = to.rows()
    for c in [] if node.options.with_deleted else to.active():
        rows = rows.where(c)
    rows, payload = _payload(rows, to, node, source)
    label = f"{to.alias}_loaded"
    if not relation.collection:
        loaded = rows.select(*[to.column(b).alias(f"k{i}") for i, (_, b) in enumerate(keys.direct)], payload.alias("one")).alias(label)
        on = conjunction([scope.column(a) == F.col(f"{label}.k{i}") for i, (a, _) in enumerate(keys.direct)])
        return df.join(loaded, on, "left"), F.when(F.col(f"{label}.k0").isNotNull(), F.col(f"{label}.one"))
    edge = f"{to.alias}_edge"
    if keys.direct:
        owner, pairs = [to.column(b) for _, b in keys.direct], keys.direct
    else:
        edges = source.table(keys.edge_table).alias(edge)
        if keys.edge and keys.edge.soft_delete and not node.options.with_deleted:
            edges = edges.where(F.col(f"{edge}.{keys.edge.soft_delete.column}").isNull())
        rows = edges.join(rows, conjunction([F.col(f"{edge}.{a}") == to.column(b) for a, b in keys.far]))
        owner, pairs = [F.col(f"{edge}.{b}") for _, b in keys.near], keys.near
    sorts = []
    for o in node.options.order_by:
        c = F.col(f"{edge}.{keys.edge.field(o.name.removeprefix('Edge.')).column}") if o.name.startswith("Edge.") and keys.edge else to.of(o.name)
        sorts.append((c, o.descending))
    # without a wish the target's key gives a stable order
    sorts += [(to.column(f.column), False) for f in keys.target.pk] if not any(not o.name.startswith("Edge.") and o.name in {f.name for f in keys.target.pk} for o in node.options.order_by) else []
    kinds = [f.dataType for f in rows.select(*[c for c, _ in sorts]).schema] if sorts else []
    encoded = [_ascending(c, down, kind) for (c, down), kind in zip(sorts, kinds, strict=True)]
    # a struct sorts by its fields in turn, without an interpreted comparison, if all of them can be made to ascend
    native = all(e is not None for e in encoded)
    item = F.struct(*[(e if native else c).alias(f"s{i}") for i, ((c, _), e) in enumerate(zip(sorts, encoded, strict=True))], payload.alias("one"))
    keyed = rows.select(*[c.alias(f"k{i}") for i, c in enumerate(owner)], item.alias("item")).where(conjunction([F.col(f"k{i}").isNotNull() for i in range(len(owner))]))
    gathered = keyed.groupBy(*[f"k{i}" for i in range(len(owner))]).agg(F.collect_list("item").alias("items"))
    ordered = F.col("items")
    if sorts:
        ordered = F.sort_array("items") if native else _sorted(F.col("items"), [d for _, d in sorts])
    loaded = gathered.select(*[f"k{i}" for i in range(len(owner))], F.transform(ordered, lambda x: x["one"]).alias("many")).alias(label)
    on = conjunction([scope.column(a) == F.col(f"{label}.k{i}") for i, (a, _) in enumerate(pairs)])
    return df.join(loaded, on, "left"), F.coalesce(F.col(f"{label}.many"), F.array().cast(loaded.schema["many"].dataType))


def _ascending(c: Column, descending: bool, kind: T.DataType) -> Column | None:
    """A value whose ascending order, NULL first, is the wished order; None if there is none for the type."""
    if not descending:
        return c
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        turned = F.bitwise_not(c)
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        turned = -c
    else:
        return None
    return F.struct(c.isNull().alias("last"), turned.alias("turned"))


def _sorted(items: Column, descending: list[bool]) -> Column:
    def order(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in range(len(descending) - 1, -1, -1):
            x, y = a[f"s{i}"], b[f"s{i}"]
            first = -1 if not descending[i] else 1  # NULL is the smallest value
            out = (
                F.when(x.isNull() & y.isNull(), out)
                .when(x.isNull(), F.lit(first))
                .when(y.isNull(), F.lit(-first))
                .when(x < y, F.lit(first))
                .when(x > y, F.lit(-first))
                .otherwise(out)
            )
        return out

    return F.array_sort(items, order)
