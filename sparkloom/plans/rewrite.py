"""Rewrites that need declared keys, which Catalyst doesn't have.

Relation-first top-N: of a root with one collection predicate, ordered by its key and limited, the association's keys
are ordered and limited first and only those join the root. Relation-only count: the association is
counted and the root left out. Both are legal only if metadata proves at most one match for each root.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.model import Keys, Model, Relation
from ..operators.order import page
from ..operators.predicate import Comparison, Existence, Logical, Predicate, Scope, compile_predicate, conjunction, has_relation, walk
from ..sources.tables import TableSource

if TYPE_CHECKING:
    from ..operators.select import Query


def fixed_fields(parts: tuple[Predicate, ...]) -> set[str]:
    """Fields that conjunctive Equal predicates fix."""
    out: set[str] = set()
    for p in parts:
        if isinstance(p, Comparison) and p.op == "=":
            out.add(p.field)
        elif isinstance(p, Logical) and p.op == "and":
            out |= fixed_fields(p.parts)
    return out


def _names(model: Model, columns: list[str]) -> set[str]:
    return {f.name for f in model.fields if f.column in columns}


def junction_only(keys: Keys, relation: Relation, parts: tuple[Predicate, ...]) -> list[tuple[str, object]] | None:
    """(edge column, value) pairs if the parts only fix the target's whole key, so that the edge alone decides."""
    if keys.target.soft_delete or not all(isinstance(p, Comparison) and p.op == "=" for p in parts):
        return None
    values = {keys.target.field(p.field).column: p.values[0] for p in parts if isinstance(p, Comparison)}
    if set(values) != {b for _, b in keys.far} or len(values) != len(parts):
        return None
    return [(a, values[b]) for a, b in keys.far]


def unproven(keys: Keys, relation: Relation, parts: tuple[Predicate, ...]) -> str:
    """Why more than one match for each root is possible; empty if it isn't."""
    if relation.kind == "many_to_many":
        if keys.edge is None:
            # a pure junction is a set of pairs: fixing the target's whole key leaves one
            return "" if junction_only(keys, relation, parts) is not None else "uniqueness_unproven"
        edge_keys = _names(keys.edge, [b for _, b in keys.near]) | _names(keys.edge, [a for a, _ in keys.far])
        if not keys.edge.is_unique(edge_keys):
            return "edge_pair_not_unique"
        fixed = _names(keys.target, [b for _, b in keys.far])
        return "" if fixed <= fixed_fields(parts) or keys.target.is_unique(fixed_fields(parts)) else "uniqueness_unproven"
    to = _names(keys.target, [b for _, b in keys.direct])
    return "" if keys.target.is_unique(to | fixed_fields(parts)) else "uniqueness_unproven"


def top_n_reason(query: Query) -> str | None:
    """None: not a candidate. Empty: the rewrite is legal. Otherwise the first reason against it."""
    if not query.limited or not query.orders or query.policy.index:
        return None
    m = query.model
    collections = [p for q in query.predicates for p in walk(q) if isinstance(p, Existence)]
    tops = [p for p in query.predicates if isinstance(p, Existence) and m.relation(p.relation).collection]
    if not collections or not any(m_ for m_ in tops) and not any(isinstance(p, Logical) and has_relation(p) for p in query.predicates):
        return None
    if len(tops) > 1:
        return "multiple_collections"
    if not tops:
        return "nested_in_logical_group"
    if query.cursor is not None:
        return "seek_after"
    if len(query.predicates) > 1:
        return "another_root_predicate"
    if m.soft_delete and not query.deleted:
        return "active_root_soft_delete"
    relation, keys = m.relation(tops[0].relation), m.resolve(tops[0].relation)
    why = unproven(keys, relation, tops[0].parts)
    if why == "edge_pair_not_unique":
        return why
    near = [a for a, _ in (keys.direct or keys.near)]
    if not m.pk or near != [f.column for f in m.pk]:
        return "source_key_not_primary_key"
    if [m.field(o.name).column for o in query.orders] != near:
        return "order_not_source_key"
    return why


def association(p: Existence, model: Model, source: TableSource) -> tuple[DataFrame, list]:
    """The association's rows that satisfy p, and its columns that hold the root's key; NULL keys are left out."""
    keys, relation = model.resolve(p.relation), model.relation(p.relation)
    to = Scope(keys.target, source)
    if keys.direct:
        df, columns = to.rows(), [to.column(b) for _, b in keys.direct]
        conditions = [*to.active(), *[compile_predicate(x, to) for x in p.parts]]
    else:
        edge = f"{to.alias}_edge"
        df = source.table(keys.edge_table).alias(edge)
        columns = [F.col(f"{edge}.{b}") for _, b in keys.near]
        conditions = [F.col(f"{edge}.{keys.edge.soft_delete.column}").isNull()] if keys.edge and keys.edge.soft_delete else []
        fixed = junction_only(keys, relation, p.parts)
        if fixed is not None:
            conditions += [F.col(f"{edge}.{a}") == v for a, v in fixed]
        else:
            own = [*to.active(), *[compile_predicate(x, to) for x in p.parts]]
            rows = to.rows().where(conjunction(own)) if own else to.rows()
            df = df.join(rows, conjunction([F.col(f"{edge}.{a}") == to.column(b) for a, b in keys.far]))
    return df.where(conjunction([*conditions, *[c.isNotNull() for c in columns]])), columns


def association_access(query: Query) -> dict | None:
    """Table, equality columns and root-key columns that a rewritten top-N reads; None if its parts aren't all equalities."""
    from .shape import _equalities

    p = query.predicates[0]
    assert isinstance(p, Existence)
    keys = query.model.resolve(p.relation)
    equal = _equalities(keys.target, p.parts)
    if equal is None:
        return None
    if keys.direct:
        gone = keys.target.soft_delete
        found = {"table": keys.target.table, "equal": equal, "order": [b for _, b in keys.direct]}
    else:
        gone = keys.edge.soft_delete if keys.edge else None
        found = {"table": keys.edge_table, "equal": [a for a, _ in keys.far], "order": [b for _, b in keys.near]}
    return found | {"equal": [*found["equal"], *([gone.column] if gone and gone.column not in found["equal"] else [])]}


def relation_top_n(query: Query, source: TableSource, scope: Scope) -> DataFrame | None:
    if top_n_reason(query) != "":
        return None
    df, columns = association(query.predicates[0], query.model, source)  # type: ignore[arg-type]
    names = [f"key_{i}" for i in range(len(columns))]
    keyed = df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)])
    orders = [o.over(F.col(n)) for o, n in zip(query.orders, names, strict=True)]
    # at most Limit keys, so the caller's limit bounds what is broadcast
    keyed = page(keyed.orderBy(*orders), query.limited, query.skipped).alias("limited")
    keyed = F.broadcast(keyed) if query.limited <= 100_000 else keyed
    on = conjunction([scope.column(f.column) == F.col(f"limited.{n}") for f, n in zip(query.model.pk, names, strict=True)])
    rows = scope.rows().join(keyed, on)
    return rows.orderBy(*[o.over(scope.of(o.name)) for o in query.orders])


def count_reason(query: Query) -> str | None:
    """As top_n_reason, for Count."""
    if query.limited is not None or query.skipped or query.cursor is not None or query.policy.index or len(query.predicates) != 1:
        return None
    p, m = query.predicates[0], query.model
    if not isinstance(p, Existence) or not m.relation(p.relation).collection:
        return None
    if m.soft_delete and not query.deleted:
        return "active_root_soft_delete"
    relation, keys = m.relation(p.relation), m.resolve(p.relation)
    if [a for a, _ in (keys.direct or keys.near)] != [f.column for f in m.pk]:
        return "source_key_not_primary_key"
    if relation.kind == "many_to_many" and junction_only(keys, relation, p.parts) is None:
        return "target_needed"
    return unproven(keys, relation, p.parts)


def relation_count(query: Query, source: TableSource) -> DataFrame | None:
    if count_reason(query) != "":
        return None
    df, _ = association(query.predicates[0], query.model, source)  # type: ignore[arg-type]
    return df.agg(F.count(F.lit(1)).alias("Count"))
