"""Value-free shapes of queries and their fingerprints."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from ..operators.predicate import Comparison, Existence, Logical, Predicate, walk


def predicate_shape(p: Predicate) -> Any:
    if isinstance(p, Comparison):
        return [p.op, p.field] if p.op not in ("in", "not in") else [p.op, p.field, "empty" if not p.values else "some"]
    if isinstance(p, Existence):
        return ["has", p.relation, *map(predicate_shape, p.parts)]
    assert isinstance(p, Logical)
    return [p.op, *map(predicate_shape, p.parts)]


def _orders(orders) -> list:
    return [[o.name, "desc" if o.descending else "asc"] for o in orders]


def query_shape(q) -> dict:
    """A canonical description without values; limits and offsets are only present or absent."""
    kind = type(q).__name__
    shape: dict[str, Any] = {"operation": kind, "model": q.model.name, "table": q.model.table}
    for name in ("fields", "grouped", "assigned", "added", "field", "metric", "distance_name", "relation"):
        if getattr(q, name, ()):
            shape[name] = x if isinstance(x := getattr(q, name), str) else list(x)
    if getattr(q, "predicates", ()):
        shape["where"] = [predicate_shape(p) for p in q.predicates]
    if getattr(q, "having_", ()):
        shape["having"] = [predicate_shape(p) for p in q.having_]
    if getattr(q, "outputs", ()):
        shape["outputs"] = [o.shape() for o in q.outputs]
    if getattr(q, "windows", ()):
        shape["windows"] = [w.shape() for w in q.windows]
    if getattr(q, "orders", ()):
        shape["order"] = _orders(q.orders)
    if getattr(q, "preloads", ()):
        shape["preload"] = [[p.path, list(p.fields), _orders(p.order_by), p.with_deleted] for p in q.preloads]
    flags = [n for n, on in (("limit", getattr(q, "limited", None) is not None), ("offset", bool(getattr(q, "skipped", 0))), ("seek", getattr(q, "cursor", None) is not None), ("deleted", getattr(q, "deleted", False)), ("approximate", getattr(q, "approximate_", False))) if on]
    if flags:
        shape["flags"] = flags
    policy = getattr(q, "policy", None)
    if policy and (policy.engine or policy.parallel or policy.index):
        shape["policy"] = [policy.engine, policy.parallel, policy.index]
    return shape


def fingerprint(shape: dict) -> str:
    return "q1:" + hashlib.sha256(json.dumps(shape, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def arguments(q) -> tuple:
    return tuple(v for p in getattr(q, "predicates", ()) for x in walk(p) if isinstance(x, Comparison) for v in x.values)


def _equalities(model, parts) -> list[str] | None:
    """Columns that conjunctive Equal predicates fix; None if there is any other predicate."""
    out: list[str] = []
    for p in parts:
        if isinstance(p, Logical) and p.op == "and":
            found = _equalities(model, p.parts)
        elif isinstance(p, Comparison) and p.op == "=":
            found = [model.field(p.field).column]
        else:
            found = None
        if found is None:
            return None
        out += [c for c in found if c not in out]
    return out


def ordered_access(q) -> dict | None:
    """The table, equality columns and ordered columns that a limited query reads in one direction; decides index advice.

    None where an index can't give just those rows: another order, other predicates, or a columnar read. A relation top-N that is
    rewritten reads the association instead of the root.
    """
    from .rewrite import association_access, top_n_reason

    orders = getattr(q, "orders", ())
    if not orders or len({o.descending for o in orders}) > 1 or not q.limited or q.policy.engine == "columnar":
        return None
    if top_n_reason(q) == "" and q.rewrites:
        found = association_access(q)
    elif any(isinstance(x, Existence) for p in q.predicates for x in walk(p)):
        return None
    else:
        equal = _equalities(q.model, q.predicates)
        if equal is not None and q.model.soft_delete and not q.deleted:
            equal = [*equal, *[c for c in [q.model.soft_delete.column] if c not in equal]]
        found = None if equal is None else {"table": q.model.table, "equal": equal, "order": [q.model.field(o.name).column for o in orders]}
    return None if found is None else found | {"descending": orders[0].descending}
