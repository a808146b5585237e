"""Which model and relation of a query a plan's scan reads."""

from __future__ import annotations

from collections.abc import Iterator

from ..operators.model import Model
from .inspect import PlanNode

Place = tuple[str, str, str]


def places(query) -> set[Place]:
    """(table, model, relation path) of everything the query reads. The root's path is empty; an edge table without a model has none."""
    model = query.model
    out = {(model.table, model.name, "")}
    expressions = getattr(query, "outputs", ())
    for p in (*getattr(query, "predicates", ()), *(e.predicate for e in expressions if e.predicate)):
        out |= set(_existence(p, model, ""))
    for path in (*(p.path for p in getattr(query, "preloads", ())), *(e.path.rpartition(".")[0] for e in expressions)):
        out |= set(_path(path, model, ""))
    return out


def _path(path: str, model: Model, prefix: str) -> Iterator[Place]:
    for name in filter(None, path.split(".")):
        keys, prefix = model.resolve(name), f"{prefix}.{name}".lstrip(".")
        if keys.edge_table:
            yield keys.edge_table, keys.edge.name if keys.edge else "", prefix
        model = keys.target
        yield model.table, model.name, prefix


def _existence(p, model: Model, prefix: str) -> Iterator[Place]:
    if relation := getattr(p, "relation", ""):
        yield from _path(relation, model, prefix)
        model, prefix = model.resolve(relation).target, f"{prefix}.{relation}".lstrip(".")
    for part in getattr(p, "parts", ()):
        yield from _existence(part, model, prefix)


def tag(root: PlanNode, query) -> PlanNode:
    """Names table, model and relation of each scan, as far as the table alone tells them apart."""
    known: dict[str, set[Place]] = {}
    for place in places(query):
        known.setdefault(place[0], set()).add(place)
    for node in root.walk():
        # a table's folder or file, or a folder above a version of it
        table = next((t for x in reversed(node.read.split("/")) if (t := x.removesuffix(".parquet")) in known), "")
        if not table:
            continue
        models, relations = ({p[i] for p in known[table]} for i in (1, 2))
        node.table = table
        node.model = models.pop() if len(models) == 1 else ""
        node.relation = relations.pop() if len(relations) == 1 else None
    return root
