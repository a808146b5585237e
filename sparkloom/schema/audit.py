"""Reference audits: structure checks of a relation, then a search for orphans in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError
from ..operators.model import Model
from ..operators.predicate import conjunction
from ..plans.inspect import Diagnostic
from ..sources.tables import TableSource


def _sides(model: Model, relation: str) -> list[tuple[str, list[str], str, list[str]]]:
    """(child table, its columns, parent table, its columns) of each reference a relation stands for."""
    keys, kind = model.resolve(relation), model.relation(relation).kind
    if keys.direct:
        own, other = [a for a, _ in keys.direct], [b for _, b in keys.direct]
        return [(model.table, own, keys.target.table, other)] if kind == "belongs_to" else [(keys.target.table, other, model.table, own)]
    return [(keys.edge_table, [b for _, b in keys.near], model.table, [a for a, _ in keys.near]), (keys.edge_table, [a for a, _ in keys.far], keys.target.table, [b for _, b in keys.far])]


def orphans(model: Model, relation: str, source: TableSource, side: int = 0) -> DataFrame:
    """Child rows whose reference is complete and has no parent; soft deletion doesn't count."""
    child, own, parent, other = _sides(model, relation)[side]
    a, b = source.table(child).alias("child"), source.table(parent).select(*other).alias("parent")
    complete = a.where(conjunction([F.col(f"child.{c}").isNotNull() for c in own]))
    return complete.join(b, conjunction([F.col(f"child.{x}") == F.col(f"parent.{y}") for x, y in zip(own, other, strict=True)]), "left_anti")


def duplicates(table: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that more than one row has; NULLs aren't compared."""
    return table.where(conjunction([F.col(c).isNotNull() for c in columns])).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def audit(models: list[Model], source: TableSource) -> list[Diagnostic]:
    """REF001 unresolvable relation, REF002 missing column, REF003 types differ, REF004 parent key not unique, REF005 orphans. One probe at a time."""
    found, seen = [], set()
    for m in models:
        for r in m.relations:
            subject = f"{m.name}.{r.name}"
            try:
                sides = _sides(m, r.name)
            except ModelError as e:
                found.append(Diagnostic("REF001", str(e), subject, "error"))
                continue
            for i, (child, own, parent, other) in enumerate(sides):
                if (child, tuple(own), parent, tuple(other)) in seen:
                    continue
                seen.add((child, tuple(own), parent, tuple(other)))
                kinds = [{f.name: f.dataType for f in source.table(t).schema} for t in (child, parent)]
                missing = [f"{t}.{c}" for t, cs, k in ((child, own, kinds[0]), (parent, other, kinds[1])) for c in cs if c not in k]
                if missing:
                    found.append(Diagnostic("REF002", f"no column {', '.join(missing)}", subject, "error"))
                    continue
                if any(kinds[0][a] != kinds[1][b] for a, b in zip(own, other, strict=True)):
                    found.append(Diagnostic("REF003", "the key's types differ", subject))
                if duplicates(source.table(parent), other).limit(1).count():
                    found.append(Diagnostic("REF004", f"{parent}'s key isn't unique", subject, "error"))
                if orphans(m, r.name, source, i).limit(1).count():
                    found.append(Diagnostic("REF005", f"{child} has rows without a {parent}", subject, "error"))
    return found
