"""Rules over models, catalogs and queries. Nothing here reads data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ..errors import SparkloomError
from ..operators.model import IDENTIFIER, MOST_DIMENSIONS, Model, Relation
from ..operators.mutation import DeleteWhere, UpdateMany, UpdateWhere
from ..operators.nearest import Nearest
from ..operators.predicate import Comparison, walk
from ..operators.select import Query
from ..plans.inspect import Diagnostic
from ..plans.rewrite import fixed_fields, top_n_reason
from ..plans.shape import ordered_access
from .ddl import CatalogIndex, CatalogTable

#: SQL type families that each kind of field accepts.
INTEGERS = {"TINYINT", "SMALLINT", "MEDIUMINT", "INT", "INTEGER", "BIGINT", "YEAR"}
DECIMALS = {"DECIMAL", "NUMERIC", "DEC", "FIXED"}
TEXTS = {"CHAR", "VARCHAR", "TINYTEXT", "TEXT", "MEDIUMTEXT", "LONGTEXT", "ENUM", "SET", "JSON"}
BINARIES = {"BINARY", "VARBINARY", "TINYBLOB", "BLOB", "MEDIUMBLOB", "LONGBLOB", "BIT"}
FAMILIES = {
    "bool": {"TINYINT", "BOOL", "BOOLEAN"},
    "int": INTEGERS,
    "uint": INTEGERS,
    "float": INTEGERS | DECIMALS | {"FLOAT", "DOUBLE", "REAL"},
    "string": TEXTS,
    "bytes": TEXTS | BINARIES,
    "time": {"DATE", "DATETIME", "TIMESTAMP"},
    "vector": {"VECTOR"},
}


def check_model(model: Model) -> list[Diagnostic]:
    """MOD001 invalid model (a name, a relation that can't be resolved or whose key types differ), MOD005 no primary key,
    and of our own MOD101 nullable field in a unique key."""
    found = []
    if not IDENTIFIER.match(model.table):
        found.append(Diagnostic("MOD001", f"{model.table!r} isn't an identifier", model.name, "error"))
    if not model.pk:
        found.append(Diagnostic("MOD005", "no primary key: keyset paging and key updates aren't possible", model.name))
    for key in model.unique_keys:
        for f in key:
            if f.nullable:
                found.append(Diagnostic("MOD101", f"{f.name} is nullable: rows with NULL aren't unique by it", model.name))
    for r in model.relations:
        try:
            keys = model.resolve(r.name)
        except SparkloomError as e:
            found.append(Diagnostic("MOD001", str(e), f"{model.name}.{r.name}", "error"))
            continue
        kinds = {f.column: f.spark_type for f in model.fields}, {f.column: f.spark_type for f in keys.target.fields}
        if any(kinds[0][a] != kinds[1][b] for a, b in keys.direct):
            found.append(Diagnostic("MOD001", "the key's types differ", f"{model.name}.{r.name}", "error"))
    return found


def _unique(table: CatalogTable, columns: list[str]) -> bool:
    """Whether some unique index has no other columns."""
    return any(i.unique and set(i.columns) <= set(columns) for i in table.indexes)


def check_schema(model: Model, catalog: dict[str, CatalogTable]) -> list[Diagnostic]:
    """CMP001 empty catalog, CMP002 table, CMP003 column, CMP004 type, CMP005 nullable column of a field that isn't, CMP006 the reverse,
    CMP007 primary key, CMP008 auto_random, CMP009 generated column that is written, CMP010 unmapped required column, CMP011 target of a
    relation not unique, CMP012 junction pair not unique, CMP013 required junction column, CMP014 relation without an index,
    CMP015 candidate key, and VEC001 vector dimensions."""
    found: list[Diagnostic] = []
    say = lambda code, text, subject=model.name, severity="error": found.append(Diagnostic(code, text, subject, severity))
    if not catalog or any(not t.columns for t in catalog.values()):
        say("CMP001", "the catalog has no tables, or one without columns")
        return found
    table = catalog.get(model.table)
    if table is None:
        say("CMP002", f"no table {model.table}")
        return found
    for f in model.fields:
        c, subject = table.columns.get(f.column), f"{model.name}.{f.name}"
        if c is None:
            if not f.computed:
                say("CMP003", f"no column {f.column}", subject)
            continue
        if f.kind in FAMILIES and c.type not in FAMILIES[f.kind]:
            say("CMP004", f"{c.type} doesn't fit kind {f.kind}", subject)
        elif f.kind in ("int", "uint") and c.unsigned != (f.kind == "uint"):
            say("CMP004", "signedness differs", subject, "warning")
        if c.nullable and not f.nullable and not f.computed:
            say("CMP005", "the column is nullable and the field isn't", subject)
        if f.nullable and not c.nullable and not f.computed:
            say("CMP006", "the field is nullable and the column isn't", subject, "warning")
        if c.generated and not f.computed:
            say("CMP009", "the column is generated: declare the field computed", subject)
        if c.auto_random != f.auto_random:
            say("CMP008", "auto_random differs", subject)
        if f.kind == "vector" and (not c.arguments or not 1 <= int(c.arguments[0]) <= MOST_DIMENSIONS):
            say("VEC001", "the vector column has no fixed number of dimensions", subject)
    if [f.column for f in model.pk] != list(table.primary.columns if table.primary else ()):
        say("CMP007", "the primary keys differ")
    unique = [set(i.columns) for i in table.indexes if i.unique]
    for key in model.unique_keys[bool(model.pk) :]:
        if {f.column for f in key} not in unique:
            say("CMP015", f"no unique index over {', '.join(f.column for f in key)}")
    mapped = {f.column for f in model.fields}
    for c in table.columns.values():
        if c.name not in mapped and not (c.nullable or c.has_default or c.generated or c.auto_random):
            say("CMP010", f"column {c.name} needs a value and isn't mapped", severity="warning")
    for r in model.relations:
        found += _check_relation(model, r, catalog)
    return found


def _check_relation(model: Model, r: Relation, catalog: dict[str, CatalogTable]) -> list[Diagnostic]:
    keys, subject, found = model.resolve(r.name), f"{model.name}.{r.name}", []
    say = lambda code, text, severity="error": found.append(Diagnostic(code, text, subject, severity))
    target = catalog.get(keys.target.table)
    if target is None:
        say("CMP002", f"no table {keys.target.table}")
        return found
    to = [b for _, b in (keys.direct or keys.far)]
    if (not r.collection or not keys.direct) and not _unique(target, to):
        say("CMP011", f"{keys.target.table} isn't unique by {', '.join(to)}")
    if keys.direct:
        where, columns = (model.table, [a for a, _ in keys.direct]) if r.kind == "belongs_to" else (keys.target.table, to)
    else:
        where, columns = keys.edge_table, [b for _, b in keys.near]
        edge = catalog.get(where)
        pair = [*columns, *[a for a, _ in keys.far]]
        if edge is None:
            say("CMP002", f"no table {where}")
            return found
        if missing := [c for c in pair if c not in edge.columns]:
            say("CMP003", f"{where} has no column {', '.join(missing)}")
            return found
        if keys.edge is None:
            if not _unique(edge, pair):
                say("CMP012", f"{where} isn't unique by {', '.join(pair)}")
            for c in edge.columns.values():
                if c.name not in pair and not (c.nullable or c.has_default or c.generated or c.auto_random):
                    say("CMP013", f"{where}.{c.name} needs a value that a pair doesn't have")
    if where in catalog and not any(set(i.columns[: len(columns)]) == set(columns) for i in catalog[where].indexes):
        say("CMP014", f"{where} has no index that starts with {', '.join(columns)}", "warning")
    return found


def check_types(model: Model, schema: T.StructType) -> list[Diagnostic]:
    """CMP003 and CMP004 against a DataFrame's schema."""
    kinds = {f.name: f.dataType for f in schema}
    found = []
    for f in model.fields:
        if f.column not in kinds:
            if not f.computed:
                found.append(Diagnostic("CMP003", f"no column {f.column}", f"{model.name}.{f.name}", "error"))
        elif f.kind != "custom" and kinds[f.column] != f.spark_type and not (f.kind == "vector" and isinstance(kinds[f.column], T.ArrayType)):
            found.append(Diagnostic("CMP004", f"{kinds[f.column].simpleString()} isn't {f.spark_type.simpleString()}", f"{model.name}.{f.name}", "error"))
    return found


def check_query(q: Query) -> list[Diagnostic]:
    """QRY002 positive Offset, QRY003 Limit without OrderBy, QRY004 leading wildcard, QRY005 relation top-N falls back."""
    found = []
    if q.skipped > 0:
        found.append(Diagnostic("QRY002", "Offset reads and drops rows: SeekAfter doesn't", q.model.name))
    if q.limited and not q.orders:
        found.append(Diagnostic("QRY003", "Limit without OrderBy takes any rows", q.model.name))
    for p in q.predicates:
        for x in walk(p):
            if isinstance(x, Comparison) and x.op in ("contains", "suffix"):
                found.append(Diagnostic("QRY004", f"{x.op} on {x.field} can't use an index or row-group statistics", q.model.name))
    if reason := top_n_reason(q):
        found.append(Diagnostic("QRY005", f"relation top-N isn't rewritten: {reason}", q.model.name))
    return found


def _columns(model: Model, names) -> list[str]:
    return [model.field(n).column for n in names]


def serves(index: CatalogIndex, equal: set[str], order: list[str]) -> bool:
    """Equality columns in any order, and then the ordering."""
    n, rest = len(equal), [c for c in order if c not in equal]
    return set(index.columns[:n]) == equal and list(index.columns[n : n + len(rest)]) == rest


def check_index(q: Query, catalog: dict[str, CatalogTable]) -> list[Diagnostic]:
    """QRY006 no index serves the equalities and order; QRY007 the table isn't in the catalog. Also reads as sort or bucket advice."""
    access = ordered_access(q)
    if access is None:
        return []
    table = catalog.get(access["table"])
    if table is None:
        return [Diagnostic("QRY007", f"{access['table']} isn't in the catalog", q.model.name)]
    equal, order = set(access["equal"]), access["order"]
    if any(i.unique and set(i.columns) <= equal for i in table.indexes) or any(serves(i, equal, order) for i in table.indexes):
        return []
    return [Diagnostic("QRY006", f"no index over ({', '.join([*sorted(equal), *[c for c in order if c not in equal]])})", q.model.name)]


def check_mutation(m: UpdateWhere | DeleteWhere | UpdateMany, catalog: dict[str, CatalogTable]) -> list[Diagnostic]:
    """QRY008 no index starts with a bounded column; QRY009 the table isn't in the catalog."""
    table = catalog.get(m.model.table)
    if table is None:
        return [Diagnostic("QRY009", f"{m.model.table} isn't in the catalog", m.model.name)]
    if isinstance(m, UpdateMany):  # rows are found by the primary key
        key = [f.column for f in m.model.pk]
        served = any(set(i.columns[: len(key)]) == set(key) for i in table.indexes)
        return [] if served else [Diagnostic("QRY008", "no index starts with the primary key", m.model.name)]
    bound = fixed_fields(m.predicates) | {p.field for p in m.predicates if isinstance(p, Comparison) and p.op in ("in", "<", "<=", ">", ">=", "between", "prefix")}
    if any(i.columns and i.columns[0] in _columns(m.model, bound) for i in table.indexes):
        return []
    return [Diagnostic("QRY008", "no index starts with a column the predicates bound", m.model.name)]


def check_vector(q: Nearest, catalog: dict[str, CatalogTable]) -> list[Diagnostic]:
    """VEC001 the column isn't a vector of the query's dimensions; VEC002 no vector index, or filters that come before it."""
    column = q.model.field(q.field).column
    table = catalog.get(q.model.table)
    found, c = [], table.columns.get(column) if table else None
    if c is None or c.type != "VECTOR" or c.arguments and int(c.arguments[0]) != len(q.vector):
        found.append(Diagnostic("VEC001", f"{column} isn't VECTOR({len(q.vector)})", q.model.name, "error"))
    if q.approximate_:
        if not table or not any(i.kind == "vector" and column in i.columns for i in table.indexes):
            found.append(Diagnostic("VEC002", f"{column} has no vector index", q.model.name))
        elif q.predicates or q.model.soft_delete and not q.deleted:
            found.append(Diagnostic("VEC002", "filters come before the search, so the index can't be used", q.model.name))
    return found


@dataclass(frozen=True)
class Suppression:
    code: str
    subject: str
    reason: str


def report(found: list[Diagnostic], suppressions: list[Suppression] = []) -> tuple[list[Diagnostic], bool]:  # noqa: B006
    """What is left after suppressions (each by exact code and subject, with a reason), and whether an error is among it."""
    for s in suppressions:
        if not s.reason.strip():
            raise SparkloomError(f"the suppression of {s.code} gives no reason")
    hidden = {(s.code, s.subject) for s in suppressions}
    left = [d for d in found if (d.code, d.subject) not in hidden]
    return left, any(d.severity == "error" for d in left)
