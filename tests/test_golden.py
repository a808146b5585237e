"""Contracts of relations, metrics, windows, calendars, vectors and paging on small tables, against DuckDB over the same rows."""

from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.aggregate import UNBOUNDED, Aggregate, Avg, CountAll, CountIf, Date, Field, Lag, Lead, Max, RowNumber, RowsBetween, Sum, SumIf, YearMonth, spec
from sparkloom.operators.model import Field as Column
from sparkloom.operators.model import Model, belongs_to, has_many, has_one, many_to_many
from sparkloom.operators.nearest import nearest
from sparkloom.operators.order import Asc, Desc
from sparkloom.operators.predicate import And, Contains, Equal, GreaterThan, Has, IsNull, Not, Or
from sparkloom.operators.select import Query
from sparkloom.sources.tables import TableSource

GONE = datetime(2022, 5, 5)
#: A library: branches below branches, books, loans of books, and which authors wrote which book.
BRANCHES = [(1, None, "north", 4, None), (2, 1, "harbour", 9, None), (3, 1, None, None, None), (4, 2, "mill", 2, GONE), (5, 77, "far", 7, None), (6, 6, "own", 1, None)]
BOOKS = [(i, 1 + i % 6, ["tale", "atlas", None, "50%_off"][i % 4], Decimal(i * i) / 4 if i % 5 else None, GONE if i % 7 == 0 else None) for i in range(1, 40)]
LOANS = [(i, 1 + (i * 7) % 45 if i % 11 else None, ["open", "late", "back"][i % 3], datetime(2021, 11, 1) + timedelta(days=9 * i, hours=i), GONE if i % 9 == 4 else None) for i in range(1, 120)]
AUTHORS = [(i, f"a{i % 3}", GONE if i == 4 else None) for i in range(1, 8)]
WROTE = [(i, 1 + i % 39, 1 + (i * 5) % 9 if i % 8 else None, i % 4, GONE if i % 10 == 3 else None) for i in range(1, 70)]
TABLES = {
    "branch": ("id long, parent_id long, name string, floors long, closed_at timestamp_ntz", BRANCHES),
    "book": ("id long, branch_id long, kind string, price decimal(20,2), gone_at timestamp_ntz", BOOKS),
    "loan": ("id long, book_id long, state string, lent_at timestamp_ntz, gone_at timestamp_ntz", LOANS),
    "author": ("id long, name string, gone_at timestamp_ntz", AUTHORS),
    "wrote": ("id long, book_id long, author_id long, place long, gone_at timestamp_ntz", WROTE),
}
soft = lambda column: Column("GoneAt", column, "time", soft_delete=True)
Branch = Model("Branch", "branch", [Column("ID", pk=True), Column("ParentID", nullable=True), Column("Name", kind="string", nullable=True), Column("Floors", nullable=True), soft("closed_at")], [belongs_to("Parent", lambda: Branch), has_many("Children", lambda: Branch, ("ID",), ("ParentID",)), has_many("Books", lambda: Book)])
Book = Model("Book", "book", [Column("ID", pk=True), Column("BranchID"), Column("Kind", kind="string", nullable=True), Column("Price", kind="custom", nullable=True), soft("gone_at")], [belongs_to("Branch", Branch), has_many("Loans", lambda: Loan), has_many("Wrote", lambda: Wrote), many_to_many("Authors", lambda: Author, via="Wrote.Author")])
Loan = Model("Loan", "loan", [Column("ID", pk=True), Column("BookID", nullable=True), Column("State", kind="string"), Column("LentAt", kind="time"), soft("gone_at")], [belongs_to("Book", Book)])
Author = Model("Author", "author", [Column("ID", pk=True), Column("Name", kind="string"), soft("gone_at")])
Wrote = Model("Wrote", "wrote", [Column("ID", pk=True), Column("BookID"), Column("AuthorID", nullable=True), Column("Place"), soft("gone_at")], [belongs_to("Author", Author)])
LIVE_LOAN = "EXISTS (SELECT 1 FROM loan l WHERE l.book_id = b.id AND l.gone_at IS NULL AND l.state = 'late')"
LIVE_AUTHOR = "EXISTS (SELECT 1 FROM wrote w JOIN author a ON a.id = w.author_id WHERE w.book_id = b.id AND w.gone_at IS NULL AND a.gone_at IS NULL AND a.name = 'a1')"
LATE, BY_A1 = Has("Loans", Equal("State", "late")), Has("Authors", Equal("Name", "a1"))


@pytest.fixture(scope="module")
def library(spark):
    return TableSource(spark, None, {n: spark.createDataFrame(rows, schema).cache() for n, (schema, rows) in TABLES.items()})


@pytest.fixture(scope="module")
def duck(library):
    c = duckdb.connect()
    for name in TABLES:
        c.register(name, library.table(name).toArrow())
    return c


def rows(found):
    return sorted((tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize(
    "p, sql, deleted",
    [
        (LATE, LIVE_LOAN, False),
        (LATE, LIVE_LOAN, True),
        (Not(LATE), f"NOT {LIVE_LOAN}", False),
        (BY_A1, LIVE_AUTHOR, False),
        (Or(LATE, Equal("Kind", "atlas")), f"{LIVE_LOAN} OR b.kind = 'atlas'", False),
        (And(BY_A1, Not(LATE)), f"{LIVE_AUTHOR} AND NOT {LIVE_LOAN}", True),
        (Has("Branch", Has("Parent", Equal("Name", "north"))), "EXISTS (SELECT 1 FROM branch x JOIN branch y ON y.id = x.parent_id WHERE x.id = b.branch_id AND x.closed_at IS NULL AND y.closed_at IS NULL AND y.name = 'north')", False),
        (Has("Loans", GreaterThan("ID", 10_000)), "FALSE", False),
    ],
)
def test_relations_never_multiply_rows(library, duck, p, sql, deleted):
    q = Aggregate(Book).select(CountAll().As("N"), Sum("Price").As("Total")).where(p)
    found = (q.with_deleted() if deleted else q).all(library)
    assert rows(found) == rows(duck.sql(f"SELECT count(*), sum(price) FROM book b WHERE ({sql}) {'' if deleted else 'AND gone_at IS NULL'}").fetchall())


def test_self_relations(library, duck):
    found = Query(Branch).select("ID").where(Has("Children", Not(IsNull("Name")))).all(library)
    assert rows(found) == rows(duck.sql("SELECT id FROM branch b WHERE closed_at IS NULL AND EXISTS (SELECT 1 FROM branch c WHERE c.parent_id = b.id AND c.closed_at IS NULL AND c.name IS NOT NULL)").fetchall())
    found = [(r.ID, r.Parent.Name if r.Parent else None, sorted(c.ID for c in r.Children)) for r in Query(Branch).select("ID").preload("Parent").preload("Children").all(library)]
    assert sorted(found) == [(1, None, [2, 3]), (2, "north", []), (3, "north", []), (5, None, []), (6, "own", [6])]


@pytest.mark.parametrize(
    "p, sql",
    [(Equal("Kind", "tale"), "kind = 'tale'"), (Not(Equal("Kind", "tale")), "kind <> 'tale'"), (IsNull("Kind"), "kind IS NULL"), (Contains("Kind", "%_"), "contains(kind, '%_')"), (Equal("Kind", "none"), "kind = 'none'"), (LATE, LIVE_LOAN)],
)
def test_conditional_metrics(library, duck, p, sql):
    q = Aggregate(Book).select(Field("BranchID"), CountIf(p).As("N"), SumIf("Price", p).As("Total")).group_by("BranchID")
    assert rows(q.all(library)) == rows(duck.sql(f"SELECT branch_id, count(CASE WHEN {sql} THEN 1 END), sum(CASE WHEN {sql} THEN price END) FROM book b WHERE gone_at IS NULL GROUP BY 1").fetchall())


def test_exact_decimals(spark):
    big = Decimal("123456789012345678.25")
    source = TableSource(spark, None, {"book": spark.createDataFrame([(1, 1, "x", big, None), (2, 1, "x", Decimal("0.50"), None)], TABLES["book"][0])})
    assert [r.Total for r in Aggregate(Book).select(Sum("Price").As("Total")).all(source)] == [big + Decimal("0.50")]


def test_output_that_differs_by_case_binds_to_the_output(library, duck):
    q = Aggregate(Book).select(Field("BranchID").As("Branch_id"), CountAll().As("Price")).group_by("Branch_id").having(GreaterThan("Price", 5)).order_by(Desc("Price"), Asc("Branch_id"))
    assert [tuple(r) for r in q.all(library)] == duck.sql("SELECT branch_id, count(*) n FROM book WHERE gone_at IS NULL GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, 1").fetchall()


@pytest.mark.parametrize("deleted", [False, True])
def test_via_preload_keeps_each_edge(library, duck, deleted):
    live = "" if deleted else "AND w.gone_at IS NULL AND a.gone_at IS NULL"
    loaded = Query(Book).with_deleted().select("ID").preload("Authors", order_by=(Desc("Edge.Place"), Asc("ID")), with_deleted=deleted).all(library)
    expected = {}
    for book, author in duck.sql(f"SELECT w.book_id, a.id FROM wrote w JOIN author a ON a.id = w.author_id WHERE TRUE {live} ORDER BY w.book_id, w.place DESC, a.id").fetchall():
        expected.setdefault(book, []).append(author)
    assert {r.ID: [a.ID for a in r.Authors] for r in loaded} == {b[0]: expected.get(b[0], []) for b in BOOKS}


@pytest.mark.parametrize("order", [(Asc("State"), Desc("ID")), (Desc("LentAt"),), (Desc("State"), Asc("LentAt")), (Desc("ID"),), (Desc("BookID"), Desc("ID"))])
def test_preload_orders(library, duck, order):
    loaded = Query(Book).with_deleted().select("ID").preload("Loans", fields=("ID",), order_by=order).all(library)
    by = ", ".join(f"{dict(State='state', ID='id', LentAt='lent_at', BookID='book_id')[o.name]} {'DESC NULLS LAST' if o.descending else 'NULLS FIRST'}" for o in order)
    expected = {}
    for book, loan in duck.sql(f"SELECT book_id, id FROM loan WHERE gone_at IS NULL ORDER BY book_id, {by}, id").fetchall():
        expected.setdefault(book, []).append(loan)
    assert {r.ID: [x.ID for x in r.Loans] for r in loaded} == {b[0]: expected.get(b[0], []) for b in BOOKS}


def test_windows_over_groups(library, duck):
    by = [Asc("Kind")]
    q = (
        Aggregate(Loan)
        .select(Field("Book.Kind").As("Kind"), CountAll().As("N"), CountIf(Has("Book", Has("Branch", GreaterThan("Floors", 3)))).As("High"), Max("ID").As("Last"))
        .group_by("Kind")
        .window(RowNumber().over(spec([], by)).As("Place"), Lag("N").over(spec([], by)).As("Before"), Lead("Last", 2).over(spec([], by)).As("After"), Sum("N").over(spec([], by, RowsBetween(UNBOUNDED, 0))).As("Running"), Avg("N").over(spec()).As("Mean"))
        .order_by(Asc("Kind"))
    )
    sql = """WITH g AS (SELECT b.kind, count(*) AS n, count(CASE WHEN EXISTS (SELECT 1 FROM book x JOIN branch y ON y.id = x.branch_id WHERE x.id = l.book_id AND x.gone_at IS NULL AND y.closed_at IS NULL AND y.floors > 3) THEN 1 END) AS high, max(l.id) AS last
      FROM loan l LEFT JOIN book b ON b.id = l.book_id AND b.gone_at IS NULL WHERE l.gone_at IS NULL GROUP BY 1)
    SELECT kind, n, high, last, row_number() OVER w, lag(n) OVER w, lead(last, 2) OVER w, CAST(sum(n) OVER (ORDER BY kind NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT), avg(n) OVER () FROM g WINDOW w AS (ORDER BY kind NULLS FIRST) ORDER BY kind NULLS FIRST"""
    assert [tuple(r) for r in q.all(library)] == duck.sql(sql).fetchall()


def test_vectors(spark):
    item = Model("Point", "point", [Column("ID", pk=True), Column("Group", "grp"), Column("Place", kind="vector", nullable=True)])
    source = TableSource(spark, None, {"point": spark.range(900).selectExpr("id", "id % 3 AS grp", "if(id = 5, null, if(id = 6, array(1f), array(cast(id * 7 % 31 AS float), cast(id * 5 % 23 AS float) - 11f))) AS place").cache()})
    points = [(r.id, r.grp, r.place) for r in source.table("point").collect()]
    far = lambda p: -1.0 if p is None or len(p) != 2 else ((p[0] - 4.0) ** 2 + (p[1] + 2.0) ** 2) ** 0.5
    best = sorted((far(p), i) for i, _, p in points)
    q = nearest(item, "Place", [4, -2], "l2", 12).select("ID").distance_as("Far")
    assert [(r.ID, r.Far) for r in q.all(source)] == [(i, None if d < 0 else pytest.approx(d)) for d, i in best[:12]]
    assert [r.ID for r in q.where(Equal("Group", 1)).all(source)] == [i for _, i in sorted((far(p), i) for i, g, p in points if g == 1)][:12]
    assert {round(r.Far, 9) for r in q.where(GreaterThan("ID", 6)).approximate().all(source)} == {round(d, 9) for d, _ in sorted((far(p), i) for i, _, p in points if i > 6)[:12]}


def test_relation_first_top_n(spark):
    seat = Model("Seat", "seat", [Column("HallID", unique=("pair",)), Column("GuestID", unique=("pair",))])
    hall = Model("Hall", "hall", [Column("ID", pk=True)], [has_many("Seats", seat)])
    taken = [(h, g) for h in range(60) for g in range(5) if (h * g + h) % 3 == 1]
    source = TableSource(spark, None, {"hall": spark.range(50), "seat": spark.createDataFrame(taken, "hall_id long, guest_id long")})
    q = Query(hall).where(Has("Seats", Equal("GuestID", 3)))
    halls = sorted({h for h, g in taken if g == 3 and h < 50}, reverse=True)
    for page in (q.order_by(Desc("ID")).limit(7), q.without_rewrites().order_by(Desc("ID")).limit(7)):
        top = [r.ID for r in page.all(source)]
        assert top == [h for h in sorted({h for h, g in taken if g == 3}, reverse=True)[:7] if h < 50] or top == halls[:7]
    assert q.without_rewrites().count(source) == len(halls)


@pytest.mark.parametrize("zone, hours", [("UTC", 0), ("Asia/Tokyo", 9)])
def test_calendar_follows_the_session_for_instants_only(spark, zone, hours):
    model = Model("At", "at", [Column("At", kind="time", nullable=True)])
    edges = [datetime(2020, 2, 29, 23, 59, 59, 999_999), datetime(2020, 3, 1), datetime(2020, 12, 31, 16, 30), datetime(2021, 1, 1), None]
    before = spark.conf.get("spark.sql.session.timeZone")
    local = spark.createDataFrame([(x,) for x in edges], "at timestamp_ntz").cache()
    instants = spark.createDataFrame([(None if x is None else int((x - datetime(1970, 1, 1)) / timedelta(microseconds=1)),) for x in edges], "us long").select(F.timestamp_micros("us").alias("at")).cache()
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        for df, shift in ((local, 0), (instants, hours)):
            days = [None if x is None else x + timedelta(hours=shift) for x in edges]
            q = Aggregate(model).select(YearMonth("At").As("Month"), CountAll().As("N")).group_by("Month")
            found = {r.Month: r.N for r in q.all(TableSource(spark, None, {"at": df}))}
            months = [None if x is None else x.year * 100 + x.month for x in days]
            assert found == {m: months.count(m) for m in months}
            q = Aggregate(model).select(Date("At").As("Day"), CountAll().As("N")).group_by("Day")
            dates = [None if x is None else x.date() for x in days]
            assert {r.Day: r.N for r in q.all(TableSource(spark, None, {"at": df}))} == {d: dates.count(d) for d in dates}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("order", [(Asc("Kind"), Asc("ID")), (Desc("Kind"), Asc("ID")), (Desc("Price"), Desc("ID")), (Asc("Price"), Desc("ID"))])
def test_keyset_pages_give_the_whole_table_once(library, order):
    q = Query(Book).with_deleted().order_by(*order)
    whole, pages, cursor = [r.ID for r in q.all(library)], [], None
    while True:
        page = (q.seek_after(*cursor) if cursor else q).limit(6).all(library)
        pages += [r.ID for r in page]
        if len(page) < 6:
            break
        cursor = tuple(page[-1][o.name] for o in order)
    assert pages == whole and sorted(whole) == [b[0] for b in BOOKS]


def test_has_one(library):
    first = Model("First", "book", Book.fields, [has_one("Loan", Model("Single", "loan", [Column("ID", pk=True), Column("BookID", "book_id", unique=("one",))]), ("ID",), ("BookID",))])
    single = {n: library.table(n) for n in TABLES} | {"loan": library.table("loan").where("book_id is not null").groupBy("book_id").agg(F.min("id").alias("id"))}
    loaded = Query(first).with_deleted().select("ID").preload("Loan").all(TableSource(library.spark, None, single))
    assert {r.ID: r.Loan.ID if r.Loan else None for r in loaded} == {b[0]: min((x[0] for x in LOANS if x[1] == b[0]), default=None) for b in BOOKS}
