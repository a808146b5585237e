"""Named queries over the driver's tables, each with DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import UNBOUNDED, Aggregate, Avg, Count, CountAll, CountDistinct, CountIf, Date, DenseRank, Field, FirstValue, Lag, LastValue, Lead, Max, Min, Rank, RowNumber, RowsBetween, Sum, SumIf, YearMonth, spec
from ..operators.demo import Customer, Document, Embedding, Event, Nation, Order, Part, SoftCustomer, SoftOrder, Supplier
from ..operators.model import Field as Column
from ..operators.model import Junction, Model, belongs_to, many_to_many
from ..operators.mutation import CompositeKey, Delete, DeleteWhere, Increment, Insert, Links, Set, Update, UpdateMany, UpdateWhere, Upsert
from ..operators.nearest import build_vector_index, nearest
from ..operators.order import Asc, Desc
from ..operators.predicate import And, Between, Contains, Equal, GreaterThan, GreaterThanOrEqual, Has, HasPrefix, HasSuffix, In, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, NotEqual, NotIn, Or
from ..operators.raw import Raw
from ..operators.select import Query
from ..sources.store import new_folder
from ..sources.tables import TableSource, dealt, shares

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

# Tables derived alike on both sides: the driver's have no NULLs, soft deletion, orphans or unique edges.
EDGE = "order_supplier AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"
SOFT = "soft_orders AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at FROM orders)"
NULLED = "nulled AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)"
SIGNED = "signed AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '50%_!' || c_name ELSE c_name END AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"
PART_ORDERS = "few_customers AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0)"


def source(spark: SparkSession, sf_dir: str) -> TableSource:
    return TableSource(
        spark,
        sf_dir,
        {
            "order_supplier": lambda s: dealt(line := s.table("lineitem"), shares(line), "l_orderkey", "l_suppkey").select("l_orderkey", "l_suppkey").distinct(),
            "soft_orders": lambda s: s.table("orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))),
            "nulled": lambda s: s.table("orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))),
            "signed": lambda s: s.table("customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("50%_!"), "c_name")).otherwise(F.col("c_name"))),
            "few_customers": lambda s: s.table("customer").where("c_custkey % 10 <> 0"),
        },
    )


Nulled = Model("Nulled", "nulled", Order.fields)
Signed = Model("Signed", "signed", Customer.fields)
O, C = Query(Order), Query(Customer)
OK = ("OrderKey", "CustKey", "TotalPrice")
OKS = 'o_orderkey AS "OrderKey", o_custkey AS "CustKey", o_totalprice AS "TotalPrice"'


def add(name: str, run: Callable[[TableSource], DataFrame], sql: str | None, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(source(spark, sf_dir))
    if sql:
        ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql


def orders(name: str, query: Query, rest: str, *ctes: str, table: str = "orders o") -> None:
    """A query over orders that returns OK; rest follows FROM."""
    add(name, query.select(*OK).df, f"SELECT {OKS} FROM {table} {rest}", *ctes)


add("scan_project", Query(Nation).select("NationKey", "Name").df, 'SELECT n_nationkey AS "NationKey", n_name AS "Name" FROM nation')
add("scan_default", Query(Nation).df, 'SELECT n_nationkey AS "NationKey", n_name AS "Name", n_regionkey AS "RegionKey" FROM nation')
orders("equal", O.where(Equal("Status", "F")), "WHERE o_orderstatus = 'F'")
orders("not_equal", O.where(NotEqual("Status", "F")), "WHERE o_orderstatus <> 'F'")
orders("greater", O.where(GreaterThan("TotalPrice", 150000.0)), "WHERE o_totalprice > 150000")
orders("greater_equal", O.where(GreaterThanOrEqual("OrderKey", 500)), "WHERE o_orderkey >= 500")
orders("less", O.where(LessThan("OrderDate", datetime(1996, 1, 1))), "WHERE o_orderdate < TIMESTAMP '1996-01-01'")
orders("less_equal", O.where(LessThanOrEqual("OrderKey", 500)), "WHERE o_orderkey <= 500")
orders("in", O.where(In("Priority", ["1-URGENT", "2-HIGH"])), "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
orders("in_empty", O.where(In("Priority", [])), "WHERE FALSE")
orders("not_in", Query(Nulled).where(NotIn("Priority", ["1-URGENT"])), "WHERE o_orderpriority NOT IN ('1-URGENT')", NULLED, table="nulled")
orders("not_in_empty_null", Query(Nulled).where(NotIn("Priority", [])), "", NULLED, table="nulled")
orders("between", O.where(Between("OrderKey", 100, 300)), "WHERE o_orderkey BETWEEN 100 AND 300")
orders("is_null", Query(Nulled).where(IsNull("Priority")), "WHERE o_orderpriority IS NULL", NULLED, table="nulled")
orders("is_not_null", Query(Nulled).where(IsNotNull("Priority")), "WHERE o_orderpriority IS NOT NULL", NULLED, table="nulled")
add("contains_literal", Query(Signed).where(Contains("Name", "%_!")).select("CustKey", "Name").df, "SELECT c_custkey AS \"CustKey\", c_name AS \"Name\" FROM signed WHERE contains(c_name, '%_!')", SIGNED)
add("prefix", Query(Signed).where(HasPrefix("Name", "50%")).select("CustKey").df, "SELECT c_custkey AS \"CustKey\" FROM signed WHERE starts_with(c_name, '50%')", SIGNED)
add("suffix", Query(Signed).where(HasSuffix("Name", "7")).select("CustKey").df, "SELECT c_custkey AS \"CustKey\" FROM signed WHERE ends_with(c_name, '7')", SIGNED)
orders("and_or_not", O.where(Or(And(Equal("Status", "F"), GreaterThan("TotalPrice", 100000.0)), Not(In("Priority", ["5-LOW", "4-NOT SPECIFIED"])))), "WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR NOT (o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED'))")
orders("not_with_null", Query(Nulled).where(Not(Equal("Priority", "1-URGENT"))), "WHERE NOT (o_orderpriority = '1-URGENT')", NULLED, table="nulled")
orders("order_nulls_first", Query(Nulled).order_by(Asc("Priority"), Asc("OrderKey")).limit(50), "ORDER BY o_orderpriority ASC NULLS FIRST, o_orderkey LIMIT 50", NULLED, table="nulled")
orders("order_nulls_last", Query(Nulled).order_by(Desc("Priority"), Desc("OrderKey")).limit(4000), "ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey DESC LIMIT 4000", NULLED, table="nulled")
orders("limit_offset", O.order_by(Desc("TotalPrice"), Asc("OrderKey")).limit(20).offset(10), "ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
orders("limit_zero", O.order_by(Asc("OrderKey")).limit(0), "LIMIT 0")
orders("seek_asc", O.order_by(Asc("OrderKey")).seek_after(1000).limit(25), "WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 25")
orders("seek_desc", O.order_by(Desc("OrderKey")).seek_after(1000).limit(25), "WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 25")
orders("seek_mixed", O.order_by(Desc("Status"), Asc("OrderKey")).seek_after("O", 700).limit(25), "WHERE o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_orderkey > 700) ORDER BY o_orderstatus DESC, o_orderkey LIMIT 25")
orders("seek_null", Query(Nulled).order_by(Asc("Priority"), Asc("OrderKey")).seek_after(None, 200).limit(40), "WHERE o_orderpriority IS NOT NULL OR (o_orderpriority IS NULL AND o_orderkey > 200) ORDER BY o_orderpriority NULLS FIRST, o_orderkey LIMIT 40", NULLED, table="nulled")
orders("seek_desc_nullable", Query(Nulled).order_by(Desc("Priority"), Desc("OrderKey")).seek_after("3-MEDIUM", 500), "WHERE o_orderpriority < '3-MEDIUM' OR o_orderpriority IS NULL OR (o_orderpriority = '3-MEDIUM' AND o_orderkey < 500)", NULLED, table="nulled")
orders("seek_desc_null", Query(Nulled).order_by(Desc("Priority"), Desc("OrderKey")).seek_after(None, 500), "WHERE o_orderpriority IS NULL AND o_orderkey < 500", NULLED, table="nulled")
add("exists", O.where(GreaterThan("TotalPrice", 1000.0)).exists_df, 'SELECT count(*) > 0 AS "Exists" FROM orders WHERE o_totalprice > 1000')
add("exists_none", O.where(LessThan("TotalPrice", 0.0)).exists_df, 'SELECT FALSE AS "Exists"')
add("count", O.where(Equal("Status", "F")).count_df, "SELECT count(*) AS \"Count\" FROM orders WHERE o_orderstatus = 'F'")
add("count_paginated", O.order_by(Asc("OrderKey")).limit(30).offset(20).count_df, 'SELECT count(*) AS "Count" FROM (SELECT 1 FROM orders LIMIT 30 OFFSET 20)')

# Relations
BIG = "EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)"
orders("has_direct", O.where(Has("Lines")), "WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
orders("has_filtered", O.where(Has("Lines", GreaterThan("Quantity", 40.0))), f"WHERE {BIG}")
add("has_nested", C.where(Has("Orders", Has("Lines", Equal("SuppKey", 7)))).select("CustKey").df, 'SELECT c_custkey AS "CustKey" FROM customer c WHERE EXISTS (SELECT 1 FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey AND l.l_suppkey = 7)')
orders("has_m2m", O.where(Has("Suppliers", GreaterThan("AcctBal", 9000.0))), "WHERE EXISTS (SELECT 1 FROM order_supplier e JOIN supplier s ON s.s_suppkey = e.l_suppkey WHERE e.l_orderkey = o.o_orderkey AND s.s_acctbal > 9000)", EDGE)
add("has_via", Query(Part).where(Has("Suppliers", Equal("SuppKey", 7))).select("PartKey").df, 'SELECT p_partkey AS "PartKey" FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_partkey = p.p_partkey AND s.s_suppkey = 7)')
orders("has_or", O.where(Or(Has("Lines", Equal("SuppKey", 7)), LessThan("OrderKey", 50))), "WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = 7) OR o_orderkey < 50")
orders("has_to_one", O.where(Has("Customer", Equal("Segment", "BUILDING"))), "WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')")
orders("not_has", O.where(Not(Has("Lines"))), "WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
add("not_has_events", C.where(Not(Has("Events", Equal("Type", "click")))).select("CustKey").df, "SELECT c_custkey AS \"CustKey\" FROM customer c WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.c_custkey AND e.event_type = 'click')")
add("has_soft_deleted_target", Query(SoftCustomer).where(Has("Orders", GreaterThan("TotalPrice", 400000.0))).select("CustKey").df, 'SELECT c_custkey AS "CustKey" FROM customer c WHERE EXISTS (SELECT 1 FROM soft_orders o WHERE o.o_custkey = c.c_custkey AND o.deleted_at IS NULL AND o.o_totalprice > 400000)', SOFT)
orders("soft_delete_scope", Query(SoftOrder), "WHERE deleted_at IS NULL", SOFT, table="soft_orders")
orders("with_deleted", Query(SoftOrder).with_deleted(), "", SOFT, table="soft_orders")

# Aggregates
money = lambda c: f'CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)'
A = Aggregate(Order)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on their order in the last bits."""
    return df.select(*[F.round(c, 2).alias(c) if c in names else F.col(c) for c in df.columns])


add("agg_global", lambda s: rounded(A.select(CountAll(), Sum("TotalPrice").As("Total"), Min("OrderKey").As("Low"), Max("OrderDate").As("Last")).df(s), "Total"), 'SELECT count(*) AS "Count", round(sum(o_totalprice), 2) AS "Total", min(o_orderkey) AS "Low", max(o_orderdate) AS "Last" FROM orders')
add("agg_global_empty", A.select(CountAll(), Sum("TotalPrice").As("Total"), Avg("TotalPrice").As("Mean")).where(LessThan("TotalPrice", 0.0)).df, 'SELECT count(*) AS "Count", sum(o_totalprice) AS "Total", avg(o_totalprice) AS "Mean" FROM orders WHERE o_totalprice < 0')
add("agg_group", lambda s: rounded(A.select(Field("Status"), CountAll().As("N"), Avg("TotalPrice").As("Mean")).group_by("Status").df(s), "Mean"), 'SELECT o_orderstatus AS "Status", count(*) AS "N", round(avg(o_totalprice), 2) AS "Mean" FROM orders GROUP BY 1')
add("agg_group_null", Aggregate(Nulled).select(Field("Priority"), CountAll().As("N"), Count("Priority").As("Known")).group_by("Priority").df, 'SELECT o_orderpriority AS "Priority", count(*) AS "N", count(o_orderpriority) AS "Known" FROM nulled GROUP BY 1', NULLED)
add("agg_date", A.select(Date("OrderDate").As("Day"), CountAll().As("N")).group_by("Day").df, 'SELECT CAST(o_orderdate AS DATE) AS "Day", count(*) AS "N" FROM orders GROUP BY 1')
add("agg_year_month", A.select(YearMonth("OrderDate").As("Month"), CountAll().As("N")).group_by("Month").df, 'SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS "Month", count(*) AS "N" FROM orders GROUP BY 1')
add("count_if", A.select(Field("Status"), CountIf(GreaterThan("TotalPrice", 200000.0)).As("Big")).group_by("Status").df, 'SELECT o_orderstatus AS "Status", count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS "Big" FROM orders GROUP BY 1')
add("sum_if", lambda s: rounded(A.select(Field("Priority"), SumIf("TotalPrice", Equal("Status", "F")).As("Total")).group_by("Priority").df(s), "Total"), "SELECT o_orderpriority AS \"Priority\", round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS \"Total\" FROM orders GROUP BY 1")
add("sum_if_none", A.select(CountIf(Equal("Status", "absent")).As("N"), SumIf("TotalPrice", Equal("Status", "absent")).As("Total")).df, "SELECT count(CASE WHEN o_orderstatus = 'absent' THEN 1 END) AS \"N\", sum(CASE WHEN o_orderstatus = 'absent' THEN o_totalprice END) AS \"Total\" FROM orders")
add("count_if_has", A.select(Field("Status"), CountIf(Has("Lines", GreaterThan("Quantity", 40.0))).As("Big")).group_by("Status").df, f'SELECT o_orderstatus AS "Status", count(CASE WHEN {BIG} THEN 1 END) AS "Big" FROM orders o GROUP BY 1')
add("sum_if_has", lambda s: rounded(A.select(Field("Status"), SumIf("TotalPrice", Has("Lines", GreaterThan("Quantity", 40.0))).As("Total")).group_by("Status").df(s), "Total"), f'SELECT o_orderstatus AS "Status", round(sum(CASE WHEN {BIG} THEN o_totalprice END), 2) AS "Total" FROM orders o GROUP BY 1')
add("count_distinct", A.select(Field("Status"), CountDistinct("CustKey").As("Customers")).group_by("Status").df, 'SELECT o_orderstatus AS "Status", count(DISTINCT o_custkey) AS "Customers" FROM orders GROUP BY 1')
add("agg_min_max", A.select(Field("CustKey"), Min("TotalPrice").As("Least"), Max("TotalPrice").As("Most")).group_by("CustKey").df, 'SELECT o_custkey AS "CustKey", min(o_totalprice) AS "Least", max(o_totalprice) AS "Most" FROM orders GROUP BY 1')
PER = A.select(Field("CustKey"), CountAll().As("N")).group_by("CustKey")
PERS = 'SELECT o_custkey AS "CustKey", count(*) AS "N" FROM orders GROUP BY 1 HAVING'
add("having_compare", PER.having(GreaterThan("N", 12)).df, f"{PERS} count(*) > 12")
add("having_in", PER.having(In("N", [9, 10])).df, f"{PERS} count(*) IN (9, 10)")
add("having_not_in", PER.having(NotIn("N", [9, 10])).df, f"{PERS} count(*) NOT IN (9, 10)")
add("having_between", PER.having(Between("N", 8, 11)).df, f"{PERS} count(*) BETWEEN 8 AND 11")
add("having_logic", PER.having(Or(LessThan("N", 6), Not(LessThanOrEqual("N", 14)))).df, f"{PERS} count(*) < 6 OR NOT (count(*) <= 14)")
add("having_null", Aggregate(Nulled).select(Field("Priority"), CountAll().As("N")).group_by("Priority").having(IsNull("Priority")).df, 'SELECT o_orderpriority AS "Priority", count(*) AS "N" FROM nulled GROUP BY 1 HAVING o_orderpriority IS NULL', NULLED)
add("agg_related_field", A.select(Field("Customer.Segment").As("Segment"), CountAll().As("N")).group_by("Segment").df, 'SELECT c.c_mktsegment AS "Segment", count(*) AS "N" FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1')
add("agg_related_nested", A.select(Field("Customer.Nation.Region.Name").As("Region"), Field("Customer.Nation.Name").As("Nation"), CountAll().As("N")).group_by("Region", "Nation").df, 'SELECT r.r_name AS "Region", n.n_name AS "Nation", count(*) AS "N" FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2')
add("agg_related_missing", Aggregate(Document).select(Field("Label.Toxic").As("Toxic"), CountAll().As("N")).group_by("Toxic").df, 'SELECT l.toxic AS "Toxic", count(*) AS "N" FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1')
add("agg_has", A.select(Field("Status"), CountAll().As("N")).where(Has("Lines", Equal("ReturnFlag", "R"))).group_by("Status").df, "SELECT o_orderstatus AS \"Status\", count(*) AS \"N\" FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R') GROUP BY 1")
add("agg_paged", PER.order_by(Desc("N"), Asc("CustKey")).limit(10).offset(5).df, 'SELECT o_custkey AS "CustKey", count(*) AS "N" FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5')
add("agg_soft_delete", Aggregate(SoftOrder).select(Field("Status"), CountAll().As("N")).group_by("Status").df, 'SELECT o_orderstatus AS "Status", count(*) AS "N" FROM soft_orders WHERE deleted_at IS NULL GROUP BY 1', SOFT)
add("agg_with_deleted", Aggregate(SoftOrder).select(CountAll().As("N")).with_deleted().df, 'SELECT count(*) AS "N" FROM soft_orders', SOFT)

# Windows over groups
W = A.select(Field("Status"), YearMonth("OrderDate").As("Month"), CountAll().As("N")).group_by("Status", "Month")
G = 'SELECT o_orderstatus AS "Status", CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS "Month", count(*) AS "N" FROM orders GROUP BY 1, 2'
by_n, by_month = spec(["Status"], [Desc("N"), Asc("Month")]), spec(["Status"], [Asc("Month")])
N_ORDER, M_ORDER = 'PARTITION BY "Status" ORDER BY "N" DESC NULLS LAST, "Month" NULLS FIRST', 'PARTITION BY "Status" ORDER BY "Month" NULLS FIRST'


def window(name: str, w, sql: str) -> None:
    add(name, W.window(w.As("W")).df, f'SELECT g.*, {sql} AS "W" FROM ({G}) g')


window("row_number", RowNumber().over(by_n), f"row_number() OVER ({N_ORDER})")
window("rank", Rank().over(spec(["Status"], [Desc("N")])), 'rank() OVER (PARTITION BY "Status" ORDER BY "N" DESC NULLS LAST)')
window("dense_rank", DenseRank().over(spec([], [Desc("N")])), 'dense_rank() OVER (ORDER BY "N" DESC NULLS LAST)')
window("lag", Lag("N", 2).over(by_month), f'lag("N", 2) OVER ({M_ORDER})')
window("lead", Lead("N").over(by_month), f'lead("N", 1) OVER ({M_ORDER})')
window("lag_zero", Lag("N", 0).over(by_month), '"N"')
window("first_value", FirstValue("N").over(by_month), f'first_value("N") OVER ({M_ORDER})')
window("last_value_default_frame", LastValue("N").over(spec(["Status"], [Desc("N")])), '"N"')
window("running_sum", Sum("N").over(spec(["Status"], [Asc("Month")], RowsBetween(UNBOUNDED, 0))), f'CAST(sum("N") OVER ({M_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT)')
window("moving_rows", Max("N").over(spec(["Status"], [Asc("Month")], RowsBetween(-2, 2))), f'max("N") OVER ({M_ORDER} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')
window("partitioned_window", Avg("N").over(spec(["Status"])), 'avg("N") OVER (PARTITION BY "Status")')
window("count_over_partition", CountAll().over(spec(["Status"])), 'count(*) OVER (PARTITION BY "Status")')
add("window_ordered_page", W.window(RowNumber().over(by_n).As("W")).order_by(Asc("W"), Asc("Status")).limit(7).df, f'SELECT * FROM (SELECT g.*, row_number() OVER ({N_ORDER}) AS "W" FROM ({G}) g) ORDER BY "W", "Status" LIMIT 7')
FLAGSHIP = (
    A.select(Field("Customer.Segment").As("Segment"), YearMonth("OrderDate").As("Month"), CountAll().As("Orders"), CountIf(Has("Lines", GreaterThan("Quantity", 40.0))).As("BigOrders"), Sum("TotalPrice").As("Total"))
    .where(GreaterThan("TotalPrice", 1000.0))
    .group_by("Segment", "Month")
    .having(GreaterThan("Orders", 1))
    .window(Sum("Orders").over(spec(["Segment"], [Asc("Month")], RowsBetween(UNBOUNDED, 0))).As("Running"))
)
add(
    "flagship",
    lambda s: rounded(FLAGSHIP.df(s), "Total"),
    f'SELECT g.*, CAST(sum("Orders") OVER (PARTITION BY "Segment" ORDER BY "Month" NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "Running" FROM (SELECT c.c_mktsegment AS "Segment", CAST(year(o.o_orderdate) * 100 + month(o.o_orderdate) AS BIGINT) AS "Month", count(*) AS "Orders", count(CASE WHEN {BIG} THEN 1 END) AS "BigOrders", round(sum(o.o_totalprice), 2) AS "Total" FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000 GROUP BY 1, 2 HAVING count(*) > 1) g',
)

# Rewrites
LINK7 = "WHERE EXISTS (SELECT 1 FROM order_supplier e WHERE e.l_orderkey = o.o_orderkey AND e.l_suppkey = 7)"
orders("topn_rewritten", O.where(Has("SupplierLinks", Equal("SuppKey", 7))).order_by(Desc("OrderKey")).limit(10), f"{LINK7} ORDER BY o_orderkey DESC LIMIT 10", EDGE)
orders("topn_junction_only", O.where(Has("Suppliers", Equal("SuppKey", 7))).order_by(Asc("OrderKey")).limit(10).offset(3), f"{LINK7} ORDER BY o_orderkey LIMIT 10 OFFSET 3", EDGE)
orders("topn_fallback", O.where(Has("Lines", Equal("SuppKey", 8))).order_by(Desc("OrderKey")).limit(10), "WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = 8) ORDER BY o_orderkey DESC LIMIT 10")
add("count_rewritten", O.where(Has("Suppliers", Equal("SuppKey", 7))).count_df, f'SELECT count(*) AS "Count" FROM orders o {LINK7}', EDGE)
add("count_fallback", O.where(Has("Lines", Equal("SuppKey", 7))).count_df, 'SELECT count(*) AS "Count" FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey = 7)')

# Relation loading, flattened
add("preload_to_one", lambda s: O.select("OrderKey").preload("Customer.Nation").df(s).select("OrderKey", F.col("Customer.Name").alias("CustomerName"), F.col("Customer.Nation.Name").alias("NationName")), 'SELECT o_orderkey AS "OrderKey", c_name AS "CustomerName", n_name AS "NationName" FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey')
add("preload_missing", lambda s: Query(Document).select("DocID").preload("Label").df(s).select("DocID", F.col("Label.Quality").alias("Quality"), F.col("Label").isNull().alias("Missing")), 'SELECT d.doc_id AS "DocID", l.quality AS "Quality", l.doc_id IS NULL AS "Missing" FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id')
add(
    "preload_has_many",
    lambda s: C.select("CustKey").preload("Orders", fields=("OrderKey",), order_by=(Desc("TotalPrice"), Asc("OrderKey"))).df(s).select("CustKey", F.posexplode_outer("Orders").alias("At", "Order")).select("CustKey", F.col("At").cast("long").alias("At"), F.col("Order.OrderKey").alias("OrderKey")),
    'SELECT c_custkey AS "CustKey", CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 END AS "At", o_orderkey AS "OrderKey" FROM customer LEFT JOIN orders ON o_custkey = c_custkey',
)
add(
    "preload_via_order",
    lambda s: Query(Part).select("PartKey").preload("Suppliers", fields=("SuppKey",), order_by=(Desc("Edge.Quantity"), Asc("SuppKey"))).df(s).select("PartKey", F.posexplode("Suppliers").alias("At", "S")).select("PartKey", F.col("At").cast("long").alias("At"), F.col("S.SuppKey").alias("SuppKey")),
    'SELECT l_partkey AS "PartKey", row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey) - 1 AS "At", l_suppkey AS "SuppKey" FROM lineitem',
)
add("preload_soft_deleted", lambda s: Query(SoftCustomer).select("CustKey").preload("Orders").df(s).select("CustKey", F.size("Orders").cast("long").alias("N")), 'SELECT c_custkey AS "CustKey", count(o_orderkey) AS "N" FROM customer LEFT JOIN soft_orders ON o_custkey = c_custkey AND deleted_at IS NULL GROUP BY 1', SOFT)

# Vectors
PROBE = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
LITERAL = "CAST([" + ", ".join(f"CAST({x} AS FLOAT)" for x in PROBE) + "] AS DOUBLE[])"
rounded6 = lambda df: df.select("VecID", F.round("Distance", 6).alias("Distance"))
add("vector_l2", lambda s: rounded6(nearest(Embedding, "Vector", PROBE, "l2", 10).select("VecID").df(s)), f'SELECT vec_id AS "VecID", round(list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), 6) AS "Distance" FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), vec_id LIMIT 10')
add("vector_cosine", lambda s: rounded6(nearest(Embedding, "Vector", PROBE, "cosine", 10).select("VecID").df(s)), f'SELECT vec_id AS "VecID", round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {LITERAL}), 6) AS "Distance" FROM embeddings ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {LITERAL}), vec_id LIMIT 10')
add("vector_filtered", lambda s: rounded6(nearest(Embedding, "Vector", PROBE, "l2", 5).where(Equal("Label", 1)).select("VecID").df(s)), f'SELECT vec_id AS "VecID", round(list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), 6) AS "Distance" FROM embeddings WHERE label = 1 ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), vec_id LIMIT 5')

# Mutations: the table's next state
NEW = ({"OrderKey": 5, "CustKey": 1, "Status": "N", "TotalPrice": 1.5, "OrderDate": datetime(2001, 2, 3), "Priority": "1-URGENT"}, {"OrderKey": 10_000_001, "CustKey": 2, "Status": "N", "TotalPrice": 2.5, "OrderDate": datetime(2001, 2, 4), "Priority": None})
ROW1, ROW2 = "SELECT 5, 1, 'N', 1.5, TIMESTAMP '2001-02-03', '1-URGENT'", "SELECT 10000001, 2, 'N', 2.5, TIMESTAMP '2001-02-04', NULL"
add("insert", lambda s: Insert(Order, NEW[1:]).apply(s.table("orders")), f"SELECT * FROM orders UNION ALL {ROW2}")
add("upsert", lambda s: Upsert(Order, NEW).apply(s.table("orders")), f"SELECT * FROM orders WHERE o_orderkey <> 5 UNION ALL {ROW1} UNION ALL {ROW2}")
add("upsert_fields", lambda s: Upsert(Order, NEW, ("Status",)).apply(s.table("orders")), f"SELECT * REPLACE (CASE WHEN o_orderkey = 5 THEN 'N' ELSE o_orderstatus END AS o_orderstatus) FROM orders UNION ALL {ROW2}")
add("update_where", lambda s: UpdateWhere(Order, (Set("Priority", None),)).where(Equal("Status", "F")).apply(s.table("orders")), "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders")
add("increment", lambda s: UpdateWhere(Order, (Increment("CustKey", 3),)).where(LessThan("OrderKey", 100)).apply(s.table("orders")), "SELECT * REPLACE (CASE WHEN o_orderkey < 100 THEN o_custkey + 3 ELSE o_custkey END AS o_custkey) FROM orders")
add("update_many", lambda s: UpdateMany(Order, ({"OrderKey": 3, "Status": "X", "Priority": None}, {"OrderKey": 7, "Status": "Y", "Priority": "9"}), ("Status", "Priority")).apply(s.table("orders")), "SELECT * REPLACE (CASE o_orderkey WHEN 3 THEN 'X' WHEN 7 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus, CASE o_orderkey WHEN 3 THEN NULL WHEN 7 THEN '9' ELSE o_orderpriority END AS o_orderpriority) FROM orders")
add("delete_where", lambda s: DeleteWhere(Order).where(Equal("Status", "P")).apply(s.table("orders")), "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
add("soft_delete", lambda s: DeleteWhere(SoftOrder, at=F.lit(datetime(2030, 1, 1))).where(LessThan("OrderKey", 500)).apply(s.table("soft_orders")), "SELECT * REPLACE (CASE WHEN deleted_at IS NULL AND o_orderkey < 500 THEN TIMESTAMP '2030-01-01' ELSE deleted_at END AS deleted_at) FROM soft_orders", SOFT)
add("restore", lambda s: UpdateWhere(SoftOrder, (Set("DeletedAt", None),)).where(LessThan("OrderKey", 500)).with_deleted().apply(s.table("soft_orders")), "SELECT * REPLACE (CASE WHEN o_orderkey < 500 THEN NULL ELSE deleted_at END AS deleted_at) FROM soft_orders", SOFT)
Linked = Model("Linked", "orders", Order.fields, [many_to_many("Suppliers", Supplier, Junction("order_supplier", ("l_orderkey",), ("l_suppkey",)))])
LINKS = Links(Linked, "Suppliers")
add("add_relation", lambda s: LINKS.add(s.table("order_supplier"), 1, [900_001, 900_002]), "SELECT * FROM order_supplier UNION ALL SELECT 1, 900001 UNION ALL SELECT 1, 900002", EDGE)
add("add_relation_ignore", lambda s: LINKS.add(s.table("order_supplier"), 1, list(range(1, 101)), ignore_existing=True), "SELECT * FROM order_supplier UNION SELECT 1, CAST(range AS BIGINT) FROM range(1, 101)", EDGE)
add("remove_relation", lambda s: LINKS.remove(s.table("order_supplier"), 1, list(range(1, 51))), "SELECT * FROM order_supplier WHERE NOT (l_orderkey = 1 AND l_suppkey BETWEEN 1 AND 50)", EDGE)
add("clear_relation", lambda s: LINKS.clear(s.table("order_supplier"), 1), "SELECT * FROM order_supplier WHERE l_orderkey <> 1", EDGE)

# Raw SQL
Spend = Model("Spend", "spend", [Column("CustKey", "custkey"), Column("Spent", "spent", "float", computed=True)])


def _raw(s: TableSource) -> DataFrame:
    s.table("orders").createOrReplaceTempView("sparkloom_raw_orders")
    found = Raw(Spend, "WITH o AS (SELECT * FROM sparkloom_raw_orders WHERE o_totalprice > ?) SELECT o_custkey AS custkey, round(sum(o_totalprice), 2) AS spent FROM o GROUP BY o_custkey", (250000.0,)).df(s.spark)
    return found


add("raw_cte", _raw, 'WITH o AS (SELECT * FROM orders WHERE o_totalprice > 250000) SELECT o_custkey AS "CustKey", round(sum(o_totalprice), 2) AS "Spent" FROM o GROUP BY 1')


def _audit(s: TableSource) -> DataFrame:
    from ..schema.audit import orphans

    child = Model("Order", "orders", Order.fields, [Order.relation("Customer").__class__("Customer", "belongs_to", Model("Few", "few_customers", Customer.fields), ("CustKey",), ("CustKey",))])
    return orphans(child, "Customer", s).groupBy().agg(F.count(F.lit(1)).alias("Orphans"))


add("orphan_audit", _audit, 'SELECT count(*) AS "Orphans" FROM orders o WHERE NOT EXISTS (SELECT 1 FROM few_customers c WHERE c.c_custkey = o.o_custkey)', PART_ORDERS)


def _capture(s: TableSource) -> DataFrame:
    """events as a workload: a user's day is a scope, a type a statement."""
    e = s.table("events")
    return e.select(F.lit("events").alias("capture"), F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("scope"), F.lit("All").alias("terminal"), F.lit("Query").alias("operation"), F.col("event_type").alias("fingerprint"), F.col("value").alias("cost"))


SCOPES = "e AS (SELECT user_id::VARCHAR || ' ' || strftime(ts, '%Y-%m-%d') AS scope, event_type, value FROM events)"


def _n_plus_one(s: TableSource) -> DataFrame:
    from .capture import repeated

    return repeated(_capture(s)).select("scope", "fingerprint", "n", "code")


add("n_plus_one_analysis", _n_plus_one, "SELECT scope, event_type AS fingerprint, count(*) AS n, 'RUN002' AS code FROM e GROUP BY 1, 2 HAVING count(*) >= 2", SCOPES)


def _cost(s: TableSource) -> DataFrame:
    from .capture import cost_baseline

    b = cost_baseline(_capture(s))
    return b.select("fingerprint", "samples", F.round("mean", 4).alias("mean"), F.round("bound", 4).alias("bound"))


add("cost_baseline", _cost, "SELECT event_type AS fingerprint, count(value) AS samples, round(avg(value), 4) AS mean, round(greatest(1.30 * avg(value), max(value)), 4) AS bound FROM events GROUP BY 1 HAVING count(value) >= 5")


def _workload(s: TableSource) -> DataFrame:
    from .capture import workload_baseline

    b = workload_baseline(_capture(s))
    return b.select("scopes", F.round("cost_bound", 4).alias("cost_bound"), F.round("statements_bound", 4).alias("statements_bound"))


add("workload_baseline", _workload, "SELECT count(*) AS scopes, round(greatest(1.30 * avg(c), max(c)), 4) AS cost_bound, round(greatest(1.30 * avg(n), max(n)), 4) AS statements_bound FROM (SELECT scope, sum(value) AS c, count(*) AS n FROM e GROUP BY 1)", SCOPES)


# Terminals: what they collect, as a table again
def frame(s: TableSource, found, schema: str) -> DataFrame:
    return s.spark.createDataFrame([tuple(r) if isinstance(r, tuple) else (r,) for r in found], schema)


KEYED = O.order_by(Desc("TotalPrice"), Asc("OrderKey")).select("OrderKey", "Status")
add("all", lambda s: frame(s, Query(Nation).select("NationKey", "Name").all(s), "NationKey int, Name string"), 'SELECT n_nationkey AS "NationKey", n_name AS "Name" FROM nation')
add("scan_all", lambda s: frame(s, Query(Nation).select("Name").scan_all(s), "Name string"), 'SELECT n_name AS "Name" FROM nation')
add("first", lambda s: frame(s, [KEYED.first(s)], "OrderKey long, Status string"), 'SELECT o_orderkey AS "OrderKey", o_orderstatus AS "Status" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1')
add("only", lambda s: frame(s, [O.select("OrderKey", "Status").where(Equal("OrderKey", 7)).only(s)], "OrderKey long, Status string"), 'SELECT o_orderkey AS "OrderKey", o_orderstatus AS "Status" FROM orders WHERE o_orderkey = 7')

# Relations of a table with itself, and deleted rows
Peer = Model("Peer", "customer", Customer.fields, [belongs_to("Other", lambda: Peer, ("NationKey",), ("CustKey",))])
PEER = "EXISTS (SELECT 1 FROM customer p WHERE p.c_custkey = c.c_nationkey AND p.c_acctbal > 0)"
add("has_self", Query(Peer).where(Has("Other", GreaterThan("AcctBal", 0.0))).select("CustKey").df, f'SELECT c_custkey AS "CustKey" FROM customer c WHERE {PEER}')
add("not_has_self", Query(Peer).where(Not(Has("Other", GreaterThan("AcctBal", 0.0)))).select("CustKey").df, f'SELECT c_custkey AS "CustKey" FROM customer c WHERE NOT {PEER}')
add("preload_self", lambda s: Query(Peer).select("CustKey").preload("Other").df(s).select("CustKey", F.col("Other.Name").alias("Other")), 'SELECT c.c_custkey AS "CustKey", p.c_name AS "Other" FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_nationkey')
add("agg_self", Aggregate(Peer).select(Field("Other.Segment").As("Segment"), CountAll().As("N")).group_by("Segment").df, 'SELECT p.c_mktsegment AS "Segment", count(*) AS "N" FROM customer c LEFT JOIN customer p ON p.c_custkey = c.c_nationkey GROUP BY 1')
add("preload_with_deleted", lambda s: Query(SoftCustomer).select("CustKey").preload("Orders", with_deleted=True).df(s).select("CustKey", F.size("Orders").cast("long").alias("N")), 'SELECT c_custkey AS "CustKey", count(o_orderkey) AS "N" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1')

# Vectors: other dimensions, names, and search that may be approximate
add("vector_null_distance", nearest(Embedding, "Vector", [1.0, 2.0], "l2", 5).select("VecID").df, 'SELECT vec_id AS "VecID", CAST(NULL AS DOUBLE) AS "Distance" FROM embeddings ORDER BY vec_id LIMIT 5')
add("vector_distance_as", lambda s: nearest(Embedding, "Vector", PROBE, "l2", 10).select("VecID").distance_as("Far").df(s).select("VecID", F.round("Far", 6).alias("Far")), f'SELECT vec_id AS "VecID", round(list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), 6) AS "Far" FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), vec_id LIMIT 10')
add("vector_approximate", lambda s: rounded6(nearest(Embedding, "Vector", PROBE, "l2", 10).approximate().select("VecID").df(s)), f'SELECT vec_id AS "VecID", round(list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), 6) AS "Distance" FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), vec_id LIMIT 10')

def _indexed(s: TableSource, metric: str) -> DataFrame:
    """Every cell of a built index is probed: the answer is the exact one, and rows come back by way of the cells."""
    from ..operators.vector_index import MOST_CELLS

    index = build_vector_index(Embedding, "Vector", metric, s, new_folder(s.spark, "vector-index"))
    return rounded6(nearest(Embedding, "Vector", PROBE, metric, 10).approximate(index, MOST_CELLS).where(NotEqual("Label", 3)).select("VecID").df(s))


add("vector_indexed", lambda s: _indexed(s, "l2"), f'SELECT vec_id AS "VecID", round(list_distance(CAST(embedding AS DOUBLE[]), {LITERAL}), 6) AS "Distance" FROM embeddings WHERE label <> 3 ORDER BY 2, 1 LIMIT 10')
add("vector_indexed_cosine", lambda s: _indexed(s, "cosine"), f'SELECT vec_id AS "VecID", round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {LITERAL}), 6) AS "Distance" FROM embeddings WHERE label <> 3 ORDER BY 2, 1 LIMIT 10')


def _migrated(s: TableSource) -> DataFrame:
    """States of a record after a baseline, two steps up and one down."""
    from ..schema.migrate import Migration, Runner

    runner = Runner.of(s.spark, [Migration(v, n, f"SELECT {v}", f"SELECT -{v}") for v, n in enumerate(("first", "second", "third", "fourth"), 1)], new_folder(s.spark, "migrations"))
    runner.baseline(1)
    runner.up(3)
    runner.down()
    return frame(s, runner.status(), "version int, name string, state string")


add("migration_status", _migrated, "SELECT * FROM (VALUES (1, 'first', 'applied'), (2, 'second', 'applied'), (3, 'third', 'pending'), (4, 'fourth', 'pending')) AS t(version, name, state)")


def _places(s: TableSource) -> DataFrame:
    """What the scans of a plan with relations read."""
    q = Query(Order).where(Has("Lines", Equal("ReturnFlag", "R"))).select("OrderKey").preload("Customer")
    return frame(s, sorted({(n.table, n.model, n.relation) for n in q.explain(s).walk() if n.table}), "table string, model string, relation string")


add("plan_places", _places, "SELECT * FROM (VALUES ('orders', 'Order', ''), ('lineitem', 'Line', 'Lines'), ('customer', 'Customer', 'Customer')) AS t(\"table\", model, relation)")

# More mutations
MORE = tuple(NEW[1] | {"OrderKey": 20_000_000 + i, "CustKey": i} for i in range(50))
MORE_ROWS = "SELECT 20000000 + range, range, 'N', 2.5, TIMESTAMP '2001-02-04', NULL FROM range(50)"
add("insert_many", lambda s: Insert(Order, MORE).apply(s.table("orders")), f"SELECT * FROM orders UNION ALL {MORE_ROWS}")
add("upsert_repeated", lambda s: Upsert(Order, (NEW[0] | {"Status": "A"}, NEW[1] | {"Status": "B"}, *NEW)).apply(s.table("orders")), f"SELECT * FROM orders WHERE o_orderkey <> 5 UNION ALL {ROW1} UNION ALL {ROW2}")
add("upsert_many", lambda s: Upsert(Order, (*MORE, *NEW, NEW[0] | {"OrderKey": 7})).apply(s.table("orders")), f"SELECT * FROM orders WHERE o_orderkey NOT IN (5, 7) UNION ALL {ROW1} UNION ALL {ROW1.replace('5,', '7,', 1)} UNION ALL {ROW2} UNION ALL {MORE_ROWS}")
add("update", lambda s: Update(Order, {"OrderKey": 3, "Status": "X"}, "Status").apply(s.table("orders")), "SELECT * REPLACE (CASE o_orderkey WHEN 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
add("delete", lambda s: Delete(Order, {"OrderKey": 3}).apply(s.table("orders")), "SELECT * FROM orders WHERE o_orderkey <> 3")
add("soft_delete_now", lambda s: DeleteWhere(SoftOrder).where(LessThan("OrderKey", 500)).apply(s.table("soft_orders")).select("o_orderkey", F.col("deleted_at").isNotNull().alias("gone")), "SELECT o_orderkey, deleted_at IS NOT NULL OR o_orderkey < 500 AS gone FROM soft_orders", SOFT)
Trip = Model("Trip", "orders", [Column("OrderKey", "o_orderkey", pk=True), Column("CustKey", "o_custkey", pk=True)], [many_to_many("Suppliers", Supplier, Junction("trips", ("t_order", "t_cust"), ("t_supp",)))])
TRIPS = "trips AS (SELECT DISTINCT l_orderkey AS t_order, o_custkey AS t_cust, l_suppkey AS t_supp FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def trips(s: TableSource) -> DataFrame:
    """Dealt by order: the join, its sorts and the distinct rows of a share are in one task."""
    line, order = s.table("lineitem"), s.table("orders")
    n = shares(line, order)
    both = dealt(line, n, "l_orderkey").join(dealt(order, n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select(F.col("l_orderkey").alias("t_order"), F.col("o_custkey").alias("t_cust"), F.col("l_suppkey").alias("t_supp")).distinct()


add("composite_key_add", lambda s: Links(Trip, "Suppliers").add(trips(s), CompositeKey(1, 900_000), [900_001, 900_002]), "SELECT * FROM trips UNION ALL SELECT 1, 900000, 900001 UNION ALL SELECT 1, 900000, 900002", TRIPS)
add("composite_key_clear", lambda s: Links(Trip, "Suppliers").clear(trips(s), CompositeKey(1, 1)), "SELECT * FROM trips WHERE NOT (t_order = 1 AND t_cust = 1)", TRIPS)


# Analysis of captures, comparison with baselines, rules
def _statements(s: TableSource) -> DataFrame:
    """events as statements of several kinds, some without a cost or a fingerprint."""
    e, kind = s.table("events"), F.col("event_id") % 4
    return e.select(
        F.lit("events").alias("capture"), F.concat_ws(" ", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM")).alias("scope"), F.lit("Exec").alias("terminal"),
        F.when(kind == 0, "Query").when(kind == 1, "Insert").when(kind == 2, "Upsert").otherwise("UpdateWhere").alias("operation"),
        F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("fingerprint"), F.when(F.col("event_id") % 20 != 3, F.col("value")).alias("cost"),
    )


STATEMENTS = """st AS (SELECT user_id::VARCHAR || ' ' || strftime(ts, '%Y-%m') AS scope, CASE event_id % 4 WHEN 0 THEN 'Query' WHEN 1 THEN 'Insert' WHEN 2 THEN 'Upsert' ELSE 'UpdateWhere' END AS operation,
 CASE WHEN event_id % 50 <> 0 THEN event_type END AS fingerprint, CASE WHEN event_id % 20 <> 3 THEN value END AS cost FROM events)"""


def _analysis(s: TableSource) -> DataFrame:
    from .capture import analyze

    return analyze(_statements(s))


add(
    "capture_analysis",
    _analysis,
    """SELECT 'RUN001' AS code, scope, CAST(NULL AS VARCHAR) AS fingerprint, count(*) AS n FROM st WHERE fingerprint IS NULL GROUP BY scope
    UNION ALL SELECT 'RUN003', scope, fingerprint, count(*) FROM st WHERE cost IS NULL AND fingerprint IS NOT NULL GROUP BY scope, fingerprint
    UNION ALL SELECT CASE WHEN operation = 'Query' THEN 'RUN002' WHEN operation IN ('Insert', 'Upsert') THEN 'RUN004' ELSE 'RUN005' END, scope, fingerprint, count(*) FROM st GROUP BY scope, operation, fingerprint HAVING count(*) >= 2""",
    STATEMENTS,
)


def _compared(s: TableSource, compared, made, names) -> DataFrame:
    """Odd users' events, of twice the value, against a baseline of even users' events; clicks are missing from the former."""
    every = _capture(s).withColumn("user", F.split("scope", " ")[0].cast("long"))
    before, now = every.where("user % 2 = 0"), every.where("user % 2 = 1 and fingerprint <> 'click'").withColumn("cost", F.col("cost") * 2)
    found = compared(made(before), now)
    return found.select("code", *[F.round(c, 4).alias(c) if c in ("mean", "value", "bound") else F.col(c) for c in names])


def _costs(s: TableSource) -> DataFrame:
    from .capture import compare_costs, cost_baseline

    return _compared(s, compare_costs, cost_baseline, ("fingerprint", "mean", "bound"))


def _workloads(s: TableSource) -> DataFrame:
    from .capture import compare_workloads, workload_baseline

    return _compared(s, compare_workloads, workload_baseline, ("capture", "value", "bound"))


HALVES = "h AS (SELECT user_id % 2 AS half, user_id::VARCHAR || ' ' || strftime(ts, '%Y-%m-%d') AS scope, event_type AS fingerprint, value * (1 + user_id % 2) AS cost FROM events WHERE user_id % 2 = 0 OR event_type <> 'click')"
add(
    "cost_comparison",
    _costs,
    """SELECT CASE WHEN n.mean IS NULL THEN 'RU002' ELSE 'RU001' END AS code, b.fingerprint, round(n.mean, 4) AS mean, round(b.bound, 4) AS bound
    FROM (SELECT fingerprint, greatest(1.30 * avg(cost), max(cost)) AS bound FROM h WHERE half = 0 GROUP BY 1 HAVING count(*) >= 5) b
    LEFT JOIN (SELECT fingerprint, avg(cost) AS mean FROM h WHERE half = 1 GROUP BY 1 HAVING count(*) >= 5) n USING (fingerprint) WHERE n.mean IS NULL OR n.mean > b.bound""",
    HALVES,
)
add(
    "workload_comparison",
    _workloads,
    """SELECT r.code, 'events' AS capture, round(r.value, 4) AS value, round(r.bound, 4) AS bound FROM (
      SELECT 'RU003' AS code, avg(CASE WHEN half = 1 THEN c END) AS value, greatest(1.30 * avg(CASE WHEN half = 0 THEN c END), max(CASE WHEN half = 0 THEN c END)) AS bound FROM w
      UNION ALL SELECT 'RU004', avg(CASE WHEN half = 1 THEN n END), greatest(1.30 * avg(CASE WHEN half = 0 THEN n END), max(CASE WHEN half = 0 THEN n END)) FROM w) r WHERE r.value > r.bound""",
    HALVES,
    "w AS (SELECT half, scope, sum(cost) AS c, count(*) AS n FROM h GROUP BY 1, 2)",
)


def _references(s: TableSource) -> DataFrame:
    from ..schema.audit import audit

    few = Model("Few", "few_customers", Customer.fields)
    models = [
        Model("Orphaned", "orders", Order.fields, [belongs_to("Customer", few, ("CustKey",), ("CustKey",))]),
        Model("Missing", "orders", [*Order.fields, Column("Nowhere", "o_nowhere")], [belongs_to("Customer", Customer, ("Nowhere",), ("CustKey",))]),
        Model("Typed", "customer", Customer.fields, [belongs_to("Other", Customer, ("NationKey",), ("CustKey",))]),
        Model("Loose", "customer", Customer.fields, [belongs_to("Some", Customer, ("NationKey",), ("NationKey",))]),
        Model("Unresolved", "orders", Order.fields, [belongs_to("Nothing", Customer)]),
    ]
    return frame(s, [(d.code, d.subject) for d in audit(models, s)], "code string, subject string")


add("reference_rules", _references, "SELECT * FROM (VALUES ('REF005', 'Orphaned.Customer'), ('REF002', 'Missing.Customer'), ('REF003', 'Typed.Other'), ('REF004', 'Loose.Some'), ('REF001', 'Unresolved.Nothing')) AS t(code, subject) UNION ALL SELECT 'REF005', 'Typed.Other' WHERE EXISTS (SELECT 1 FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer p WHERE p.c_custkey = c.c_nationkey))")


def _rules(s: TableSource) -> DataFrame:
    from ..schema import checks
    from ..schema.ddl import parse

    catalog = parse("CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL, o_orderstatus TEXT NOT NULL, o_totalprice DOUBLE NOT NULL, o_orderdate DATETIME(6), o_orderpriority TEXT, KEY k (o_orderstatus, o_orderkey))")
    page = O.order_by(Asc("OrderKey")).limit(5)
    found = {
        "schema": checks.check_schema(Order, catalog),
        "paged": checks.check_query(O.where(Contains("Status", "x")).limit(5).offset(2)),
        "fallback": checks.check_query(page.where(Has("Lines", Equal("SuppKey", 8)))),
        "served": checks.check_index(page.where(Equal("Status", "F")), catalog),
        "unserved": checks.check_index(page.where(Equal("CustKey", 1)), catalog),
        "range": checks.check_index(page.where(GreaterThan("TotalPrice", 1.0)), catalog),
        "update": checks.check_mutation(UpdateWhere(Order, (Set("Priority", "x"),)).where(Equal("CustKey", 1)), catalog),
        "update_many": checks.check_mutation(UpdateMany(Customer, ({"CustKey": 1},), ("Name",)), catalog),
    }
    return frame(s, [(on, d.code, d.subject) for on, all_ in found.items() for d in all_], "checked string, code string, subject string")


add(
    "model_rules",
    _rules,
    """SELECT * FROM (VALUES ('schema', 'CMP005', 'Order.OrderDate'), ('schema', 'CMP002', 'Order.Customer'), ('schema', 'CMP002', 'Order.Lines'), ('schema', 'CMP002', 'Order.SupplierLinks'), ('schema', 'CMP002', 'Order.Suppliers'),
    ('paged', 'QRY002', 'Order'), ('paged', 'QRY003', 'Order'), ('paged', 'QRY004', 'Order'), ('fallback', 'QRY005', 'Order'), ('unserved', 'QRY006', 'Order'), ('update', 'QRY008', 'Order'), ('update_many', 'QRY009', 'Customer')) AS t(checked, code, subject)""",
)
