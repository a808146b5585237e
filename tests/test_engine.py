"""Builders, rewrites, mutations, plans, capture, schema rules: validation comes before any job."""

import json
import math
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sparkloom.errors import BuildError, Conflict, DuplicateKey, ModelError, MultipleRows, NoRows, SparkloomError
from sparkloom.functions.vector import Vector
from sparkloom.operators import aggregate as A
from sparkloom.operators.demo import MODELS, Customer, Document, Embedding, Line, Order, Part, SoftOrder
from sparkloom.operators.model import Field, Junction, Model, belongs_to, has_many, many_to_many, snake_case
from sparkloom.operators.mutation import Delete, DeleteWhere, Increment, Insert, Links, Set, UpdateMany, UpdateWhere, Upsert
from sparkloom.operators.nearest import nearest
from sparkloom.operators.order import Asc, Desc
from sparkloom.operators.predicate import And, Contains, Equal, GreaterThan, Has, In, IsNotNull, LessThan, Not, Or
from sparkloom.operators.select import Query
from sparkloom.plans import capture as C
from sparkloom.plans.compare import compare
from sparkloom.plans.inspect import explain, explain_analyze
from sparkloom.plans.observe import observing, redact
from sparkloom.plans.registry import QUERIES, source
from sparkloom.plans.rewrite import count_reason, top_n_reason
from sparkloom.plans.shape import fingerprint, query_shape
from sparkloom.schema import checks, ddl, migrate
from sparkloom.schema.audit import audit
from sparkloom.sources.store import VersionedStore
from sparkloom.sources.tables import TableSource, shares


@pytest.fixture(scope="module")
def tables(spark, data):
    return source(spark, data)


class NoJob:
    """A source whose tables can't be read."""

    spark = folder = None
    derived = {}

    def table(self, name):
        raise AssertionError(f"{name} was read")


O = Query(Order)
BAD = {
    "no field": lambda: O.select("Nope"),
    "field twice": lambda: O.select("OrderKey", "OrderKey"),
    "text on number": lambda: O.where(Contains("OrderKey", "1")),
    "nil": lambda: O.where(Equal("Status", None)),
    "nil in": lambda: O.where(In("Status", ["a", None])),
    "one and": lambda: O.where(And(Equal("Status", "a"))),
    "one or": lambda: O.where(Or(Equal("Status", "a"))),
    "relation": lambda: O.where(Has("Nope")),
    "nested relation": lambda: O.where(Has("Lines", Equal("Nope", 1))),
    "order twice": lambda: O.order_by(Asc("OrderKey"), Desc("OrderKey")),
    "offset alone": lambda: O.offset(3),
    "negative": lambda: O.limit(-1),
    "seek without order": lambda: O.seek_after(1),
    "seek without key": lambda: O.order_by(Asc("Status")).seek_after("a"),
    "seek and offset": lambda: O.order_by(Asc("OrderKey")).seek_after(1).limit(2).offset(1),
    "seek count": lambda: O.order_by(Asc("OrderKey")).seek_after(1, 2),
    "seek null": lambda: O.order_by(Asc("OrderKey")).seek_after(None),
    "seek without pk": lambda: Query(Line).order_by(Asc("OrderKey")).seek_after(1),
    "soft delete": lambda: O.with_deleted(),
    "preload": lambda: O.preload("Nope"),
    "preload order": lambda: O.preload("Customer", order_by=(Asc("Name"),)),
    "edge order": lambda: O.preload("Lines", order_by=(Asc("Edge.Quantity"),)),
    "policy": lambda: O.read_from("row").mpp("enforce"),
    "index name": lambda: O.force_index("a b"),
    "index and engine": lambda: O.force_index("i").read_from("columnar"),
    "aggregate nothing": lambda: A.Aggregate(Order),
    "ungrouped": lambda: A.Aggregate(Order).select(A.Field("Status"), A.CountAll()),
    "group metric": lambda: A.Aggregate(Order).select(A.CountAll().As("N")).group_by("N"),
    "output twice": lambda: A.Aggregate(Order).select(A.CountAll().As("N"), A.Count("Status").As("n")),
    "related alias": lambda: A.Aggregate(Order).select(A.Field("Customer.Segment")).group_by("Customer.Segment"),
    "collection path": lambda: A.Aggregate(Order).select(A.Field("Lines.Tax").As("Tax")).group_by("Tax"),
    "sum of text": lambda: A.Aggregate(Order).select(A.Sum("Status")),
    "date of number": lambda: A.Aggregate(Order).select(A.Date("OrderKey").As("D")).group_by("D"),
    "having text": lambda: A.Aggregate(Order).select(A.Field("Status")).group_by("Status").having(Contains("Status", "x")),
    "having has": lambda: A.Aggregate(Order).select(A.CountAll()).having(Has("Lines")),
    "rank without order": lambda: A.Aggregate(Order).select(A.CountAll().As("N")).window(A.Rank().As("R")),
    "rank with frame": lambda: A.Aggregate(Order).select(A.CountAll().As("N")).window(A.Rank().over(A.spec([], [Asc("N")], A.RowsBetween(0, 1))).As("R")),
    "frame": lambda: A.RowsBetween(2, 1),
    "window on window": lambda: A.Aggregate(Order).select(A.CountAll().As("N")).window(A.RowNumber().over(A.spec([], [Asc("N")])).As("R"), A.Sum("R").over(A.spec()).As("S")),
    "window alias": lambda: A.Aggregate(Order).select(A.CountAll().As("N")).window(A.Sum("N").over(A.spec())),
    "distinct window": lambda: A.Aggregate(Order).select(A.CountAll().As("N")).window(A.CountDistinct("N").over(A.spec()).As("D")),
    "negative lag": lambda: A.Aggregate(Order).select(A.CountAll().As("N")).window(A.Lag("N", -1).over(A.spec([], [Asc("N")])).As("L")),
    "vector field": lambda: nearest(Embedding, "Label", [1.0], "l2", 1),
    "vector metric": lambda: nearest(Embedding, "Vector", [1.0], "dot", 1),
    "vector k": lambda: nearest(Embedding, "Vector", [1.0], "l2", 0),
    "vector empty": lambda: nearest(Embedding, "Vector", [], "l2", 1),
    "vector value": lambda: Vector([float("inf")]),
    "vector name": lambda: nearest(Embedding, "Vector", [1.0], "l2", 1).distance_as("label"),
    "update key": lambda: UpdateWhere(Order, (Set("OrderKey", 1),)),
    "update twice": lambda: UpdateWhere(Order, (Set("Status", "a"), Set("Status", "b"))),
    "increment text": lambda: UpdateWhere(Order, (Increment("Status", 1),)),
    "increment nothing": lambda: Increment("CustKey", None),
}


@pytest.mark.parametrize("name", BAD)
def test_invalid_queries_fail_before_reading(name):
    with pytest.raises(SparkloomError):
        q = BAD[name]()
        q.validate()
        q.df(NoJob())


MODEL_ERRORS = {
    "dash with options": lambda: Field.tagged("A", "int", "-,pk"),
    "unknown option": lambda: Field.tagged("A", "int", "a,nope"),
    "option twice": lambda: Field.tagged("A", "int", "a,pk,pk"),
    "identifier": lambda: Field("A", "a b"),
    "computed key": lambda: Field("A", pk=True, computed=True),
    "soft delete kind": lambda: Field("A", kind="int", soft_delete=True),
    "column twice": lambda: Model("M", "m", [Field("A", "x"), Field("B", "X")]),
    "two soft deletes": lambda: Model("M", "m", [Field("A", kind="time", soft_delete=True), Field("B", kind="time", soft_delete=True)]),
    "many to many": lambda: many_to_many("X", Order),
    "via": lambda: Model("M", "m", [Field("A", pk=True)], [many_to_many("X", Order, via="Y.Z")]).resolve("X"),
}


@pytest.mark.parametrize("name", MODEL_ERRORS)
def test_invalid_models(name):
    with pytest.raises(ModelError):
        MODEL_ERRORS[name]()


def test_model_inference_and_tags():
    assert [snake_case(x) for x in ("UserID", "HTTPServer", "CreatedAt", "ID")] == ["user_id", "http_server", "created_at", "id"]
    user = Model("User", "users", [Field("ID", pk=True)], [has_many("Posts", lambda: post)])
    post = Model("Post", "posts", [Field("ID", pk=True), Field("UserID")], [belongs_to("User", user)])
    assert user.resolve("Posts").direct == (("id", "user_id"),) and post.resolve("User").direct == (("user_id", "id"),)
    f = Field.tagged("Mail", "string", "email,unique=a,unique=b")
    assert (f.column, f.unique) == ("email", ("a", "b")) and Field.tagged("X", "int", "-") is None
    assert Order.schema["o_orderkey"].metadata == {"pk": True}


def test_terminals(tables):
    assert O.where(Equal("OrderKey", 5)).only(tables).OrderKey == 5
    assert O.order_by(Desc("OrderKey")).first(tables).OrderKey == max(r.OrderKey for r in O.select("OrderKey").all(tables))
    with pytest.raises(NoRows):
        O.where(LessThan("OrderKey", -1)).first(tables)
    with pytest.raises(NoRows):
        O.where(LessThan("OrderKey", -1)).only(tables)
    with pytest.raises(MultipleRows):
        O.only(tables)
    assert O.exists(tables) and not O.limit(0).exists(tables)
    assert O.select("OrderKey").order_by(Asc("OrderKey")).limit(3).scan_all(tables) == sorted(O.select("OrderKey").scan_all(tables))[:3]

    @dataclass
    class Small:
        OrderKey: int
        Status: str

    assert isinstance(O.select("OrderKey", "Status").limit(1).scan_all(tables, Small)[0], Small)
    for q, into in ((O, Small), (O, None), (O.select("OrderKey").preload("Lines"), None)):
        with pytest.raises(BuildError):
            q.scan_all(tables, into)
    text, shape = O.where(Equal("Status", "F")).build(tables)
    assert "o_orderstatus" in text and shape["where"] == [["=", "Status"]]


@pytest.mark.parametrize("name", ["flagship", "has_via", "preload_via_order", "topn_rewritten", "count_if_has", "seek_null", "upsert", "vector_cosine"])
def test_registered_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_rewrite_reasons(tables):
    top = lambda p, *more: O.where(p, *more).order_by(Desc("OrderKey")).limit(5)
    pair = Has("SupplierLinks", Equal("SuppKey", 7))
    assert top_n_reason(O) is None and top_n_reason(top(pair)) == ""
    assert top_n_reason(top(pair, Equal("Status", "F"))) == "another_root_predicate"
    assert top_n_reason(top(pair, pair)) == "multiple_collections"
    assert top_n_reason(top(Not(pair))) == "nested_in_logical_group"
    assert top_n_reason(top(pair).seek_after(7)) == "seek_after"
    assert top_n_reason(top(pair).force_index("i")) is None
    assert top_n_reason(O.where(pair).order_by(Asc("Status")).limit(5)) == "order_not_source_key"
    assert top_n_reason(top(Has("Lines", Equal("SuppKey", 8)))) == "uniqueness_unproven"
    assert top_n_reason(Query(Part).where(Has("Suppliers", Equal("SuppKey", 7))).order_by(Asc("PartKey")).limit(5)) == "edge_pair_not_unique"
    assert count_reason(O.where(pair)) == "" and count_reason(O.where(Has("Suppliers", GreaterThan("AcctBal", 1.0)))) == "target_needed"
    plan = top(pair).df(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftSemi" in top(pair).without_rewrites().df(tables)._jdf.queryExecution().optimizedPlan().toString()
    for q in (top(pair), top(Has("Lines", Equal("SuppKey", 8)))):
        assert q.all(tables) == q.without_rewrites().all(tables)


def test_pushdown_and_pruning(tables):
    plan = O.select("OrderKey").where(GreaterThan("TotalPrice", 1000.0)).df(tables)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_mutations(spark, tables):
    orders = tables.table("orders")
    row = {"OrderKey": 5, "CustKey": 1, "Status": "N", "TotalPrice": 1.5, "OrderDate": datetime(2001, 2, 3), "Priority": None}
    with pytest.raises(DuplicateKey):
        Insert(Order, (row,)).apply(orders)
    with pytest.raises(DuplicateKey):
        UpdateMany(Order, ({"OrderKey": 1}, {"OrderKey": 1}), ("Status",)).apply(orders)
    with pytest.raises(BuildError):
        UpdateWhere(Order, (Set("Status", "x"),)).apply(orders)
    with pytest.raises(BuildError):
        DeleteWhere(Order, (Has("Lines"),)).apply(orders)
    assert UpdateMany(Order, ({"OrderKey": 5, "Status": "Q"}, {"OrderKey": -9, "Status": "Q"}), ("Status",)).affected(orders) == 1
    assert UpdateWhere(SoftOrder, (Set("Status", "x"),)).where(Equal("Status", "P")).affected(tables.table("soft_orders")) == 0
    auto = Model("Auto", "auto", [Field("ID", pk=True, auto_random=True), Field("Name", kind="string", unique=("n",))])
    state = Insert(auto, ({"Name": "a"}, {"ID": 9, "Name": "b"})).apply(spark.createDataFrame([(3, "x")], "id long, name string"))
    assert sorted(map(tuple, state.collect())) == [(3, "x"), (9, "b"), (10, "a")]
    merged = Upsert(auto, ({"ID": 50, "Name": "x"}, {"ID": 3, "Name": "z"}, {"ID": 60, "Name": "new"})).apply(spark.createDataFrame([(3, "y"), (4, "x")], "id long, name string"))
    assert sorted(map(tuple, merged.collect())) == [(3, "z"), (4, "x"), (60, "new")]
    repeated = Upsert(auto, ({"ID": 1, "Name": "a"}, {"ID": 9, "Name": "b"}, {"ID": 1, "Name": "c"}, {"ID": 9, "Name": "d"}, {"ID": 8, "Name": "d"})).apply(spark.createDataFrame([(1, "x")], "id long, name string"))
    assert sorted(map(tuple, repeated.collect())) == [(1, "c"), (9, "d")]
    with pytest.raises(DuplicateKey):
        Upsert(auto, ()).merge(spark.createDataFrame([(1, "x")], "id long, name string"), spark.createDataFrame([(2, "b"), (3, "b")], "id long, name string"))
    links = Links(Model("M", "m", [Field("ID", pk=True)], [many_to_many("Rs", Model("R", "r", [Field("ID", pk=True)]), Junction("mr", ("m_id",), ("r_id",)))]), "Rs")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "m_id long, r_id long")
    with pytest.raises(DuplicateKey):
        links.add(pairs, 1, [2, 3])
    assert links.add(pairs, 1, [2, 3], ignore_existing=True).count() == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_look_up_the_given_pairs_without_moving_the_junction(spark):
    links = Links(Model("M", "m", [Field("ID", pk=True)], [many_to_many("Rs", Model("R", "r", [Field("ID", pk=True)]), Junction("mr", ("m_id",), ("r_id",)))]), "Rs")
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (2, 3), (None, 2)], "m_id int, r_id int")
    for state, expected in (
        (links.add(df, 1, [1, 2, 2], ignore_existing=True), [(None, 2), (1, None), (1, 1), (1, 1), (1, 2), (2, 3)]),
        (links.add(df, 2, [4], ignore_existing=False), [(None, 2), (1, None), (1, 1), (1, 1), (2, 3), (2, 4)]),
        (links.remove(df, 1, [1, 2]), [(None, 2), (1, None), (2, 3)]),
    ):
        assert sorted((tuple(r) for r in state.collect()), key=str) == sorted(expected, key=str)
        assert "SortMergeJoin" not in _plan(state) and "ShuffledHashJoin" not in _plan(state)
    with pytest.raises(DuplicateKey):
        links.add(df, 2, [3])


def test_a_task_takes_as_many_junction_rows_whatever_the_size(spark, tables, monkeypatch):
    parts = lambda: tables.table("order_supplier").rdd.getNumPartitions()
    few = parts()
    monkeypatch.setattr("sparkloom.sources.tables.SHARE_BYTES", 2000)
    assert few == spark.sparkContext.defaultParallelism and parts() >= 20
    assert tables.table("order_supplier").count() == tables.table("lineitem").select("l_orderkey", "l_suppkey").distinct().count()
    assert shares(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) is None


@pytest.mark.parametrize("name", ["composite_key_add", "composite_key_clear"])
@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_a_task_takes_as_many_trips_whatever_the_size(spark, data, monkeypatch, name, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        expected = sorted(QUERIES[name](spark, data).collect())
        monkeypatch.setattr("sparkloom.sources.tables.SHARE_BYTES", 2000)
        df = QUERIES[name](spark, data)
        assert sorted(df.collect()) == expected
        assert "ENSURE_REQUIREMENTS" not in _plan(df)
        assert df.rdd.getNumPartitions() >= 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_store_and_transaction(spark, tmp_path):
    m = Model("M", "m", [Field("ID", pk=True), Field("N", nullable=True)])
    store = VersionedStore(spark, str(tmp_path))
    store.put("m", spark.createDataFrame([(1, 1), (2, None)], "id long, n long"))
    assert store.exec(UpdateWhere(m, (Increment("N", 5),)).where(Equal("ID", 1))) == 1

    def fails(t):
        t.exec(Delete(m, {"ID": 1}))
        assert t.table("m").count() == 1
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.transaction(fails)
    assert sorted(map(tuple, store.table("m").collect())) == [(1, 6), (2, None)]
    store.transaction(lambda t: (t.exec(Delete(m, {"ID": 1})), t.exec(Insert(m, ({"ID": 7, "N": 0},)))))
    assert sorted(map(tuple, store.table("m").collect())) == [(2, None), (7, 0)]


def test_concurrent_writers(spark, tmp_path):
    m = Model("M", "m", [Field("ID", pk=True), Field("N", nullable=True)])
    store = VersionedStore(spark, str(tmp_path))
    store.transaction(lambda t: (t.put("m", spark.createDataFrame([(1, 1)], "id long, n long")), t.put("other", spark.range(3))))
    assert store.commit_number() == 1 and store.table("other").count() == 3

    def overtaken(name):
        def work(t):
            t.exec(UpdateWhere(m, (Increment("N", 5),)).where(Equal("ID", 1)))
            store.put(name, store.table(name).union(store.table(name)))

        return work

    store.transaction(overtaken("other"))  # another table: both writers' work stays
    assert store.table("m").collect()[0].n == 6 and store.table("other").count() == 6
    with pytest.raises(Conflict):
        store.transaction(overtaken("m"))
    assert sorted(map(tuple, store.table("m").collect())) == [(1, 6), (1, 6)] and store.commit_number() == 4


def test_to_one_relations_need_a_unique_target():
    line = Model("Loose", "lineitem", [Field("OrderKey", "l_orderkey")])
    order = Model("Order", "orders", [Field("OrderKey", "o_orderkey", pk=True)], [belongs_to("Line", line, ("OrderKey",), ("OrderKey",))])
    with pytest.raises(BuildError):
        Query(order).preload("Line").validate()


def test_policies_that_cannot_apply_are_errors(spark, tables, data):
    assert O.read_from("row").count(tables) == O.count(tables) and O.read_from("columnar").df(tables).limit(1).count() == 1
    for s in (TableSource(spark), TableSource(spark, data, {"orders": tables.table("orders")})):
        with pytest.raises(BuildError):
            O.read_from("row").df(s)


def test_stream_upsert(spark, tmp_path):
    from sparkloom.streaming.upsert import upsert_stream

    m = Model("M", "m", [Field("ID", pk=True), Field("N")])
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.put("m", spark.createDataFrame([(1, 1), (2, 2)], "id long, n long"))
    spark.createDataFrame([(2, 5), (2, 9), (3, 3)], "id long, n long").write.parquet(str(tmp_path / "in"))
    upsert_stream(spark.readStream.schema("id long, n long").parquet(str(tmp_path / "in")), m, store, str(tmp_path / "cp"), "N").awaitTermination()
    assert sorted(map(tuple, store.table("m").collect())) == [(1, 1), (2, 9), (3, 3)]


def test_shapes_have_no_values(tables):
    a, b = (query_shape(O.where(Equal("Status", s)).limit(n)) for s, n in (("secret", 1), ("other", 2)))
    assert fingerprint(a) == fingerprint(b) and fingerprint(a).startswith("q1:") and "secret" not in json.dumps(a)
    assert fingerprint(query_shape(O)) != fingerprint(a)
    hidden = {"mysql://u:hunter2@h/db": "mysql://u:[REDACTED]@h/db", "db_pwd = x; a=1": "db_pwd = [REDACTED]; a=1", '{"private-key": "a\\"b"}': '{"private-key": "[REDACTED]"}', "dsn='q r' accessKey:z": "dsn='[REDACTED]' accessKey:[REDACTED]", "credential=1&x=2": "credential=[REDACTED]&x=2"}
    assert {redact(k) for k in hidden} == set(hidden.values()) and redact("my topsecretvalue", "topsecretvalue") == "my [REDACTED]"
    prints = {fingerprint(query_shape(q)) for q in (nearest(Embedding, "Vector", [1.0], "l2", 1), nearest(Embedding, "Vector", [1.0], "cosine", 1), nearest(Embedding, "Vector", [1.0], "l2", 1).approximate(), UpdateWhere(Order, (Set("CustKey", 1),)), UpdateWhere(Order, (Increment("CustKey", 1),)))}
    assert len(prints) == 5


def test_capture_and_analysis(spark, tables, tmp_path):
    seen, path = [], str(tmp_path / "c.jsonl")
    with observing(seen.append), C.RuntimeCapture(path, "run").recording():
        for request in range(6):
            with C.scope(str(request)):
                for k in range(2 if request == 0 else 1):
                    O.where(Equal("OrderKey", k)).all(tables)
        with pytest.raises(NoRows):
            O.where(Equal("OrderKey", -1)).first(tables)
    assert len(seen) == 8 and all(e.arguments == () for e in seen)
    capture = C.read_capture(spark, path)
    assert [(r.code, r.scope, r.n) for r in C.analyze(capture).collect()] == [("RUN002", "0", 2)]
    fixed = capture.where("terminal = 'All'").withColumn("cost", F.lit(1.0))
    base = C.cost_baseline(fixed)
    assert [(r.samples, r.bound) for r in base.collect()] == [(7, 1.3)]
    assert C.compare_costs(base, fixed).count() == 0
    assert [r.code for r in C.compare_costs(base, fixed.withColumn("cost", F.lit(1.4))).collect()] == ["RU001"]
    assert [r.code for r in C.compare_costs(base, fixed.limit(2)).collect()] == ["RU002"]
    work = C.workload_baseline(fixed)
    assert {r.code for r in C.compare_workloads(work, fixed.withColumn("cost", F.lit(9.0))).collect()} == {"RU003"}


def test_plans_and_comparison(tables, spark, data):
    estimated = explain(O.where(Equal("Status", "F")).df(tables))
    assert estimated.estimated_bytes and len(estimated.summary()) > 1
    run = explain_analyze(O.where(Equal("Status", "F")).df(tables))
    assert run.result_rows == O.where(Equal("Status", "F")).count(tables)
    assert any(n.rows for n in run.root.walk())
    q = A.Aggregate(Order).select(A.Field("Status"), A.CountAll().As("N")).group_by("Status")
    with pytest.raises(BuildError):
        compare(q, tables)
    found = compare(q.order_by(Asc("Status")), TableSource(spark, data))
    assert found.status in ("auto", "row", "columnar") and all(len(v.seconds) == 5 and v.equal for v in found.variants)


DDL = """
SET NAMES utf8; DROP TABLE IF EXISTS x;
CREATE TABLE `customer` (c_custkey BIGINT NOT NULL AUTO_RANDOM, c_name VARCHAR(25) NOT NULL DEFAULT 'a;b', c_nationkey INT NOT NULL, -- note
  c_acctbal DECIMAL(20,2) NOT NULL, c_mktsegment CHAR(10), extra INT NOT NULL, PRIMARY KEY (c_custkey), UNIQUE KEY seg (c_mktsegment, c_name));
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL, o_orderstatus TEXT NOT NULL, o_totalprice DOUBLE NOT NULL, o_orderdate DATETIME(6) NOT NULL, o_orderpriority TEXT, twice INT GENERATED ALWAYS AS (o_custkey * 2), KEY by_status (o_orderstatus, o_orderkey));
"""


def test_ddl_and_rules():
    catalog = ddl.parse(DDL)
    assert catalog["customer"].primary.columns == ("c_custkey",) and catalog["orders"].columns["twice"].generated
    for bad in ("CREATE TABLE a LIKE b", "CREATE TABLE a AS SELECT 1", "CREATE TABLE a (b INT, b INT)", "CREATE TABLE a (b INT, KEY (c))", "CREATE TABLE a (b INT"):
        with pytest.raises(ddl.DDLError):
            ddl.parse(bad)
    codes = {(d.code, d.subject) for d in checks.check_schema(Customer, catalog)}
    assert {("CMP005", "Customer.Segment"), ("CMP008", "Customer.CustKey"), ("CMP010", "Customer"), ("CMP002", "Customer.Nation")} <= codes
    assert {d.code for d in checks.check_schema(Document, catalog)} == {"CMP002"} and {d.code for d in checks.check_schema(Document, {})} == {"CMP001"}
    dump = "INSERT INTO a VALUES (1, 'x;y'); CREATE UNIQUE INDEX i ON a (b); CREATE TABLE a (b INT NOT NULL, c INT NOT NULL, d INT); CREATE TABLE t (b INT PRIMARY KEY); CREATE TABLE u (b INT, c INT)"
    pair = Model("T", "t", [Field("B", "b", pk=True)], [many_to_many("Us", Model("U", "u", [Field("B", "b", pk=True)]), Junction("a", ("b",), ("d",)))])
    assert {d.code for d in checks.check_schema(pair, ddl.parse(dump))} == {"CMP011", "CMP012", "CMP013", "CMP014"}
    assert [d.code for d in checks.check_query(O.limit(5).offset(2).where(Contains("Status", "x")))] == ["QRY002", "QRY003", "QRY004"]
    assert [d.code for d in checks.check_query(Query(Part).where(Has("Suppliers", Equal("SuppKey", 7))).order_by(Asc("PartKey")).limit(5))] == ["QRY005"]
    served = O.where(Equal("Status", "F")).order_by(Asc("OrderKey")).limit(5)
    assert checks.check_index(O.where(GreaterThan("TotalPrice", 1.0)).order_by(Asc("Status")).limit(5), catalog) == []
    assert [d.code for d in checks.check_index(O.where(Has("SupplierLinks", Equal("SuppKey", 7))).order_by(Asc("OrderKey")).limit(5), catalog)] == ["QRY007"]
    assert checks.check_mutation(UpdateMany(Order, ({"OrderKey": 1},), ("Status",)), catalog) == []
    assert checks.check_index(served, catalog) == [] and [d.code for d in checks.check_index(served.where(Equal("CustKey", 1)), catalog)] == ["QRY006"]
    assert [d.code for d in checks.check_mutation(UpdateWhere(Order, (Set("Priority", "x"),)).where(Equal("CustKey", 1)), catalog)] == ["QRY008"]
    found = checks.check_schema(Customer, catalog)
    left, failed = checks.report(found, [checks.Suppression(d.code, d.subject, "known") for d in found])
    assert not left and not failed and checks.report(found)[1]
    with pytest.raises(SparkloomError):
        checks.report(found, [checks.Suppression("CMP005", "x", " ")])
    assert {d.code for m in MODELS for d in checks.check_model(m)} <= {"MOD001", "MOD005", "MOD101"}


def test_cost_vector_index_and_mutation_events(spark, tables, tmp_path):
    from sparkloom.operators.nearest import build_vector_index
    from sparkloom.plans.cost import collect_cost, collect_warnings

    rows, cost = collect_cost(spark, lambda: O.all(tables))
    assert rows and cost.input_bytes > 0 and cost.executor_seconds > 0 and collect_warnings() == []
    assert build_vector_index(Embedding, "Vector", "l2").column == "embedding"
    with pytest.raises(BuildError):
        build_vector_index(Embedding, "Label", "l2")
    catalog = ddl.parse("CREATE TABLE embeddings (vec_id BIGINT PRIMARY KEY, embedding VECTOR(3), label INT, VECTOR INDEX v (embedding))")
    q = nearest(Embedding, "Vector", [1, 2, 3], "l2", 5)
    assert checks.check_vector(q, catalog) == [] and [d.code for d in checks.check_vector(nearest(Embedding, "Vector", [1], "l2", 5), catalog)] == ["VEC001"]
    assert [d.code for d in checks.check_vector(q.approximate().where(Equal("Label", 1)), catalog)] == ["VEC002"]
    assert q.index_usage() == "not_used" and "limit" not in q.build(tables)[1]
    store, seen = VersionedStore(spark, str(tmp_path)), []
    store.put("orders", tables.table("orders"))
    with observing(seen.append, include_arguments=True):
        store.exec(UpdateWhere(Order, (Set("Status", "x"),)).where(Equal("OrderKey", 5)))
    assert [(e.terminal, e.operation, e.rows, e.arguments) for e in seen] == [("Exec", "UpdateWhere", 1, (5,))]
    assert O.explain(tables).walk() and O.explain_analyze(tables).result_rows == len(rows)


def test_audit(tables):
    child = Model("Order", "orders", Order.fields, [belongs_to("Customer", Model("Few", "few_customers", Customer.fields), ("CustKey",), ("CustKey",))])
    assert [(d.code, d.severity) for d in audit([child], tables)] == [("REF005", "error")]
    assert audit([Order], tables) == []


def test_migrations(spark, tmp_path):
    (tmp_path / "0001_a.up.sql").write_text("CREATE OR REPLACE TEMP VIEW mig_a AS SELECT 'x;y' AS c; -- done; really\n")
    (tmp_path / "0001_a.down.sql").write_text("DROP VIEW mig_a")
    found = migrate.load(tmp_path)
    done = migrate.apply(spark, found, {})
    assert spark.table("mig_a").collect()[0].c == "x;y" and migrate.plan(found, done) == []
    with pytest.raises(SparkloomError):
        migrate.plan(found, {1: "other"})
    (tmp_path / "0002_b.up.sql").write_text("SELECT 1")
    with pytest.raises(SparkloomError):
        migrate.load(tmp_path)


def test_migration_runner(spark, tmp_path):
    files, record = tmp_path / "files", str(tmp_path / "record")
    files.mkdir()
    for v, up in enumerate(("SELECT 1", "CREATE OR REPLACE TEMP VIEW mig_b AS SELECT 2 AS n", "SELECT * FROM mig_nowhere"), 1):
        (files / f"000{v}_m.up.sql").write_text(up)
        (files / f"000{v}_m.down.sql").write_text("DROP VIEW mig_b" if v == 2 else "SELECT 0")
    runner = migrate.Runner(spark, files, record)
    with pytest.raises(SparkloomError):
        runner.baseline(7)
    assert runner.baseline(1) == [1] and runner.up(2) == [2] and spark.table("mig_b").collect()[0].n == 2
    with pytest.raises(SparkloomError):
        runner.baseline(1)
    with pytest.raises(AnalysisException):
        runner.up()
    # another runner sees the mark and doesn't run
    other = migrate.Runner(spark, files, record)
    assert [x[2] for x in other.status()] == ["applied", "applied", "running up"]
    with pytest.raises(SparkloomError):
        other.up()
    other.resolve(3, applied=False)
    with pytest.raises(SparkloomError):
        other.resolve(3, applied=False)
    assert other.down() == [2] and [x[2] for x in runner.status()] == ["applied", "pending", "pending"]
    (files / "0001_m.up.sql").write_text("SELECT 9")
    changed = migrate.Runner(spark, files, record)
    assert changed.status()[0][2] == "changed"
    with pytest.raises(SparkloomError):
        changed.up()
    number = runner.store.commit_number()
    runner._advance(number, {})
    with pytest.raises(Conflict):
        other._advance(number, {})


def test_migration_lint():
    M = migrate.Migration
    found = migrate.lint([M(1, "a", "-- nothing", "SELECT 1"), M(2, "b", "DROP TABLE t; DELETE FROM t; DELETE FROM t WHERE a = 1; ALTER TABLE t DROP COLUMN c", "SELECT 1"), M(4, "c", "SELECT 1", "")])
    assert [(d.code, d.subject) for d in found] == [("MIG101", "1_a"), ("MIG102", "2_b"), ("MIG102", "2_b"), ("MIG102", "2_b"), ("MIG103", "4_c"), ("MIG104", "4_c")]


def test_plan_places(tables):
    q = O.where(Not(Has("Lines", Has("Part", Equal("Size", 3))))).select("OrderKey")
    scans = {(n.model, n.relation) for n in q.explain(tables).walk() if n.table}
    assert scans == {("Order", ""), ("Line", "Lines"), ("Part", "Lines.Part")}
    run = A.Aggregate(Order).select(A.Field("Customer.Segment").As("Segment"), A.CountAll().As("N")).group_by("Segment").explain_analyze(tables)
    assert {(n.model, n.relation) for n in run.root.walk() if n.table} == {("Order", ""), ("Customer", "Customer")}
    # a table that is read at two places: the scan's relation isn't known
    peer = Model("Peer", "customer", Customer.fields, [belongs_to("Other", lambda: peer, ("NationKey",), ("CustKey",))])
    assert {(n.model, n.relation) for n in Query(peer).where(Has("Other")).explain(tables).walk() if n.table} == {("Peer", None)}


def test_vector_index(spark, tmp_path):
    from sparkloom.operators.nearest import build_vector_index, nearest
    from sparkloom.operators.vector_index import MOST_CELLS

    rng = np.random.default_rng(3)
    middles = rng.normal(size=(30, 8)) * 4
    vectors = [(middles[i % 30] + rng.normal(size=8) * 0.5).tolist() for i in range(1200)]
    # a third of the rows are one vector; null, empty, short, partly null and non-finite ones have no cell
    odd = [None, [], [1.0], [None] + [0.0] * 7, [math.nan] * 8, [math.inf] + [0.0] * 7, [0.0] * 8]
    rows = [(i, v, i % 10) for i, v in enumerate([*vectors, *[vectors[0]] * 600, *odd])]
    schema = "vec_id long, embedding array<float>, label int"
    source = TableSource(spark, None, {"embeddings": spark.createDataFrame(rows, schema), "customer": spark.range(1)})
    for metric in ("l2", "cosine"):
        index = build_vector_index(Embedding, "Vector", metric, source, str(tmp_path / metric))
        assert spark.read.parquet(f"{index.folder}/rows").count() == len(rows)
        hit = 0
        for at in (1, 500):
            q = nearest(Embedding, "Vector", vectors[at], metric, 15).where(IsNotNull("Vector"), LessThan("VecID", 1200)).select("VecID")
            exact, near = q.all(source), q.approximate(index).all(source)
            assert q.approximate(index, MOST_CELLS).all(source)[0].Distance == exact[0].Distance
            hit += len({r.VecID for r in exact} & {r.VecID for r in near})
        assert hit >= 0.9 * 2 * 15
        plan = q.approximate(index).df(source)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [vector_cell" in plan and q.approximate(index).index_usage() == "used"
        short = nearest(Embedding, "Vector", [1.0], metric, 5).select("VecID")
        assert sorted(r.Distance for r in short.approximate(index).all(source) if r.Distance is not None) == sorted(r.Distance for r in short.all(source) if r.Distance is not None)
    q = nearest(Embedding, "Vector", vectors[0], "l2", 3)
    assert [d.code for d in q.approximate().diagnostics()] == ["VEC003"] and q.approximate(build_vector_index(Embedding, "Vector", "l2", source, str(tmp_path / "l"))).diagnostics() == []
    for wrong in (index, build_vector_index(Embedding, "Vector", "l2")):
        with pytest.raises(BuildError):
            q.approximate(wrong).validate()
    none = TableSource(spark, None, {"embeddings": spark.createDataFrame([], schema)})
    assert q.approximate(build_vector_index(Embedding, "Vector", "l2", none, str(tmp_path / "none"))).all(none) == []
