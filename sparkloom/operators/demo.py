"""Models over the driver's tables."""

from __future__ import annotations

from pyspark.sql import types as T

from .model import Field, Junction, Model, belongs_to, has_many, has_one, many_to_many

INT = T.IntegerType()

Region = Model("Region", "region", [Field("RegionKey", "r_regionkey", type=INT, pk=True), Field("Name", "r_name", "string")], [has_many("Nations", lambda: Nation, ("RegionKey",), ("RegionKey",))])
Nation = Model(
    "Nation",
    "nation",
    [Field("NationKey", "n_nationkey", type=INT, pk=True), Field("Name", "n_name", "string"), Field("RegionKey", "n_regionkey", type=INT)],
    [belongs_to("Region", lambda: Region, ("RegionKey",), ("RegionKey",)), has_many("Customers", lambda: Customer, ("NationKey",), ("NationKey",)), has_many("Suppliers", lambda: Supplier, ("NationKey",), ("NationKey",))],
)
Customer = Model(
    "Customer",
    "customer",
    [Field("CustKey", "c_custkey", pk=True), Field("Name", "c_name", "string"), Field("NationKey", "c_nationkey", type=INT), Field("AcctBal", "c_acctbal", "float"), Field("Segment", "c_mktsegment", "string")],
    [belongs_to("Nation", lambda: Nation, ("NationKey",), ("NationKey",)), has_many("Orders", lambda: Order, ("CustKey",), ("CustKey",)), has_many("Events", lambda: Event, ("CustKey",), ("UserID",))],
)
Supplier = Model(
    "Supplier",
    "supplier",
    [Field("SuppKey", "s_suppkey", pk=True), Field("Name", "s_name", "string"), Field("NationKey", "s_nationkey", type=INT), Field("AcctBal", "s_acctbal", "float")],
    [belongs_to("Nation", lambda: Nation, ("NationKey",), ("NationKey",)), has_many("Lines", lambda: Line, ("SuppKey",), ("SuppKey",))],
)
Part = Model(
    "Part",
    "part",
    [Field("PartKey", "p_partkey", pk=True), Field("Name", "p_name", "string"), Field("Brand", "p_brand", "string"), Field("Type", "p_type", "string"), Field("Size", "p_size", type=INT), Field("RetailPrice", "p_retailprice", "float")],
    [has_many("Lines", lambda: Line, ("PartKey",), ("PartKey",)), many_to_many("Suppliers", lambda: Supplier, via="Lines.Supplier")],
)
ORDER_FIELDS = [
    Field("OrderKey", "o_orderkey", pk=True),
    Field("CustKey", "o_custkey"),
    Field("Status", "o_orderstatus", "string"),
    Field("TotalPrice", "o_totalprice", "float"),
    Field("OrderDate", "o_orderdate", "time"),
    Field("Priority", "o_orderpriority", "string", nullable=True),
]
Order = Model(
    "Order",
    "orders",
    ORDER_FIELDS,
    [
        belongs_to("Customer", lambda: Customer, ("CustKey",), ("CustKey",)),
        has_many("Lines", lambda: Line, ("OrderKey",), ("OrderKey",)),
        has_many("SupplierLinks", lambda: OrderSupplier, ("OrderKey",), ("OrderKey",)),
        many_to_many("Suppliers", lambda: Supplier, Junction("order_supplier", ("l_orderkey",), ("l_suppkey",))),
    ],
)
#: (orderkey, linenumber) isn't unique in the tables, so lines have no primary key.
Line = Model(
    "Line",
    "lineitem",
    [
        Field("OrderKey", "l_orderkey", unique=("line",)),
        Field("PartKey", "l_partkey", unique=("line",)),
        Field("SuppKey", "l_suppkey", unique=("line",)),
        Field("LineNumber", "l_linenumber", type=INT, unique=("line",)),
        Field("Quantity", "l_quantity", "float"),
        Field("ExtendedPrice", "l_extendedprice", "float"),
        Field("Discount", "l_discount", "float"),
        Field("Tax", "l_tax", "float"),
        Field("ReturnFlag", "l_returnflag", "string"),
        Field("LineStatus", "l_linestatus", "string"),
        Field("ShipDate", "l_shipdate", "time"),
    ],
    [belongs_to("Order", lambda: Order, ("OrderKey",), ("OrderKey",)), belongs_to("Part", lambda: Part, ("PartKey",), ("PartKey",)), belongs_to("Supplier", lambda: Supplier, ("SuppKey",), ("SuppKey",))],
)
#: Distinct pairs of lineitem: a payload edge whose pair is unique.
OrderSupplier = Model("OrderSupplier", "order_supplier", [Field("OrderKey", "l_orderkey", unique=("pair",)), Field("SuppKey", "l_suppkey", unique=("pair",))], [belongs_to("Supplier", lambda: Supplier, ("SuppKey",), ("SuppKey",))])
#: orders of which those with status P count as deleted.
SoftOrder = Model("SoftOrder", "soft_orders", [*ORDER_FIELDS, Field("DeletedAt", "deleted_at", "time", soft_delete=True)], [belongs_to("Customer", lambda: SoftCustomer, ("CustKey",), ("CustKey",))])
SoftCustomer = Model("SoftCustomer", "customer", Customer.fields, [has_many("Orders", lambda: SoftOrder, ("CustKey",), ("CustKey",))])
Event = Model(
    "Event",
    "events",
    [Field("EventID", "event_id", pk=True), Field("At", "ts", "time"), Field("UserID", "user_id"), Field("Type", "event_type", "string"), Field("Value", "value", "float"), Field("Props", "props", "string")],
    [belongs_to("Customer", lambda: Customer, ("UserID",), ("CustKey",))],
)
Document = Model("Document", "documents", [Field("DocID", "doc_id", pk=True), Field("Text", "text", "string"), Field("Lang", "lang", "string"), Field("Source", "source", "string"), Field("Chars", "n_chars")], [has_one("Label", lambda: Label, ("DocID",), ("DocID",))])
Label = Model("Label", "labels", [Field("DocID", "doc_id", pk=True), Field("Quality", "quality", type=INT), Field("Toxic", "toxic", type=INT)], [belongs_to("Document", lambda: Document, ("DocID",), ("DocID",))])
Embedding = Model("Embedding", "embeddings", [Field("VecID", "vec_id", pk=True), Field("Vector", "embedding", "vector"), Field("Label", "label", type=INT)])
MODELS = (Region, Nation, Customer, Supplier, Part, Order, Line, OrderSupplier, Event, Document, Label, Embedding)
