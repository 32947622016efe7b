"""Configurations of the tables the registered queries run on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.config import Code, Flag, Joined, Name, TableConfig, Template


def base64_of(c: Column) -> Column:
    """Base64 of a text on one line."""
    return F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))


CUSTOMER = TableConfig("shop", "customer", ("c_name", "c_mktsegment"), ("c_nationkey", "c_acctbal", "c_mktsegment"),
                       "c_custkey", "Customer")
SUPPLIER = TableConfig("shop", "supplier", ("s_name",), ("s_nationkey", "s_acctbal"), "s_suppkey", "Supplier")
PART = TableConfig("shop", "part", ("p_name", "p_brand", "p_type"), ("p_size", "p_retailprice", "p_brand"),
                   "p_partkey", "Part")
ORDERS = TableConfig("shop", "orders", ("o_orderstatus", "o_orderpriority"),
                     ("o_custkey", "o_totalprice", "o_orderstatus"), "o_orderkey", "Order",
                     date_column="o_orderdate")
LINEITEM = TableConfig("shop", "lineitem", ("l_returnflag", "l_linestatus", "l_shipdate"),
                       ("l_orderkey", "l_quantity"), None, "Line Item", date_column="l_shipdate")
NATION = TableConfig("shop", "nation", ("n_name",), ("n_regionkey",), "n_nationkey", "Nation")
DOCUMENTS = TableConfig("corpus", "documents", ("text",), ("lang", "source", "n_chars"), "doc_id", "Document")
CONVERSATIONS = TableConfig("corpus", "conversations", ("role", "text"), ("conv_id", "turn", "role"), None,
                            "Conversation")
BENCHMARK = TableConfig("corpus", "benchmark", ("text",), (), "item_id", "Question")
PAGES = TableConfig("corpus", "pages", ("url",), ("url",), "page_id", "Page", file_columns=(("url", ""),))
EVENTS = TableConfig("corpus", "events", ("event_type", "props"), ("user_id", "value", "event_type"), "event_id",
                     "Event", date_column="ts")
MISSING = TableConfig("shop", "invoices", ("i_note",), (), "i_id", "Invoice")

FAN_IN = (CUSTOMER, SUPPLIER, PART, ORDERS, DOCUMENTS, CONVERSATIONS)

# One template per feature: fields, joined groups, flags, codes, names, ranges,
# percent signs and parentheses.
TEMPLATES = {
    "customer": Template(
        "Customer Record\nName: {c_name} | Segment: {c_mktsegment}\nAbroad: {abroad} | Balance: {c_acctbal}",
        {"abroad": Flag("c_nationkey")}),
    "supplier": Template("Supplier Record\nIssued By: {s_name} ({s_nationkey})\nBalance: {s_acctbal}"),
    "part": Template(
        "Part Master\nPart: {p_name}\nTraits: {traits}",
        {"traits": Joined(("p_brand", "p_type", "p_size", "p_retailprice"), " | ")}),
    "orders": Template(
        "Order\nStatus: {status} | Priority: {o_orderpriority}\nPlaced: {o_orderdate} | Total: {o_totalprice}",
        {"status": Code("o_orderstatus", {"F": "Filled", "O": "Open"}, "Pending")}),
    "lineitem": Template(
        "Order Line\nLine: {l_linenumber} ({l_quantity} - {l_extendedprice})\n"
        "Discount: {l_discount}% | Flags: {flags}",
        {"flags": Joined(("l_returnflag", "l_linestatus"), ", ")}),
    "nation": Template("Nation\n{names}", {"names": Joined(("n_name", "n_regionkey"), ", ")}),
    "person": Template("Person\nName: {name} | No: {c_custkey}",
                       {"name": Name(("c_name", "middle_name", "c_mktsegment"))}),
}
