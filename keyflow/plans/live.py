"""Registered queries of live views."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyflow.functions.files import new_folder
from keyflow.operators import changes
from keyflow.operators.keyed import KeyedTable
from keyflow.plans.registry import query
from keyflow.sources.tables import live_files, load
from keyflow.streaming.views import LiveView


def totals(roots: dict[str, KeyedTable]) -> KeyedTable:
    """Customers with the number and sum of their orders."""
    aggregates = {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)}
    return roots["customer"].map_joined_values(roots["orders"], F.col("c_custkey"), F.col("o_custkey"), aggregates, {"n": 0, "total": 0.0})


def customer_view(spark, d, at: str) -> tuple[LiveView, KeyedTable]:
    """A view of customers and every order whose key isn't divisible by 4; and all orders."""
    customer = KeyedTable(load(spark, d, "customer").df.select("c_custkey", "c_nationkey"), "c_custkey")
    orders = KeyedTable(load(spark, d, "orders").df.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")
    roots = {"customer": customer, "orders": orders.select(F.col("o_orderkey") % 4 != 0)}
    return LiveView(spark, at, roots, totals, {"customer": "c_custkey", "orders": "o_custkey"}, "c_custkey"), orders


def order_changes(orders: KeyedTable):
    """Two batches of changes: orders that come (first with no price), and orders, some of these too, that move to another customer and go."""
    new = F.struct("o_custkey", "o_totalprice")
    free = F.struct("o_custkey", F.lit(0.0).alias("o_totalprice"))
    moved = F.struct((F.col("o_custkey") % 100 + 1).alias("o_custkey"), "o_totalprice")
    kind = orders.df.select(new.alias("x")).schema["x"].dataType

    def change(condition: str, op: str, row, place: int):
        ord_ = (F.col("o_orderkey") * 2 + place).alias("ord")
        return orders.df.filter(condition).select(F.lit(op).alias("op"), "o_orderkey", row.cast(kind).alias("new"), ord_)

    came = "o_orderkey % 4 = 0"
    first = change(came, "insert", free, 0).unionByName(change(came, "update", new, 1))
    second = change("o_orderkey % 10 = 3 or o_orderkey % 8 = 0", "update", moved, 0)
    return first, second.unionByName(change("o_orderkey % 10 = 7 or o_orderkey % 12 = 0", "remove", F.lit(None), 1))


_AFTER = """WITH o AS (SELECT CASE WHEN o_orderkey % 10 = 3 OR o_orderkey % 8 = 0 THEN o_custkey % 100 + 1 ELSE o_custkey END AS k, o_totalprice FROM orders WHERE o_orderkey % 10 <> 7 AND o_orderkey % 12 <> 0)
SELECT c_custkey, c_nationkey, count(k) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN o ON k = c_custkey GROUP BY ALL"""


def write_logs(spark, orders: KeyedTable, at: str):
    """The batches as files, one after the other; gives their schema."""
    for i, log in enumerate(order_changes(orders)):
        log.coalesce(1).write.parquet(f"{at}/log/{i}")
    return spark.read.parquet(f"{at}/log/0").schema


@query(_AFTER)
def live_view(spark, d):
    """A view kept up to date by a stream of two micro-batches: the same as the definition over all that was changed."""
    at = new_folder(spark, "live")
    view, orders = customer_view(spark, d, f"{at}/view")
    schema = write_logs(spark, orders, at)
    view.follow({"orders": live_files(spark, f"{at}/log/*", schema)}, f"{at}/checkpoint").awaitTermination()
    return view.output.df


@query(_AFTER)
def live_view_restart(spark, d):
    """The same, the view being closed after its first batch and opened again from its folder."""
    at = new_folder(spark, "live")
    view, orders = customer_view(spark, d, f"{at}/view")
    first, second = order_changes(orders)
    view.apply(0, {"orders": first})
    again, _ = customer_view(spark, d, f"{at}/view")
    again.apply(again.version + 1, {"orders": second})
    return again.output.df


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 5 <> 0),
o AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0)
SELECT c_custkey, c_nationkey, count(o_custkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM c LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL""")
def live_view_roots(spark, d):
    """One stream with the changes of two roots."""
    at = new_folder(spark, "live")
    view, orders = customer_view(spark, d, f"{at}/view")
    entry = lambda *c: F.to_json(F.struct(*c)).alias("entry")
    came = orders.df.filter("o_orderkey % 8 = 0").select(F.lit("orders").alias("root"), F.lit(0).alias("ord"), F.lit("insert").alias("op"), entry("o_orderkey", "o_custkey", "o_totalprice"))
    customers = load(spark, d, "customer").df
    moved = customers.filter("c_custkey % 3 = 0").select(F.lit("customer").alias("root"), F.lit(0).alias("ord"), F.lit("update").alias("op"), entry("c_custkey", F.lit(7).alias("c_nationkey")))
    gone = customers.filter("c_custkey % 5 = 0").select(F.lit("customer").alias("root"), F.lit(1).alias("ord"), F.lit("remove").alias("op"), entry("c_custkey"))
    came.unionByName(moved).unionByName(gone).coalesce(1).write.parquet(f"{at}/log")
    log = spark.readStream.schema("root string, ord int, op string, entry string").parquet(f"{at}/log")
    view.follow(log, f"{at}/checkpoint").awaitTermination()
    return view.output.df


@query("""SELECT CASE WHEN s.s_suppkey IS NULL THEN 'insert' WHEN n.s_suppkey IS NULL THEN 'remove' ELSE 'update' END AS op, coalesce(s.s_suppkey, n.s_suppkey) AS s_suppkey, n.s_nationkey AS new_nation
FROM (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) s FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 99 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) n USING (s_suppkey)
WHERE s.s_nationkey IS DISTINCT FROM n.s_nationkey""")
def changes_reset(spark, d):
    """What a log with a reset in its middle changes: what is before the reset doesn't count, and what it doesn't name goes."""
    suppliers = load(spark, d, "supplier").df.select("s_suppkey", "s_nationkey")
    state = KeyedTable(suppliers.filter("s_suppkey % 2 = 0"), "s_suppkey")
    row = F.struct("s_nationkey").alias("new")
    before = suppliers.select(F.lit(0).alias("ord"), F.lit("insert").alias("op"), "s_suppkey", row)
    reset = suppliers.filter("s_suppkey % 3 = 0").select(F.lit(1).alias("ord"), F.lit("initial").alias("op"), "s_suppkey", row)
    after = suppliers.filter("s_suppkey % 6 = 0").select(F.lit(2).alias("ord"), F.lit("update").alias("op"), "s_suppkey", F.struct(F.lit(99).alias("s_nationkey")).alias("new"))
    made = changes.effective(state, before.unionByName(reset).unionByName(after), resets=True)
    return made.select("op", "s_suppkey", F.col("new.s_nationkey").alias("new_nation"))


@query("SELECT range AS seq, CASE WHEN range < 6 THEN 'value' ELSE 'complete' END AS signal, CASE WHEN range < 2 THEN range WHEN range < 6 THEN range + 2 END AS value FROM range(7)")
def bounded_input(spark, d):
    """A source fed through a buffer of four that drops its oldest values: of 0 to 7, 2 and 3 don't fit."""
    from keyflow.sources.inputs import BoundedInput, Source

    source = Source(spark, new_folder(spark, "source"), "long")
    buffer = BoundedInput(source, 4, "drop_oldest")
    for i in range(8):
        buffer.push(i)
        if i == 1:
            buffer.flush()
    buffer.close()
    source.emit(99)
    return source.events()
