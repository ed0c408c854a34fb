"""Registered queries of keyed tables and changelogs, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.operators import changes
from keyflow.operators.keyed import KeySet, KeyedTable, Relation
from keyflow.plans.registry import query
from keyflow.sources.tables import load

ORDERS_OF_CUSTOMER = Relation("orders_of_customer", "c_custkey", "o_custkey")
LINES_OF_ORDER = Relation("lines_of_order", "o_orderkey", "l_orderkey")


def _t(spark: SparkSession, d: str, name: str) -> KeyedTable:
    return load(spark, d, name)


def _orders(spark: SparkSession, d: str) -> KeyedTable:
    return KeyedTable(_t(spark, d, "orders").df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey")


@query("SELECT * FROM customer WHERE c_acctbal > 5000")
def select(spark, d):
    return _t(spark, d, "customer").select(F.col("c_acctbal") > 5000).df


@query("SELECT * FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal < 0")
def select_by(spark, d):
    return _t(spark, d, "customer").select_by((F.col("c_custkey") % 3 == 0) & (F.col("c_acctbal") < 0)).df


@query("SELECT o_orderkey, o_totalprice * 2 AS net, lower(o_orderpriority) AS priority FROM orders")
def map_values(spark, d):
    return _t(spark, d, "orders").map_values(net=F.col("o_totalprice") * 2, priority=F.lower("o_orderpriority")).df


@query("SELECT o_orderkey, round(o_totalprice, 0) AS price FROM orders WHERE o_orderstatus = 'F'")
def filter_map_values(spark, d):
    return _t(spark, d, "orders").filter_map_values(F.col("o_orderstatus") == "F", price=F.round("o_totalprice", 0)).df


@query("SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size > 10 AND p_size * 2 < 60 AND p_partkey % 2 = 0")
def fused_stages(spark, d):
    """Filters and projections one after another; Catalyst makes one stage of them."""
    t = _t(spark, d, "part").select(F.col("p_size") > 10).map_values(twice=F.col("p_size") * 2)
    return t.select(F.col("twice") < 60).select_by(F.col("p_partkey") % 2 == 0).df


@query("SELECT 'C' || CAST(c_custkey AS VARCHAR) AS code, c_nationkey AS nation FROM customer")
def map_entries(spark, d):
    return _t(spark, d, "customer").map_entries({"code": F.concat(F.lit("C"), F.col("c_custkey").cast("string"))}, {"nation": F.col("c_nationkey")}).df


@query("SELECT s_suppkey + 1000000 AS new_key, s_name AS name FROM supplier WHERE s_acctbal > 0")
def filter_map_entries(spark, d):
    return _t(spark, d, "supplier").filter_map_entries(F.col("s_acctbal") > 0, {"new_key": F.col("s_suppkey") + 1000000}, {"name": F.col("s_name")}).df


@query("SELECT item_id, CAST(unnest(range(len(w))) AS INTEGER) AS local_key, unnest(w) AS item FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def flat_map_entries(spark, d):
    return _t(spark, d, "benchmark").flat_map_entries(F.split("text", " ")).df


_LATEST = "(SELECT user_id, arg_max(event_type, event_id) AS last_type, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id)"


@query(f"SELECT o_orderkey, o_custkey FROM orders JOIN {_LATEST} l ON user_id = o_custkey WHERE l.last_type <> 'error'")
def select_cell(spark, d):
    """Orders of customers whose latest event isn't an error."""
    gates = _t(spark, d, "events").df.select(F.col("user_id").alias("o_custkey"), "event_id", (F.col("event_type") != "error").alias("open"))
    return _orders(spark, d).select_cell(gates, "o_custkey", "event_id", "open").df.select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey AS k, round(o_totalprice + l.last_value, 2) AS v FROM orders JOIN {_LATEST} l ON user_id = o_custkey")
def project_cell(spark, d):
    cells = _t(spark, d, "events").df.select(F.col("user_id").alias("o_custkey"), "event_id", "value")
    return _orders(spark, d).project_cell(cells, "o_custkey", "event_id", "value", {"k": F.col("o_orderkey")}, {"v": F.round(F.col("o_totalprice") + F.col("value"), 2)}).df


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def inner_join(spark, d):
    return _t(spark, d, "documents").map_values(lang=F.col("lang")).inner_join(_t(spark, d, "labels")).df


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def inner_join_fk(spark, d):
    return _t(spark, d, "customer").inner_join_fk(_orders(spark, d), ORDERS_OF_CUSTOMER).df.select("c_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT s.s_suppkey, count(*) AS n, CAST(sum(c.c_custkey) AS BIGINT) AS keys FROM supplier s JOIN customer c
ON CASE WHEN s_nationkey > 3 THEN s_nationkey END IS NOT DISTINCT FROM CASE WHEN c_nationkey > 3 THEN c_nationkey END GROUP BY 1""")
def inner_join_by(spark, d):
    """Many to many on computed keys, summed up for each supplier; NULL meets NULL."""
    on = lambda c: F.when(F.col(c) > 3, F.col(c))
    pairs = _t(spark, d, "supplier").inner_join_by(_t(spark, d, "customer"), on("s_nationkey"), on("c_nationkey"))
    return pairs.df.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


_DIGEST = "CAST(count(o_orderkey) AS INTEGER) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders"


def _digest(matches: str = "matches"):
    return F.size(matches).alias("n"), F.array_join(F.transform(matches, lambda x: x["o_orderkey"].cast("string")), ",").alias("orders")


@query(f"SELECT c_custkey, {_DIGEST} FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(spark, d):
    """Customers with their orders nested, in the order of their keys; the flagship query."""
    return _t(spark, d, "customer").left_join_fk(_orders(spark, d), ORDERS_OF_CUSTOMER).df.select("c_custkey", *_digest())


@query("SELECT doc_id, CAST(count(quality) AS INTEGER) AS n, max(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id")
def left_join_key(spark, d):
    df = _t(spark, d, "documents").map_values(lang=F.col("lang")).left_join(_t(spark, d, "labels")).df
    return df.select("doc_id", F.size("matches").alias("n"), F.array_max(F.transform("matches", lambda x: x["quality"])).alias("quality"))


@query(f"SELECT s_suppkey, {_DIGEST.replace('o_orderkey', 'n_nationkey').replace('orders', 'nations')} FROM supplier LEFT JOIN nation ON s_nationkey % 5 IS NOT DISTINCT FROM CASE WHEN n_regionkey < 4 THEN n_regionkey END GROUP BY s_suppkey")
def left_join_by(spark, d):
    left, right = _t(spark, d, "supplier"), _t(spark, d, "nation")
    df = left.left_join_by(right, F.col("s_nationkey") % 5, F.when(F.col("n_regionkey") < 4, F.col("n_regionkey"))).df
    return df.select("s_suppkey", F.size("matches").alias("n"), F.array_join(F.transform("matches", lambda x: x["n_nationkey"].cast("string")), ",").alias("nations"))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def map_joined_values(spark, d):
    """Aggregates of nested rows without making an array."""
    aggregates = {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)}
    df = _t(spark, d, "customer").map_joined_values(_orders(spark, d), F.col("c_custkey"), F.col("o_custkey"), aggregates, {"n": 0, "total": 0.0}).df
    return df.select("c_custkey", "n", "total")


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name, n_name, r_name, coalesce(n_lines, 0) AS n_lines, coalesce(quantity, 0) AS quantity
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
     LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN l ON o_orderkey = l_orderkey
""")
def left_join_chain(spark, d):
    """Four left joins in a row."""
    one = lambda c: F.max(c)
    t = _orders(spark, d).map_joined_values(_t(spark, d, "customer"), F.col("o_custkey"), F.col("c_custkey"), {"c_name": one("c_name"), "c_nationkey": one("c_nationkey")})
    t = t.map_joined_values(_t(spark, d, "nation"), F.col("c_nationkey"), F.col("n_nationkey"), {"n_name": one("n_name"), "n_regionkey": one("n_regionkey")})
    t = t.map_joined_values(_t(spark, d, "region"), F.col("n_regionkey"), F.col("r_regionkey"), {"r_name": one("r_name")})
    lines = KeyedTable(_t(spark, d, "lineitem").df.select("l_orderkey", "l_quantity"), ["l_orderkey"])
    t = t.map_joined_values(lines, F.col("o_orderkey"), F.col("l_orderkey"), {"n_lines": F.count(F.lit(1)), "quantity": F.sum("l_quantity")}, {"n_lines": 0, "quantity": 0.0})
    return t.df.select("o_orderkey", "c_name", "n_name", "r_name", "n_lines", "quantity")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def left_semi_join(spark, d):
    return _t(spark, d, "documents").map_values(lang=F.col("lang")).left_semi_join(_t(spark, d, "labels")).df


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def left_semi_join_fk(spark, d):
    lines = KeyedTable(_t(spark, d, "lineitem").df.filter("l_returnflag = 'R'").select("l_orderkey"), ["l_orderkey"])
    return _orders(spark, d).left_semi_join_fk(lines, LINES_OF_ORDER).df.select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE CASE WHEN c_acctbal > 0 THEN c_nationkey END IS NOT DISTINCT FROM CASE WHEN s_acctbal > 0 THEN s_nationkey END)")
def left_semi_join_by(spark, d):
    left = F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))
    return _t(spark, d, "customer").left_semi_join_by(_t(spark, d, "supplier"), left, F.when(F.col("s_acctbal") > 0, F.col("s_nationkey"))).df.select("c_custkey")


@query("""
WITH k AS (SELECT DISTINCT c_custkey, unnest([c_nationkey, (c_nationkey + 1) % 30, c_nationkey]) AS nation FROM customer WHERE c_acctbal >= 0)
SELECT customer.c_custkey, CAST(count(s_suppkey) AS INTEGER) AS n, coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey), '') AS suppliers
FROM customer LEFT JOIN k ON customer.c_custkey = k.c_custkey LEFT JOIN supplier ON s_nationkey = nation GROUP BY customer.c_custkey
""")
def multi_left_join_by(spark, d):
    """Suppliers of a customer's nation or the next; customers in debt ask for none."""
    nation = F.col("c_nationkey")
    keys = F.when(F.col("c_acctbal") >= 0, F.array(nation, (nation + 1) % 30, nation)).otherwise(F.array().cast("array<int>"))
    made = {"n": F.size, "suppliers": lambda found: F.array_join(F.transform(found, lambda x: x["s_suppkey"].cast("string")), ",")}
    suppliers = _t(spark, d, "supplier").map_values(s_nationkey=F.col("s_nationkey"))
    return _t(spark, d, "customer").multi_left_join_by(suppliers, keys, F.col("s_nationkey"), made=made).df.select("c_custkey", *made)


@query("SELECT c_nationkey AS nation, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS customers FROM customer GROUP BY 1")
def group_by(spark, d):
    df = _t(spark, d, "customer").group_by("nation", F.col("c_nationkey")).df
    return df.select("nation", F.array_join(F.transform("rows", lambda x: x["c_custkey"].cast("string")), ",").alias("customers"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by(spark, d):
    return _t(spark, d, "events").count_by("event_type", F.col("event_type")).df


@query("SELECT o_custkey AS parent_key, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS children FROM orders GROUP BY 1")
def nest(spark, d):
    df = _orders(spark, d).nest(F.col("o_custkey")).grouped()
    return df.select("parent_key", F.array_join(F.transform("children", lambda x: x["o_orderkey"].cast("string")), ",").alias("children"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 1")
def children_of(spark, d):
    return _orders(spark, d).nest(F.col("o_custkey")).children_of(1).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey AS parent_key FROM orders WHERE o_orderkey = 7")
def lookup_parent(spark, d):
    return _orders(spark, d).nest(F.col("o_custkey")).lookup_parent(7)


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def get(spark, d):
    return _t(spark, d, "nation").get(7)


@query("SELECT n_nationkey FROM nation")
def keys(spark, d):
    return _t(spark, d, "nation").keys()


@query("SELECT n_name, n_regionkey FROM nation")
def items(spark, d):
    return _t(spark, d, "nation").items()


@query("SELECT count(*) AS size FROM orders")
def size(spark, d):
    return _t(spark, d, "orders").size()


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) UNION SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'")
def key_set(spark, d):
    """A set with values taken out and put in."""
    e = _t(spark, d, "events").df
    users = KeySet(e.filter("event_type = 'click'"), "user_id").remove(e.filter("event_type = 'error' and value > 90"))
    return users.insert(e.filter("event_type = 'signup'")).df


# changelogs: the old orders, and the same with some gone, some new and some with another price


def _old_new(spark, d):
    o = _orders(spark, d)
    old = o.select(F.col("o_orderkey") % 5 != 0)
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = o.select(F.col("o_orderkey") % 11 != 0).map_values(o_custkey=F.when(F.col("o_orderkey") % 13 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), o_orderstatus=F.col("o_orderstatus"), o_totalprice=price)
    return old, new


_OLD_NEW = """WITH old AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT coalesce(old.o_orderkey, new.o_orderkey) AS o_orderkey, old.o_totalprice AS old_price, new.o_totalprice AS new_price, old.o_custkey AS old_parent, new.o_custkey AS new_parent,
             CASE WHEN old.o_orderkey IS NULL THEN 'insert' WHEN new.o_orderkey IS NULL THEN 'remove' ELSE 'update' END AS op
      FROM old FULL JOIN new ON old.o_orderkey = new.o_orderkey
      WHERE (old.o_orderkey IS NULL OR new.o_orderkey IS NULL OR old.o_totalprice <> new.o_totalprice OR old.o_custkey <> new.o_custkey)) """


@query(_OLD_NEW + "SELECT op, o_orderkey, old_price, new_price FROM d")
def diff(spark, d):
    return changes.diff(*_old_new(spark, d)).select("op", "o_orderkey", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


@query(_OLD_NEW + "SELECT op, count(*) AS n FROM d GROUP BY op")
def replace_all(spark, d):
    return changes.replace_all(*_old_new(spark, d)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(_OLD_NEW + "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM new")
def apply_changes(spark, d):
    """The old table after the changes: the new one."""
    old, new = _old_new(spark, d)
    log = changes.diff(old, new).withColumn("ord", F.lit(1)).select("ord", "op", "o_orderkey", "new")
    noise = old.df.filter("o_orderkey % 3 = 0").select(F.lit(0).alias("ord"), F.lit("remove").alias("op"), "o_orderkey", F.lit(None).alias("new"))
    changed = log.select("o_orderkey")
    return changes.apply_changes(old, log.unionByName(noise.join(changed, "o_orderkey", "left_semi"))).df


@query(_OLD_NEW + "SELECT op, o_orderkey FROM d WHERE op <> 'update'")
def key_changes(spark, d):
    return changes.key_changes(changes.diff(*_old_new(spark, d)), ["o_orderkey"])


@query(_OLD_NEW + """, u AS (SELECT old_parent AS parent, 'remove' AS op, o_orderkey FROM d WHERE op = 'update' AND old_parent <> new_parent
  UNION ALL SELECT new_parent, 'insert', o_orderkey FROM d WHERE op = 'update' AND old_parent <> new_parent
  UNION ALL SELECT coalesce(new_parent, old_parent), op, o_orderkey FROM d WHERE NOT (op = 'update' AND old_parent <> new_parent)) SELECT * FROM u""")
def grouped_changes(spark, d):
    """Changes tagged with the parent; rows that move leave one and come to the other."""
    return changes.grouped_changes(changes.diff(*_old_new(spark, d)), "o_custkey", ["o_orderkey"])


def _event_log(spark, d):
    """Events as a changelog of users: clicks insert or update, errors remove; ten batches."""
    e = _t(spark, d, "events").df.filter("event_type in ('click', 'error')")
    n = F.row_number().over(_by_user())
    before = F.lag("event_type").over(_by_user())
    op = F.when(F.col("event_type") == "click", F.when((n == 1) | (before == "error"), "insert").otherwise("update")).otherwise(F.when(before == "click", "remove"))
    return e.select((F.col("event_id") % 1000 / 100).cast("int").alias("batch_id"), F.col("event_id").alias("ord"), op.alias("op"), "user_id", F.struct("value").alias("new")).filter("op is not null")


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


_LOG = """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type IN ('click', 'error')),
log AS (SELECT CAST(floor(event_id % 1000 / 100) AS INTEGER) AS batch_id, event_id AS ord, user_id, value,
               CASE WHEN event_type = 'click' THEN CASE WHEN before IS NULL OR before = 'error' THEN 'insert' ELSE 'update' END WHEN before = 'click' THEN 'remove' END AS op FROM e)
"""


@query(_LOG + "SELECT batch_id, CAST(sum(step) OVER (ORDER BY batch_id) AS BIGINT) AS size FROM (SELECT batch_id, sum(CASE op WHEN 'insert' THEN 1 WHEN 'remove' THEN -1 ELSE 0 END) AS step FROM log WHERE op IS NOT NULL GROUP BY 1)")
def running_size(spark, d):
    return changes.running_size(_event_log(spark, d))


@query(_LOG + "SELECT user_id, arg_max(op, ord) AS op, arg_max(value, ord) AS value FROM log WHERE op IS NOT NULL GROUP BY 1")
def coalesce_changes(spark, d):
    return changes.coalesce(_event_log(spark, d), ["user_id"]).select("user_id", "op", "new.value")


@query(_LOG + "SELECT batch_id, ord, value FROM log WHERE op IS NOT NULL AND user_id = 5")
def watch_key(spark, d):
    return changes.watch_key(_event_log(spark, d), F.col("user_id") == 5, "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 9 <> 0")
def upsert_remove(spark, d):
    t = KeyedTable(_t(spark, d, "customer").df.select("c_custkey", "c_acctbal"), "c_custkey")
    t = changes.upsert(t, t.df.filter("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(0.0)))
    return changes.remove(t, t.df.filter("c_custkey % 9 = 0")).df


@query("SELECT o_orderkey, o_custkey, o_totalprice, total FROM orders JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON k = o_custkey WHERE o_totalprice > 100000")
def share(spark, d):
    """One relation read twice in a plan: its scan and exchange are used again."""
    o = _orders(spark, d)
    t = o.select(F.col("o_totalprice") > 100000).map_joined_values(o, F.col("o_custkey"), F.col("o_custkey"), {"total": F.round(F.sum("o_totalprice"), 2)})
    return t.df.select("o_orderkey", "o_custkey", "o_totalprice", "total")
