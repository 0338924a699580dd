"""Two tables compared by amount, key and category."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import constant_rows
from tallyloom.operators import history, keys, reconcile
from tallyloom.plans.registry import query, sql_grouped, sql_money, table
from tallyloom.sources.readers import union_all


def _orders_lineitem(spark, sf):
    return table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_totalprice", "l_extendedprice"


_SETS = "keys AS (SELECT DISTINCT round(l_extendedprice, 2) AS k FROM lineitem)"


@query("compare_tables", f"""
WITH {_SETS},
a AS (SELECT count(*) AS count_a, round(sum(o_totalprice), 2) AS total_a FROM orders),
b AS (SELECT count(*) AS count_b, round(sum(l_extendedprice), 2) AS total_b FROM lineitem),
m AS (SELECT count(*) AS common_count, round(coalesce(sum(o_totalprice), 0), 2) AS common_amount
      FROM orders WHERE round(o_totalprice, 2) IN (SELECT k FROM keys)),
x AS (SELECT count(*) AS missing_count, round(coalesce(sum(o_totalprice), 0), 2) AS missing_amount
      FROM orders WHERE round(o_totalprice, 2) NOT IN (SELECT k FROM keys)),
r AS (SELECT *, abs(count_a - count_b) AS count_difference, round(abs(total_a - total_b), 2) AS amount_difference
      FROM a, b, m, x)
SELECT *,
  'Direct comparison results:' || chr(10)
  || '• orders: ' || {sql_grouped('count_a')} || ' transactions, ' || {sql_money('total_a')} || chr(10)
  || '• lineitem: ' || {sql_grouped('count_b')} || ' transactions, ' || {sql_money('total_b')} || chr(10)
  || '• Difference: ' || {sql_grouped('count_difference')} || ' transactions, ' || {sql_money('amount_difference')} || chr(10)
  || '• Common transactions: ' || common_count || ' found'
  || CASE WHEN missing_count > 0 THEN chr(10) || '• Missing from lineitem: ' || missing_count || ' transactions, '
     || {sql_money('missing_amount')} ELSE '' END AS answer
FROM r""")
def compare_tables(spark, sf):
    a, b, amount_a, amount_b = _orders_lineitem(spark, sf)
    return reconcile.compare_tables(a, b, amount_a, amount_b, "orders", "lineitem")


@query("match_by_amount", f"""
WITH {_SETS}
SELECT count(*) AS common_count, round(coalesce(sum(o_totalprice), 0), 2) AS common_amount
FROM orders WHERE round(o_totalprice, 2) IN (SELECT k FROM keys)""")
def match_by_amount(spark, sf):
    return reconcile.match_by_amount(*_orders_lineitem(spark, sf))


@query("missing_by_amount", f"""
WITH {_SETS}
SELECT count(*) AS missing_count, round(coalesce(sum(o_totalprice), 0), 2) AS missing_amount
FROM orders WHERE round(o_totalprice, 2) NOT IN (SELECT k FROM keys)""")
def missing_by_amount(spark, sf):
    return reconcile.missing_by_amount(*_orders_lineitem(spark, sf))


@query("missing_by_key", """
SELECT count(*) AS missing_count, round(coalesce(sum(c_acctbal), 0), 2) AS missing_amount
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o
  ON c_custkey = o_custkey
WHERE o_custkey IS NULL""")
def missing_by_key(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return reconcile.missing_by_key(table(spark, sf, "customer"), urgent, "c_custkey", "o_custkey", "c_acctbal")


@query("missing_by_found_key", """
WITH a AS (SELECT l_orderkey, l_partkey, sum(l_extendedprice) AS amount, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey, l_partkey)
SELECT count(*) AS missing_count, round(coalesce(sum(amount), 0), 2) AS missing_amount, 'l_orderkey, l_partkey' AS key_a, 'order_ref, item_ref' AS key_b
FROM a WHERE NOT (month(last) % 3 <> 0)""")
def missing_by_found_key(spark, sf):
    """A key of two columns, named otherwise in the other table."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_extendedprice").alias("amount"), F.max("l_shipdate").alias("last"))
    booked = items.where(F.month("last") % 3 != 0).selectExpr("string(l_partkey) AS item_ref", "amount AS booked", "string(l_orderkey) AS order_ref")
    return keys.missing_by_found_key(items.select("l_orderkey", "l_partkey", "amount"), booked, "amount")


@query("unique_column_sets", """
SELECT 'customer' AS name, 'c_custkey' AS columns UNION ALL SELECT 'customer', 'c_name'
UNION ALL SELECT 'totals', 'l_partkey, l_orderkey' UNION ALL SELECT 'doubled', NULL""")
def unique_column_sets(spark, sf):
    """One and two columns; a table whose rows all occur twice has no key."""
    customers = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name", "c_mktsegment")
    totals = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    doubled = customers.select("c_custkey", "c_nationkey").union(customers.select("c_custkey", "c_nationkey"))
    found = [(n, ", ".join(s)) for n, df in (("customer", customers), ("totals", totals), ("doubled", doubled)) for s in keys.unique_column_sets(df) or [()]]
    return constant_rows(spark, [(n, s or None) for n, s in found], "name string, columns string")


@query("missing_rows_by_amount", """
SELECT o_orderkey, o_custkey, o_totalprice FROM (
  SELECT *, nullif(o_totalprice, (SELECT max(o_totalprice) FROM orders)) AS p FROM orders)
WHERE p IS NULL OR NOT EXISTS (
  SELECT 1 FROM lineitem WHERE round(l_extendedprice, 2) = round(p, 2))""")
def missing_rows_by_amount(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    top = orders.agg(F.max("o_totalprice")).scalar()
    rows = reconcile.missing_rows(
        orders, items, reconcile.amount_key(F.nullif(F.col("o_totalprice"), top)),
        reconcile.amount_key(F.col("l_extendedprice")))
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("match_with_tolerance", """
WITH b AS (SELECT DISTINCT cast(round(l_extendedprice * 100) AS bigint) AS u FROM lineitem),
near AS (SELECT u FROM b UNION SELECT u - 1 FROM b UNION SELECT u + 1 FROM b)
SELECT count(*) AS common_count, round(coalesce(sum(o_totalprice), 0), 2) AS common_amount
FROM orders WHERE cast(round(o_totalprice * 100) AS bigint) IN (SELECT u FROM near)""")
def match_with_tolerance(spark, sf):
    return reconcile.match_with_tolerance(*_orders_lineitem(spark, sf), tolerance_units=1)


@query("inclusion_ratio", """
SELECT count(*) AS rows, count(*) FILTER (hit) AS found,
  count(*) FILTER (hit) / count(*)::double AS ratio, count(*) FILTER (hit) > 0 AS any_overlap
FROM (SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS hit FROM orders)""")
def inclusion_ratio(spark, sf):
    building = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return reconcile.inclusion_ratio(table(spark, sf, "orders"), building, "o_custkey", "c_custkey")


@query("subset_check", """
SELECT count(*) AS values_b, count(*) FILTER (NOT hit) AS not_in_a, count(*) FILTER (NOT hit) = 0 AS is_subset
FROM (SELECT k, k IN (SELECT p_partkey FROM part) AS hit FROM (SELECT DISTINCT l_partkey AS k FROM lineitem))""")
def subset_check(spark, sf):
    return reconcile.subset_check(table(spark, sf, "part"), table(spark, sf, "lineitem"), "p_partkey", "l_partkey")


@query("compare_categories", """
SELECT coalesce(a.k, b.k) AS category, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b
FROM (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_retailprice < 1000 GROUP BY 1) a
FULL JOIN (SELECT p_brand AS k, count(*) AS n FROM part WHERE p_size > 45 GROUP BY 1) b ON a.k = b.k""")
def compare_categories(spark, sf):
    part = table(spark, sf, "part")
    return reconcile.compare_categories(part.where("p_retailprice < 1000"), part.where("p_size > 45"), "p_brand")


@query("cascade_delete", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'orders' AS "table", count(*) AS rows, round(coalesce(sum(o_totalprice), 0), 2) AS amount FROM o
UNION ALL
SELECT 'lineitem', count(*), round(coalesce(sum(l_extendedprice), 0), 2) FROM l""")
def cascade_delete(spark, sf):
    doomed = history.cascade_delete(
        table(spark, sf, "customer").where("c_acctbal < 0"), "c_custkey", {
            "orders": (table(spark, sf, "orders"), "o_orderkey", "o_custkey"),
            "lineitem": (table(spark, sf, "lineitem"), "l_linenumber", "l_orderkey"),
        }, parents={"lineitem": "orders"})

    def figures(name, amount):
        return doomed[name].agg(
            F.lit(name).alias("table"), F.count("*").alias("rows"),
            F.round(F.coalesce(F.sum(amount), F.lit(0.0)), 2).alias("amount"))

    return figures("orders", "o_totalprice").unionByName(figures("lineitem", "l_extendedprice"))


@query("common_amounts", """
SELECT DISTINCT round(o_totalprice, 2) AS amount FROM orders
INTERSECT SELECT DISTINCT round(l_extendedprice, 2) FROM lineitem""")
def common_amounts(spark, sf):
    return reconcile.common_amounts(*_orders_lineitem(spark, sf))


@query("amounts_only_in_a", """
SELECT DISTINCT round(o_totalprice, 2) AS amount FROM orders
EXCEPT SELECT DISTINCT round(l_extendedprice, 2) FROM lineitem""")
def amounts_only_in_a(spark, sf):
    return reconcile.amounts_only_in_a(*_orders_lineitem(spark, sf))


@query("category_universe", """
SELECT c_mktsegment AS category FROM customer UNION SELECT event_type FROM events""")
def category_universe(spark, sf):
    return reconcile.category_universe(
        table(spark, sf, "customer"), table(spark, sf, "events"), "c_mktsegment", "event_type")


@query("concat_tables", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def concat_tables(spark, sf):
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return union_all([customers, suppliers])
