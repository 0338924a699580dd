"""Counts, sums and means across tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import chunks, messages, quality, totals
from tallyloom.plans.registry import query, sql_grouped, sql_money, table

_AMOUNTS = {"orders": "o_totalprice", "lineitem": "l_extendedprice", "customer": "c_acctbal"}


def _tables(spark, sf):
    return {name: (table(spark, sf, name), amount) for name, amount in _AMOUNTS.items()}


_TAGGED = "t AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS source, {a} AS amount FROM {n}" for n, a in _AMOUNTS.items()) + ")"


@query("total_across", f"""
WITH {_TAGGED},
g AS (SELECT source, round(sum(amount), 2) AS total, count(*) AS rows FROM t GROUP BY 1
      UNION ALL SELECT '(all)', round(sum(amount), 2), count(*) FROM t)
SELECT *, CASE WHEN source = '(all)' THEN 'Total across all files: ' || {sql_money('total')}
  ELSE '• ' || source || ': ' || {sql_money('total')} || ' (' || {sql_grouped('rows')} || ' transactions)' END AS answer
FROM g""")
def total_across(spark, sf):
    return totals.total_across(_tables(spark, sf))


@query("count_across", f"""
WITH {_TAGGED},
g AS (SELECT source, count(*) AS rows FROM t GROUP BY 1 UNION ALL SELECT '(all)', count(*) FROM t)
SELECT *, CASE WHEN source = '(all)' THEN 'Total transactions across all files: ' || {sql_grouped('rows')}
  ELSE '• ' || source || ': ' || {sql_grouped('rows')} || ' transactions' END AS answer
FROM g""")
def count_across(spark, sf):
    return totals.count_across(_tables(spark, sf))


@query("mean_across", f"""
WITH {_TAGGED},
m AS (SELECT source, avg(amount) AS mean FROM t GROUP BY 1),
g AS (SELECT source, round(mean, 6) AS mean FROM m
      UNION ALL SELECT '(all)', round(avg(CASE WHEN mean > 0 THEN mean END), 6) FROM m)
SELECT *, CASE WHEN source = '(all)' THEN 'Average across all files: ' || {sql_money('mean')}
  ELSE '• ' || source || ': ' || {sql_money('mean')} || ' average' END AS answer
FROM g""")
def mean_across(spark, sf):
    return totals.mean_across(_tables(spark, sf))


@query("dataset_overview", f"""
WITH {_TAGGED},
c(source, columns) AS (VALUES ('orders', 6), ('lineitem', 11), ('customer', 5)),
g AS (
  SELECT source, count(*) AS rows, any_value(columns) AS columns, round(sum(amount), 2) AS total,
    round(avg(amount), 6) AS average, min(amount) AS lowest, max(amount) AS highest
  FROM t JOIN c USING (source) GROUP BY source
  UNION ALL
  SELECT '(all)', count(*), (SELECT sum(columns) FROM c), round(sum(amount), 2), round(avg(amount), 6), min(amount), max(amount)
  FROM t)
SELECT source, rows, cast(columns AS bigint) AS columns, total, average, lowest, highest,
  CASE WHEN source = '(all)' THEN 'Dataset Overview:' || chr(10) || '• Total files: 3' || chr(10)
    || '• Total transactions: ' || {sql_grouped('rows')} || chr(10) || '• Total amount: ' || {sql_money('total')}
  ELSE '• ' || source || ': ' || {sql_grouped('rows')} || ' rows, ' || {sql_money('total')} || ' total' END AS answer
FROM g""")
def dataset_overview(spark, sf):
    return totals.dataset_overview(_tables(spark, sf))


@query("issue_rollup", """
SELECT type, count(*) AS issues FROM (
  SELECT 'null_values' AS type FROM (SELECT count(*) FILTER (nullif(l_tax, 0) IS NULL) AS n FROM lineitem) WHERE n > 0
  UNION ALL
  SELECT 'null_values' FROM (SELECT count(*) FILTER (nullif(l_discount, 0) IS NULL) AS n FROM lineitem) WHERE n > 0
  UNION ALL SELECT 'failed_event' FROM events WHERE event_type = 'error')
GROUP BY type""")
def issue_rollup(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr("nullif(l_tax, 0) AS l_tax", "nullif(l_discount, 0) AS l_discount")
    failed = table(spark, sf, "events").where("event_type = 'error'").select(F.lit("failed_event").alias("type"))
    return totals.issue_rollup(quality.null_issue_rows(items).select("type").unionByName(failed))


# Responses of several providers, taken from the event stream.
_RESPONSES = """
  SELECT event_id, user_id AS query_id, event_type AS provider, event_type <> 'error' AS success,
    value AS response_time_ms, CASE WHEN value > 1 THEN round(1 / value, 6) END AS confidence_score
  FROM events"""


def _responses(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "user_id AS query_id", "event_type AS provider", "event_type <> 'error' AS success",
        "value AS response_time_ms", "CASE WHEN value > 1 THEN round(1 / value, 6) END AS confidence_score")


@query("response_stats", f"""
WITH r AS ({_RESPONSES})
SELECT count(*) AS responses, count(DISTINCT provider) AS providers, count(*) FILTER (success) AS successful,
  round(avg(response_time_ms), 6) AS average_time_ms,
  (SELECT provider FROM r WHERE success AND confidence_score IS NOT NULL ORDER BY confidence_score DESC, provider LIMIT 1) AS best_provider
FROM r""")
def response_stats(spark, sf):
    return totals.response_stats(_responses(spark, sf))


@query("best_response", f"""
SELECT * FROM ({_RESPONSES}) WHERE success AND confidence_score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence_score DESC, event_id) = 1""")
def best_response(spark, sf):
    return messages.best_response(_responses(spark, sf), "query_id", "success", "confidence_score", "event_id")


def _chunk_totals(batch):
    grouped = batch.groupby("l_returnflag", as_index=False, dropna=False).agg(total=("l_extendedprice", "sum"), rows=("l_extendedprice", "size"))
    return grouped


@query("chunk_then_combine", """
SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS rows FROM lineitem GROUP BY 1""")
def chunk_then_combine(spark, sf):
    items = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return chunks.chunk_then_combine(
        items, _chunk_totals, "l_returnflag string, total double, rows bigint",
        [F.round(F.sum("total"), 2).alias("total"), F.sum("rows").alias("rows")], by=["l_returnflag"])



@query("apply_process_fn", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem""")
def apply_process_fn(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return chunks.apply_process_fn(
        items, lambda b: b.assign(net=b["l_extendedprice"] * (1 - b["l_discount"])),
        "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_discount double, net double")
