"""Relationships between tables, schemas and migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.scalars import name_similarity_column
from tallyloom.operators import relate, schema
from tallyloom.plans.registry import query, table, union_sql

# The driver's tables under the names a migration would meet.
_VIEWS = {
    "customers": "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_id, c_mktsegment AS segment FROM customer",
    "orders_in": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total, o_orderstatus AS status FROM orders",
    "nations": "SELECT n_nationkey AS nation_id, n_name AS name, n_regionkey AS region_id FROM nation",
    "suppliers": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation_id FROM supplier",
}
_WITH = "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in _VIEWS.items())
_SOURCES = {"customers": "customer", "orders_in": "orders", "nations": "nation", "suppliers": "supplier"}


def named_tables(spark, sf, *names):
    result = {}
    for name in names or _VIEWS:
        columns = _VIEWS[name].removeprefix("SELECT ").split(" FROM ")[0].split(", ")
        result[name] = table(spark, sf, _SOURCES[name]).selectExpr(*columns)
    return result


def _measured_sql(candidates):
    return union_sql([f"""
SELECT '{s}' AS source_table, '{t}' AS target_table, '{a}' AS source_column, '{b}' AS target_column,
  (SELECT count(*) FROM {s}) AS source_rows, (SELECT count(DISTINCT {a}) FROM {s}) AS source_values,
  (SELECT count(*) FROM {t}) AS target_rows, (SELECT count(DISTINCT {b}) FROM {t}) AS target_values,
  (SELECT count(*) FROM (SELECT {a} FROM {s} WHERE {a} IS NOT NULL INTERSECT SELECT {b} FROM {t})) AS common,
  (SELECT count(*) FROM {s} WHERE {a} IN (SELECT {b} FROM {t})) AS source_rows_found""" for s, t, a, b in candidates])


_RATIOS = """r AS (SELECT *, common / source_values::double AS so, common / target_values::double AS tg,
  source_values / source_rows::double AS su, target_values / target_rows::double AS tu FROM m)"""


def _type(limit):
    return (f"CASE WHEN su > {limit} AND tu > {limit} THEN 'one-to-one' WHEN su > {limit} THEN 'one-to-many' "
            f"WHEN tu > {limit} THEN 'many-to-one' ELSE 'many-to-many' END")


_CONFIDENCE = "round(least(so, tg) * 0.7 + su * tu * 0.3, 6)"


def _relationships_sql(candidates, where="so >= 0.1 OR tg >= 0.1", extra=""):
    return f"""{_WITH},
m AS ({_measured_sql(candidates)}), {_RATIOS}
SELECT source_table, target_table, source_column, target_column, {extra}{_type(0.9)} AS relationship_type, {_CONFIDENCE} AS confidence
FROM r WHERE {where}"""


@query("column_relationship", _relationships_sql(
    [("orders_in", "customers", "customer_id", "id")], extra="round(so, 6) AS source_overlap, round(tg, 6) AS target_overlap, "))
def column_relationship(spark, sf):
    t = named_tables(spark, sf, "orders_in", "customers")
    return relate.column_relationship(t["orders_in"], t["customers"], "customer_id", "id", "orders_in", "customers")


_ALL = [
    ("customers", "orders_in", "id", "order_id"), ("customers", "orders_in", "id", "customer_id"),
    ("customers", "orders_in", "nation_id", "order_id"), ("customers", "orders_in", "nation_id", "customer_id"),
    ("customers", "nations", "name", "name"), ("customers", "nations", "nation_id", "nation_id"),
    ("customers", "nations", "id", "nation_id"), ("customers", "nations", "id", "region_id"),
    ("customers", "nations", "nation_id", "region_id"),
    ("customers", "suppliers", "id", "id"), ("customers", "suppliers", "name", "name"),
    ("customers", "suppliers", "nation_id", "nation_id"), ("customers", "suppliers", "id", "nation_id"),
    ("customers", "suppliers", "nation_id", "id"),
    ("orders_in", "nations", "order_id", "nation_id"), ("orders_in", "nations", "order_id", "region_id"),
    ("orders_in", "nations", "customer_id", "nation_id"), ("orders_in", "nations", "customer_id", "region_id"),
    ("orders_in", "suppliers", "order_id", "id"), ("orders_in", "suppliers", "order_id", "nation_id"),
    ("orders_in", "suppliers", "customer_id", "id"), ("orders_in", "suppliers", "customer_id", "nation_id"),
    ("nations", "suppliers", "nation_id", "nation_id"), ("nations", "suppliers", "name", "name"),
    ("nations", "suppliers", "nation_id", "id"), ("nations", "suppliers", "region_id", "id"),
    ("nations", "suppliers", "region_id", "nation_id"),
]


@query("detect_relationships", _relationships_sql(_ALL))
def detect_relationships(spark, sf):
    return relate.detect_relationships(named_tables(spark, sf))


@query("key_relationships", _relationships_sql(
    [("nations", "suppliers", "nation_id", "nation_id"), ("nations", "suppliers", "name", "name"),
     ("nations", "customers", "nation_id", "nation_id"), ("nations", "customers", "name", "name"),
     ("suppliers", "customers", "id", "id"), ("suppliers", "customers", "name", "name"), ("suppliers", "customers", "nation_id", "nation_id"),
     ("orders_in", "customers", "customer_id", "id")],
    where="(so >= 0.1 OR tg >= 0.1) AND " + _CONFIDENCE + " > 0.7"))
def key_relationships(spark, sf):
    return relate.key_relationships(named_tables(spark, sf, "nations", "suppliers", "orders_in", "customers"))


_SHARED = [("customers", "nations", "nation_id", "nation_id"), ("customers", "suppliers", "nation_id", "nation_id"),
           ("nations", "suppliers", "nation_id", "nation_id")]


@query("shared_column_relationships", f"""{_WITH},
m AS ({_measured_sql(_SHARED)}), {_RATIOS}
SELECT source_table, target_table, source_column, target_column, {_type(0.8)} AS relationship_type, 0.7::double AS confidence FROM r""")
def shared_column_relationships(spark, sf):
    return relate.shared_column_relationships(named_tables(spark, sf))


_ID_PAIRS = [
    ("customers", "orders_in", "id", "order_id"), ("customers", "orders_in", "id", "customer_id"),
    ("customers", "nations", "id", "nation_id"), ("customers", "nations", "id", "region_id"),
    ("customers", "nations", "nation_id", "nation_id"), ("nations", "customers", "nation_id", "nation_id"),
]


@query("id_column_relationships", f"""{_WITH},
m AS ({_measured_sql(_ID_PAIRS)})
SELECT source_table, target_table, source_column, target_column, 'one-to-many' AS relationship_type, 0.8::double AS confidence
FROM m WHERE common > 0""")
def id_column_relationships(spark, sf):
    return relate.id_column_relationships(named_tables(spark, sf, "customers", "orders_in", "nations"))


_WITHIN = ["o_orderkey", "o_custkey", "parent", "line"]
_WITHIN_SQL = """t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS parent,
  CAST(length(o_orderpriority) AS bigint) AS line FROM orders)"""


@query("foreign_keys_within", f"WITH {_WITHIN_SQL}\n" + union_sql([f"""
SELECT '{x}' AS primary_key, '{y}' AS foreign_key,
  round((SELECT count(DISTINCT {y}) FROM t) / (SELECT count(DISTINCT {x}) FROM t)::double, 6) AS confidence
WHERE (SELECT count(DISTINCT {x}) / count(*)::double FROM t) > 0.9
  AND (SELECT (count(*) - count({x})) / count(*)::double FROM t) < 0.01
  AND NOT EXISTS (SELECT 1 FROM t WHERE {y} IS NOT NULL AND {y} NOT IN (SELECT {x} FROM t WHERE {x} IS NOT NULL))"""
    for x in _WITHIN for y in _WITHIN if x != y]))
def foreign_keys_within(spark, sf):
    return relate.foreign_keys_within(table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS parent",
        "CAST(length(o_orderpriority) AS bigint) AS line"))


@query("name_similarity", """
SELECT p_partkey, CASE WHEN x = y THEN 1.0::double WHEN contains(x, y) OR contains(y, x) THEN 0.8::double
  ELSE round(len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, ''))))
    / len(list_distinct(list_concat(string_split(x, ''), string_split(y, ''))))::double, 6) END AS similarity
FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[_ ]', '', 'g') AS x, regexp_replace(lower(p_type), '[_ ]', '', 'g') AS y FROM part)""")
def name_similarity(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.round(name_similarity_column(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


def _enum(c, source):
    return f"""(SELECT 'ENUM(' || string_agg(v, ', ' ORDER BY v) || ')' FROM (SELECT DISTINCT {c} AS v FROM {source} WHERE {c} IS NOT NULL))"""


def _suggest_sql(columns, source):
    parts = []
    for c, sql_type in columns.items():
        key = c == "id" or c.endswith("_id")
        if sql_type == "TEXT":
            sql_type_expr = (f"CASE WHEN count(DISTINCT {c}) <= 10 AND count(DISTINCT {c}) / count(*)::double < 0.1 THEN {_enum(c, source)} "
                             f"WHEN max(length(coalesce({c}, ''))) < 50 THEN 'VARCHAR(50)' ELSE 'TEXT' END")
        else:
            sql_type_expr = f"'{sql_type}'"
        parts.append(f"""SELECT '{c}' AS "column", {sql_type_expr} AS sql_type, count(*) > count({c}) AS nullable,
  count(DISTINCT {c}) AS unique_values, {f'count(DISTINCT {c}) = count(*)' if key else 'false'} AS primary_key,
  {'true' if c.endswith('_id') and c != 'id' else 'false'} AS "index" FROM {source}""")
    return union_sql(parts)


@query("suggest_schema", "WITH t AS (SELECT doc_id AS id, text, lang, nullif(source, 'src1') AS source, n_chars, CAST(n_chars AS double) AS size, "
       "doc_id AS group_id FROM documents)\n" + _suggest_sql(
    {"id": "INTEGER", "text": "TEXT", "lang": "TEXT", "source": "TEXT", "n_chars": "INTEGER", "size": "DECIMAL", "group_id": "INTEGER"}, "t"))
def suggest_schema(spark, sf):
    return schema.suggest_schema(table(spark, sf, "documents").selectExpr(
        "doc_id AS id", "text", "lang", "nullif(source, 'src1') AS source", "n_chars", "CAST(n_chars AS double) AS size", "doc_id AS group_id"))


def _unify_inputs(spark, sf):
    return {
        "customer": table(spark, sf, "customer").selectExpr("c_custkey AS `Id`", "c_name AS `Full Name`", "c_acctbal AS balance", "c_mktsegment AS segment"),
        "supplier": table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_name AS full_name", "CAST(s_acctbal AS bigint) AS balance"),
        "part": table(spark, sf, "part").selectExpr("p_name AS id", "p_brand AS segment"),
    }


_MAPPING_SQL = """
m(source_file, source_column, target_column, data_type, position) AS (VALUES
  ('customer', 'Id', 'id', 'INTEGER', 0), ('customer', 'Full Name', 'full_name', 'TEXT', 1),
  ('customer', 'balance', 'balance', 'DECIMAL', 2), ('customer', 'segment', 'segment', 'TEXT', 3),
  ('supplier', 'id', 'id', 'INTEGER', 0), ('supplier', 'full_name', 'full_name', 'TEXT', 1), ('supplier', 'balance', 'balance', 'INTEGER', 2),
  ('part', 'id', 'id', 'TEXT', 0), ('part', 'segment', 'segment', 'TEXT', 1))"""


@query("unify_schema", f"""
WITH {_MAPPING_SQL}
SELECT source_file, source_column, target_column, data_type, position, 0.9::double AS confidence,
  CASE target_column WHEN 'balance' THEN 'DECIMAL' ELSE 'TEXT' END AS unified_type FROM m""")
def unify_schema(spark, sf):
    return schema.unify_schema(_unify_inputs(spark, sf), by_values=True)


@query("type_conflicts", f"""
WITH {_MAPPING_SQL}
SELECT target_column, string_agg(DISTINCT data_type, ',' ORDER BY data_type) AS conflicting_types,
  string_agg(source_file || '.' || source_column, ',' ORDER BY source_file || '.' || source_column) AS sources
FROM m GROUP BY 1 HAVING count(DISTINCT data_type) > 1""")
def type_conflicts(spark, sf):
    return schema.type_conflicts(schema.unify_schema(_unify_inputs(spark, sf), by_values=True))


# The same tables as untyped files would give them: all texts, and a column that is never filled.
_UNTYPED = {
    "customer": ("customer", {"Id": "c_custkey", "Full Name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment", "note": "NULL"}),
    "supplier": ("supplier", {"id": "s_suppkey", "full_name": "s_name", "balance": "CAST(trunc(s_acctbal) AS bigint)", "code": "substr(s_name, 10)"}),
    "part": ("part", {"id": "p_name", "segment": "p_size", "note": "p_brand"}),
}


def _untyped(spark, sf):
    return {
        name: table(spark, sf, source).selectExpr(*[
            f"CAST({e.replace('CAST(trunc(s_acctbal) AS bigint)', 'CAST(s_acctbal AS bigint)')} AS string) AS `{c}`" for c, e in columns.items()])
        for name, (source, columns) in _UNTYPED.items()}


def _untyped_row(name, source, position, column, expression):
    whole, number = r"^\s*[+-]?(0|[1-9][0-9]*)\s*$", r"^\s*[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return f"""SELECT '{name}' AS source_file, '{column}' AS source_column, '{column.lower().replace(' ', '_')}' AS target_column,
  {position} AS position, count(v) > 0 AS known, CASE WHEN count(v) > 0 THEN 0.9 ELSE 0.7 END::double AS confidence,
  CASE WHEN bool_and(regexp_matches(v, '{whole}') AND try_cast(v AS bigint) IS NOT NULL) THEN 'INTEGER'
    WHEN bool_and(regexp_matches(v, '{number}') AND (NOT regexp_matches(v, '{whole}') OR try_cast(v AS bigint) IS NOT NULL)) THEN 'DECIMAL'
    ELSE 'TEXT' END AS data_type
  FROM (SELECT CAST({expression} AS varchar) AS v FROM {source})"""


_UNTYPED_SQL = "m AS (" + union_sql([
    _untyped_row(name, source, i, c, e) for name, (source, columns) in _UNTYPED.items() for i, (c, e) in enumerate(columns.items())]) + """),
u AS (SELECT target_column, list_sort(list(DISTINCT data_type) FILTER (known)) AS types FROM m GROUP BY 1)"""


@query("unify_schema_by_values", f"""
WITH {_UNTYPED_SQL}
SELECT source_file, source_column, m.target_column, data_type, position, confidence,
  CASE WHEN len(types) = 1 THEN types[1] WHEN types = ['DECIMAL', 'INTEGER'] THEN 'DECIMAL' ELSE 'TEXT' END AS unified_type
FROM m JOIN u ON u.target_column = m.target_column""")
def unify_schema_by_values(spark, sf):
    return schema.unify_schema(_untyped(spark, sf), by_values=True)


@query("type_conflicts_by_values", f"""
WITH {_UNTYPED_SQL}
SELECT target_column, string_agg(DISTINCT data_type, ',' ORDER BY data_type) AS conflicting_types,
  string_agg(source_file || '.' || source_column, ',' ORDER BY source_file || '.' || source_column) AS sources
FROM m GROUP BY 1 HAVING count(DISTINCT data_type) > 1""")
def type_conflicts_by_values(spark, sf):
    return schema.type_conflicts(schema.unify_schema(_untyped(spark, sf), by_values=True))


@query("mapping_confidence", f"""
WITH {_UNTYPED_SQL}
SELECT count(*) AS total_mappings, count(*) FILTER (confidence >= 0.8) AS high_confidence, count(*) FILTER (confidence < 0.8) AS low_confidence FROM m""")
def mapping_confidence(spark, sf):
    return schema.mapping_confidence(schema.unify_schema(_untyped(spark, sf), by_values=True))


_MIGRATED = """
  SELECT CAST(c_custkey AS varchar) AS id, c_name AS full_name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source_file FROM customer
  UNION ALL SELECT CAST(s_suppkey AS varchar), s_name, CAST(CAST(trunc(s_acctbal) AS bigint) AS double), NULL, 'supplier' FROM supplier
  UNION ALL SELECT p_name, NULL, NULL, p_brand, 'part' FROM part"""


@query("migrate_files", _MIGRATED)
def migrate_files(spark, sf):
    return schema.migrate(_unify_inputs(spark, sf))[0]


@query("migrate_files_report", f"""
WITH g AS ({_MIGRATED}),
n AS (SELECT source_file, 'migrated' AS status, CAST(NULL AS varchar) AS "column", count(*) AS rows, CAST(NULL AS double) AS percentage FROM g GROUP BY 1
""" + "".join(f"""  UNION ALL SELECT source_file, 'null_values', '{c}', count(*) - count({c}), round((count(*) - count({c})) * 100 / count(*)::double, 6) FROM g GROUP BY 1
""" for c in ("id", "full_name", "balance", "segment")) + """)
SELECT *, CAST(NULL AS varchar) AS reason FROM n WHERE rows > 0""")
def migrate_files_report(spark, sf):
    return schema.migrate(_unify_inputs(spark, sf))[1]
