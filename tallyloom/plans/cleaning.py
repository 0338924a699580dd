"""Projections, filters, typing, samples."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions import scalars
from tallyloom.operators import clean, documents, pick, references, sampling, schema
from tallyloom.plans.registry import query, table, union_sql


@query("map_columns", """
SELECT c_custkey AS customer_id, c_name AS full_name, c_acctbal AS balance, CAST(NULL AS varchar) AS email FROM customer""")
def map_columns(spark, sf):
    return clean.map_columns(
        table(spark, sf, "customer"),
        {"c_custkey": "customer_id", "c_name": "full_name", "c_acctbal": "balance"},
        {"customer_id": "bigint", "full_name": "string", "balance": "double", "email": "string"})


@query("normalize_names", "SELECT p_partkey AS part_key, p_name AS part_name, p_retailprice AS retail_price FROM part")
def normalize_names(spark, sf):
    spoken = table(spark, sf, "part").select(
        F.col("p_partkey").alias("Part Key"), F.col("p_name").alias("Part Name"), F.col("p_retailprice").alias("Retail Price"))
    return clean.normalize_names(spoken)


# Part sizes as text, with names where a size is large.
_MIXED = "CASE WHEN p_size > 25 THEN p_name ELSE CAST(p_size AS {text}) END"


def _mixed(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_retailprice").cast("string").alias("price_text"),
        F.expr(_MIXED.format(text="string")).alias("mixed"))


_MIXED_SQL = f"SELECT p_partkey, p_retailprice AS price_text, {_MIXED.format(text='varchar')} AS mixed FROM part"


@query("cast_by_schema", f"""
SELECT p_partkey, price_text, CAST(NULL AS varchar) AS price_text_raw, false AS price_text_failed,
  try_cast(mixed AS bigint) AS mixed,
  CASE WHEN try_cast(mixed AS bigint) IS NULL THEN mixed END AS mixed_raw,
  try_cast(mixed AS bigint) IS NULL AS mixed_failed
FROM ({_MIXED_SQL})""")
def cast_by_schema(spark, sf):
    return clean.cast_by_schema(_mixed(spark, sf), {"price_text": "float", "mixed": "int"})


@query("retype_whole_column", f"SELECT *, p_partkey + 9007199254740992 AS id_text FROM ({_MIXED_SQL})")
def retype_whole_column(spark, sf):
    ids = (F.col("p_partkey") + F.lit(2**53)).cast("string")
    return clean.retype_whole_columns(_mixed(spark, sf).withColumn("id_text", ids))


@query("to_numeric_coerce", f"SELECT p_partkey, price_text, try_cast(mixed AS double) AS mixed FROM ({_MIXED_SQL})")
def to_numeric_coerce(spark, sf):
    return clean.to_numeric_coerce(_mixed(spark, sf), ["price_text", "mixed"])


def _written_dates(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "d/M/yyyy")).alias("settle_date"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_time"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("day"))


@query("parse_dates", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS settle_date, o_orderdate AS day FROM orders""")
def parse_dates(spark, sf):
    parsed = clean.parse_dates(_written_dates(spark, sf), ["settle_date", "day"], "d/M/yyyy", on_error="coerce")
    return parsed.select("o_orderkey", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("settle_date", "day")])


@query("parse_dates_keep", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE strftime(o_orderdate, '%-d/%-m/%Y') END AS settle_date,
  o_orderdate AS day FROM orders""")
def parse_dates_keep(spark, sf):
    parsed = clean.parse_dates(_written_dates(spark, sf), ["settle_date", "day"], "d/M/yyyy", on_error="keep")
    return parsed.select("o_orderkey", "settle_date", F.col("day").cast("timestamp_ntz").alias("day"))


@query("date_string_check", """
SELECT 'settle_date' AS "column", count(*) AS failed, count(*) = 0 AS is_date_string FROM orders
UNION ALL SELECT 'order_time', 0, true""")
def date_string_check(spark, sf):
    return clean.date_string_columns(_written_dates(spark, sf))


@query("select_columns", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def select_columns(spark, sf):
    return clean.select_columns(table(spark, sf, "lineitem"), lambda name: name.endswith("key"))


@query("drop_blank_rows", """
SELECT * FROM (
  SELECT CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT' THEN o_totalprice END AS price FROM orders)
WHERE trim(priority) <> '' OR price IS NOT NULL""")
def drop_blank_rows(spark, sf):
    return clean.drop_blank_rows(table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderstatus = 'F' THEN '  ' ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT' THEN o_totalprice END AS price"))


# A report-like table: total rows, sparse rows, and harmless words that contain "sum".
_REPORT_COLUMNS = [
    "p_partkey AS no",
    "CASE WHEN p_size = 1 THEN 'Total:' WHEN p_size = 2 THEN 'Amount Due' WHEN p_size = 3 THEN 'consumer' "
    "WHEN p_size > 40 THEN NULL ELSE p_name END AS label",
    "CASE WHEN p_size > 40 THEN NULL ELSE p_brand END AS brand",
    "CASE WHEN p_size > 30 THEN NULL ELSE p_type END AS kind",
    "CASE WHEN p_size BETWEEN 41 AND 45 THEN p_retailprice END AS price",
]
_REPORT = f"SELECT {', '.join(_REPORT_COLUMNS)} FROM part"


@query("filter_summary_rows", f"""
SELECT * FROM ({_REPORT})
WHERE NOT regexp_matches(lower(concat_ws(' # ', label, brand, kind)), 'total|sum|balance|amount due')
  AND (no IS NOT NULL)::int + (label IS NOT NULL)::int + (brand IS NOT NULL)::int + (kind IS NOT NULL)::int
    + (price IS NOT NULL)::int >= 2""")
def filter_summary_rows(spark, sf):
    return clean.filter_summary_rows(table(spark, sf, "part").selectExpr(*_REPORT_COLUMNS))


@query("filter_summary_rows_words", f"""
SELECT * FROM ({_REPORT})
WHERE NOT regexp_matches(lower(concat_ws(' # ', label, brand, kind)), '\\b(total|sum|subtotal|summary|balance|amount due)\\b')
  AND (no IS NOT NULL)::int + (label IS NOT NULL)::int + (brand IS NOT NULL)::int + (kind IS NOT NULL)::int
    + (price IS NOT NULL)::int >= 2""")
def filter_summary_rows_words(spark, sf):
    return clean.filter_summary_rows(table(spark, sf, "part").selectExpr(*_REPORT_COLUMNS), word_boundary=True)


# Page tokens with a confidence and a box, taken from the order lines.
TOKENS = """
  SELECT l_orderkey AS block_num, l_linenumber AS word_num, l_partkey AS part_num, l_suppkey AS supp_num,
    CASE WHEN l_linenumber = 2 THEN '  ' ELSE l_returnflag || l_linestatus END AS text,
    l_quantity * 2 AS conf, l_partkey AS "left", l_suppkey AS top, CAST(l_quantity AS bigint) AS width, l_linenumber AS height
  FROM lineitem"""


def tokens(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS block_num", "l_linenumber AS word_num", "l_partkey AS part_num", "l_suppkey AS supp_num",
        "CASE WHEN l_linenumber = 2 THEN '  ' ELSE concat(l_returnflag, l_linestatus) END AS text",
        "l_quantity * 2 AS conf", "l_partkey AS left", "l_suppkey AS top", "CAST(l_quantity AS bigint) AS width",
        "l_linenumber AS height")


@query("confidence_filter", f"SELECT * FROM ({TOKENS}) WHERE conf > 70 AND trim(text) <> ''")
def confidence_filter(spark, sf):
    return clean.confidence_filter(tokens(spark, sf))


@query("text_blocks", f"""
SELECT block_num, round(avg(conf), 6) AS confidence, min("left") AS x, min(top) AS y,
  CAST(sum(width) AS bigint) AS width, max(height) AS height,
  CAST(1 AS bigint) AS part, string_agg(text, ' ' ORDER BY word_num, part_num, supp_num, text) AS text
FROM ({TOKENS}) WHERE conf > 70 AND trim(text) <> '' GROUP BY block_num""")
def text_blocks(spark, sf):
    kept = clean.confidence_filter(tokens(spark, sf))
    return documents.text_blocks(kept, ["block_num"], ["word_num", "part_num", "supp_num", "text"])


_INTS = {"l_orderkey": "lineitem", "l_partkey": "lineitem", "l_suppkey": "lineitem", "l_linenumber": "lineitem"}


@query("narrow_types", "SELECT *, " + " ".join((
    "CASE WHEN lowest >= -128 AND highest <= 127 THEN 'tinyint'",
    "WHEN lowest >= -32768 AND highest <= 32767 THEN 'smallint'",
    "WHEN lowest >= -2147483648 AND highest <= 2147483647 THEN 'int' ELSE 'bigint' END AS narrow_type FROM (")) + union_sql([
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS bigint) AS lowest, CAST(max({c}) AS bigint) AS highest FROM {t}"""
        for c, t in _INTS.items()]) + ")")
def narrow_types(spark, sf):
    return clean.narrowest_types(table(spark, sf, "lineitem"))


@query("narrow_types_rows", "SELECT p_partkey, p_size, p_retailprice FROM part")
def narrow_types_rows(spark, sf):
    narrow = clean.narrow_types(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))
    return narrow.selectExpr("CAST(p_partkey AS bigint) AS p_partkey", "CAST(p_size AS int) AS p_size", "p_retailprice")


@query("stringify_complex", """
SELECT p_partkey, CAST(to_json(string_split(p_name, ' ')) AS varchar) AS words,
  CAST(to_json({'brand': p_brand, 'size': p_size}) AS varchar) AS label FROM part""")
def stringify_complex(spark, sf):
    nested = table(spark, sf, "part").select(
        "p_partkey", F.split("p_name", " ").alias("words"),
        F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("label"))
    return clean.stringify_complex(nested)


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _evidence_sql(columns, source):
    parts = [
        f"""SELECT {i} AS position, '{c}' AS "column", count(try_cast({c} AS double)) AS numbers,
          round(avg(try_cast({c} AS double)), 6) AS mean FROM {source}"""
        for i, c in enumerate(columns)
    ]
    hinted = " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in fixed.AMOUNT_WORDS)
    listed = ", ".join(f"'{n}'" for n in fixed.AMOUNT_NAMES)
    return f"""
SELECT *, rank() OVER (ORDER BY step NULLS LAST, coalesce(nullif(list_position([{listed}], "column"), 0), 0), position) = 1 AS is_amount
FROM (SELECT *, CASE WHEN numbers > 0 AND "column" IN ({listed}) THEN 1
  WHEN numbers > 0 AND ({hinted}) THEN 2
  WHEN numbers > 0 AND mean BETWEEN 0.01 AND 100000 THEN 3 END AS step
FROM ({union_sql(parts)}))"""


@query("find_amount_column", _evidence_sql(_ORDER_COLUMNS, "orders"))
def find_amount_column(spark, sf):
    orders = table(spark, sf, "orders").select(*_ORDER_COLUMNS)
    found = pick.find_amount_column(orders)
    ranked = pick.rank_amount_columns(orders)
    return ranked.select(
        "position", "column", "numbers", F.round("mean", 6).alias("mean"), "step", (F.col("column") == found).alias("is_amount"))


_STATES = """
  SELECT event_id, nullif(user_id, 7) AS id,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
      WHEN 'signup' THEN 'failed' ELSE 'broken' END AS processing_status, value AS progress_percentage
  FROM events"""


@query("validate_constraints", f"""
SELECT * FROM (
  SELECT *, concat_ws(',', CASE WHEN id IS NULL THEN 'id_set' END,
    CASE WHEN processing_status = 'broken' THEN 'status_known' END,
    CASE WHEN NOT progress_percentage BETWEEN 0 AND 100 THEN 'progress_in_range' END) AS failed_rules FROM ({_STATES}))
WHERE failed_rules <> ''""")
def validate_constraints(spark, sf):
    states = table(spark, sf, "events").selectExpr(
        "event_id", "nullif(user_id, 7) AS id",
        "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' "
        "WHEN 'signup' THEN 'failed' ELSE 'broken' END AS processing_status", "value AS progress_percentage")
    rules = {
        "id_set": F.col("id").isNotNull(),
        "status_known": clean.metadata_rules("file_metadata")["status_known"],
        "progress_in_range": clean.metadata_rules("processing_states")["progress_in_range"],
    }
    _, broken = clean.validate_constraints(states, rules)
    return broken.withColumn("failed_rules", F.array_join("failed_rules", ","))


_METADATA = {
    "user_sessions": "SELECT c_custkey AS id, nullif(c_nationkey, 3) AS user_id, c_name AS session_data FROM customer UNION ALL SELECT 5, 1, ''",
    "file_metadata": """
        SELECT o_orderkey AS id, CASE WHEN o_custkey % 50 = 0 THEN 9000000 + o_custkey ELSE o_custkey END AS session_id, o_orderstatus AS filename,
          nullif(o_orderpriority, '2-HIGH') AS file_type, o_totalprice AS size, CASE WHEN o_orderkey % 500 = 0 THEN 'lost' ELSE 'pending' END AS processing_status
        FROM orders""",
    "processing_states": """
        SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey = 7 THEN 8000001 ELSE l_orderkey END AS file_id, l_returnflag AS current_step,
          CASE WHEN l_partkey % 100 = 0 THEN 101.0 ELSE l_quantity END AS progress_percentage
        FROM lineitem WHERE l_linenumber = 1""",
    "conversation_history": """
        SELECT event_id AS id, CASE WHEN event_id % 100 = 0 THEN -1 ELSE 1 + user_id % 100 END AS session_id,
          CASE WHEN event_type = 'error' THEN 'error' ELSE 'user' END AS message_type, props AS content
        FROM events""",
    "data_insights": "SELECT p_partkey AS id, CASE WHEN p_size = 3 THEN -p_partkey ELSE 1 END AS file_id, CASE WHEN p_size = 9 THEN NULL ELSE p_size * 2.5 END AS quality_score FROM part",
    "resource_usage": """
        SELECT s_suppkey % 40 AS id, CASE WHEN s_nationkey = 1 THEN NULL WHEN s_nationkey = 2 THEN 7000000 ELSE s_suppkey END AS session_id, s_acctbal AS cpu_percent,
          50.0 AS memory_percent, 1.5 AS memory_used_mb, 99.0 AS disk_usage_percent, s_name AS operation_type
        FROM supplier""",
}


def _metadata_sql() -> str:
    rules = {
        "user_sessions": {"id_set": "id IS NULL", "user_id_set": "user_id IS NULL"},
        "file_metadata": {"file_type_set": "file_type IS NULL", "status_known": "processing_status = 'lost'"},
        "processing_states": {"progress_in_range": "progress_percentage > 100"},
        "conversation_history": {"content_set": "content IS NULL"},
        "data_insights": {"quality_score_set": "quality_score IS NULL", "score_in_range": "quality_score NOT BETWEEN 0 AND 100"},
        "resource_usage": {"session_id_set": "session_id IS NULL", "cpu_in_range": "cpu_percent NOT BETWEEN 0 AND 100"},
    }
    parts = [f"SELECT '{t}' AS \"table\", '{r}' AS rule, CAST(id AS varchar) AS key, count(*) AS rows FROM {t} WHERE {broken} GROUP BY id" for t, found in rules.items() for r, broken in found.items()]
    parts += [f"SELECT '{t}', 'id_unique', CAST(id AS varchar), count(*) FROM {t} WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1" for t in _METADATA]
    parts += [
        f"SELECT '{t}', '{c}_exists', CAST({c} AS varchar), count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {p}) GROUP BY {c}"
        for t, (c, p) in fixed.METADATA_REFERENCES.items()]
    return "WITH " + ", ".join(f"{t} AS ({q})" for t, q in _METADATA.items()) + "\n" + "\nUNION ALL\n".join(parts)


@query("metadata_errors", _metadata_sql())
def metadata_errors(spark, sf):
    """Broken rules, repeated ids and orphans planted in each of the six tables."""
    given = {n: table(spark, sf, n) for n in ("customer", "orders", "lineitem", "events", "part", "supplier")}
    tables = {n: spark.sql(re.sub(r"FROM (\w+)", r"FROM {\1}", q), **given) for n, q in _METADATA.items()}
    tables["user_sessions"] = tables["user_sessions"].withColumn("session_data", F.struct("session_data"))
    return references.metadata_errors(tables)


@query("head_sample", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def head_sample(spark, sf):
    return sampling.head_sample(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 100)


@query("random_sample", """
SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 100""")
def random_sample(spark, sf):
    return sampling.random_sample(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], 100)


@query("time_series", "SELECT o_orderdate AS date, o_totalprice AS value FROM orders ORDER BY 1, 2")
def time_series(spark, sf):
    return sampling.time_series(table(spark, sf, "orders"), "o_totalprice")


@query("batch_numbers", """
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS row_no,
  CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 50) + 1 AS bigint) AS batch FROM orders""")
def batch_numbers(spark, sf):
    return documents.batch_numbers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50)


@query("extract_schema", """
WITH e AS (SELECT event_id, ts, user_id, event_type, nullif(value, 0.02) AS value, CASE WHEN event_id > 1100 THEN props END AS props FROM events),
h AS (SELECT * FROM e)
""" + union_sql([
    f"""SELECT '{c}' AS "column", '{t}' AS data_type, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count,
  (SELECT coalesce(string_agg(v, '|' ORDER BY event_id), '') FROM (
     SELECT event_id, {text} AS v FROM h WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 5)) AS sample_values FROM e"""
    for c, t, text in (
        ("event_id", "INTEGER", "CAST(event_id AS varchar)"), ("user_id", "INTEGER", "CAST(user_id AS varchar)"),
        ("event_type", "TEXT", "event_type"), ("value", "DECIMAL", "CAST(value AS varchar)"), ("props", "TEXT", "props"))]))
def extract_schema(spark, sf):
    events = table(spark, sf, "events").selectExpr(
        "event_id", "user_id", "event_type", "nullif(value, 0.02D) AS value", "CASE WHEN event_id > 1100 THEN props END AS props")
    return schema.extract_schema(events, ["event_id"])


@query("scalar_functions", """
SELECT page_id, regexp_extract(url, '[^/]*$') AS name,
  regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1') AS stem,
  lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.(\\.[^.]*)$', 1)) AS extension,
  try_cast(regexp_extract(url, '([0-9]+)', 1) AS double) AS number,
  format('{:,}', length(html)) AS grouped, 'RM ' || format('{:,.2f}', length(html) / 7.0::double) AS money,
  regexp_matches(regexp_extract(url, '[^/]*$'), '^[0-9]+$') AS digits,
  CASE WHEN trim(regexp_extract(url, '/(en|fr|de)/', 1)) <> '' THEN regexp_extract(url, '/(en|fr|de)/', 1) END AS language,
  contains(html, '</nav>') OR contains(html, '</table>') AS has_any,
  contains(html, '<p>')::int + contains(html, '<h1>')::int + contains(html, '<table>')::int AS how_many,
  page_id / nullif(page_id - 3, 0)::double AS ratio FROM pages""")
def scalar_functions(spark, sf):
    """The shared column helpers, side by side."""
    name = scalars.file_name(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", name.alias("name"), scalars.file_stem(F.col("url")).alias("stem"),
        scalars.file_extension(F.col("url")).alias("extension"),
        scalars.to_number(F.regexp_extract("url", "([0-9]+)", 1)).alias("number"),
        scalars.grouped_number(F.length("html")).alias("grouped"), scalars.money(F.length("html") / 7).alias("money"),
        scalars.is_digits(name).alias("digits"),
        scalars.blank_to_null(F.regexp_extract("url", "/(en|fr|de)/", 1)).alias("language"),
        scalars.contains_any(F.col("html"), ["</nav>", "</table>"]).alias("has_any"),
        scalars.count_contained(F.col("html"), ["<p>", "<h1>", "<table>"]).alias("how_many"),
        scalars.share(F.col("page_id"), F.col("page_id") - 3).alias("ratio"))
