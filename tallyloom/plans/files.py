"""Sources and sinks: tables written in messy or plain formats and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.functions.scalars import file_name
from tallyloom.operators import clean
from tallyloom.plans.registry import query, table
from tallyloom.session import scratch_dir
from tallyloom.sinks import writers
from tallyloom.sources import catalog, conversations, probe, readers

_REPORT_COLUMNS = ["Order No", "Settlement Date", "Transaction Type", "Transaction Amount (RM)"]


def _write_report(spark, sf):
    """Orders as settlement reports: an empty first line, the header in line 2, a total row at the end."""
    orders = table(spark, sf, "orders")
    parts = max(4, -(-orders.count() // 2_000_000))
    data = orders.select(
        F.pmod(F.xxhash64("o_orderkey"), F.lit(parts)).alias("part"), F.lit(2).alias("_rank"),
        F.col("o_orderkey").cast("string").alias("c0"), F.date_format("o_orderdate", "d/M/yyyy").alias("c1"),
        F.concat(F.lit("Sale, "), "o_orderstatus").alias("c2"), F.col("o_totalprice").cast("string").alias("c3"))
    numbered = spark.range(parts).select(F.col("id").alias("part"))
    empty = numbered.select("part", F.lit(0).alias("_rank"), *[F.lit(None).cast("string").alias(f"c{i}") for i in range(4)])
    header = numbered.select("part", F.lit(1).alias("_rank"), *[F.lit(n).alias(f"c{i}") for i, n in enumerate(_REPORT_COLUMNS)])
    total = data.groupBy("part").agg(F.sum(F.col("c3").cast("double")).cast("string").alias("c3")).select(
        "part", F.lit(3).alias("_rank"), F.lit(None).cast("string").alias("c0"), F.lit(None).cast("string").alias("c1"),
        F.lit("Total:").alias("c2"), "c3")
    path = scratch_dir(spark, "report")
    (
        data.unionByName(empty).unionByName(header).unionByName(total)
        .repartition(parts, "part").sortWithinPartitions("part", "_rank").drop("_rank")
        .write.partitionBy("part").csv(path, escape='"')
    )
    return path


_REPORT_SQL = """SELECT o_orderkey AS order_no, o_orderdate AS settlement_date, 'Sale, ' || o_orderstatus AS kind, o_totalprice AS amount FROM orders"""


@query("scan_csv", _REPORT_SQL)
def scan_csv(spark, sf):
    """Find the header, drop the total row, type the columns."""
    good, _ = readers.quarantine_rows(readers.scan_csv(spark, _write_report(spark, sf)))
    rows = clean.filter_summary_rows(good.drop("source_file"))
    rows = clean.retype_whole_columns(rows, ["Order No", "Transaction Amount (RM)"])
    rows = clean.parse_dates(rows, ["Settlement Date"], "d/M/yyyy")
    return rows.select(
        F.col("Order No").cast("bigint").alias("order_no"), F.col("Settlement Date").cast("timestamp_ntz").alias("settlement_date"),
        F.col("Transaction Type").alias("kind"), F.col("`Transaction Amount (RM)`").alias("amount"))


@query("scan_csv_quoted_breaks", """
SELECT p_partkey AS no, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', chr(10)) ELSE p_name || ', "' || p_brand || '"' END AS note,
  round(p_retailprice, 2) AS price
FROM part""")
def scan_csv_quoted_breaks(spark, sf):
    """Cells with line breaks, separators and quotes, read back in splits."""
    note = F.when(F.col("p_partkey") % 3 == 0, F.replace("p_name", F.lit(" "), F.lit("\n"))).otherwise(F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')))
    path = scratch_dir(spark, "breaks")
    table(spark, sf, "part").select(F.col("p_partkey").alias("no"), note.alias("note"), F.round("p_retailprice", 2).alias("price")).write.csv(path, header=True, escape='"')
    good, _ = readers.quarantine_rows(readers.scan_csv(spark, path, multi_line=True))
    return good.select(F.col("no").cast("bigint").alias("no"), "note", F.col("price").cast("double").alias("price"))


@query("detect_header_row", """
SELECT 1 AS header_row, 'Order No|Settlement Date|Transaction Type|Transaction Amount (RM)' AS names, ',' AS sep""")
def detect_header_row(spark, sf):
    found = probe.probe_delimited(spark, _write_report(spark, sf))
    return found.select("header_row", F.array_join("names", "|").alias("names"), "sep").distinct()


@query("sniff_dialect", "SELECT * FROM (VALUES (';', '\"'), ('|', '\"'), (chr(9), '\"')) AS t(sep, quote)")
def sniff_dialect(spark, sf):
    customers = table(spark, sf, "customer").withColumn("c_name", F.concat(F.lit('say "hi", '), "c_name"))
    found = []
    for sep in (";", "|", "\t"):
        path = scratch_dir(spark, "dialect")
        writers.write_csv(customers, path, sep=sep)
        found.append(probe.probe_delimited(spark, path).select("sep", "quote").distinct())
    return readers.union_all(found)


@query("promote_header", """
SELECT CAST(p_partkey AS bigint) AS no, p_name AS type, p_brand AS brand, CAST(p_size AS bigint) AS size, p_retailprice AS amount FROM part""")
def promote_header(spark, sf):
    part = table(spark, sf, "part")
    body = part.select(
        (F.col("p_partkey") + 1).alias("_row"), F.col("p_partkey").cast("string").alias("c0"), F.col("p_name").alias("c1"),
        F.col("p_brand").alias("c2"), F.col("p_size").cast("string").alias("c3"), F.col("p_retailprice").cast("string").alias("c4"))
    names = part.limit(1).select(
        F.lit(-1).cast("bigint").alias("_row"), *[F.lit(n).alias(f"c{i}") for i, n in enumerate(("no", "type", "brand", "size", "amount"))])
    return readers.promote_header(names.unionByName(body), order=["_row"])


@query("scan_parquet", "SELECT * FROM orders")
def scan_parquet(spark, sf):
    return readers.scan_parquet(spark, f"{sf}/orders.parquet")


@query("scan_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def scan_json(spark, sf):
    path = scratch_dir(spark, "events-json")
    writers.write_json(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return readers.scan_json(spark, path, schema="event_id bigint, user_id bigint, event_type string, value double, props string")


@query("scan_any", """
SELECT 'csv' AS kind, CAST(count(*) AS bigint) AS rows, round(sum(c_acctbal), 2) AS total FROM customer
UNION ALL SELECT 'json', count(*), round(sum(s_acctbal), 2) FROM supplier
UNION ALL SELECT 'parquet', count(*), round(sum(p_retailprice), 2) FROM part
UNION ALL SELECT 'error: unsupported file type: .orc', 1, NULL""")
def scan_any(spark, sf):
    base = scratch_dir(spark, "any")
    writers.write_csv(table(spark, sf, "customer"), f"{base}/a")
    writers.write_json(table(spark, sf, "supplier"), f"{base}/b")
    table(spark, sf, "part").write.parquet(f"{base}/c")
    table(spark, sf, "region").select("r_regionkey", "r_name").write.orc(f"{base}/d")
    paths = {"csv": (f"{base}/a", "c_acctbal"), "json": (f"{base}/b", "s_acctbal"), "parquet": (f"{base}/c", "p_retailprice")}
    scan = readers.scan_any(spark, [*(p for p, _ in paths.values()), f"{base}/d"])
    found = [
        scan.tables[p].agg(F.count("*").alias("rows"), F.round(F.sum(F.col(c).cast("double")), 2).alias("total")).withColumn("kind", F.lit(k))
        for k, (p, c) in paths.items()
    ]
    errors = scan.errors.select(F.concat(F.lit("error: "), "error").alias("kind"), F.lit(1).cast("bigint").alias("rows"))
    return readers.union_all([*found, errors])


@query("scan_multi", """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customers' AS _sheet_name, 1 AS table_num FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, 'suppliers', 2 FROM supplier""")
def scan_multi(spark, sf):
    sheets = {
        "customers": table(spark, sf, "customer").selectExpr("c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"),
        "suppliers": table(spark, sf, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance"),
        "parts": table(spark, sf, "part").selectExpr("p_name AS name"),
    }
    return readers.scan_multi(sheets, only=["customers", "suppliers"], label="_sheet_name")


@query("file_catalog", """
SELECT '.csv' AS file_type, count(*) AS rows, 5 AS columns,
  'c_custkey:int64,c_name:object,c_nationkey:int64,c_acctbal:float64,c_mktsegment:object' AS types FROM customer
UNION ALL SELECT '.json', count(*), 2, 's_name:object,s_suppkey:int64' FROM supplier
UNION ALL SELECT '.parquet', count(*), 2, 'p_partkey:int64,p_name:object' FROM part""")
def file_catalog(spark, sf):
    base = scratch_dir(spark, "catalog")
    writers.write_csv(table(spark, sf, "customer"), f"{base}/a")
    writers.write_json(table(spark, sf, "supplier").select("s_suppkey", "s_name"), f"{base}/b")
    table(spark, sf, "part").select("p_partkey", "p_name").write.parquet(f"{base}/c")
    listed, _ = catalog.file_catalog(spark, base, order_by="size")
    return listed.groupBy("file_type", "columns", "types").agg(F.sum("rows").alias("rows"))


@query("scan_conversations", """
SELECT 'c' || conv_id AS conversation_id, CAST(turn AS int) AS turn, role, text AS content FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def scan_conversations(spark, sf):
    """Conversations with a system message are written cut off, as damaged documents."""
    talks = table(spark, sf, "conversations")
    documents = talks.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"),
        F.max(F.col("role") == "system").alias("damaged"))
    line = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id")).alias("conversation_id"), "messages"))
    path = scratch_dir(spark, "conversations")
    documents.select(F.when(F.col("damaged"), F.substring(line, 1, 40)).otherwise(line)).write.text(path)
    good, _ = conversations.scan_conversations(spark, path, multi_line=False)
    return good.select("conversation_id", "turn", "role", "content")


@query("quarantine_rows", """
SELECT c_custkey || ',' || c_name || ',' || c_acctbal || ',surplus' AS raw, 'too many cells' AS error FROM customer WHERE c_acctbal < 0""")
def quarantine_rows(spark, sf):
    customers = table(spark, sf, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"),
                       F.when(F.col("c_acctbal") < 0, F.lit("surplus")))
    path = scratch_dir(spark, "bad-rows")
    # Ready-made lines under a header line: one column, written without quoting.
    customers.select(line.alias("c_custkey,c_name,c_acctbal")).write.options(header=True, quote="", sep="\u0001").csv(path)
    return readers.quarantine_rows(readers.scan_csv(spark, path))[1].select("raw", "error")


@query("write_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def write_csv(spark, sf):
    path = scratch_dir(spark, "csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    writers.write_csv(orders, path, history=scratch_dir(spark, "export-history"))
    return spark.read.schema(orders.schema).options(header=True, escape='"').csv(path)


@query("write_json", "SELECT doc_id, text, nullif(lang, 'de') AS lang FROM documents")
def write_json(spark, sf):
    path = scratch_dir(spark, "json")
    documents = table(spark, sf, "documents").selectExpr("doc_id", "text", "nullif(lang, 'de') AS lang")
    writers.write_json(documents, path)
    return spark.read.schema(documents.schema).json(path)


@query("split_output", "SELECT count(*) AS rows, true AS all_within_limit, true AS enough_files FROM orders")
def split_output(spark, sf):
    path = scratch_dir(spark, "split")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    writers.split_output(orders, path, 4000)
    sizes = (
        spark.read.schema(orders.schema).options(header=True).csv(path)
        .groupBy(file_name(F.col("_metadata.file_path")).alias("file")).agg(F.count("*").alias("n"))
    )
    return sizes.agg(
        F.sum("n").alias("rows"), (F.max("n") <= 4000).alias("all_within_limit"), (F.count("*") >= F.ceil(F.sum("n") / 4000)).alias("enough_files"))


@query("write_table", """
SELECT * FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def write_table(spark, sf):
    name = f"landed_{uuid.uuid4().hex[:12]}"
    path = scratch_dir(spark, name)
    writers.write_table(table(spark, sf, "customer"), name, path=path, primary_keys=("c_custkey",))
    suppliers = table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS c_custkey", "s_name AS c_name", "s_nationkey AS c_nationkey", "s_acctbal AS c_acctbal", "CAST(NULL AS string) AS c_mktsegment")
    writers.write_table(suppliers, name, path=path)
    return spark.table(name)


@query("validate_export", """
SELECT "column", (SELECT count(*) FROM customer) AS rows, (SELECT count(*) FROM customer) AS rows_written, true AS is_same
FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment')) AS t("column")""")
def validate_export(spark, sf):
    path = scratch_dir(spark, "validated")
    customers = table(spark, sf, "customer")
    writers.write_csv(customers, path)
    return writers.validate_export(customers, path).select("column", "rows", "rows_written", "is_same")
