"""Column and table statistics, quality."""

from __future__ import annotations


from tallyloom.operators import profile, quality
from tallyloom.plans.registry import query, table, union_sql

# Order lines with NULLs and a column of mixed content.
_LINES = [
    "l_linenumber", "l_quantity", "l_extendedprice", "nullif(l_discount, 0) AS l_discount", "nullif(l_tax, 0) AS l_tax",
    "l_returnflag", "nullif(l_linestatus, 'O') AS l_linestatus",
    "CASE WHEN l_linenumber > 5 THEN CAST(l_partkey AS {text}) ELSE l_returnflag || '-' || l_linestatus END AS note",
    "CASE WHEN l_returnflag <> 'A' THEN l_shipdate END AS l_shipdate",
]
_SQL = f"SELECT {', '.join(_LINES)} FROM lineitem".format(text="varchar")
_WITH = f"t AS ({_SQL})"
_NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_TEXT = ["l_returnflag", "l_linestatus", "note"]
_TYPES = {"l_linenumber": "int64", "l_shipdate": "datetime64[ns]", **{c: "float64" for c in _NUMERIC[1:]}, **{c: "object" for c in _TEXT}}
_COLUMNS = [*_NUMERIC, *_TEXT, "l_shipdate"]


def lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[e.format(text="string") for e in _LINES])


def _number(c, sql):
    return sql.format(c=c) if c in _NUMERIC else "CAST(NULL AS double)"


def _top(c, k, digits_expr):
    return f"""(SELECT string_agg(v || '=' || {digits_expr}, '|' ORDER BY n DESC, v) FROM (
      SELECT CAST({c} AS varchar) AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {k}))"""


def _column_statistics_sql(c):
    is_text = c in _TEXT
    categorical = f"count(DISTINCT {c}) / count(*)::double < 0.1" if is_text else "CAST(NULL AS boolean)"
    top = "CAST(NULL AS varchar)"
    if is_text:
        shares = f"format('{{:.4f}}', n / (SELECT count({c}) FROM t)::double)"
        top = f"CASE WHEN count(DISTINCT {c}) / count(*)::double < 0.1 THEN {_top(c, 5, shares)} END"
    return f"""SELECT '{c}' AS "column", '{_TYPES[c]}' AS type, count(*) AS row_count, count({c}) AS count,
  count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / count(*)::double, 6) AS missing_ratio,
  count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / count(*)::double, 6) AS unique_ratio,
  {_number(c, 'CAST(min({c}) AS double)')} AS min, {_number(c, 'CAST(max({c}) AS double)')} AS max,
  {_number(c, 'round(avg({c}), 6)')} AS mean, {_number(c, 'round(quantile_cont({c}, 0.5), 6)')} AS median,
  {_number(c, 'round(stddev_samp({c}), 6)')} AS std, {_number(c, 'round(CAST(sum({c}) AS double), 2)')} AS sum,
  {categorical} AS appears_categorical, {top} AS top_categories FROM t"""


@query("column_statistics", f"WITH {_WITH}\n" + union_sql([_column_statistics_sql(c) for c in _COLUMNS]))
def column_statistics(spark, sf):
    return profile.column_statistics(lines(spark, sf))


def _outliers(c):
    return (f"(SELECT count(*) FROM t, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM t) q "
            f"WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))")


@query("profile_numeric", f"WITH {_WITH}\n" + union_sql([f"""
SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count({c}) AS count,
  CAST(min({c}) AS double) AS min, CAST(max({c}) AS double) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  {_outliers(c)} AS outlier_count,
  round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3,
  round({_outliers(c)} * 100 / count({c})::double, 6) AS outlier_percentage FROM t""" for c in _NUMERIC]))
def profile_numeric(spark, sf):
    return profile.profile_numeric(lines(spark, sf))


@query("profile_numeric_bracketed", """
SELECT "column", count(v) AS count, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q3
FROM (SELECT 'l_extendedprice' AS "column", l_extendedprice AS v FROM lineitem
      UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem) GROUP BY 1""")
def profile_numeric_bracketed(spark, sf):
    """The quartiles again on the path for tables of any size (sketch, count, narrow)."""
    found = profile.profile_numeric(
        table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity"), accuracy=256)
    return found.select("column", "count", "q1", "median", "q3")


_DOC_COLUMNS = {"text": "text", "lang": "nullif(lang, 'de')", "source": "source"}
_DOCS = "t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _DOC_COLUMNS.items()) + " FROM documents)"


def documents(spark, sf):
    return table(spark, sf, "documents").selectExpr(*[f"{e} AS {c}" for c, e in _DOC_COLUMNS.items()])


def _profile_string_sql(c):
    percent = f"format('{{:,.4f}}', n * 100 / (SELECT count({c}) FROM t)::double)"
    return f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count({c}) AS count,
  CAST(min(length({c})) AS int) AS min_length, CAST(max(length({c})) AS int) AS max_length,
  round(avg(length({c})), 6) AS avg_length, count(DISTINCT {c}) AS unique_count,
  round(count(DISTINCT {c}) * 100 / count({c})::double, 6) AS unique_percentage,
  CASE WHEN count(DISTINCT {c}) < 100 THEN {_top(c, 10, percent)} END AS top_values FROM t"""


@query("profile_string", f"WITH {_DOCS}\n" + union_sql([_profile_string_sql(c) for c in _DOC_COLUMNS]))
def profile_string(spark, sf):
    return profile.profile_string(documents(spark, sf))


def _profile_datetime_sql(c, source):
    months = ", ".join(
        f"CASE WHEN count(*) FILTER (month({c}) = {m}) > 0 THEN '{m}=' || "
        f"format('{{:,.4f}}', count(*) FILTER (month({c}) = {m}) * 100 / count({c})::double) END" for m in range(1, 13))
    return f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count({c}) AS count,
  min({c}) AS "first", max({c}) AS "last", bool_or(isodow({c}) >= 6) AS has_weekend_dates,
  round((epoch_us(max({c})) - epoch_us(min({c}))) / 1000000 / 86400, 6) AS range_days, concat_ws('|', {months}) AS month_shares
FROM ({source})"""


_STAMPS = """SELECT ts, date_trunc('week', ts) AS week_start, CASE WHEN event_type <> 'error' THEN ts END AS ok_ts FROM events"""


@query("profile_datetime", union_sql([_profile_datetime_sql(c, _STAMPS) for c in ("ts", "week_start", "ok_ts")]))
def profile_datetime(spark, sf):
    stamps = table(spark, sf, "events").selectExpr(
        "ts", "CAST(date_trunc('week', ts) AS timestamp_ntz) AS week_start", "CASE WHEN event_type <> 'error' THEN ts END AS ok_ts")
    return profile.profile_datetime(stamps)


def _table_profile_sql(c, kind):
    numeric, text = kind == "numeric", kind == "categorical"

    def only(flag, sql, none="CAST(NULL AS double)"):
        return sql if flag else none

    top = f"(SELECT {{}} FROM (SELECT {c} AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1))"
    return f"""SELECT '{c}' AS "column", '{kind}' AS class, count(*) AS rows,
  round((count(*) - count({c})) * 100 / count(*)::double, 6) AS missing_pct,
  {only(numeric, f'round(avg({c}), 6)')} AS mean, {only(numeric, f'round(quantile_cont({c}, 0.5), 6)')} AS median,
  {only(numeric, f'round(stddev_samp({c}), 6)')} AS std, {only(numeric, f'CAST(min({c}) AS double)')} AS min,
  {only(numeric, f'CAST(max({c}) AS double)')} AS max, {only(text, f'count(DISTINCT {c})', 'CAST(NULL AS bigint)')} AS unique_count,
  {only(text, top.format('v'), 'CAST(NULL AS varchar)')} AS top_value, {only(text, top.format('n'), 'CAST(NULL AS bigint)')} AS top_count,
  CAST(NULL AS double) AS duplicate_pct FROM t"""


_CLASSES = {**{c: "numeric" for c in _NUMERIC}, **{c: "categorical" for c in _TEXT}, "l_shipdate": "datetime"}
_LIST = ", ".join(_COLUMNS)


@query("table_profile", f"WITH {_WITH}\n" + union_sql([_table_profile_sql(c, k) for c, k in _CLASSES.items()] + [f"""
SELECT '(table)', 'numeric=5,categorical=3,datetime=1,boolean=0,other=0', count(*),
  round((""" + " + ".join(f"(count(*) - count({c})) * 100 / count(*)::double" for c in _COLUMNS) + f""") / {len(_COLUMNS)}, 6),
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_LIST} FROM t))) * 100 / count(*)::double, 6) FROM t"""]))
def table_profile(spark, sf):
    return profile.table_profile(lines(spark, sf))


_NULLS = f"n AS (" + union_sql([
    f"""SELECT '{c}' AS "column", count(*) AS cells, count(*) - count({c}) AS nulls FROM t""" for c in _COLUMNS]) + ")"


@query("null_report", f"""
WITH {_WITH}, {_NULLS},
g AS (SELECT * FROM n UNION ALL SELECT '(table)', CAST(sum(cells) AS bigint), CAST(sum(nulls) AS bigint) FROM n)
SELECT *, round(nulls * 100 / cells::double, 6) AS null_percent, round(1.0 - nulls / cells::double, 6) AS completeness FROM g""")
def null_report(spark, sf):
    return profile.null_report(lines(spark, sf))


@query("null_issue_rows", f"""
WITH {_WITH}, {_NULLS}
SELECT 'null_values' AS type, "column", nulls AS count, round(nulls * 100 / cells::double, 6) AS percentage FROM n WHERE nulls > 0""")
def null_issue_rows(spark, sf):
    return quality.null_issue_rows(lines(spark, sf))


@query("duplicate_rows", f"""
WITH {_DOCS}, d AS (SELECT DISTINCT * FROM t)
SELECT (SELECT count(*) FROM t) AS rows, (SELECT count(*) FROM t) - (SELECT count(*) FROM d) AS duplicates,
  round(((SELECT count(*) FROM t) - (SELECT count(*) FROM d)) * 100 / (SELECT count(*) FROM t)::double, 6) AS duplicate_percent""")
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(documents(spark, sf))


@query("value_counts", """
SELECT p_name AS value, count(*) AS rows, round(count(*) / (SELECT count(p_name) FROM part)::double, 6) AS share
FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def value_counts(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), "p_name", 10)


@query("histogram", """
WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w,
             avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS int), 29) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
SELECT CAST(r.bin AS int) AS bin, round(lo + r.bin * w, 6) AS bin_start, round(lo + (r.bin + 1) * w, 6) AS bin_end,
  coalesce(n, 0) AS rows, round(mean, 6) AS mean, round(median, 6) AS median
FROM range(30) r(bin) LEFT JOIN c ON c.bin = r.bin, s""")
def histogram(spark, sf):
    return profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)


@query("describe", union_sql([f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  CAST(min({c}) AS double) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS q3, CAST(max({c}) AS double) AS max FROM part"""
    for c in ("p_partkey", "p_size", "p_retailprice")]))
def describe(spark, sf):
    return profile.describe(table(spark, sf, "part"))


@query("outlier_rows", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM q),
o AS (SELECT event_id, event_type, value, lo, hi, n FROM events, b WHERE value < lo OR value > hi)
SELECT event_id, event_type, value, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
  round((SELECT count(*) FROM o) * 100.0 / n, 6) AS outlier_percent FROM o""")
def outlier_rows(spark, sf):
    return profile.outlier_rows(table(spark, sf, "events").select("event_id", "event_type", "value"), "value")


_PAIRS = [(a, b) for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]]


@query("correlation_matrix", f"WITH {_WITH}\nSELECT column_a, column_b, CASE WHEN abs(r) >= 0.001 THEN r END AS correlation FROM (" + union_sql([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM t" for a, b in _PAIRS]) + ")")
def correlation_matrix(spark, sf):
    return profile.correlation_matrix(lines(spark, sf).select(*_NUMERIC), threshold=0.001)


# Forty columns of whole numbers, a seventh of each NULL.
_WIDE = {
    f"x{i}": f"CASE WHEN l_linenumber % 7 <> {i % 7} THEN (l_orderkey * {2 * i + 1} + l_partkey * {i % 5} + l_linenumber) % {11 + i} END" for i in range(40)}
_WIDE_PAIRS = [(a, b) for i, a in enumerate(_WIDE) for b in list(_WIDE)[i + 1:]]


@query("correlation_matrix_wide", "WITH t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + """ FROM lineitem),
w AS (SELECT [""" + ",\n".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr({a}, {b})}}" for a, b in _WIDE_PAIRS) + """] AS pairs FROM t),
p AS (SELECT unnest(pairs) AS p FROM w)
SELECT p.a AS column_a, p.b AS column_b, CASE WHEN NOT isnan(p.r) THEN round(p.r, 6) END AS correlation FROM p""")
def correlation_matrix_wide(spark, sf):
    return profile.correlation_matrix(table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()]))


_CHARGES = "SELECT l_quantity, l_extendedprice, l_extendedprice * (1 + l_tax) AS charge, l_quantity * -2 AS taken, l_linenumber, l_orderkey FROM lineitem"


@query("high_correlation", f"WITH t AS ({_CHARGES})\nSELECT * FROM (" + union_sql([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM t"
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "charge"), ("l_quantity", "taken"),
                 ("l_extendedprice", "charge"), ("l_extendedprice", "taken"), ("charge", "taken"))]) + ") WHERE abs(correlation) > 0.9")
def high_correlation(spark, sf):
    charges = table(spark, sf, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_extendedprice * (1 + l_tax) AS charge", "l_quantity * -2 AS taken", "l_linenumber", "l_orderkey")
    return profile.high_correlation(charges)


@query("duplicate_columns", """
WITH t AS (SELECT nullif(c_mktsegment, 'BUILDING') AS segment, c_name AS name, nullif(c_mktsegment, 'BUILDING') AS segment_copy, c_mktsegment AS raw FROM customer)
SELECT * FROM (SELECT 'segment' AS column_a, 'name' AS column_b, count(*) FILTER (segment IS DISTINCT FROM name) AS d FROM t
  UNION ALL SELECT 'segment', 'segment_copy', count(*) FILTER (segment IS DISTINCT FROM segment_copy) FROM t
  UNION ALL SELECT 'segment', 'raw', count(*) FILTER (segment IS DISTINCT FROM raw) FROM t) WHERE d = 0""".replace("SELECT * FROM (SELECT 'segment'", "SELECT column_a, column_b FROM (SELECT 'segment'"))
def duplicate_columns(spark, sf):
    return profile.duplicate_columns(table(spark, sf, "customer").selectExpr(
        "nullif(c_mktsegment, 'BUILDING') AS segment", "c_name AS name",
        "nullif(c_mktsegment, 'BUILDING') AS segment_copy", "c_mktsegment AS raw"))


def _minority(c):
    return (f"least(count(*) FILTER (regexp_matches({c}, '^[0-9]+$')), "
            f"count(*) FILTER (NOT regexp_matches({c}, '^[0-9]+$')))")


@query("mixed_types", f"WITH {_WITH}\n" + union_sql([f"""
SELECT '{c}' AS "column", count(*) FILTER (regexp_matches({c}, '^[0-9]+$')) AS digit_values,
  count(*) FILTER (NOT regexp_matches({c}, '^[0-9]+$')) AS other_values,
  round({_minority(c)} / count({c})::double, 6) AS minority_ratio, {_minority(c)} / count({c})::double > 0.05 AS is_mixed FROM t"""
    for c in _TEXT]))
def mixed_types(spark, sf):
    return quality.mixed_types(lines(spark, sf))


_CASED = """SELECT CASE WHEN p_size < 10 THEN upper(p_name) WHEN p_size < 20 THEN 'Red Ring' ELSE p_name END AS mixed,
  p_name AS plain, p_brand AS brand, upper(p_type) AS kind FROM part"""


def _casing_sql(c, source):
    return f"""
SELECT '{c}' AS "column", bool_or({c} = lower({c}) AND lower({c}) <> upper({c})) AS any_lower,
  bool_or({c} = upper({c}) AND lower({c}) <> upper({c})) AS any_upper,
  bool_or(lower({c}) <> upper({c}) AND NOT regexp_matches({c}, '\\p{{L}}\\p{{Lu}}')
    AND NOT regexp_matches({c}, '(^|[^\\p{{L}}])\\p{{Ll}}')) AS any_title FROM {source}"""


@query("inconsistent_case", f"WITH p AS ({_CASED})\nSELECT *, any_lower AND any_upper AND any_title AS is_inconsistent FROM ("
       + union_sql([_casing_sql(c, "p") for c in ("mixed", "plain", "brand", "kind")]) + ")")
def inconsistent_case(spark, sf):
    return quality.inconsistent_case(table(spark, sf, "part").selectExpr(
        "CASE WHEN p_size < 10 THEN upper(p_name) WHEN p_size < 20 THEN 'Red Ring' ELSE p_name END AS mixed",
        "p_name AS plain", "p_brand AS brand", "upper(p_type) AS kind"))


_R = "r AS (" + union_sql([f"""
SELECT '{c}' AS "column", (count(*) - count({c})) / count(*)::double AS null_ratio,
  {f'{_outliers(c)} / count({c})::double' if c in _NUMERIC else 'CAST(NULL AS double)'} AS outlier_ratio,
  count(DISTINCT {c}) / count({c})::double AS uniqueness,
  {f'{_minority(c)} / count({c})::double' if c in _TEXT else 'CAST(NULL AS double)'} AS mixed_ratio FROM t""" for c in _COLUMNS]) + ")"


def _severity(ratio, medium, high):
    return f"CASE WHEN {ratio} > {high} THEN 'high' WHEN {ratio} > {medium} THEN 'medium' ELSE 'low' END"


@query("quality_scorecard", f"""
WITH {_WITH}, {_R},
s AS (SELECT 1.0 - avg(null_ratio) AS completeness, avg(1.0 - outlier_ratio) AS validity, avg(uniqueness) AS uniqueness,
        1.0 - avg(coalesce(mixed_ratio > 0.05, false)::int) AS consistency FROM r)
""" + union_sql([f"SELECT 'score' AS item, '{n}' AS name, CAST(NULL AS varchar) AS \"column\", round({e}, 6) AS value, CAST(NULL AS varchar) AS severity FROM s"
                 for n, e in (("completeness", "completeness"), ("validity", "validity"), ("uniqueness", "uniqueness"),
                              ("consistency", "consistency"), ("overall", "(completeness + validity + uniqueness + consistency) / 4"))] + [
    f"SELECT 'issue', '{n}', \"column\", round({c} * 100, 6), {_severity(c, m, h)} FROM r WHERE {c} > {flag}"
    for n, c, flag, m, h in (("high_null_percentage", "null_ratio", 0.1, 0.2, 0.5), ("high_outlier_percentage", "outlier_ratio", 0.05, 0.1, 0.2),
                             ("mixed_data_types", "mixed_ratio", 0.05, 0.1, 0.2))]))
def quality_scorecard(spark, sf):
    return quality.quality_scorecard(lines(spark, sf))


@query("quality_score_simple", f"""
WITH {_WITH}, {_NULLS},
f AS (SELECT 1.0 - sum(nulls) / sum(cells)::double AS completeness, count(*) FILTER (nulls / cells::double > 0.5) AS columns_mostly_missing,
        count(*) AS columns FROM n)
SELECT round(completeness, 6) AS completeness, columns_mostly_missing,
  CASE WHEN completeness < 0.7 THEN 'high_missing_data' WHEN columns_mostly_missing > columns * 0.5 THEN 'moderate_missing_data' END AS issue,
  round(greatest(0.3, completeness - CASE WHEN completeness < 0.7 OR columns_mostly_missing > columns * 0.5 THEN 0.05 ELSE 0 END), 6) AS score
FROM f""")
def quality_score_simple(spark, sf):
    return quality.quality_score_simple(lines(spark, sf))


def _side_sql(name, types, source):
    return [f"""SELECT '{name}' AS "table", '{c}' AS "column", '{t}' AS type, count({c}) AS non_null,
      count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS unique_count FROM {source}""" for c, t in types.items()]


@query("side_by_side", union_sql(
    _side_sql("customer", {"c_custkey": "int64", "c_name": "object", "c_nationkey": "int64", "c_acctbal": "float64", "c_mktsegment": "object"}, "customer")
    + _side_sql("supplier", {"s_suppkey": "int64", "s_name": "object", "s_nationkey": "int64", "s_acctbal": "float64"}, "supplier")))
def side_by_side(spark, sf):
    return profile.side_by_side(table(spark, sf, "customer"), table(spark, sf, "supplier"), "customer", "supplier")


@query("cleaning_recommendations", f"""
WITH {_DOCS}, p AS ({_CASED}),
o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS order_date, CASE WHEN o_orderstatus = 'P' THEN 'later' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ship_date FROM orders)
SELECT 'documents' AS "table", 'missing_values' AS type, 'lang' AS columns, CAST(1 AS bigint) AS found WHERE EXISTS (SELECT 1 FROM t WHERE lang IS NULL)
UNION ALL SELECT 'documents', 'duplicates', '', n FROM (SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n) WHERE n > 0
UNION ALL SELECT 'parts', 'duplicates', '', n FROM (SELECT (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS n) WHERE n > 0
UNION ALL SELECT "table", 'inconsistent_formatting', "column", 1 FROM (
""" + union_sql([f"SELECT '{t}' AS \"table\", * FROM ({_casing_sql(c, s)})" for t, s, columns in (
    ("documents", "t", _DOC_COLUMNS), ("parts", "p", ("mixed", "plain", "brand", "kind")), ("orders", "o", ("order_date", "ship_date")))
    for c in columns]) + """) WHERE any_lower AND any_upper AND any_title
UNION ALL SELECT 'orders', 'duplicates', '', n FROM (SELECT (SELECT count(*) FROM o) - (SELECT count(*) FROM (SELECT DISTINCT * FROM o)) AS n) WHERE n > 0
UNION ALL SELECT 'orders', 'incorrect_data_type', 'order_date', 1""")
def cleaning_recommendations(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "CASE WHEN p_size < 10 THEN upper(p_name) WHEN p_size < 20 THEN 'Red Ring' ELSE p_name END AS mixed",
        "p_name AS plain", "p_brand AS brand", "upper(p_type) AS kind")
    orders = table(spark, sf, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyy-MM-dd') AS order_date",
        "CASE WHEN o_orderstatus = 'P' THEN 'later' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS ship_date")
    return quality.cleaning_recommendations({"documents": documents(spark, sf), "parts": parts, "orders": orders})
