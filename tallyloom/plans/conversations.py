"""Questions, messages, histories, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.operators import documents, history, messages
from tallyloom.plans.registry import query, table

# Questions asked about orders: the wording follows status and priority.
_QUESTION = """
  CASE o_orderpriority
    WHEN '1-URGENT' THEN 'How many transactions are missing from file ' || o_custkey || ' and what is the total?'
    WHEN '2-HIGH' THEN 'What is the grand TOTAL, or how much is it altogether, of account ' || o_custkey || '?'
    WHEN '3-MEDIUM' THEN 'Match the related and common transactions of customer ' || o_custkey
    WHEN '4-NOT SPECIFIED' THEN 'Please analyze the pattern and logical relation; give a breakdown with insights'
    ELSE 'Hello ' || o_custkey END
  || CASE o_orderstatus WHEN 'F' THEN '. Show the average and the missing count in RM' WHEN 'O' THEN ' - number of records vs entries' ELSE '' END"""


def _questions(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.expr(_QUESTION).alias("question"))


def _intent_sql(tables):
    scores = []
    for intent, patterns in fixed.INTENT_PATTERNS.items():
        hits = []
        for p in patterns:
            if p.endswith(r"(?!.*\bmissing\b)"):
                # No look-ahead in RE2: test the text after the last "missing".
                hits.append(f"regexp_matches(regexp_replace(q, '^.*\\bmissing\\b', ''), '{p.removesuffix('(?!.*' + chr(92) + 'bmissing' + chr(92) + 'b)')}')::int")
            else:
                hits.append(f"regexp_matches(q, '{p}')::int")
        scores.append(f"({' + '.join(hits)}) / {len(patterns)}.0::double AS {intent}")
    names = list(fixed.INTENT_PATTERNS)
    best = f"greatest({', '.join(names)})"
    chosen = " ".join(f"WHEN {n} = best AND best > 0 THEN '{n}'" for n in names)
    weak = "WHEN best < 0.3 THEN 'comparison' " if tables >= 2 else ""
    confidence = "CASE WHEN best < 0.3 THEN 0.5 ELSE best END" if tables >= 2 else "best"
    return f"""
SELECT o_orderkey, question, CASE {weak}{chosen} ELSE 'analysis' END AS intent, round({confidence}, 6) AS confidence
FROM (SELECT *, {best} AS best FROM (SELECT *, {', '.join(scores)} FROM (
  SELECT *, lower(question) AS q FROM (SELECT o_orderkey, {_QUESTION} AS question FROM orders))))"""


@query("classify_intent", _intent_sql(1))
def classify_intent(spark, sf):
    return messages.classify_intent(_questions(spark, sf), "question", tables=1)


@query("classify_intent_two_tables", _intent_sql(2))
def classify_intent_two_tables(spark, sf):
    return messages.classify_intent(_questions(spark, sf), "question", tables=2)


@query("aggregation_kind", f"""
SELECT o_orderkey, CASE WHEN contains(q, 'total') OR contains(q, 'sum') THEN 'sum' WHEN contains(q, 'count') OR contains(q, 'number') THEN 'count'
  WHEN contains(q, 'average') OR contains(q, 'mean') THEN 'mean' ELSE 'sum' END AS kind
FROM (SELECT o_orderkey, lower({_QUESTION}) AS q FROM orders)""")
def aggregation_kind(spark, sf):
    return _questions(spark, sf).select("o_orderkey", messages.aggregation_kind(F.col("question")).alias("kind"))


# Words that occur in the invented texts stand in for the English ones.
_WORDS = ["thing", "avec", "und", "que "]
_DECIDED = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in _WORDS) + ")"
_DECISIONS = f"""
  SELECT conv_id, turn, 'recommendation' AS type, CASE WHEN prev_role = 'user' THEN prev_text ELSE '' END AS question, text AS decision
  FROM (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant' AND {_DECIDED}"""


@query("extract_decisions", _DECISIONS)
def extract_decisions(spark, sf):
    return messages.extract_decisions(table(spark, sf, "conversations"), _WORDS)


@query("audit_trail", f"""
WITH d AS ({_DECISIONS}), c AS (SELECT conv_id, 'Conversation ' || conv_id AS title, count(*) AS messages FROM conversations GROUP BY 1)
SELECT c.conv_id, title, messages, CAST(1 AS bigint) AS part, count(turn) AS decisions,
  coalesce(string_agg(turn || ':' || decision, '|' ORDER BY turn), '') AS decision_list
FROM c LEFT JOIN d ON d.conv_id = c.conv_id GROUP BY ALL""")
def audit_trail(spark, sf):
    talks = table(spark, sf, "conversations")
    about = talks.groupBy("conv_id").agg(F.count("*").alias("messages")).withColumn(
        "title", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))
    trail = messages.audit_trail(talks, about, _WORDS)
    listed = F.from_json("decision_list", "array<struct<turn: bigint, type: string, question: string, decision: string>>")
    return trail.withColumn("decision_list", F.array_join(
        F.transform(listed, lambda d: F.concat_ws(":", d["turn"].cast("string"), d["decision"])), "|"))


@query("recent_n", "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def recent_n(spark, sf):
    return messages.recent_n(table(spark, sf, "conversations"), 2)


@query("compact_history", """
SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3
  OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def compact_history(spark, sf):
    return messages.compact_history(table(spark, sf, "conversations"), keep_last=3)


@query("conversation_summary", """
SELECT conv_id, count(*) AS messages, CAST(floor(sum(length(text)) / 4) AS bigint) AS estimated_tokens,
  min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY 1 DESC""")
def conversation_summary(spark, sf):
    return messages.conversation_summary(table(spark, sf, "conversations"))


_SPEAKER = "upper(substr(role, 1, 1)) || lower(substr(role, 2))"


@query("export_conversation", f"""
SELECT conv_id, CAST(1 AS bigint) AS part, '# Conversation ' || conv_id || chr(10) || chr(10) || '## Messages' || chr(10) || chr(10)
  || string_agg('**' || {_SPEAKER} || ':**' || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY turn) AS document
FROM conversations GROUP BY conv_id""")
def export_conversation(spark, sf):
    return messages.export_conversation(table(spark, sf, "conversations"), "markdown")


@query("export_conversation_html", f"""
SELECT conv_id, CAST(1 AS bigint) AS part, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><title>Conversation ' || conv_id
  || '</title></head>' || chr(10) || '<body>' || chr(10) || '<h1>Conversation ' || conv_id || '</h1>' || chr(10) || '<h2>Messages</h2>' || chr(10)
  || string_agg('<div class="message ' || role || '"><strong>' || {_SPEAKER} || ':</strong><br>' || replace(text, chr(10), '<br>') || '</div>' || chr(10), '' ORDER BY turn)
  || '</body>' || chr(10) || '</html>' || chr(10) AS document
FROM conversations GROUP BY conv_id""")
def export_conversation_html(spark, sf):
    return messages.export_conversation(table(spark, sf, "conversations"), "html")


@query("export_conversation_csv", """
SELECT conv_id, CAST(1 + turn // 2 AS bigint) AS part, CASE WHEN turn // 2 = 0 THEN 'turn,role,content' || chr(10) ELSE '' END
  || string_agg(turn || ',' || role || ',' || CASE WHEN regexp_matches(text, '[",\\r\\n]')
     THEN '"' || replace(text, '"', '""') || '"' ELSE text END, chr(10) ORDER BY turn) || chr(10) AS document
FROM conversations GROUP BY conv_id, turn // 2""")
def export_conversation_csv(spark, sf):
    """In parts of two messages, as a very long conversation would come."""
    return messages.export_conversation(table(spark, sf, "conversations"), "csv", per_part=2)


@query("export_conversation_json", """
SELECT conv_id, CAST(1 AS bigint) AS part, '{"conversation_id":' || conv_id || ',"messages":['
  || string_agg(to_json({'turn': turn, 'role': role, 'content': text}), ',' ORDER BY turn) || ']}' AS document
FROM conversations GROUP BY conv_id""")
def export_conversation_json(spark, sf):
    return messages.export_conversation(table(spark, sf, "conversations"), "json")


_PAIRED = """
  SELECT conv_id, turn, text AS response, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query, role FROM conversations"""


def _any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _how_many(column, words):
    return "(" + " + ".join(f"contains({column}, '{w}')::int" for w in words) + ")"


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({}), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))"


@query("score_responses", f"""
WITH p AS (SELECT conv_id, turn, response, coalesce(query, '') AS query, lower(response) AS low FROM ({_PAIRED}) WHERE role = 'assistant'),
s AS (SELECT conv_id, turn,
  CASE WHEN length(response) BETWEEN length(query) * 2 AND length(query) * 20 THEN 1.0
    WHEN length(response) < length(query) * 2 THEN greatest(0.3, length(response) / (length(query) * 2)::double)
    ELSE greatest(0.5, length(query) * 20 / length(response)::double) END::double AS a,
  least(1.0, CASE WHEN {_any('response', fixed.LIST_MARKERS)} THEN 0.3::double ELSE 0 END
    + CASE WHEN contains(response, chr(10) || chr(10)) OR length(response) - length(replace(response, chr(10), '')) >= 2 THEN 0.3::double ELSE 0 END
    + CASE WHEN {_any('low', fixed.ADVICE_WORDS)} THEN 0.2::double ELSE 0 END
    + CASE WHEN {_any('low', fixed.DATA_WORDS)} THEN 0.2::double ELSE 0 END)::double AS b,
  least(1.0, coalesce(len(list_intersect({_TOKENS.format('query')}, {_TOKENS.format('response')}))
    / nullif(len({_TOKENS.format('query')}), 0)::double, 0) * 2)::double AS c,
  least(1.0, {_how_many('low', fixed.ACTION_WORDS)} / 3.0::double)::double AS d,
  least(1.0, {_how_many('low', fixed.ANALYSIS_TERMS)} / 5.0::double)::double AS e FROM p)
SELECT conv_id, turn, round(a, 6) AS length_score, round(b, 6) AS structure_score, round(c, 6) AS relevance_score,
  round(d, 6) AS action_score, round(e, 6) AS data_score, round((a + b + c + d + e) / 5, 6) AS score FROM s""")
def score_responses(spark, sf):
    from tallyloom.operators.ordered import with_previous

    paired = with_previous(table(spark, sf, "conversations"), ["conv_id"], ["turn"], {"query": F.col("text")})
    answers = paired.where("role = 'assistant'").withColumnRenamed("text", "response")
    return messages.score_responses(answers, "response", "query").drop("role", "response", "query")


# Opening tags marked by chr(1), closing ones by chr(2), in pages without comments, scripts and styles; an element is what follows a chr(1).
_ELEMENTS = r"""regexp_extract_all(regexp_replace(regexp_replace(
  regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'),
  '(?i)(<(?:h[1-6]|p)(?:\s[^>]*)?>)', chr(1) || '\1', 'g'), '(?i)</(?:h[1-6]|p)\s*>', chr(2), 'g'), '\x01([^\x01\x02]*)', 1)"""


@query("heading_counts", f"""
SELECT CAST(substr(e, 3, 1) AS int) AS level, count(*) AS headings FROM (SELECT unnest({_ELEMENTS}) AS e FROM pages)
WHERE trim(regexp_replace(e, '<[^>]*>', '', 'g')) <> '' AND lower(e) LIKE '<h%' GROUP BY 1""")
def heading_counts(spark, sf):
    return documents.heading_counts(documents.html_elements(table(spark, sf, "pages"), "page_id", "html"))


@query("heading_sections", f"""
WITH x AS (SELECT page_id, unnest({_ELEMENTS}) AS e, generate_subscripts({_ELEMENTS}, 1) - 1 AS position FROM pages),
y AS (SELECT page_id, CAST(position AS int) AS position, trim(regexp_replace(e, '<[^>]*>', '', 'g'), ' ') AS text,
        TRY_CAST(substr(e, 3, 1) AS int) AS level FROM x),
z AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN {{'t': text, 'l': level, 'p': position}} END IGNORE NULLS)
        OVER (PARTITION BY page_id ORDER BY position) AS s FROM y WHERE text <> '')
SELECT page_id, position, coalesce(s.t, '') AS heading, coalesce(s.l, 0) AS heading_level, coalesce(s.p, -1) AS heading_position, text
FROM z WHERE level IS NULL""")
def heading_sections(spark, sf):
    elements = documents.html_elements(table(spark, sf, "pages"), "page_id", "html")
    return documents.heading_sections(elements, "page_id")


# ---- histories and retention ------------------------------------------------------

_LATEST = "(SELECT max(ts) - INTERVAL 5 DAY FROM events)"


@query("conversation_history", f"""
SELECT * FROM events WHERE ts < {_LATEST} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 25""")
def conversation_history(spark, sf):
    events = table(spark, sf, "events")
    before = events.agg(F.max("ts") - F.expr("INTERVAL 5 DAYS")).scalar()
    return history.conversation_history(
        events, 25, before=before, session_column="user_id", timestamp="ts", tie_break="event_id")


@query("usage_history", f"""
SELECT * FROM events WHERE ts BETWEEN (SELECT min(ts) + INTERVAL 3 DAY FROM events) AND {_LATEST} ORDER BY user_id, ts""")
def usage_history(spark, sf):
    events = table(spark, sf, "events")
    start = events.agg(F.min("ts") + F.expr("INTERVAL 3 DAYS")).scalar()
    end = events.agg(F.max("ts") - F.expr("INTERVAL 5 DAYS")).scalar()
    return history.usage_history(events, start, end, session_column="user_id", timestamp="ts")


@query("file_history", "SELECT * FROM orders ORDER BY o_custkey, o_orderdate DESC")
def file_history(spark, sf):
    return history.file_history(table(spark, sf, "orders"), file_column="o_custkey", started="o_orderdate")


_CUTOFF = "(SELECT max(ts) - INTERVAL 7 DAY FROM events)"


@query("retention_cleanup", f"""
SELECT count(*) FILTER (ts < {_CUTOFF}) AS removed, count(*) FILTER (ts >= {_CUTOFF}) AS kept FROM events""")
def retention_cleanup(spark, sf):
    events = table(spark, sf, "events")
    cutoff = events.agg(F.max("ts") - F.expr("INTERVAL 7 DAYS")).scalar()
    return history.retention_cleanup(events, "ts", cutoff)[1]


@query("retention_cleanup_rows", f"SELECT * FROM events WHERE ts >= {_CUTOFF}")
def retention_cleanup_rows(spark, sf):
    events = table(spark, sf, "events")
    cutoff = events.agg(F.max("ts") - F.expr("INTERVAL 7 DAYS")).scalar()
    return history.retention_cleanup(events, "ts", cutoff)[0]


@query("keep_recent_items", """
SELECT event_id, ts FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) > 500""")
def keep_recent_items(spark, sf):
    removed = history.keep_recent_items(table(spark, sf, "events"), 500, "ts", "event_id")[1]
    return removed.select("event_id", "ts")


_EVENTS = "SELECT user_id AS id, event_type AS status, ts AS updated_at, event_id FROM events"


@query("upsert_latest", f"""
SELECT * FROM ({_EVENTS} WHERE event_type <> 'purchase' UNION ALL {_EVENTS} WHERE event_type = 'purchase')
QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, event_id DESC) = 1""")
def upsert_latest(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id AS id", "event_type AS status", "ts AS updated_at", "event_id")
    return history.upsert_latest(rows.where("status <> 'purchase'"), rows.where("status = 'purchase'"), "id", "updated_at")
