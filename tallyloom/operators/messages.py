"""Questions, answers and conversations held as tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import col, contains_any, count_contained, null_safe_join, share
from tallyloom.operators.ordered import first_per_group, with_previous, with_row_number


# ---- questions -------------------------------------------------------------

def needed_word(pattern: str) -> str | None:
    """A word every match of the pattern must contain, if one is plain to see.

    Only words right after a word boundary, outside of groups, count; the last
    letter goes if it is optional.
    """
    plain = pattern
    while (shorter := re.sub(r"\([^()]*\)[?*]?", "()", plain.replace("()", ""))) != plain and "(" in plain:
        plain = shorter
    if "|" in plain:
        return None
    words = [w[:-1] if optional else w for w, optional in re.findall(r"\\b([a-z]{3,})([?*{]?)", plain)]
    return max(words, key=len, default=None)


def matches(text: Column, pattern: str) -> Column:
    """``rlike`` with a cheap look for the needed word first."""
    word = needed_word(pattern)
    return text.contains(word) & text.rlike(pattern) if word else text.rlike(pattern)


def classify_intent(df: DataFrame, question: str, tables: int = 2,
                    patterns: Mapping[str, list[str]] = fixed.INTENT_PATTERNS) -> DataFrame:
    """Add ``intent`` and ``confidence``: the intent with the largest share of matching patterns.

    The first intent wins a tie. A weak best with two or more tables at hand
    means a comparison; no match at all means analysis. The scores are a step
    of their own, so that every pattern runs once per question.
    """
    text = F.col("_text")
    scores = F.array(*[
        sum((matches(text, p).cast("int") for p in listed), F.lit(0)) / F.lit(float(len(listed)))
        for listed in patterns.values()
    ])
    scored = (
        df.withColumn("_text", F.lower(F.coalesce(col(question), F.lit(""))))
        .withColumn("_scores", scores).withColumn("_best", F.array_max("_scores"))
    )
    names = F.array(*[F.lit(n) for n in patterns])
    best = F.col("_best")
    intent = F.when(best > 0, F.element_at(names, F.array_position("_scores", best).cast("int"))).otherwise("analysis")
    confidence = best
    if tables >= 2:
        weak = best < fixed.INTENT_FLOOR
        intent = F.when(weak, F.lit("comparison")).otherwise(intent)
        confidence = F.when(weak, F.lit(fixed.INTENT_FALLBACK_CONFIDENCE)).otherwise(best)
    return scored.withColumns({"intent": intent, "confidence": F.round(confidence, 6)}).drop("_text", "_scores", "_best")


def aggregation_kind(question: Column) -> Column:
    """sum / count / mean by the words of the question; sum if none."""
    text = F.lower(question)
    result = F.lit("sum")
    for name, words in reversed(fixed.AGGREGATION_WORDS.items()):
        result = F.when(contains_any(text, words), F.lit(name)).otherwise(result)
    return result


# ---- responses ---------------------------------------------------------------

def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def score_responses(df: DataFrame, response: str, query: str, data_context: bool = True) -> DataFrame:
    """Add the part scores and their mean ``score`` (0 to 1).

    Parts: length fit, structure, overlap with the words of the query,
    actionability and, with a data context, data terms.
    """
    answer, asked = F.coalesce(col(response), F.lit("")), F.coalesce(col(query), F.lit(""))
    lower = F.lower(answer)
    size, low, high = F.length(answer), F.length(asked) * 2, F.length(asked) * 20
    length_fit = (
        F.when(size.between(low, high), F.lit(1.0))
        .when(size < low, F.greatest(F.lit(0.3), share(size, low)))
        .otherwise(F.greatest(F.lit(0.5), share(high, size)))
    )
    line_breaks = F.length(answer) - F.length(F.replace(answer, F.lit("\n"), F.lit("")))
    structure = F.least(F.lit(1.0), (
        F.when(contains_any(answer, fixed.LIST_MARKERS), 0.3).otherwise(0.0)
        + F.when(answer.contains("\n\n") | (line_breaks >= 2), 0.3).otherwise(0.0)
        + F.when(contains_any(lower, fixed.ADVICE_WORDS), 0.2).otherwise(0.0)
        + F.when(contains_any(lower, fixed.DATA_WORDS), 0.2).otherwise(0.0)))
    asked_words = _words(asked)
    shared = F.size(F.array_intersect(asked_words, _words(answer)))
    relevance = F.least(F.lit(1.0), F.coalesce(share(shared, F.size(asked_words)), F.lit(0.0)) * 2)
    parts = {
        "length_score": length_fit, "structure_score": structure, "relevance_score": relevance,
        "action_score": F.least(F.lit(1.0), count_contained(lower, fixed.ACTION_WORDS) / F.lit(3.0)),
    }
    if data_context:
        parts["data_score"] = F.least(F.lit(1.0), count_contained(lower, fixed.ANALYSIS_TERMS) / F.lit(5.0))
    scored = df.withColumns({n: F.round(e, 6) for n, e in parts.items()})
    return scored.withColumn("score", F.round(sum(parts.values(), F.lit(0.0)) / F.lit(float(len(parts))), 6))


def best_response(df: DataFrame, query_key: str, success: str, score: str, tie_break: str) -> DataFrame:
    """The highest-scoring successful response per query."""
    good = df.where(col(success) & col(score).isNotNull())
    return first_per_group(good, [query_key], [F.desc(score), F.asc(tie_break)])


# ---- conversations -------------------------------------------------------------

def extract_decisions(
    messages: DataFrame, words: Iterable[str] = tuple(fixed.DECISION_WORDS), *, conversation: str = "conv_id",
    turn: str = "turn", role: str = "role", text: str = "text", timestamp: str | None = None, **options,
) -> DataFrame:
    """Assistant messages with an indicator word, the user question right before them, and their own ``timestamp`` where named."""
    when = [] if timestamp is None else [timestamp]
    paired = with_previous(
        messages.select(conversation, turn, role, text, *when), [conversation], [turn],
        {"_role": col(role), "_text": col(text)}, **options)
    decided = (col(role) == "assistant") & contains_any(F.lower(col(text)), words)
    return paired.where(decided).select(
        conversation, turn, F.lit("recommendation").alias("type"),
        F.when(F.col("_role") == "user", F.col("_text")).otherwise("").alias("question"),
        col(text).alias("decision"), *when)


def audit_trail(
    messages: DataFrame, conversations: DataFrame, words: Iterable[str] = tuple(fixed.DECISION_WORDS), *,
    conversation: str = "conv_id", turn: str = "turn", per_part: int = 1_000, **options,
) -> DataFrame:
    """Per conversation the facts in ``conversations`` and its decisions as a JSON array.

    A conversation with more than ``per_part`` decisions gets several rows.
    """
    decisions = with_row_number(
        extract_decisions(messages, words, conversation=conversation, turn=turn, **options), [conversation], [turn])
    listed = (
        decisions.withColumn("part", F.floor((F.col("row_no") - 1) / per_part) + 1)
        .groupBy(conversation, "part")
        .agg(
            F.count("*").alias("decisions"),
            F.to_json(F.transform(
                F.sort_array(F.collect_list(F.struct(col(turn), "type", "question", "decision"))), lambda d: d)).alias("decision_list"))
    )
    return conversations.join(listed, conversation, "left").withColumns({
        "part": F.coalesce("part", F.lit(1)), "decisions": F.coalesce("decisions", F.lit(0)),
        "decision_list": F.coalesce("decision_list", F.lit("[]"))})


def recent_n(messages: DataFrame, n: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` messages of every conversation."""
    return first_per_group(messages, [conversation], [F.desc(turn)], n)


def compact_history(messages: DataFrame, keep_last: int = 20, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The first message and the last ``keep_last`` of every conversation."""
    first = first_per_group(messages, [conversation], [F.asc(turn)])
    last = recent_n(messages, keep_last, conversation, turn)
    return first.unionByName(last).dropDuplicates([conversation, turn])


def conversation_summary(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text",
                         updated_at: str | None = None) -> DataFrame:
    """Messages and estimated tokens (a quarter of the characters) per conversation, the last updated first where ``updated_at`` is named."""
    latest = [] if updated_at is None else [F.max(updated_at).alias("updated_at")]
    return messages.groupBy(conversation).agg(
        F.count("*").alias("messages"),
        F.floor(F.sum(F.coalesce(F.length(text), F.lit(0))) / 4).alias("estimated_tokens"),
        F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), *latest,
    ).orderBy(*[F.desc_nulls_last("updated_at") for _ in latest], F.desc(conversation))


def _csv_cell(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)


def _escaped(value: Column) -> Column:
    """Text as HTML shows it."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


def export_conversation(
    messages: DataFrame, fmt: str = "markdown", *, conversation: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text", about: DataFrame | None = None, per_part: int = 1_000, **options,
) -> DataFrame:
    """One document per conversation: csv, markdown, html or json.

    ``about`` may bring ``title``, ``date`` and ``data_files`` (text) per
    conversation. Result: (conversation, part, document). Parts of a conversation with more than
    ``per_part`` messages join, in order, to the whole document.
    """
    speaker = F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substring(role, 2, 1_000)))
    default_title = F.concat(F.lit("Conversation "), col(conversation).cast("string"))
    title = default_title if about is None else F.coalesce(F.col("_title"), default_title)
    date, files = (
        (F.lit(None), F.lit(None)) if about is None else (F.col("_date").cast("string"), F.col("_files").cast("string")))
    rendered = {
        "markdown": F.concat(F.lit("**"), speaker, F.lit(":**\n\n"), col(text), F.lit("\n\n---\n\n")),
        "html": F.concat(
            F.lit('<div class="message '), _escaped(col(role)), F.lit('"><strong>'), _escaped(speaker), F.lit(":</strong><br>"),
            F.replace(_escaped(col(text)), F.lit("\n"), F.lit("<br>")), F.lit("</div>\n")),
        "csv": F.concat_ws(",", col(turn).cast("string"), _csv_cell(col(role)), _csv_cell(col(text))),
        "json": F.to_json(F.struct(col(turn).alias("turn"), col(role).alias("role"), col(text).alias("content"))),
    }[fmt]
    head = {
        "markdown": F.concat_ws(
            "\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("Date: "), date), F.concat(F.lit("Files: "), files),
            F.lit("## Messages\n\n")),
        "html": F.concat(
            F.lit("<!DOCTYPE html>\n<html>\n<head><title>"), _escaped(title), F.lit("</title></head>\n<body>\n<h1>"), _escaped(title),
            F.lit("</h1>\n"), F.coalesce(F.concat(F.lit("<p>Date: "), _escaped(date), F.lit("</p>\n")), F.lit("")),
            F.coalesce(F.concat(F.lit("<p>Files: "), _escaped(files), F.lit("</p>\n")), F.lit("")), F.lit("<h2>Messages</h2>\n")),
        "csv": F.lit("turn,role,content\n"),
        "json": F.concat(
            F.lit('{"conversation_id":'), F.coalesce(F.regexp_replace(F.to_json(F.array(col(conversation))), r"^\[|\]$", ""), F.lit("null")),
            F.lit(',"messages":[')),
    }[fmt]
    tail = {"markdown": "", "html": "</body>\n</html>\n", "csv": "\n", "json": "]}"}[fmt]
    glue = {"markdown": "", "html": "", "csv": "\n", "json": ","}[fmt]

    base = messages.select(conversation, turn, F.coalesce(rendered, F.lit("")).alias("_entry"))
    numbered = with_row_number(base, [conversation], [turn], **options)
    parts = (
        numbered.withColumn("part", F.floor((F.col("row_no") - 1) / per_part) + 1)
        .groupBy(conversation, "part")
        .agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("row_no", "_entry"))), lambda e: e["_entry"]), glue).alias("_body"))
    )
    last = parts.groupBy(conversation).agg(F.max("part").alias("_last"))
    is_last = F.col("part") == F.col("_last")
    documents = null_safe_join(parts, last, [conversation])
    if about is not None:
        documents = null_safe_join(documents, about.select(
            conversation, F.col("title").alias("_title"), F.col("date").alias("_date"), F.col("data_files").alias("_files")), [conversation])
    return documents.select(
        conversation, "part",
        F.concat(
            F.when(F.col("part") == 1, head).otherwise(""), F.col("_body"),
            F.when(is_last, F.lit(tail)).otherwise(F.lit(glue))).alias("document"))
