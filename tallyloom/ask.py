"""Answer a question about tables from the data itself.

The question picks the calculation (compare, total, count, mean, overview);
the amount column of every table is found from names and values; the answer is
a DataFrame with the figures and an ``answer`` text column.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import constant_rows, grouped_number, money
from tallyloom.operators import keys, messages, pick, reconcile, totals


@dataclass
class Answer:
    intent: str
    method: str
    result: DataFrame

    def text(self) -> str:
        """The answer lines; a handful of rows, one per table."""
        return "\n".join(r["answer"] for r in self.result.select("answer").collect())


def _problem(spark, text: str, method: str, intent: str = "none") -> Answer:
    return Answer(intent, method, constant_rows(spark, [(text,)], "answer string"))


#: A question that asks to match rows by their key, not by amount.
BY_KEY = re.compile(r"\b(?:by|on|using|same|matching)\s+(?:the\s+|their\s+|common\s+|\w+\s+)?(?:keys?|ids?|identifiers?|references?)\b", re.IGNORECASE)


def _by_key(tables: Mapping[str, DataFrame], a: str, b: str, amount: str | None, intent: str) -> Answer:
    """Rows of A that B lacks by a key found from the data."""
    result = keys.missing_by_found_key(tables[a], tables[b], amount).withColumn("answer", F.concat(
        F.lit(f"Missing from {b}: "), grouped_number(F.col("missing_count")), F.lit(" transactions, "), money(F.col("missing_amount")),
        F.lit(" (matched by "), F.col("key_a"), F.lit(")")))
    if result.isEmpty():
        return _problem(tables[a].sparkSession, f"Could not find a key that {a} and {b} share", "column_detection_error", intent)
    return Answer(intent, "missing_by_key", result)


def ask(question: str, tables: Mapping[str, DataFrame], amounts: Mapping[str, str] | None = None) -> Answer:
    """Answer ``question`` over ``tables`` (name -> frame).

    ``amounts`` names the amount columns where they are known; the others are
    found with one pass per table. A comparison "by key", "by transaction id"
    and the like, or of tables without amounts, matches rows by a key of one or
    more columns that is found from the data.
    """
    if not tables:
        raise ValueError("no tables given")
    spark = next(iter(tables.values())).sparkSession
    if not re.search(r"\S", question):
        return _problem(spark, "Empty query provided", "validation_error")
    asked = constant_rows(spark, [(question,)], "question string")
    decided = messages.classify_intent(asked, "question", len(tables)).withColumn(
        "kind", messages.aggregation_kind(F.col("question"))).first()
    intent, kind = decided["intent"], decided["kind"]
    wanted = list(tables)[:2] if intent in ("comparison", "transaction_matching") else list(tables)
    found = {n: (amounts or {}).get(n) or pick.find_amount_column(tables[n]) for n in wanted}

    if intent in ("comparison", "transaction_matching"):
        if len(wanted) < 2:
            return _problem(spark, "Need at least 2 files for comparison", "validation_error", intent)
        a, b = wanted
        if BY_KEY.search(question) or not (found[a] or found[b]):
            return _by_key(tables, a, b, found[a], intent)
        if not found[a] or not found[b]:
            missing = ", ".join(n for n in wanted if not found[n])
            return _problem(spark, f"Could not find amount columns: {missing}", "column_detection_error", intent)
        return Answer(intent, "comparison", reconcile.compare_tables(tables[a], tables[b], found[a], found[b], a, b))
    named = {n: (tables[n], found[n]) for n in wanted}
    if intent == "aggregation":
        operator = {"sum": totals.total_across, "count": totals.count_across, "mean": totals.mean_across}[kind]
        return Answer(intent, kind, operator(named))
    return Answer(intent, "overview", totals.dataset_overview(named))
