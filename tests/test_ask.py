from tallyloom import ask


def tables(spark):
    a = spark.createDataFrame([("x", 10.0), ("y", 20.5)], "ref string, `Transaction Amount (RM)` double")
    b = spark.createDataFrame([("2024-01-01", 10.0), ("2024-01-02", 7.0), ("2024-01-03", 1.0)], "Day string, `Gross payments` double")
    return {"a.csv": a, "b.csv": b}


def test_missing_question(spark):
    got = ask("How many transactions are missing and how much?", tables(spark))
    assert got.intent == "comparison"
    assert got.text().splitlines()[-1] == "• Missing from b.csv: 1 transactions, RM 20.50"


def test_total_count_mean(spark):
    t = tables(spark)
    assert "Total across all files: RM 48.50" in ask("What is the grand total? How much is it altogether?", t).text()
    counted = ask("Give me the count", {"a.csv": t["a.csv"]})
    assert counted.method == "count" and "Total transactions across all files: 2" in counted.text()
    assert "Average across all files: RM 15.25" in ask("average please", {"a.csv": t["a.csv"]}).text()


def test_overview_and_problems(spark):
    t = tables(spark)
    assert "• Total transactions: 2" in ask("tell me about it", {"a.csv": t["a.csv"]}).text()
    assert ask("  ", t).text() == "Empty query provided"
    assert ask("compare them, find the missing ones, check missing count", {"a.csv": t["a.csv"]}).method == "validation_error"
    plain = spark.createDataFrame([(True,)], "flag boolean")
    assert ask("compare", {"p": plain, "a": t["a.csv"]}).method == "column_detection_error"


def test_needed_words():
    from tallyloom.functions.fixed_values import INTENT_PATTERNS
    from tallyloom.operators.messages import needed_word

    words = {p: needed_word(p) for listed in INTENT_PATTERNS.values() for p in listed}
    assert words[r"\bmissing\b.*\b(between|from)\b"] == "missing" and words[r"\binsights?\b"] == "insight"
    assert words[r"\banalyze|analysis\b"] is None and words[r"\b(total|sum|count|average|mean)\b(?!.*\bmissing\b)"] is None
    assert words[r"\bgrand\s+total\b(?!.*\bmissing\b)"] == "grand"
    assert needed_word(r"(\bfoo(bar)?)?baz") is None and needed_word(r"\bfoo*") == "fo" and needed_word(r"a|\bword") is None
