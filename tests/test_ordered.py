"""Group windows: the split path for oversized groups gives what plain windows give."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import documents, messages, ordered


@pytest.fixture(scope="module")
def events(spark):
    # Group 0 holds a third of all rows; a NULL group is a group too.
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("g"),
        F.col("id").alias("t"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("mark"), F.concat(F.lit("m"), "id").alias("text"))


@pytest.mark.parametrize("limit", [10, 120, 10_000])
def test_row_number(spark, rows, events, limit):
    expected = events.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("t")).cast("bigint"))
    got = ordered.with_row_number(events, ["g"], ["t"], "n", max_rows=limit)
    assert rows(got, "t", "n") == rows(expected, "t", "n")


@pytest.mark.parametrize("limit", [10, 10_000])
def test_previous(spark, rows, events, limit):
    w = Window.partitionBy("g").orderBy("t")
    expected = events.withColumns({"p": F.lag("text").over(w), "q": F.lag("mark").over(w)})
    got = ordered.with_previous(events, ["g"], ["t"], {"p": F.col("text"), "q": F.col("mark")}, max_rows=limit)
    assert rows(got, "t", "p", "q") == rows(expected, "t", "p", "q")


@pytest.mark.parametrize("limit", [10, 10_000])
def test_last_known(spark, rows, events, limit):
    w = Window.partitionBy("g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    expected = events.withColumn("k", F.last("mark", ignorenulls=True).over(w))
    got = ordered.with_last_known(events, ["g"], ["t"], {"k": F.col("mark")}, max_rows=limit)
    assert rows(got, "t", "k") == rows(expected, "t", "k")


@pytest.mark.parametrize("limit", [100, 10_000])
def test_batches_over_the_whole_table(spark, events, limit):
    got = documents.batch_numbers(events, ["t"], 50, max_rows=limit).collect()
    assert all(r["row_no"] == r["t"] + 1 and r["batch"] == r["t"] // 50 + 1 for r in got)


def test_first_per_group_passes_few_rows_on(spark, events):
    plan = ordered.first_per_group(events, ["g"], [F.desc("t")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def talk(spark):
    return spark.createDataFrame([
        (1, 0, "user", "Which key?"), (1, 1, "assistant", "I recommend the id."), (1, 2, "assistant", "You should index it."),
        (2, 0, "assistant", "We suggest waiting."), (2, 1, "user", "ok, \"fine\""), (2, 2, "assistant", "Done."),
        (3, 0, "user", "Nothing here"),
    ], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("limit", [1, 100])
def test_decisions(spark, rows, limit):
    got = messages.extract_decisions(talk(spark), max_rows=limit)
    assert rows(got, "conv_id", "turn", "question") == [(1, 1, "Which key?"), (1, 2, ""), (2, 0, "")]


@pytest.mark.parametrize("limit", [1, 100])
def test_audit_trail(spark, limit):
    about = talk(spark).select("conv_id").distinct()
    got = {(r["conv_id"], r["part"]): r["decisions"] for r in messages.audit_trail(talk(spark), about, per_part=1, max_rows=limit).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (2, 1): 1, (3, 1): 0}


def test_export_parts_join_to_the_document(spark):
    for fmt in ("markdown", "html", "csv", "json"):
        whole = {r[0]: r[2] for r in messages.export_conversation(talk(spark), fmt).collect()}
        parts = messages.export_conversation(talk(spark), fmt, per_part=1, max_rows=1).orderBy("conv_id", "part").collect()
        joined = {}
        for r in parts:
            joined[r[0]] = joined.get(r[0], "") + r[2]
        assert joined == whole
    assert whole[2].startswith('{"conversation_id":2,"messages":[{"turn":0') and whole[2].endswith("]}")


def test_export_with_title_and_null_conversation(spark):
    talks = talk(spark).unionByName(spark.createDataFrame([(None, 0, "user", "lost")], talk(spark).schema))
    about = spark.createDataFrame([(1, "Keys", "2024-01-01", "a.csv, b.csv")], "conv_id long, title string, date string, data_files string")
    got = {r["conv_id"]: r["document"] for r in messages.export_conversation(talks, "markdown", about=about).collect()}
    assert got[1].startswith("# Keys\n\nDate: 2024-01-01\n\nFiles: a.csv, b.csv\n\n## Messages\n\n**User:**\n\nWhich key?\n\n---\n\n")
    assert got[2].startswith("# Conversation 2\n\n## Messages\n\n") and None in got


def test_compact_and_recent(spark, rows):
    assert rows(messages.recent_n(talk(spark), 1), "conv_id", "turn") == [(1, 2), (2, 2), (3, 0)]
    assert rows(messages.compact_history(talk(spark), 1), "conv_id", "turn") == [(1, 0), (1, 2), (2, 0), (2, 2), (3, 0)]


def test_sections(spark, rows):
    elements = spark.createDataFrame([
        (1, 0, None, "before"), (1, 1, 1, "Title"), (1, 2, 2, "Part"), (1, 3, None, "a"), (1, 4, None, "b"), (1, 5, 2, "Empty"),
    ], "doc long, position int, level int, text string")
    for limit in (1, 100):
        got = documents.heading_sections(elements, "doc", max_rows=limit)
        assert rows(got, "position", "heading", "heading_level") == [(0, "", 0), (3, "Part", 2), (4, "Part", 2)]


def test_text_blocks(spark):
    tokens = spark.createDataFrame([
        (1, 1, "Hello", 90.0, 5, 10, 20, 8), (1, 2, "World", 80.0, 30, 9, 25, 9), (2, 1, None, 50.0, 1, 1, 1, 1),
    ], "block_num int, word_num int, text string, conf double, left int, top int, width int, height int")
    got = {r["block_num"]: r for r in documents.text_blocks(tokens, ["block_num"], ["word_num"]).collect()}
    assert (got[1]["text"], got[1]["confidence"], got[1]["x"], got[1]["y"], got[1]["width"], got[1]["height"]) == ("Hello World", 85.0, 5, 9, 45, 9)
    assert got[2]["text"] == ""
    parts = documents.text_blocks(tokens, ["block_num"], ["word_num"], per_part=1, max_rows=1).where("block_num = 1").orderBy("part").collect()
    assert [r["text"] for r in parts] == ["Hello", "World"] and {r["confidence"] for r in parts} == {85.0}
