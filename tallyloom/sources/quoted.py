"""Records of delimited files whose quoted cells hold line breaks, read in as many splits as any other file.

A line end is a record end where the quotes so far are even in number. A split cannot know how many came before it, so
it reports both readings of its lines, for an even and for an odd number. A prefix over the splits of a file then says
which reading is right, and how many records came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import null_safe_join

_AT = ["file", "block"]


def _lines(spark: SparkSession, paths: list[str], quote: str) -> DataFrame:
    """(file, block, line_no, line, odd): the lines of each split in their order, and whether their quotes are odd in number."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    line = F.col("value")
    quotes = F.length(line) - F.length(F.replace(line, F.lit(quote), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"), line.alias("line"), (quotes % 2 == 1).alias("odd"))


def _runs(keys: list[tuple]) -> Iterator[tuple[int, int]]:
    """Ranges of equal keys."""
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield begin, i
            begin = i


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: how many lines turn the reading, the records that end in it by either reading, and its lines from the last turn on."""
    schema = ["file", "block", "turns", "records0", "records1", "tail"]
    at, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), *[pa.array([state[k]], pa.int64()) for k in schema[2:]]], schema)

    for batch in batches:
        odd, blank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("odd", "blank"))
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
        for a, b in _runs(keys):
            if keys[a] != at:
                if at is not None:
                    yield out()
                at, state = keys[a], {"turns": 0, "records0": 0, "records1": 0, "tail": 0}
            after = (state["turns"] + np.cumsum(odd[a:b])) % 2 == 1
            before = after ^ odd[a:b]
            for reading in (0, 1):  # a record ends where the reading is even again; an empty line between records is none
                state[f"records{reading}"] += int(((after == bool(reading)) & ~((before == bool(reading)) & blank[a:b])).sum())
            state["turns"] += int(odd[a:b].sum())
            turned = np.flatnonzero(odd[a:b])
            state["tail"] = b - a - int(turned[-1]) if len(turned) else state["tail"] + b - a
    if at is not None:
        yield out()


def _plan(lines: DataFrame) -> DataFrame:
    """Per split: ``open`` (begins inside quotes), ``records_before`` and ``closes`` (a quote open at its end closes later)."""
    facts = lines.select(*_AT, "odd", F.col("line").isin("", "\r").alias("blank"))
    splits = facts.mapInArrow(_readings, "file string, block long, turns long, records0 long, records1 long, tail long")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    opened = splits.withColumns({
        "open": F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1,
        "closes": F.coalesce(F.max(F.col("turns") > 0).over(after), F.lit(False))})
    unclosed = (F.col("open") != (F.col("turns") % 2 == 1)) & ~F.col("closes")
    records = F.when(F.col("open"), F.col("records1")).otherwise(F.col("records0")) + F.when(unclosed, F.col("tail")).otherwise(0)
    return opened.select(*_AT, "open", "closes", F.coalesce(F.sum(records).over(before), F.lit(0)).alias("records_before"))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order of (file, block, line) to records; what goes on beyond an end of the split is a part of its record.

    Lines of a quote that never closes are records of their own, marked ``unclosed``.
    """
    names = ["file", "block", "record_no", "text", "part", "unclosed"]
    at, held, inside, number, part = None, [], False, 0, False
    closes = True

    def left() -> list[tuple]:
        """What is held at the end of a split."""
        if not held:
            return []
        if closes:
            return [(*at, number, "\n".join(held), True, False)]
        return [(*at, number + i, line, False, True) for i, line in enumerate(held)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        rows: list[tuple] = []
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "line", "odd", "open", "records_before", "closes"))
        for file, block, line, odd, open_, before, closing in zip(*columns, strict=True):
            if (file, block) != at:
                rows += left()
                at, held, inside, number, part, closes = (file, block), [], open_, before, open_, closing
            if not held and not inside and line in ("", "\r"):
                inside ^= odd
                continue
            held.append(line)
            inside ^= odd
            if not inside:
                rows.append((*at, number, "\n".join(held), part, False))
                held, part, number = [], False, number + 1
        yield batch_of(rows)
    if at is not None:
        yield batch_of(left())


def records(spark: SparkSession, paths: list[str], quote: str) -> DataFrame:
    """(file, record_no, text, unclosed): the records of UTF-8 files, numbered from 0 in their file, empty lines left out.

    A line break inside quotes is part of its record, also where a split ends in it. Quotes inside quotes are doubled.
    If a quote never closes, every line from it on is a record marked ``unclosed``, so no record grows with the file.
    """
    lines = _lines(spark, paths, quote)
    placed = null_safe_join(lines, _plan(lines), _AT, "inner").sortWithinPartitions(*_AT, "line_no")
    pieces = placed.select(*_AT, "line", "odd", "open", "records_before", "closes").mapInArrow(
        _assembled, "file string, block long, record_no long, text string, part boolean, unclosed boolean")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    stitched = pieces.where("part").groupBy("file", "record_no").agg(F.array_join(in_order, "\n").alias("text"), F.max("unclosed").alias("unclosed"))
    whole = pieces.where("not part").select("file", "record_no", "text", "unclosed").unionByName(stitched)
    text = F.regexp_replace("text", "\r$", "")
    return whole.withColumn("text", F.when(F.col("record_no") == 0, F.regexp_replace(text, "^﻿", "")).otherwise(text))
