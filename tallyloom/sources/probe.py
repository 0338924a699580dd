"""Look at the head of delimited files: separator, quote, header row.

The head is a file's first whole lines, however long they are. Tasks read it
off local files directly; files of any other store come through Spark's own
text reader, with its file systems and credentials, which costs one scan.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import unique_names

#: Lines of a head, and how much of it the dialect is judged by.
HEAD_LINES = 200
SAMPLE_CHARS = 10_240
HEADER_ROWS = 10
SEPARATORS = ",;\t|"
#: Part of the lines that must have the same number of cells.
LEAST_CONSTANT = 0.3


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, modified) of the files, without reading their content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"), F.col("_metadata.file_path").alias("file_path"))
    )


def _local_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path in batch["path"]:
            try:
                with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:
                    out.append((path, b"".join(line for _, line in zip(range(HEAD_LINES), f)), None))
            except OSError as problem:  # an unreadable file is a row, not a failure
                out.append((path, None, f"{type(problem).__name__}: {problem}"))
        yield pd.DataFrame(out, columns=["path", "head", "error"])


def file_heads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, head, error) per file: its first ``HEAD_LINES`` lines as bytes."""
    files = list_files(spark, path).select("path", "file_path")
    local = F.col("path").rlike("^(file:|/)")
    heads = files.where(local).select("path").mapInPandas(_local_heads, "path string, head binary, error string")
    if files.where(~local).isEmpty():
        return heads
    first = Window.partitionBy("file_path").orderBy("at")
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(path)
        .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"))
        .where("start = 0").withColumn("at", F.monotonically_increasing_id())
        .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= HEAD_LINES)
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda e: F.concat(e["line"], F.lit(bytearray(b"\n"))))
    joined = lines.groupBy("file_path").agg(F.aggregate(ordered, F.lit(bytearray()), lambda done, line: F.concat(done, line)).alias("head"))
    read = files.where(~local).join(joined, "file_path", "left")
    return heads.unionByName(read.select("path", F.coalesce("head", F.lit(bytearray())).alias("head"), F.lit(None).cast("string").alias("error")))


def _widths(sample: str, sep: str, quote: str) -> list[int]:
    """Cells per filled line under a dialect."""
    try:
        return [len(row) for row in csv.reader(io.StringIO(sample), delimiter=sep, quotechar=quote) if any(c.strip() for c in row)]
    except csv.Error:
        return []


def _quoted_cells(sample: str, quote: str) -> int:
    """Cells that start and end with the quote."""
    edge = f"[{re.escape(SEPARATORS)}\\n]"
    return len(re.findall(f"(?:^|(?<={edge})){quote}[^{quote}]*{quote}(?=$|\\r|{edge})", sample))


def sniff_dialect(sample: str) -> tuple[str, str]:
    """(separator, quote) of the sample; comma and double quote if undecided.

    The quote is the one around more cells. Under each separator the lines are cut to cells; the one counts that gives
    the same number of cells, two or more, in the largest part of the lines, of equal ones that with more cells.
    Undecided is what does so in less than ``LEAST_CONSTANT`` of the lines.
    """
    quote = "'" if _quoted_cells(sample, "'") > _quoted_cells(sample, '"') else '"'
    best = (LEAST_CONSTANT, 0, ",")
    for sep in SEPARATORS:
        widths = _widths(sample, sep, quote)
        several = Counter(w for w in widths if w > 1)
        if several:
            width, lines = max(several.items(), key=lambda found: (found[1], found[0]))
            best = max(best, (lines / len(widths), width, sep), key=lambda found: found[:2])
    return best[2], quote


def looks_textual(cell: str) -> bool:
    return not cell.replace(".", "").replace("-", "").replace("/", "").isdigit()


def find_header_row(rows: list[list[str]]) -> int:
    """First of the leading rows with more than half of its filled cells textual; else 0."""
    for i, row in enumerate(rows[:HEADER_ROWS]):
        filled = [c for c in row if c != ""]
        if filled and sum(map(looks_textual, filled)) > len(filled) * 0.5:
            return i
    return 0


def probe_text(sample: str, sep: str | None = None, quote: str | None = None) -> dict:
    short = sample[:SAMPLE_CHARS]
    if len(sample) > SAMPLE_CHARS and "\n" in short:
        short = short[:short.rindex("\n") + 1]
    found_sep, found_quote = sniff_dialect(short)
    sep, quote = sep or found_sep, quote or found_quote
    lines = csv.reader(io.StringIO(sample), delimiter=sep, quotechar=quote)
    rows = []
    try:
        for row in lines:
            if row:
                rows.append(row)
            if len(rows) >= HEADER_ROWS:
                break
    except csv.Error:
        pass
    at = find_header_row(rows)
    header = rows[at] if rows else []
    width = max([len(r) for r in rows[at:]] or [0]) if not header else len(header)
    return {
        "sep": sep, "quote": quote, "header_row": at,
        "names": unique_names(c or None for c in header), "head": rows[:at + 1], "width": width,
    }


def probe_delimited(
    spark: SparkSession, path: str | list[str], *, encoding: str = "utf-8", sep: str | None = None, quote: str | None = None,
) -> DataFrame:
    """One row per file: (path, sep, quote, header_row, names, head, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, raw, error in zip(batch["path"], batch["head"], batch["error"], strict=True):
                if error is not None:
                    out.append((file, None, None, None, None, None, error))
                    continue
                try:
                    p = probe_text(raw.decode(encoding, errors="replace").lstrip("﻿"), sep, quote)
                    out.append((file, p["sep"], p["quote"], p["header_row"], p["names"], p["head"], None))
                except Exception as problem:  # an unreadable file is a row, not a failure
                    out.append((file, None, None, None, None, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(out, columns=["path", "sep", "quote", "header_row", "names", "head", "error"])

    return file_heads(spark, path).mapInPandas(run, (
        "path string, sep string, quote string, header_row int, names array<string>, head array<array<string>>, error string"))
