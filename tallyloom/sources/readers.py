"""Readers: messy delimited files, JSON, Parquet, several files at once."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import col, constant_rows, file_extension, file_name, unique_names
from tallyloom.operators.clean import retype_whole_columns
from tallyloom.sources import quoted
from tallyloom.sources.probe import file_heads, list_files, probe_delimited

SOURCE, BAD = "source_file", "_bad_record"
MAX_HEAD_LINES = 50
_CORRUPT = "_corrupt_record"


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Append frames; the union of their columns, NULL where absent."""
    frames = list(frames)
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def scan_csv(
    spark: SparkSession, path: str | list[str], *, sep: str | None = None, quote: str | None = None,
    encoding: str = "utf-8", multi_line: bool = False, on_error: str = "raise",
) -> DataFrame:
    """Delimited files as text columns, with ``source_file`` and ``_bad_record``.

    Dialect and header row are found per file from its head. Files of one
    shape are read together. Rows above the header are dropped, short rows are
    padded with NULL, and rows with too many cells keep their raw text in
    ``_bad_record`` (see :func:`quarantine_rows`). A file that cannot be read
    raises; with ``on_error="skip"`` it is left to :func:`unreadable_files`.

    ``multi_line``: quoted cells may hold line breaks. UTF-8 files are still
    read in splits (see :mod:`tallyloom.sources.quoted`), each line from a
    quote that never closes on being a bad record; files of other encodings
    are read whole by one task each.
    """
    shapes = scan_shapes(spark, path, sep=sep, quote=quote, encoding=encoding, multi_line=multi_line, on_error=on_error)
    return union_all(shapes) if shapes else constant_rows(spark, [], f"{SOURCE} string, {BAD} string")


def scan_shapes(
    spark: SparkSession, path: str | list[str], *, sep: str | None = None, quote: str | None = None,
    encoding: str = "utf-8", multi_line: bool = False, on_error: str = "raise", full_path: bool = False,
) -> list[DataFrame]:
    """The same, one frame per shape (dialect, header row and column names)."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"on_error is raise or skip, not {on_error!r}")
    probes = probe_delimited(spark, path, encoding=encoding, sep=sep, quote=quote)
    shapes = probes.groupBy("error", "sep", "quote", "header_row", "names").agg(
        F.sort_array(F.collect_list("path")).alias("paths"),
        F.array_distinct(F.flatten(F.collect_set("head"))).alias("head"),
    ).withColumn("head", F.when(F.size("head") <= MAX_HEAD_LINES, F.col("head"))).collect()
    failed = [s for s in shapes if s["error"] is not None]
    if failed and on_error == "raise":
        raise OSError(f"{sum(len(s['paths']) for s in failed)} unreadable files, such as {failed[0]['paths'][0]}: {failed[0]['error']}")
    shapes = sorted((s for s in shapes if s["error"] is None and s["names"]), key=lambda s: s["paths"][0])
    return [_scan_shape(spark, s, encoding, multi_line, full_path) for s in shapes]


def unreadable_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, error) of the delimited files that cannot be opened or decoded."""
    return probe_delimited(spark, path).where("error is not null").select("path", "error")


def _scan_shape(spark: SparkSession, shape, encoding: str, multi_line: bool, full_path: bool = False) -> DataFrame:
    names, at = list(shape["names"]), shape["header_row"]
    if multi_line and encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return _scan_records(spark, shape, full_path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    options = {"sep": shape["sep"], "quote": shape["quote"], "escape": shape["quote"], "encoding": encoding}
    # Without the full record Spark does not see that a row has too many cells.
    raw = spark.read.option("columnPruning", False).csv(
        list(shape["paths"]), schema=schema, header=at == 0, enforceSchema=True, mode="PERMISSIVE",
        columnNameOfCorruptRecord=_CORRUPT, multiLine=multi_line, **options)
    rows = raw.select(
        *[F.when(col(n) != "", col(n)).alias(n) for n in names],
        F.col(_CORRUPT),
        (F.col("_metadata.file_path") if full_path else file_name(F.col("_metadata.file_path"))).alias(SOURCE),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    if at > 0:
        rows = _drop_head(rows, names, at + 1, shape["head"])
    # A flagged row is bad only if it has more cells than the header. The test on
    # the first cell is always true: Spark refuses to read the raw record alone.
    wider = ", ".join(f"`_c{i}` string" for i in range(len(names) + 1))
    extra = F.from_csv(F.col(_CORRUPT), F.lit(wider), {k: v for k, v in options.items() if k != "encoding"})[f"_c{len(names)}"]
    parsed = F.length(F.coalesce(col(names[0]), F.lit(""))) >= 0
    return rows.select(
        *[col(n) for n in names], SOURCE, F.when(extra.isNotNull() & parsed, F.col(_CORRUPT)).alias(BAD))


def _scan_records(spark: SparkSession, shape, full_path: bool) -> DataFrame:
    """The same for files with line breaks in quoted cells, a row per record."""
    names = list(shape["names"])
    found = quoted.records(spark, list(shape["paths"]), shape["quote"]).where(F.col("record_no") > shape["header_row"])
    cells = [f"_c{i}" for i in range(len(names) + 1)]  # one more than the header has
    row = F.from_csv("text", ", ".join(f"{c} string" for c in cells), {"sep": shape["sep"], "quote": shape["quote"], "escape": shape["quote"], "multiLine": "true"})
    rows = found.withColumn("_row", F.when(~F.col("unclosed"), row))
    return rows.select(
        *[F.when(F.col("_row")[c] != "", F.col("_row")[c]).alias(n) for c, n in zip(cells, names)],
        (F.col("file") if full_path else file_name(F.col("file"))).alias(SOURCE),
        F.when(F.col("unclosed") | F.col("_row")[cells[-1]].isNotNull(), F.col("text")).alias(BAD))


def _drop_head(rows: DataFrame, names: list[str], count: int, head: list[list[str]] | None) -> DataFrame:
    """Drop the first ``count`` rows of every file, up to and with the header.

    Only rows of a file's first block that look like one of the leading rows of
    these files are numbered. They include all leading rows, which therefore
    come first; everything else passes without a shuffle. If the files have too
    many different leading rows (``head`` is None), all rows of the first block
    are numbered.
    """
    like_head = F.lit(head is None)
    for line in head or []:
        same = F.lit(True)
        for i, n in enumerate(names):
            cell = line[i] if i < len(line) and line[i] != "" else None
            same = same & col(n).eqNullSafe(F.lit(cell))
        like_head = like_head | same
    candidate = like_head & (F.col("_block") == 0)
    order = Window.partitionBy("_file").orderBy("_position")
    later = (
        rows.where(candidate).withColumn("_position", F.monotonically_increasing_id())
        .withColumn("_row", F.row_number().over(order))
        .where(F.col("_row") > count).drop("_position", "_row")
    )
    return rows.where(~candidate).unionByName(later)


def quarantine_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows with their origin and raw text)."""
    good = df.where(F.col(BAD).isNull()).drop(BAD)
    bad = df.where(F.col(BAD).isNotNull()).select(
        SOURCE, F.col(BAD).alias("raw"), F.lit("too many cells").alias("error"))
    return good, bad


def promote_header(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Use the first data row as header if it reads like one; retype whole columns.

    ``order`` names columns that give the row order; they are no part of the
    table and are dropped. Without it the first row of the scan counts; rows of
    a multi-file scan have no defined order, so give one there.
    """
    body_columns = [c for c in df.columns if c not in (order or [])]
    numbered, keys = df, order
    if order is None:
        numbered, keys = df.withColumn("_position", F.monotonically_increasing_id()), ["_position"]
        first = numbered.head(1)
    else:
        first = numbered.orderBy(*[col(k) for k in keys]).head(1)
    if not first:
        return df.select(*[col(c) for c in body_columns])
    cells = [first[0][c] for c in body_columns]
    filled = [str(c).lower() for c in cells if c is not None]
    if len(filled) <= 3 or not any(w in c for c in filled for w in fixed.HEADER_WORDS):
        return df.select(*[col(c) for c in body_columns])
    is_first = F.lit(True)
    for k in keys:
        is_first = is_first & col(k).eqNullSafe(F.lit(first[0][k]))
    names = unique_names(None if c is None else str(c) for c in cells)
    body = numbered.where(~is_first).select(*[col(c) for c in body_columns]).toDF(*names)
    return retype_whole_columns(body)


def scan_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def scan_json(spark: SparkSession, path: str | list[str], *, multi_line: bool = False, schema=None) -> DataFrame:
    """JSON lines, or whole documents with ``multi_line``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=multi_line)


def _json_body(spark, path):
    """Files of JSON lines and whole documents side by side, each read its own way."""
    def run(batches):
        for batch in batches:
            yield batch.assign(lines=[h is not None and is_json_lines(h) for h in batch["head"]])[["path", "lines", "error"]]

    layouts = file_heads(spark, path).mapInPandas(run, "path string, lines boolean, error string")
    found = {r["lines"]: sorted(r["paths"]) for r in layouts.groupBy("lines").agg(F.collect_list("path").alias("paths")).collect()}
    return union_all(scan_json(spark, paths, multi_line=not lines) for lines, paths in sorted(found.items(), key=lambda x: x[1]))


def is_json_lines(head: bytes) -> bool:
    """True if the first line of the file is a JSON object by itself."""
    line = head.decode("utf-8", errors="replace").lstrip().partition("\n")[0]
    if not line.startswith("{"):
        return False
    try:
        json.loads(line)
        return True
    except ValueError:
        return False


READERS = {
    ".csv": scan_csv, ".tsv": scan_csv, ".txt": scan_csv,
    ".json": _json_body, ".jsonl": scan_json, ".parquet": scan_parquet, ".pq": scan_parquet,
}


@dataclass
class Scan:
    """Tables by path, an error row per path that could not be read, and rows with too many cells with their origin."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: DataFrame | None = None
    bad_rows: DataFrame | None = None


def scan_any(spark: SparkSession, paths: Iterable[str]) -> Scan:
    """Read each path with the readers for its extensions. Problems are rows, not exceptions.

    A folder with files of several types gives a table per type, under the path followed by the extension.
    """
    scan, problems, bad = Scan(), [], []
    for path in paths:
        try:
            suffix = file_extension(F.col("path"))
            listed = list_files(spark, path).groupBy(suffix.alias("suffix")).agg(F.sort_array(F.collect_list("path")).alias("files")).collect()
        except (PySparkException, Py4JJavaError) as problem:
            problems.append((path, first_line(problem)))
            continue
        if not listed:
            problems.append((path, "no files"))
        for suffix, files in sorted(listed):
            name = path if len(listed) == 1 else f"{path}{suffix}"
            if suffix not in READERS:
                problems.append((name, f"unsupported file type: {suffix or files[0].rsplit('/', 1)[-1]}"))
                continue
            try:
                df = READERS[suffix](spark, files)
            except (PySparkException, Py4JJavaError, OSError) as problem:
                problems.append((name, first_line(problem)))
                continue
            if READERS[suffix] is scan_csv:
                df, surplus = quarantine_rows(df)
                bad.append(surplus)
            scan.tables[name] = df
    scan.errors = constant_rows(spark, problems, "path string, error string")
    scan.bad_rows = union_all(bad) if bad else constant_rows(spark, [], f"{SOURCE} string, raw string, error string")
    return scan


def first_line(problem: Exception) -> str:
    return (str(problem).splitlines() or [type(problem).__name__])[0]


def scan_multi(tables: Mapping[str, DataFrame], only: Iterable[str] | None = None, label: str = SOURCE) -> DataFrame:
    """Several files, or sheets handed over as tables, as one table with provenance columns."""
    wanted = list(tables) if only is None else list(only)
    return union_all(
        tables[name].withColumns({label: F.lit(name), "table_num": F.lit(i + 1)}) for i, name in enumerate(wanted))
