"""User functions over chunks of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


def apply_process_fn(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | None = None, on_error: str = "raise",
) -> DataFrame:
    """Run ``fn`` on Arrow batches of the table.

    ``passthrough`` hands a batch on unchanged when ``fn`` fails, so the output
    has the input's schema; the default lets the job fail.
    """
    if on_error == "passthrough" and schema is not None:
        raise ValueError("passthrough keeps the input schema")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if on_error != "passthrough":
                yield fn(batch)
                continue
            try:
                result = fn(batch.copy())
            except Exception:
                result = batch
            yield result

    return df.mapInPandas(run, schema or df.schema)


def chunk_then_combine(
    df: DataFrame, chunk_fn: Callable[[pd.DataFrame], pd.DataFrame], partial_schema: str,
    combine: Iterable[Column], by: Iterable[str] = (),
) -> DataFrame:
    """``chunk_fn`` turns each batch into partial rows; ``combine`` aggregates them."""
    partial = apply_process_fn(df, chunk_fn, partial_schema)
    keys = list(by)
    return partial.groupBy(*keys).agg(*combine) if keys else partial.agg(*combine)
