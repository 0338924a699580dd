"""History reads, retention and upserts of metadata tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.scalars import col
from tallyloom.operators.ordered import first_per_group


def conversation_history(messages: DataFrame, limit: int, *, session: object = None, before: object = None,
                         session_column: str = "session_id", timestamp: str = "timestamp",
                         tie_break: str = "id") -> DataFrame:
    """The newest ``limit`` messages of one session, or of every session, optionally before a time."""
    newest = [F.desc(timestamp), F.desc(tie_break)]
    chosen = messages if before is None else messages.where(col(timestamp) < before)
    if session is None:
        return first_per_group(chosen, [session_column], newest, limit)
    return chosen.where(col(session_column) == session).orderBy(*newest).limit(limit)


def usage_history(usage: DataFrame, start: object, end: object, *, session: object = None,
                  session_column: str = "session_id", timestamp: str = "timestamp") -> DataFrame:
    """Resource rows of one session, or of all, in a time range with both ends included, in time order."""
    chosen = usage.where(col(timestamp).between(start, end))
    if session is not None:
        chosen = chosen.where(col(session_column) == session)
    return chosen.orderBy(session_column, timestamp)


def file_history(states: DataFrame, *, file: object = None, file_column: str = "file_id",
                 started: str = "started_at") -> DataFrame:
    """Processing states of one file, or of all, newest first per file."""
    chosen = states if file is None else states.where(col(file_column) == file)
    return chosen.orderBy(F.asc(file_column), F.desc(started))


def retention_cleanup(df: DataFrame, timestamp: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the numbers removed and kept)."""
    old = F.coalesce(col(timestamp) < cutoff, F.lit(False))
    return df.where(~old), df.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def keep_recent_items(df: DataFrame, keep: int, timestamp: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(the newest ``keep`` rows, the rows to remove).

    The oldest row that stays is found by a bounded top-k; everything below it
    goes. No join and no global window.
    """
    position = F.struct(col(timestamp).alias("t"), col(key).alias("k"))
    newest = df.orderBy(F.desc(timestamp), F.desc(key)).limit(keep)
    oldest_kept = newest.agg(F.min(position)).scalar()
    return newest, df.where(F.coalesce(position < oldest_kept, F.lit(True)))  # nothing stays: all go


def cascade_delete(deleted: DataFrame, deleted_key: str,
                   children: Mapping[str, tuple[DataFrame, str, str]], root: str = "root",
                   parents: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Rows of child tables that fall with deleted parents, down the chain.

    ``children``: table -> (frame, own key, key of the parent) in top-down
    order; ``parents``: table -> parent table (``root`` if not listed).
    """
    gone = {root: deleted.select(col(deleted_key).alias("_gone")).distinct()}
    result = {}
    for table, (df, own_key, parent_key) in children.items():
        parent = (parents or {}).get(table, root)
        result[table] = df.join(gone[parent], col(parent_key) == F.col("_gone"), "left_semi")
        gone[table] = result[table].select(col(own_key).alias("_gone")).distinct()
    return result


def upsert_latest(existing: DataFrame, updates: DataFrame, key: str, updated_at: str) -> DataFrame:
    """One row per key: the latest, of equally late ones the update, of equally late updates the largest by its other columns."""
    both = existing.withColumn("_from", F.lit(0)).unionByName(updates.withColumn("_from", F.lit(1)))
    rest = F.to_json(F.struct(*[col(c) for c in existing.columns]))
    return first_per_group(both, [key], [F.desc(updated_at), F.desc("_from"), F.desc(rest)]).drop("_from")
