"""Benchmark decontamination: BM25 over the test items with block-max WAND, then question and answer overlap."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyloom.llm import words as W
from tallyloom.llm.shared import slices

#: BM25's parameters, postings per block.
K1, B, BLOCK = 1.2, 0.75, 16
#: Part of the threshold that the terms left out of the pivot test may add to an item.
COMMON = 0.4
#: Part of an item's own score that a passage must reach, and of its question's and answer's word triples that it must hold; parts of fewer words count as one run.
THRESHOLD, OVERLAP, TRIPLE = 0.5, 0.5, 3
#: Items with more text than this are indexed in several parts, each sent to the tasks on its own.
INDEX_BYTES = 16 << 20


@dataclass
class Index:
    """Postings of a part of the items, with BM25 impacts relative to each item's own score."""

    terms: np.ndarray  # sorted word hashes
    starts: np.ndarray  # postings of term i: starts[i] to starts[i + 1]
    items: np.ndarray
    impacts: np.ndarray
    block_max: list[list[float]]  # of each term's blocks, then of them all
    rare: np.ndarray  # terms whose postings are looked at for every passage
    common_mass: np.ndarray  # the most that an item can gain from the other terms
    ids: list
    questions: list[tuple[int, np.ndarray]]  # words per run, and the runs' hashes
    answers: list[tuple[int, np.ndarray]]
    window: int
    postings: list[int]  # ``items`` and ``starts`` as lists, for the cursors
    starts_list: list[int]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: the last sentence is the answer, of a single one the last quarter of its words."""
    parts = [p for p in re.split(r"(?<=[.?!:])\s+|\n+", text.strip()) if p]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    units = text.split()
    cut = len(units) - max(1, len(units) // 4)
    return " ".join(units[:cut]), " ".join(units[cut:])


def build_index(ids: list, texts: list[str], n_items: int, frequency: dict[int, int], mean_words: float, threshold: float = THRESHOLD) -> Index:
    """``n_items``, ``frequency`` (items per word hash) and ``mean_words`` are those of all items, of which these are a part.

    Common terms are the most frequent ones that leave no item more than ``COMMON`` of the threshold to gain from them.
    """
    lower = W.lettered()
    hashed = W.hash_words(texts, lower)
    rows = []
    for i, words in enumerate(hashed):
        terms, counts = np.unique(words, return_counts=True)
        idf = np.array([math.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) for t in terms.tolist()])
        weight = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(words) / mean_words))
        rows.append((terms, np.full(len(terms), i), weight / max(weight.sum(), 1e-12)))
    term, item, impact = (np.concatenate(c) if rows else np.empty(0) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.uint64), np.empty(0, int), np.empty(0))
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    terms, starts = np.unique(term, return_index=True)
    starts = np.append(starts, len(term))
    block_max = [[*np.maximum.reduceat(impact[a:b], np.arange(0, b - a, BLOCK)).tolist(), float(impact[a:b].max())] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    rare, common = np.ones(len(terms), bool), np.zeros(len(texts))
    for t in np.argsort(-np.diff(starts), kind="stable").tolist():
        own = slice(starts[t], starts[t + 1])
        if (common[item[own]] + impact[own] <= COMMON * threshold).all():
            common[item[own]] += impact[own]
            rare[t] = False
    halves = [split_item(t) for t in texts]
    runs = [[(k := max(1, min(TRIPLE, len(h))), _runs(h, k)) for h in W.hash_words([x[side] for x in halves], lower)] for side in (0, 1)]
    return Index(terms, starts, item, impact, block_max, rare, common, ids, *runs, max([len(w) for w in hashed], default=1), item.tolist(), starts.tolist())


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    return W.shingles(hashes, np.array([0, len(hashes)]), k)[0]


def wand(index: Index, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items with a score of ``threshold`` or more for the distinct known terms ``query``: block-max WAND.

    One cursor per term. Cursors are ordered by item; the pivot is the first item that the terms' maxima could lift to
    the threshold. If the maxima of the blocks around it can't, all cursors jump past the nearest block end; if they
    can, the item is scored.
    """
    items, out = index.postings, []
    cursors = [[index.starts_list[t], index.starts_list[t], index.starts_list[t + 1], index.block_max[t], index.block_max[t][-1]] for t in query.tolist()]
    least = threshold - 1e-9
    while cursors:
        cursors.sort(key=lambda c: items[c[0]])
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c[4]
            if bound >= least:
                pivot = i
                break
        if pivot < 0:
            break
        at = items[cursors[pivot][0]]
        while pivot + 1 < len(cursors) and items[cursors[pivot + 1][0]] == at:
            pivot += 1
        bound, until = 0.0, None
        for c in cursors[:pivot + 1]:  # the blocks that hold the pivot
            p = bisect_left(items, at, c[0], c[2])
            if p < c[2]:
                block = (p - c[1]) // BLOCK
                bound += c[3][block]
                last = items[min(c[1] + (block + 1) * BLOCK, c[2]) - 1]
                until = last if until is None else min(until, last)
        if bound >= least:
            target = at
            if items[cursors[0][0]] == at:
                score = sum(index.impacts[c[0]] for c in cursors[:pivot + 1])
                if score >= least:
                    out.append((at, float(score)))
                target = at + 1
        else:
            target = (until if until is not None else at) + 1
            if pivot + 1 < len(cursors):
                target = min(target, items[cursors[pivot + 1][0]])
            target = max(target, at + 1)
        for c in cursors[:pivot + 1]:
            c[0] = bisect_left(items, target, c[0], c[2])
        cursors = [c for c in cursors if c[0] < c[2]]
    return out


def _share(part: tuple[int, np.ndarray], passage: np.ndarray) -> float:
    """Which part of a question's or answer's word runs the passage holds; 1 if it has no words."""
    k, runs = part
    return len(np.intersect1d(runs, _runs(passage, k), assume_unique=True)) / len(runs) if len(runs) else 1.0


def _hits(index: Index, hashes: np.ndarray, bounds: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
    """(row, item, first word, end, score, question overlap, answer overlap) of all verified passages, best one per row and item."""
    half, n_items = index.window, len(index.ids)
    if not len(index.terms) or not len(hashes):
        return []
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    nth = (np.arange(len(hashes)) - bounds[row]) // half
    at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
    known = index.terms[at] == hashes
    # Pivot test of all passages at once: rare terms' impacts by passage and item, and all that common terms could add.
    passages, n_terms = int(nth.max()) + 2, len(index.terms)
    place = np.flatnonzero(known & index.rare[at])
    term = (row[place] * passages + nth[place] + 1) * n_terms + at[place]
    term = np.unique(np.concatenate([term, term - n_terms]))  # each word is in two windows: nth and nth - 1
    passage, term = term // n_terms, term % n_terms
    n = index.starts[term + 1] - index.starts[term]
    posting = np.repeat(index.starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
    keys, inverse = np.unique(np.repeat(passage, n) * n_items + index.items[posting], return_inverse=True)
    mass = np.bincount(inverse, index.impacts[posting], len(keys))
    likely = np.unique(keys[mass + index.common_mass[keys % n_items] >= threshold - 1e-9] // n_items)
    best: dict[tuple[int, int], tuple] = {}
    for code in likely.tolist():
        r, w = code // passages, code % passages - 1
        first, stop = int(bounds[r]), int(bounds[r + 1])
        a, b = first + max(w, 0) * half, min(stop, first + (w + 2) * half)
        query = np.unique(at[a:b][known[a:b]])
        for item, score in wand(index, query, threshold):
            near = hashes[max(first, a - half):min(stop, b + half)]
            q, s = _share(index.questions[item], near), _share(index.answers[item], near)
            if q >= overlap and s >= overlap and score > best.get((r, item), (0, 0, -1.0))[2]:
                best[r, item] = (a - first, b - first, score, q, s)
    return [(r, item, *x) for (r, item), x in sorted(best.items())]


def _flag(index: Index, text: str, threshold: float, overlap: float, item_type: pa.DataType):
    kind = pa.list_(pa.struct([
        ("item", item_type), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()),
        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = W.lettered()
        for part, data, offsets in slices(batches, text):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            hits: list[list] = [[] for _ in range(len(part))]
            for r, item, first, end, score, q, s in _hits(index, hashes, bounds, threshold, overlap):
                hits[r].append({"item": index.ids[item], "first_word": first, "end_word": end, "score": score, "question_overlap": q, "answer_overlap": s})
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(hits, kind)], [*part.schema.names, "_hits"])

    return run


def _indexes(items: DataFrame, item_col: str, text_col: str, threshold: float) -> Iterator[Index]:
    """Indexes of bounded size. Test items are read on the driver, a part at a time."""
    texts = items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null and id is not null").distinct()
    lower, frequency, n, total = W.lettered(), {}, 0, 0
    for r in texts.toLocalIterator():
        words = W.hash_words([r["text"]], lower)[0]
        n, total = n + 1, total + len(words)
        for t in np.unique(words).tolist():
            frequency[t] = frequency.get(t, 0) + 1
    ids, held, size = [], [], 0
    for r in texts.orderBy("id", "text").toLocalIterator():
        if not len(W.hash_words([r["text"]], lower)[0]):
            continue
        ids.append(r["id"])
        held.append(r["text"])
        size += len(r["text"])
        if size > INDEX_BYTES:
            yield build_index(ids, held, n, frequency, total / n, threshold)
            ids, held, size = [], [], 0
    if ids:
        yield build_index(ids, held, n, frequency, total / n, threshold)


def _hits_sql(item_type: T.DataType) -> str:
    return f"array<struct<item:{item_type.simpleString()},first_word:long,end_word:long,score:double,question_overlap:double,answer_overlap:double>>"


def contamination(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """One row per document and test item that it holds: ids, ``first_word``, ``end_word``, ``score``, ``question_overlap``, ``answer_overlap``.

    Every text is cut into windows of twice the longest item's words, each starting one such length after the last,
    so an item lies whole in one of them. Each window is a BM25 query against the inverted index of the items, with
    impacts as parts of the item's own score; block-max WAND retrieves all items at ``threshold`` or more. An item is
    reported if the window and its surroundings hold ``overlap`` of the word triples of its question and its answer.

    The index goes to the tasks in parts of 16 MB of item text, one pass over the documents each; the documents are
    never shuffled. Null texts match nothing, items without words or id are left out, repeated rows are reported each.
    Empty tables give an empty result. Other columns don't matter, whatever their names.
    """
    kind, item_kind = df.schema[id_col].dataType, items.schema[item_col].dataType
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = None
    for index in _indexes(items, item_col, item_text, threshold):
        schema = f"id {kind.simpleString()}, text string, _hits {_hits_sql(item_kind)}"
        hits = narrow.mapInArrow(_flag(index, "text", threshold, overlap, to_arrow_type(item_kind)), schema).select("id", F.explode("_hits").alias("h"))
        part = hits.select(F.col("id").alias(id_col), F.col("h.item").alias(item_col), "h.first_word", "h.end_word", "h.score", "h.question_overlap", "h.answer_overlap")
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, first_word long, end_word long, score double, question_overlap double, answer_overlap double"
        return df.sparkSession.createDataFrame([], schema)
    return found


def drop_contaminated(
    df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP,
) -> DataFrame:
    """Rows of ``df``, with its columns, that hold no item: see ``contamination``. One pass per index part, no shuffle."""
    hidden = [f"_c{i}" for i in range(len(df.columns))]
    left = df.toDF(*hidden)
    text, item_kind = hidden[df.columns.index(text_col)], items.schema[item_col].dataType
    schema = ", ".join([f"{h} {f.dataType.simpleString()}" for h, f in zip(hidden, df.schema.fields, strict=True)])
    for index in _indexes(items, item_col, item_text, threshold):
        left = left.mapInArrow(_flag(index, text, threshold, overlap, to_arrow_type(item_kind)), f"{schema}, _hits {_hits_sql(item_kind)}").where(F.size("_hits") == 0).drop("_hits")
    return left.toDF(*df.columns)
