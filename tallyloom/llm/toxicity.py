"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import words as W
from tallyloom.llm.shared import slices

#: Labelled rows that the model is fitted on at most, those of the smallest id hashes; features; severity grades above 0.
FIT_ROWS, FEATURES, GRADES = 20_000, 256, 3
#: Bytes of the word beginnings that are features beside whole words.
STEMS = range(3, 8)
#: A word is a feature if its log odds between the classes are so many standard deviations from none, with so many documents.
LEAST_Z, LEAST_DOCUMENTS = 4.0, 5


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(weights . x - cuts[k]): one weight per word for all thresholds, cuts in order."""

    terms: np.ndarray  # sorted word hashes
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, activation: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(activation[:, None] - self.cuts[None, :], -30, 30)))


def fit_ordinal(row: np.ndarray, term: np.ndarray, value: np.ndarray, grade: np.ndarray, n_terms: int, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of the proportional-odds model, by Adam on the mean log likelihood of sparse rows."""
    n, top = len(grade), int(grade.max()) if len(grade) else 0
    k = max(top, 1)
    share = np.array([(np.sum(grade > j) + 0.5) / (n + 1) for j in range(k)])
    raw = np.append(-np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-3)))
    x = np.concatenate([np.zeros(n_terms), raw])
    m, v = np.zeros_like(x), np.zeros_like(x)
    low, high = np.maximum(grade - 1, 0), np.minimum(grade, k - 1)
    for t in range(1, steps + 1):
        w, gaps = x[:n_terms], np.exp(x[n_terms + 1:])
        cuts = np.append(x[n_terms], x[n_terms] + np.cumsum(gaps))
        a = np.bincount(row, value * w[term], n)
        p_low = np.where(grade > 0, 1 / (1 + np.exp(-np.clip(a - cuts[low], -30, 30))), 1.0)  # P(grade >= own)
        p_high = np.where(grade < k, 1 / (1 + np.exp(-np.clip(a - cuts[high], -30, 30))), 0.0)  # P(grade > own)
        likely = np.maximum(p_low - p_high, 1e-9)
        d_low, d_high = p_low * (1 - p_low) / likely / n, p_high * (1 - p_high) / likely / n
        slope = d_high - d_low  # of the loss by the activation
        by_cut = np.bincount(low, d_low * (grade > 0), k) - np.bincount(high, d_high * (grade < k), k)
        g_w = np.bincount(term, value * slope[row], n_terms) + ridge * w / max(n_terms, 1)
        tail = by_cut[::-1].cumsum()[::-1]
        g = np.concatenate([g_w, [by_cut.sum()], gaps * tail[1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return x[:n_terms], np.append(x[n_terms], x[n_terms] + np.cumsum(np.exp(x[n_terms + 1:])))


def _text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words and of all words' beginnings: inflected and compound words keep their stem's."""
    lower = W.lettered()
    starts, ends, hashes, bounds = W.words(data, offsets, lower)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    word, stem = W.prefixes(data, starts, ends, lower, STEMS)
    return np.concatenate([row, row[word]]), np.concatenate([hashes, stem])


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, hash) for each distinct word or stem of each document."""
    for part, data, offsets in slices(batches, "text"):
        row, hashes = _text_features(data, offsets)
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.append(True, (np.diff(row) != 0) | (hashes[1:] != hashes[:-1]))[:len(row)]
        label, flat = part.column(0).to_numpy(zero_copy_only=False)[row[new]], hashes[new].view(np.int64)
        for i in range(0, len(flat), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(label[i:i + (1 << 16)], pa.int32()), pa.array(flat[i:i + (1 << 16)])], ["label", "word"])


def _features(terms: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of the features that a text has, in order: log of one plus their number."""
    if not len(terms) or not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    row, hashes = _text_features(data, offsets)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == hashes)
    cell, times = np.unique(row[hit] * len(terms) + at[hit], return_counts=True)
    return cell // len(terms), cell % len(terms), np.log1p(times)


def _sparse(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            row, term, value = _features(terms, data, offsets)
            cut = np.searchsorted(row, np.arange(len(part) + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (term, value)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["label", "term", "value"])

    return run


def fit_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Ordinal:
    """The model from at most ``fit_rows`` labelled documents.

    Spark counts in how many documents of each class a word, or a beginning of words, stands; those that tell the
    classes apart most are the features. Grade 0 are documents not labelled toxic. The label says no more about the others, so they are graded
    by the features that speak for toxicity: the lower, middle and upper third by how many of them they hold are
    grades 1, 2 and 3. Null labels and ids are left out; an id counts as toxic if any of its labels says so. With no
    label or one class alone the model has no words and its cuts give that class's share.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").select("label", "text")  # the sample's bound is fit_rows
    size = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        share = (bad + 0.5) / (bad + good + 1)
        return Ordinal(np.empty(0, np.uint64), np.empty(0), -np.log(share / (1 - share)) + np.arange(GRADES, dtype=float))
    counts = chosen.mapInArrow(_document_words, "label int, word long").groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    b, g = F.col("bad") + 0.5, F.col("all") - F.col("bad") + 0.5
    odds = F.log(b / (bad + 1 - b)) - F.log(g / (good + 1 - g))
    z = odds / F.sqrt(1 / b + 1 / g)
    picked = counts.where(F.col("all") >= LEAST_DOCUMENTS).select("word", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(FEATURES).collect()
    terms, z_of = np.array([r["word"] for r in picked], np.int64).view(np.uint64), np.array([r["z"] for r in picked])
    order = np.argsort(terms)
    terms, z_of = terms[order], z_of[order]
    rows = chosen.mapInArrow(_sparse(terms), "label int, term array<long>, value array<double>").orderBy("label", "term", "value").collect()
    row = np.repeat(np.arange(len(rows)), [len(r["term"]) for r in rows])
    term = np.array([t for r in rows for t in r["term"]], np.int64)
    value = np.array([x for r in rows for x in r["value"]], float)
    toxic = np.array([r["label"] for r in rows])
    speaks = np.bincount(row, np.expm1(value) * (z_of[term] > 0), len(rows))[toxic == 1]
    thirds = np.quantile(speaks, np.arange(1, GRADES) / GRADES)
    grade = np.zeros(len(rows), np.int64)
    grade[toxic == 1] = 1 + np.searchsorted(thirds, speaks, "left")
    weights, cuts = fit_ordinal(row, term, value, grade, len(terms))
    return Ordinal(terms, weights, cuts)


def _predict(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, "text"):
            row, term, value = _features(model.terms, data, offsets)
            above = model.above(np.bincount(row, value * model.weights[term], len(part)))
            chances = np.column_stack([np.ones(len(part)), above]) - np.column_stack([above, np.zeros(len(part))])
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(chances.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5),
            ], ["id", "severity", "p_toxic", "grade", "toxic"])

    return run


def score_toxicity(df: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``severity`` (expected grade, 0 to 3), ``p_toxic``, ``grade`` (likeliest), ``toxic`` (p_toxic >= 0.5).

    One pass over whole texts, no shuffle. Null text counts as empty and gets the score of a text without any feature.
    Null and repeated ids are kept. An empty table gives an empty result. Other columns of ``df`` don't matter.
    """
    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(_predict(model), f"id {kind}, severity double, p_toxic double, grade int, toxic boolean").withColumnRenamed("id", id_col)
