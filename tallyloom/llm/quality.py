"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import words as W
from tallyloom.llm.shared import slices

#: Labelled rows that the trees are fitted on at most, those of the smallest id hashes.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, MIN_ROWS = 80, 4, 48, 0.15, 1.0, 20
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "bar", "exclaim", "stop", "comma", "beyond_ascii", "space",
    "breaks_per_word", "words_per_stop", "distinct_words", "top_word", "distinct_lines", "line_bytes", "longest_word", "distinct_triples",
)


def _classes() -> dict[str, np.ndarray]:
    """Which bytes count for which statistic."""
    def of(chars: bytes) -> np.ndarray:
        out = np.zeros(256, np.uint8)
        out[list(chars)] = 1
        return out

    return {
        "upper": of(bytes(range(65, 91))), "digit": of(b"0123456789"), "symbol": of(b"#$%&*@^~=+<>_\\/{}[]"), "bar": of(b"|"), "exclaim": of(b"!"),
        "stop": of(b".?"), "comma": of(b",;:"), "beyond_ascii": of(bytes(range(0xC0, 256))), "space": of(b" \t\r\n\x0b\x0c"), "break": of(b"\n"),
    }


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` per text, from its bytes alone."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    count = {}
    for name, member in _classes().items():
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(member[data], out=run[1:])
        count[name] = (run[offsets[1:]] - run[offsets[:-1]]).astype(float)
    starts, ends, hashes, bounds = W.words(data, offsets, W.spaced())
    _, _, lines, line_bounds = W.words(data, offsets, W.table(b"\r\n"))
    words, n_lines = np.diff(bounds).astype(float), np.diff(line_bounds).astype(float)
    some, letters, some_lines = np.maximum(words, 1), np.maximum(size, 1), np.maximum(n_lines, 1)
    distinct, top, longest, triples, line_kinds = (np.zeros(n) for _ in range(5))
    lengths = ends - starts
    joint = W.mix(hashes[:-2], 1) + W.mix(hashes[1:-1], 2) + W.mix(hashes[2:], 3) if len(hashes) > 2 else np.empty(0, np.uint64)
    for i, (a, b, c, d) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), line_bounds[:-1].tolist(), line_bounds[1:].tolist(), strict=True)):
        if b > a:
            _, times = np.unique(hashes[a:b], return_counts=True)
            distinct[i], top[i], longest[i] = len(times), times.max(), lengths[a:b].max()
            triples[i] = len(np.unique(joint[a:b - 2])) / (b - 2 - a) if b - a > 2 else 1
            line_kinds[i] = len(np.unique(lines[c:d]))
    return np.column_stack([
        np.log1p(size), np.log1p(words), (lengths_sum := np.bincount(np.repeat(np.arange(n), np.diff(bounds)), lengths, n)) / some,
        count["upper"] / letters, count["digit"] / letters, count["symbol"] / letters, count["bar"] / letters, count["exclaim"] / letters,
        count["stop"] / letters, count["comma"] / letters, count["beyond_ascii"] / letters, count["space"] / letters,
        count["break"] / some, words / (count["stop"] + 1), distinct / some, top / some, line_kinds / some_lines, lengths_sum / some_lines, longest, triples,
    ])


@dataclass
class Trees:
    """All trees as arrays: node i's children are 2i + 1 and 2i + 2, the last level holds the leaves' values."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic boosting; each level's gains come from gradient histograms over quantile bins."""
    inner = 2**DEPTH - 1
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) < 2 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)])
    total = np.full(len(y), model.start)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            split = np.full(nodes, -1)
            for f in range(x.shape[1]):
                cell = (at - first) * BINS + binned[:, f]
                sums = [np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + RIDGE) + (gt - gl)**2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = 0
                gain = gain[:, :max(len(cuts[f]), 1)]
                top = gain.argmax(axis=1)
                better = (gain[np.arange(nodes), top] > best) & (len(cuts[f]) > 0)
                best[better] = gain[np.arange(nodes), top][better]
                feature[first:first + nodes][better] = f
                split[better] = top[better]
            for k in np.flatnonzero(split >= 0):
                threshold[first + k] = cuts[feature[first + k]][split[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(model.start, np.array(features), np.array(thresholds), np.array(values))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in slices(batches, "text"):
        rows = statistics(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))
        yield pa.RecordBatch.from_arrays([part.column(0), lists], ["label", "x"])


def fit_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees fitted on at most ``fit_rows`` labelled documents; only their statistics (20 numbers each) reach the driver.

    Null labels and ids are left out, of an id's labels the smallest counts. With no label, or one class alone, every
    score is that class's smoothed share (0.5 with no label).
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("label"))
    sample = own.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").select("label", "text")  # the sample's bound is fit_rows
    rows = chosen.mapInArrow(_measure, "label double, x array<double>").orderBy("label", "x").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, np.array([r["label"] for r in rows]))


def _score(model: Trees, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(statistics(data, offsets)))], [*part.schema.names, "_score"])

    return run


def score_quality(df: DataFrame, model: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1, higher for likelier good texts. One pass over the rows, no shuffle.

    Scores depend on the text alone; null counts as empty, and empty texts get a score, too. Rows are kept as they
    are, repeated ones and nulls included. A column named like the score is replaced. An empty table stays empty.
    """
    names = [c for c in df.columns if c != score_col]
    hidden = [f"_c{i}" for i in range(len(names))]
    rows = df.select(*[F.col(f"`{c}`").alias(h) for c, h in zip(names, hidden, strict=True)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    scored = rows.mapInArrow(_score(model, hidden[names.index(text_col)]), f"{schema}, _score double")
    return scored.toDF(*names, score_col)
