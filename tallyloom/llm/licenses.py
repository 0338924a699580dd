"""Licence scans: a generalised suffix automaton of licence words gives matching statistics, chained into covered spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm import words as W
from tallyloom.llm.shared import slices

# Phrases that name a licence wherever their words stand together, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The whole texts and the usual notices of common licences, by label. Several texts of one label stand in one file.
TEMPLATES = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}

# Names of licences, by label. A match that holds one is distinctive at any length.
NAMES = {
    "mit license": "mit", "apache license": "apache-2.0", "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl-1.0",
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl", "mozilla public license": "mpl-2.0", "eclipse public license": "epl-1.0",
    "gnu free documentation license": "gfdl", "creative commons attribution 4": "cc-by", "creative commons attribution sharealike 4": "cc-by-sa",
    "sil open font license": "ofl",
}

#: Matches of so many words at least are chained; words that a chain may leave out between two matches of a template.
MIN_MATCH, MAX_GAP = 4, 6
#: A run of so many words is distinctive without a name; so many covered words give the full score.
MIN_COVER, FULL_COVER = 12, 12


@dataclass
class Automaton:
    """Suffix automaton of several word sequences, built word by word; after ``finish``, states know whose parts they are."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    owners: list[set[str]] = field(default_factory=lambda: [set()])
    phrases: list[list[tuple[int, str]]] = field(default_factory=list)
    names: list[list[tuple[int, str]]] = field(default_factory=list)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.owners.append(set())
        return len(self.step) - 1

    def _split(self, at: int, word: int) -> int:
        """The state for ``at``'s string and the word, cloned where the present one also stands for longer strings."""
        there = self.step[at][word]
        if self.length[there] == self.length[at] + 1:
            return there
        clone = self._state(self.length[at] + 1, dict(self.step[there]), self.link[there])
        self.link[there] = clone
        while at != -1 and self.step[at].get(word) == there:
            self.step[at][word] = clone
            at = self.link[at]
        return clone

    def add(self, sequence: list[int], label: str) -> None:
        at = 0
        for word in sequence:
            if word in self.step[at]:
                at = self._split(at, word)
            else:
                new = self._state(self.length[at] + 1, {}, 0)
                p = at
                while p != -1 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, word)
                at = new
            self.owners[at].add(label)

    def finish(self, phrases: dict[tuple[int, ...], str], names: dict[tuple[int, ...], str] | None = None) -> None:
        """Every state's owners pass to its suffixes; each state lists the phrases and names that its longest string ends with."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.link[s] > 0:
                self.owners[self.link[s]] |= self.owners[s]
        self.phrases, self.names = self._ends(phrases, order), self._ends(names or {}, order)

    def _ends(self, sequences: dict[tuple[int, ...], str], order: list[int]) -> list[list[tuple[int, str]]]:
        ends: dict[int, list[tuple[int, str]]] = {}
        for words, label in sequences.items():
            at = 0
            for w in words:
                at = self.step[at][w]
            ends.setdefault(at, []).append((len(words), label))
        out: list[list[tuple[int, str]]] = [[] for _ in self.step]
        for s in order:
            own = ends.get(s)
            out[s] = out[self.link[s]] + own if own else out[self.link[s]]
        return out

    def statistics(self, run: list[int]) -> list[tuple[int, int]]:
        """For each place the longest match that ends there: (length, state)."""
        out, at, n = [], 0, 0
        for word in run:
            while at and word not in self.step[at]:
                at = self.link[at]
                n = self.length[at]
            if word in self.step[at]:
                at, n = self.step[at][word], n + 1
            else:
                at, n = 0, 0
            out.append((n, at))
        return out


def build(templates: dict[str, str], phrases: dict[str, str], names: dict[str, str]) -> tuple[Automaton, np.ndarray, dict[str, int]]:
    """The automaton, its sorted vocabulary (a word is known by its place there), and each label's number of words, of its template if it has one."""
    lower = W.lettered()
    texts = [*templates.values(), *phrases, *names]
    hashed = W.hash_words(texts, lower)
    vocabulary = np.unique(np.concatenate(hashed))
    coded = [np.searchsorted(vocabulary, h).tolist() for h in hashed]
    automaton = Automaton()
    for label, words in zip([*templates, *phrases.values(), *names.values()], coded, strict=True):
        automaton.add(words, label)
    first, last = len(templates), len(templates) + len(phrases)
    automaton.finish(
        {tuple(w): label for w, label in zip(coded[first:last], phrases.values(), strict=True)}, {tuple(w): label for w, label in zip(coded[last:], names.values(), strict=True)})
    sizes = {label: len(words) for label, words in zip([*names.values(), *phrases.values(), *templates], [*coded[last:], *coded[first:last], *coded[:first]], strict=True)}
    return automaton, vocabulary, sizes


def chains(matches: list[tuple[int, int, frozenset, frozenset]], free: int, gap: int = MAX_GAP) -> list[tuple[str, int, int, int, int, bool]]:
    """(label, first word, end, covered words, weight, named): maximal matches of one label in order, no further apart than ``gap``.

    The first ``free`` words of a match have no weight, so a row of everyday phrases adds up to nothing. A match is
    (start, end, labels, labels of the names in it).
    """
    open_: dict[str, list] = {}
    out = []
    for start, end, labels, named in matches:
        for label in labels:
            span = open_.get(label)
            if span and start - span[1] <= gap:
                new = end - max(start, span[1])
                span[1:] = max(end, span[1]), span[2] + new, span[3] + max(0, new - free), span[4] or label in named
            else:
                if span:
                    out.append((label, *span))
                open_[label] = [start, end, end - start, max(0, end - start - free), label in named]
    return out + [(label, *span) for label, span in open_.items()]


def _scan(automaton: Automaton, vocabulary: np.ndarray, sizes: dict[str, int], min_match: int, min_cover: int, full_cover: int):
    shortest = min([min_match, *(size for ends in automaton.phrases for size, _ in ends)])  # shorter runs hold neither phrase nor match
    least = {label: max(0, min(min_cover, size) - min_match) for label, size in sizes.items()}

    def one(codes: np.ndarray) -> tuple:
        known = np.flatnonzero(codes >= 0)
        places, matches = [], []
        for run in np.split(known, np.flatnonzero(np.diff(known) > 1) + 1) if len(known) else []:
            if len(run) < shortest:
                continue
            first = int(run[0])
            found, latest = automaton.statistics(codes[run].tolist()), {}
            for i, (n, state) in enumerate(found):
                places += [(first + i + 1 - size, label) for size, label in automaton.phrases[state] if size <= n]
                latest.update((label, i + 1 - size) for size, label in automaton.names[state] if size <= n)
                longest = i + 1 == len(found) or found[i + 1][0] <= n  # the match doesn't go on to the right
                if n >= min_match and longest:
                    named = frozenset(label for label, at in latest.items() if at >= i + 1 - n)
                    matches.append((first + i + 1 - n, first + i + 1, frozenset(automaton.owners[state]), named))
        spans = [s[:4] for s in chains(matches, min_match) if s[5] or s[4] >= least[s[0]]]
        base = {label for _, label in places}
        labels = base | {s[0] for s in spans}
        covered = max([s[3] for s in spans], default=0)
        score = min(1.0, max(covered / full_cover, 0.5 * bool(base)))
        starts = [p for p, _ in places]
        return (len(codes), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score,
                [{"label": a, "first_word": b, "end_word": c, "covered": d} for a, b, c, d in sorted(spans, key=lambda s: (s[1], s[0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = W.lettered()
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
        for part, data, offsets in slices(batches, "text"):
            _, _, hashes, bounds = W.words(data, offsets, lower)
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            codes = np.where(vocabulary[at] == hashes, at, -1)
            out = [one(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None, min_match: int = MIN_MATCH, min_cover: int = MIN_COVER, full_cover: int = FULL_COVER,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``spans``.

    Whole texts stream through the automaton; only runs of licence words reach it. A phrase stands wherever the match
    ending at a place has it as its end. Longest matches of ``min_match`` words and more are chained per template into
    spans. A span counts and gives its template's label if one of its matches holds a name of the licence, or if the
    words of its matches beyond the first ``min_match`` of each come to those of one run of ``min_cover`` words, or of
    the whole template where that is shorter; everyday phrases that also stand in licences come to nothing. Score:
    covered words of the best span by ``full_cover``, 0.5 at least with a phrase, 1 at most. The broadcast automaton
    depends on the templates only. ``names`` is ``NAMES`` with the own templates, and empty with others.

    Null text counts as empty: 0 words, empty labels, null places. Null and repeated ids are kept. An empty table
    gives an empty result. Other columns of ``df`` don't matter, whatever their names.
    """
    automaton, vocabulary, sizes = build(
        TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, (NAMES if templates is None else {}) if names is None else names)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,covered:long>>"
    narrow = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    return narrow.mapInArrow(_scan(automaton, vocabulary, sizes, min_match, min_cover, full_cover), schema).withColumnRenamed("id", id_col)
