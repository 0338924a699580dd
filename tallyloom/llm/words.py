"""Words of many texts at once: places and 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SEGMENT = 1 << 20


def table(separators: bytes) -> np.ndarray:
    """Byte to its lower-case byte, 0 for separators. A NUL that is none is 256, so it stands in words."""
    out = np.arange(256, dtype=np.uint16)
    out[0] = 256
    out[65:91] += 32
    out[list(separators)] = 0
    return out


#: Words between white space, and words of ASCII letters, digits and everything beyond ASCII.
SPACED = bytes([0x20, *range(0x09, 0x0E)])
LETTERED = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def spaced() -> np.ndarray:
    return table(SPACED)


def lettered() -> np.ndarray:
    """A to Z are lowered before the class is applied, so they count as letters."""
    out = table(bytes(b for b in LETTERED if not 65 <= b <= 90))
    return out


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits."""
    x = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and bounds: row i has the words bounds[i] to bounds[i + 1]."""
    mapped = lower[data]
    inside = mapped != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    size = max(1, min(_SEGMENT, len(data)))
    up, down = _powers(_BASE, size), _powers(inverse, size)
    i = 0
    while i < len(starts):
        begin = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, begin + _SEGMENT, "right")))
        length = int(ends[j - 1] - begin)
        if length > len(up):
            up, down = _powers(_BASE, length), _powers(inverse, length)
        run = np.zeros(length + 1, np.uint64)
        np.cumsum((mapped[begin:ends[j - 1]].astype(np.uint64) + np.uint64(1)) * up[:length], out=run[1:])
        a, b = starts[i:j] - begin, ends[i:j] - begin
        hashes[i:j] = (run[b] - run[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    return starts, ends, mix(hashes), np.searchsorted(starts, offsets)


def prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray, lengths: range) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of each longer word's beginnings of ``lengths`` bytes; they never equal a word's own hash."""
    power, at, out = np.uint64(1), np.zeros(len(starts), np.uint64), []
    long = ends - starts
    for i in range(lengths.stop - 1):
        place = np.minimum(starts + i, max(len(data) - 1, 0))
        at = at + (lower[data[place]].astype(np.uint64) + np.uint64(1)) * power if len(starts) else at
        power = np.uint64(int(power) * _BASE & 0xFFFFFFFFFFFFFFFF)
        if i + 1 in lengths:
            word = np.flatnonzero(long > i + 1)
            out.append((word, mix(at[word], 1000 + i)))
    return np.concatenate([w for w, _ in out]), np.concatenate([h for _, h in out])


def hash_words(terms: list[str], lower: np.ndarray) -> list[np.ndarray]:
    """Word hashes of each given text."""
    out = []
    for term in terms:
        data = np.frombuffer(term.encode(), np.uint8)
        out.append(words(data, np.array([0, len(data)]), lower)[2] if len(data) else np.empty(0, np.uint64))
    return out


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``k`` words of each row; of fewer words the whole sequence is one."""
    n = len(hashes)
    joint = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        joint = mix(joint, 1) + mix(hashes[i:i + len(joint)], i + 2)
    joint = mix(joint, k + 7)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joint[a:b - k + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for i in range(a, b):
                whole = mix(whole, 1) + mix(hashes[i:i + 1], i - a + 2)
            out.append(mix(whole, 1000 + b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
