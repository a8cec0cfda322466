"""Array kernels over batches of whole texts: words, word hashes and shingle sets without a Python loop per word."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_PRIME_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLICE = 1 << 20
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _PRIME)
_STEP = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | _U(1)
_powers = {"size": 0}


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["size"] < size:
        up, down = np.full(size, _PRIME), np.full(size, _PRIME_INVERSE)
        up[0] = down[0] = 1
        _powers.update(size=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts with a line feed after each, and where each starts (one entry more than texts)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8), starts


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hash of data[start:end] for each span, spans ascending and apart; works in slices of bounded memory."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + _SLICE, side="right")))
        size = int(end[j - 1] - base)
        up, down = _power(max(size, _SLICE))
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(byte[data[base : base + size]] * up[:size], out=total[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * _PRIME)
        i = j
    return out


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lower-cased) and the number of the text it stands in."""
    data, starts = joined(texts)
    data = FOLD[data]
    a, b = word_spans(data)
    return span_hashes(data, a, b), np.searchsorted(starts, a, side="right") - 1


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted by text and hash, and the bounds of each text's share.

    A text of fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    word, doc = words(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    value = np.zeros(len(word), dtype=np.uint64)
    for k in range(SHINGLE):
        value[: len(word) - k] += word[k:] * _STEP[k]
    first = np.concatenate([[0], np.cumsum(n_words)])
    whole = n_words >= SHINGLE
    place = np.arange(len(word)) - first[doc]
    keep = place <= n_words[doc] - SHINGLE
    for d in np.flatnonzero(~whole & (n_words > 0)):
        part = word[first[d] : first[d + 1]]
        length = np.array([len(part)], dtype=np.uint64)
        value[first[d]] = ((part * _STEP[: len(part)]).sum(dtype=np.uint64) + length * _PRIME)[0]
        keep[first[d]] = True
    value, doc = mix(value[keep]), doc[keep]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        value[bounds[d] : bounds[d + 1]].sort()
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))
