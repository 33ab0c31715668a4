"""Hashes of words and word n-grams of whole batches of texts, without a Python step per word."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_MULT = 0x9E3779B97F4A7C13  # odd and 3 modulo 8: has an inverse, and swapped letters stay apart
_INVERSE = pow(_MULT, -1, 1 << 64)
_LONG_WORD = 64  # bytes; longer words are hashed by blake2b
_RUN = 1 << 15  # bytes that are summed up at once; the powers, which a process keeps, reach over two runs
_rng = np.random.Generator(np.random.PCG64(20240101))
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 62, 16, dtype=np.uint64) * _U(2) + _U(1)
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_MULT, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in bytes, and the index of each text's first word (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, by its bytes and length alone; spans may overlap and come in any order.

    Sums run over spans that start in one run of _RUN bytes at a time, so that memory besides the result does not grow with the data."""
    if (starts[1:] < starts[:-1]).any():
        order = np.argsort(starts, kind="stable")
        out = np.empty(len(starts), np.uint64)
        out[order] = span_hashes(data, starts[order], ends[order])
        return out
    power, inverse = _power(2 * _RUN + 1)
    out = np.zeros(len(starts), np.uint64)
    total = np.zeros(2 * _RUN + 1, np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + _RUN + 1, _RUN))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if lo < hi:
            a, b, e = int(starts[lo]), starts[lo:hi], ends[lo:hi]
            z = min(int(e.max()), a + 2 * _RUN)
            np.cumsum(_LETTER[data[a:z]] * power[: z - a], out=total[1 : z - a + 1])
            out[lo:hi] = (total[np.minimum(e, z) - a] - total[b - a]) * inverse[b - a]
            for k in np.flatnonzero(e > z).tolist():
                out[lo + k] = _long_sum(data[b[k] : e[k]])
    return mix(out + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _long_sum(data: np.ndarray) -> np.uint64:
    """The sum of a span that is longer than a run."""
    total = 0
    for a in range(0, len(data), _RUN):
        some = data[a : a + _RUN]
        total += int((_LETTER[some] * _power(len(some))[0]).sum()) * pow(_MULT, a, 1 << 64)
    return _U(total % (1 << 64))


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """64-bit hash of each word (A-Z taken as a-z if lower), index of each text's first word, and the words' spans."""
    starts, ends, first = word_spans(data, at)
    letters = _LOWER[data] if lower else data
    out = span_hashes(letters, starts, ends)
    for k in np.flatnonzero(ends - starts > _LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(letters[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out, first, (starts, ends)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; entry i starts at word i. Runs across texts are left for the caller to skip."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * _PLACE[j]
    return mix(total)


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; a text of fewer words has its whole word sequence as the one shingle, one of none has none."""
    words, first, _ = word_hashes(data, at)
    grams = ngram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(ngram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


_PLAIN = _LOWER.copy()
for _k in range(128):
    if not chr(_k).isalnum() and _k not in (10, 13):
        _PLAIN[_k] = 0x20


def plain(data: np.ndarray) -> np.ndarray:
    """The bytes in lower case (A-Z only) and with ASCII punctuation as spaces; positions stay, and so do line ends."""
    return _PLAIN[data]
