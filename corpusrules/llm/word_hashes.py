"""64-bit hashes of words and of word sequences, by numpy over whole texts."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Longest run of bytes that is hashed at once; longer texts are cut at white space.
_SPAN = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_FACTOR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_UP = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_SPAN, _BASE)]))
_DOWN = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_SPAN, _INVERSE)]))


def word_hashes(text: str | None, lower: bool) -> np.ndarray:
    """One number per word ``[^\\x20\\x09-\\x0D]+`` of the text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode()
    if len(data) <= _SPAN:
        return _hashes(data, lower)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SPAN)
        if end < len(data):
            space = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, end - at, at)])
            if len(space):
                end = at + int(space[-1]) + 1
            else:  # a word longer than the span
                rest = data[at:].split(None, 1)[0]
                word = rest.lower() if lower else rest
                number = hashlib.blake2b(word, digest_size=8).digest()
                parts.append(np.frombuffer(number, np.uint64))
                at += len(rest)
                continue
        parts.append(_hashes(data[at:end], lower))
        at = end
    return np.concatenate(parts)


def _hashes(data: bytes, lower: bool) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    values = _BYTE[_LOWER[raw] if lower else raw]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values * _UP[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts])


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One number per run of ``size`` words; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if size <= 8:
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total += words[i : i + n] * _FACTOR[i]
        return mix(total + np.uint64(size))
    total = np.zeros(len(words) + 1, np.uint64)
    up = np.full(len(words), _BASE)
    up[0] = 1
    np.cumsum(words * np.cumprod(up), out=total[1:])
    down = np.full(n, _INVERSE)
    down[0] = 1
    return mix((total[size:] - total[:n]) * np.cumprod(down) + np.uint64(size))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct word shingles of a text, sorted; a short text is one shingle, no words none."""
    words = word_hashes(text, lower=True)
    if not len(words):
        return words
    return np.unique(sequence_hashes(words, min(size, len(words))))


def fingerprint(numbers: np.ndarray) -> bytes:
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).digest()
