"""Vectorised polynomial hashes over byte buffers, and words of many texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOL = np.random.default_rng(20_177).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(n + (1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def forget(most: int = 1 << 21) -> None:
    """Drop powers that a very long text asked for."""
    for kind, steps in _powers.items():
        if len(steps) > most:
            _powers[kind] = steps[:1].copy()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(buffer: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol * base**position, with a leading 0."""
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_SYMBOL[buffer] * _power("up", _BASE, len(buffer)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buffer[start:end], independent of its position."""
    return (prefix[end] - prefix[start]) * _power("down", _INVERSE, len(prefix))[start]


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """span_hash of every window of one width."""
    n = len(prefix) - width
    return (prefix[width:] - prefix[:n]) * _power("down", _INVERSE, n) if n > 0 else np.zeros(0, np.uint64)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a blank after each text, and the starts (and the end) of the texts in it."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b" ".join(texts) + b" " * bool(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_words(texts: list[bytes], word_bytes: np.ndarray, most: int = 1 << 20, letters: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (lower-cased by `letters`), in order, and the text each belongs to; about `most` bytes at a time."""
    buffer, bounds = join_texts(texts)
    if not len(buffer):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = word_bytes[buffer]
    inside[bounds[1:] - 1] = False
    start, end = spans_of(inside)
    out = np.empty(len(start), np.uint64)
    cut = np.searchsorted(start, np.arange(0, len(buffer) + most, most))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if a < b:
            low = int(start[a])
            out[a:b] = span_hash(prefix_hash(letters[buffer[low : int(end[b - 1])]]), start[a:b] - low, end[a:b] - low)
    return mix(out), np.searchsorted(bounds, start, side="right") - 1


CODE = 8


def word_codes(texts: list[bytes]) -> list[bytes]:
    """Every text as the 64-bit hashes of its words, CODE bytes each: equal runs of words are equal strings, whatever blanks part them."""
    words, owner = hashed_words(texts, ~BLANK, letters=np.arange(256, dtype=np.uint8))
    stop = CODE * np.cumsum(np.bincount(owner, minlength=len(texts)))
    codes = words.astype("<u8").tobytes()
    return [codes[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)] if texts else []


def words_gone(text: bytes, codes_gone: Callable[[int], np.ndarray]) -> np.ndarray:
    """Bytes of a text under whole words whose codes go, and between two such words; codes_gone makes the mask of so many bytes of codes."""
    start, end = spans_of(~BLANK[np.frombuffer(text, np.uint8)])
    a, b = spans_of(codes_gone(CODE * len(start)).reshape(-1, CODE).all(1))
    edge = np.zeros(len(text) + 1, np.int8)
    edge[start[a]] = 1
    edge[end[b - 1]] = -1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0
