"""Hashes of words and word shingles, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes that are hashed together; longer texts are cut at white space.
BLOCK = 1 << 18
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
FIVE = tuple(np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(1, 6))

_POWERS: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64."""
    if not _POWERS:
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(BLOCK + 1, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0], _POWERS[1]


def mix(z: np.ndarray) -> np.ndarray:
    """Splitmix's finaliser."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _block(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of at most BLOCK bytes."""
    power, inverse = powers()
    space = IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start]), start


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, in order."""
    out = []
    while len(text) >= BLOCK:
        cut = max(text.rfind(bytes([s]), 0, BLOCK) for s in (0x20, 9, 10, 11, 12, 13))
        if cut < 0:  # a word of a block or more has a hash of its own kind
            cut = min((p for s in (0x20, 9, 10, 11, 12, 13) if (p := text.find(bytes([s]))) >= 0), default=len(text))
            out.append(np.array([xxhash.xxh3_64_intdigest(text[:cut])], np.uint64))
        else:
            out.append(_block(np.frombuffer(text[:cut], np.uint8))[0])
        text = text[cut + 1 :]
    out.append(_block(np.frombuffer(text, np.uint8))[0] if len(text) else np.zeros(0, np.uint64))
    return np.concatenate(out)


def words_by_text(texts: list[bytes]) -> Iterator[np.ndarray]:
    """word_hashes of each text; short texts are hashed together."""
    at = 0
    while at < len(texts):
        if len(texts[at]) >= BLOCK:
            yield word_hashes(texts[at])
            at += 1
            continue
        size, to = 0, at
        while to < len(texts) and size + len(texts[to]) + 1 <= BLOCK:
            size += len(texts[to]) + 1
            to += 1
        h, start = _block(np.frombuffer(b"\n".join(texts[at:to]), np.uint8))
        bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts[at:to]]))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield h[lo:hi]
        at = to


def shingles(words: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's different five-word shingles, sorted; how often each occurs; the mean of its words' values.

    Fewer than five words make one shingle; no words make none.
    """
    n = len(words)
    if n < 5:
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        h = np.uint64(n)
        with np.errstate(over="ignore"):
            for w in words:
                h = h * FIVE[0] + w
        return mix(np.array([h], np.uint64)), np.ones(1), np.array([value.mean()])
    h = words[: n - 4] * FIVE[0]
    v = value[: n - 4].copy()
    for k in range(1, 5):
        h += words[k : n - 4 + k] * FIVE[k]
        v += value[k : n - 4 + k]
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return mix(h[first]), np.diff(first, append=len(h)).astype(float), v[order[first]] / 5
