"""Hashes of words and word shingles with numpy, in bounded pieces."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PIECE = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_MINV = np.uint64(pow(int(_M), -1, 1 << 64))
_K = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
_POW: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, key: str, n: int) -> np.ndarray:
    got = _POW.get(key)
    if got is None or len(got) < n:
        step = np.full(max(n, _PIECE + 1), base, np.uint64)
        step[0] = 1
        got = np.multiply.accumulate(step)
        if n <= 4 * _PIECE:
            _POW[key] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_words(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    gap = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers(_M, "m", len(a))[: len(a)], out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(_MINV, "i", len(a))[start]
    return mix(h + (end - start).astype(np.uint64) * _K[0])


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text with A-Z lower-cased, in order."""
    raw = raw.translate(_LOWER)
    if len(raw) <= _PIECE:
        return _piece_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + _PIECE, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        out.append(_piece_words(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(raw: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words: the whole sequence as one; none: empty."""
    w = word_hashes(raw)
    if not len(w):
        return w
    if len(w) < width:
        return mix(np.array([(w * _K[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))
    n = len(w) - width + 1
    s = np.zeros(n, np.uint64)
    for t in range(width):
        s += w[t : t + n] * _K[t % 5]
    s = np.sort(mix(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
