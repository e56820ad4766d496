"""Hashes of words and of runs of words, computed on whole arrays."""

from __future__ import annotations

import numpy as np

#: White space between words; and a random number for each byte, A-Z as a-z.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
BYTES[SPACE] = 0
BASE = 0x9E3779B97F4A7C15
#: Bytes of a text that are hashed at a time; a longer word makes a longer piece.
PIECE = 1 << 16
MULTIPLIERS = np.random.default_rng(6).integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _scales(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each number's bits over all 64; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """64 bits for each word of a text (runs of what isn't white space, A-Z lower-cased), in order; whole texts in pieces."""
    raw, out, at = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8), [], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not SPACE[raw[end - 1]]:
            ahead = SPACE[raw[end : end + PIECE]]
            end += int(ahead.argmax()) + 1 if ahead.any() else len(ahead)
        piece, at = raw[at:end], end
        bounds = np.concatenate([[-1], np.flatnonzero((piece == 0x20) | (piece - np.uint8(0x09) <= 4)), [len(piece)]])
        wide = np.flatnonzero(bounds[1:] - bounds[:-1] > 1)
        first, last = bounds[wide] + 1, bounds[wide + 1]
        powers, inverses = _scales(len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTES.take(piece) * powers[: len(piece)], out=sums[1:])
        out.append(mixed((sums[last] - sums[first]) * inverses[first]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each run of k word hashes, in order."""
    count = len(words) - k + 1
    if k < 1 or count < 1:
        return words[:0]
    total = np.zeros(count, np.uint64)
    for i in range(k):
        total += words[i : count + i] * MULTIPLIERS[i % len(MULTIPLIERS)]
    return mixed(total)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """64 bits for each run of k words of a text; for the whole sequence if it is shorter; none without words."""
    words = word_hashes(text)
    return runs(words, min(k, len(words)))
