"""Hashes of words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROW = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


#: One number for each byte, from the rule above; A-Z are given those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes between words that are made of letters and digits.
_SIGN = np.ones(256, bool)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Bytes of text whose words are hashed at once; only a longer word takes more.
_WINDOW = 1 << 16
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """n powers of an odd number and of its inverse modulo 2^64; those of a window are kept."""
    if not _POWERS or n > _WINDOW:
        base, made = 0xC2B2AE3D27D4EB4F, []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(max(n, _WINDOW), b, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.cumprod(steps, dtype=np.uint64))
        if n > _WINDOW:
            return made
        _POWERS[:] = made
    return [p[:n] for p in _POWERS]


def alnum_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like word_hashes, for runs of ASCII letters and digits and of non-ASCII bytes."""
    return word_hashes(raw, offsets, _SIGN)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (runs of anything but ASCII white space, A-Z lower-cased), and the words of each text."""
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~between[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    # A text starts a word of its own wherever the text before ends.
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begin[firsts] |= word[firsts]
    starts = np.flatnonzero(begin)
    stop = word.copy()
    stop[:-1] &= ~word[1:] | begin[1:]
    ends = np.flatnonzero(stop) + 1
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _WINDOW, "right")))
        a, z = starts[at:to] - base, ends[at:to] - base
        up, down = _powers(int(z[-1]))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw[base : base + z[-1]]] * up, dtype=np.uint64)])
            hashes[at:to] = mix((total[z] - total[a]) * down[a] + (z - a).astype(np.uint64) * _ODD)
        at = to
    return hashes, np.searchsorted(starts, offsets[1:], "left") - np.searchsorted(starts, offsets[:-1], "left")


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` words of a text (in order, with repeats), and the runs of each text.

    A text of fewer words, but one at least, has its whole sequence as one run.
    """
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(np.cumsum(counts) - counts, runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    size = np.repeat(np.minimum(counts, width), runs)
    out = size.astype(np.uint64) * _ODD
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out + np.where(k < size, padded[first + k], 0).astype(np.uint64)) * _ROW
    return mix(out), runs


def distinct_in_text(hashes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and how many they are."""
    text = np.repeat(np.arange(len(runs)), runs)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.bincount(t[new], minlength=len(runs))
