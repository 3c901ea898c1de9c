"""The start of md5 of many numbered texts at once, as arrays: what expr.uniform hashes a row at a time."""

from __future__ import annotations

import math

import numpy as np

SINES = np.array([int(abs(math.sin(k + 1)) * 2**32) for k in range(64)], np.uint32)
TURNS = np.array([(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)], np.uint32)
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
PLACES = [[k, (5 * k + 1) % 16, (3 * k + 5) % 16, 7 * k % 16] for k in range(64)]
#: Texts that are hashed together: so many that arrays stay in the cache.
TOGETHER = 16384


def turned(state: list[np.ndarray], words: list[np.ndarray], steps: int = 64) -> list[np.ndarray]:
    """a, b, c, d after so many steps of md5 over one block of 16 words; words of one element hold for all texts."""
    a, b, c, d = (x.copy() for x in state)
    f, g = np.empty_like(a), np.empty_like(a)
    for k in range(steps):
        turn = k // 16
        if turn < 2:  # one of two bits, chosen by the third
            x, y, z = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            np.bitwise_and(f, x, out=f)
            np.bitwise_xor(f, z, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, words[PLACES[k][turn]] + SINES[k], out=a)
        by = TURNS[turn, k % 4]
        np.left_shift(a, by, out=g)
        np.right_shift(a, np.uint32(32) - by, out=a)
        np.bitwise_or(a, g, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def firsts(texts: np.ndarray, row: np.ndarray, numbers: np.ndarray, digits: int) -> np.ndarray:
    """The first 32 bits of md5 of texts[row] + the number in decimal, for numbers of so many digits. texts: bytes of one length, a row each."""
    length = texts.shape[1] + digits
    blocks = (length + 8) // 64 + 1
    padded = np.zeros((len(texts), 64 * blocks), np.uint8)
    padded[:, : texts.shape[1]] = texts
    padded[:, length] = 0x80
    padded[:, -8:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
    fixed = padded.view("<u4").astype(np.uint32)
    alike = (fixed == fixed[:1]).all(axis=0)
    words = [fixed[:1, j] if alike[j] else fixed[row, j] for j in range(fixed.shape[1])]
    rest = numbers.astype(np.uint32) if digits < 10 else numbers
    for place in range(length - 1, length - digits - 1, -1):
        rest, digit = np.divmod(rest, rest.dtype.type(10))
        words[place // 4] = words[place // 4] + ((digit.astype(np.uint32) + np.uint32(48)) << np.uint32(8 * (place % 4)))
    state = [np.full(len(row), s, np.uint32) for s in START]
    for k in range(blocks - 1):
        state = [s + t for s, t in zip(state, turned(state, words[16 * k : 16 * k + 16]), strict=True)]
    # What step 61 makes is a after step 64.
    return (state[0] + turned(state, words[16 * blocks - 16 :], 61)[1]).byteswap()


def below(texts: list[bytes], first: np.ndarray, last: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each text, how many numbers t of first .. last have the first 32 bits of md5 of text + t, as a share of 2**32, below limit."""
    hits, lengths = np.zeros(len(texts), np.int64), np.array([len(t) for t in texts], np.int64)
    least, most = 1, 0
    while least <= last.max(initial=0):
        digits, most = len(str(least)), 10 * least - 1
        begin, end = np.maximum(first, least), np.minimum(last, most)
        for length in np.unique(lengths[begin <= end]):
            rows = np.flatnonzero((begin <= end) & (lengths == length))
            many = end[rows] - begin[rows] + 1
            ends = np.cumsum(many)
            known = np.frombuffer(b"".join(texts[r] for r in rows), np.uint8).reshape(len(rows), length)
            for low in range(0, int(ends[-1]), TOGETHER):
                at = np.arange(low, min(low + TOGETHER, int(ends[-1])))
                here = np.searchsorted(ends, at, "right")
                own = slice(int(here[0]), int(here[-1]) + 1)
                numbers = begin[rows][here] + at - (ends - many)[here]
                hit = firsts(known[own], here - here[0], numbers, digits) < limit[rows][here] * 2.0**32
                hits[rows[own]] += np.bincount(here - here[0], hit, own.stop - own.start).astype(np.int64)
        least = 10 * least
    return hits
