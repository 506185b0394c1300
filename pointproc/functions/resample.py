"""Counter-based random numbers: a hash of (seed, counters), so any task can
recompute any draw and a retried task repeats its own draws exactly.

``draw_word`` and ``draw_index`` are expressions; ``draw_words`` gives the same
numbers for whole arrays of counters inside a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digests worked out together, so that a numpy call costs little against its work.
CHUNK = 1 << 16
#: Four decimal digits as the bytes of a little-endian word.
_FOUR = (np.arange(10_000)[:, None] // 10 ** np.arange(3, -1, -1) % 10 + 48).astype(np.uint8).view("<u4").ravel().astype(np.uint64)


def draw_word(*parts: Column | int | str) -> Column:
    """A 60-bit word (as BIGINT) from the joined counter parts."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def draw_index(n: Column | int, *parts: Column | int | str) -> Column:
    """0-based index in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(draw_word(*parts), n.cast("bigint"))


# MD5 (RFC 1321): rotations of the four rounds, the sine rule for the added constants,
# and the word of the message that each step takes.
_ROTATE = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_ADD = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_WORD = [(a * i + b) % 16 for a, b in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def first_halves(messages: np.ndarray) -> np.ndarray:
    """First 8 bytes of the MD5 digests of equally long messages (rows of bytes, at most 55) as big-endian numbers."""
    rows, length = messages.shape
    if length > 55:
        raise ValueError("a message must fit one block")
    block = np.zeros((rows, 64), np.uint8)
    block[:, :length] = messages
    block[:, length] = 0x80
    words = list(np.ascontiguousarray(block.view("<u4").T))
    words[14] = 8 * length
    return _first_half(words, rows)


def _first_half(words: list[np.ndarray | int], rows: int) -> np.ndarray:
    """First 8 bytes of the digests of blocks, given as 16 words: arrays, or numbers where all rows have the same."""
    a, b, c, d = (np.full(rows, v, np.uint32) for v in _START)
    f, turned = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for step in range(64):
        if step < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif step < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif step < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:  # c ^ (b | ~d)
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[_WORD[step]]
        f += a
        if isinstance(word, np.ndarray):
            f += word
            word = 0
        f += np.uint32((int(_ADD[step]) + word) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_ROTATE[step]), out=turned)
        f >>= np.uint32(32 - _ROTATE[step])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b = a + _START[0], b + _START[1]
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def _digits(x: np.ndarray, width: int) -> np.ndarray:
    """Decimal digits of numbers that have so many."""
    return (x[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8)


def _message(parts: list[bytes | tuple[np.ndarray, int]]) -> list[np.ndarray | int]:
    """The words of one block from fixed bytes and from numbers of at most 8 digits with how many they have."""
    long: list[np.ndarray | int] = [0] * 8
    at = 0

    def put(value, size: int) -> None:
        nonlocal at
        k, bit = at // 8, at % 8 * 8
        array = isinstance(value, np.ndarray)
        long[k] = long[k] | (value << np.uint64(bit) if array else value << bit & (1 << 64) - 1)
        if bit + 8 * size > 64:
            long[k + 1] = long[k + 1] | (value >> np.uint64(64 - bit) if array else value >> 64 - bit)
        at += size

    for part in parts:
        if isinstance(part, bytes):
            for lo in range(0, len(part), 8):
                put(int.from_bytes(part[lo:lo + 8], "little"), len(part[lo:lo + 8]))
        else:
            x, size = part[0].astype(np.uint64), part[1]
            high = x // np.uint64(10_000)
            put((_FOUR[high] | _FOUR[x - high * np.uint64(10_000)] << np.uint64(32)) >> np.uint64(64 - 8 * size), size)
    length = at
    put(0x80, 1)
    words = []
    for x in long:
        if isinstance(x, np.ndarray):
            words += [x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)]
        else:
            words += [x & 0xFFFFFFFF, x >> 32]
    words[14] = 8 * length
    return words


def _width(x: np.ndarray) -> np.ndarray:
    """How many decimal digits whole numbers have."""
    out = np.ones(len(x), np.int64)
    for k in range(1, len(str(x.max()))):
        out += x >= 10**k
    return out


def draw_words(*parts: np.ndarray | int | str) -> np.ndarray:
    """The words of ``draw_word`` for arrays of whole numbers >= 0 (all of one length) and fixed parts.

    Parts are joined by bars, but for those around a comma, which make one counter.
    """
    n = len(next(p for p in parts if isinstance(p, np.ndarray)))
    commas = [isinstance(p, str) and p == "," for p in parts]
    joins = [b"" if k == 0 or commas[k] or commas[k - 1] else b"|" for k in range(len(parts))]
    out = np.empty(n, np.int64)
    for lo in range(0, n, CHUNK):
        now = [p[lo:lo + CHUNK] if isinstance(p, np.ndarray) else p for p in parts]
        shape = np.zeros(min(CHUNK, n - lo), np.int64)
        for p in now:
            if isinstance(p, np.ndarray):
                shape = shape * 20 + _width(p)
        for s in np.unique(shape[np.append(True, shape[1:] != shape[:-1])]).tolist():
            rows = np.flatnonzero(shape == s)
            one = len(rows) == len(shape)
            pieces = []
            for join, p in zip(joins, now):
                if isinstance(p, np.ndarray):
                    x = p if one else p[rows]
                    pieces += [join, (x, len(str(x[0])))]
                else:
                    pieces.append(join + str(p).encode())
            sizes = [len(x) if isinstance(x, bytes) else x[1] for x in pieces]
            if max(x[1] for x in pieces if isinstance(x, tuple)) <= 8 and sum(sizes) <= 55:
                found = _first_half(_message(pieces), len(rows))
            else:
                found = first_halves(np.concatenate([
                    np.broadcast_to(np.frombuffer(x, np.uint8), (len(rows), len(x))) if isinstance(x, bytes) else _digits(*x) for x in pieces], axis=1))
            out[lo + rows] = (found >> np.uint64(4)).astype(np.int64)
    return out
