"""MD5 (RFC 1321) of every text of one list before every text of another, a tile of pairs at a time. Spark's md5 goes text by text; here a
step of the digest is taken for all pairs of a tile at once, in a fraction of the time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Pairs of a tile: five arrays of them stay within a core's cache.
TILE = 1 << 16
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = [i % 16 if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _mixed(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    """The function of step i, into out."""
    if i < 16:
        np.bitwise_xor(c, d, out)
        out &= b
        out ^= d
    elif i < 32:
        np.bitwise_xor(b, c, out)
        out &= d
        out ^= c
    elif i < 48:
        np.bitwise_xor(b, c, out)
        out ^= d
    else:
        np.invert(d, out)
        out |= b
        out ^= c


def _heads(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The digests' first 32 bits, (rows of left) x (rows of right): a message is a row of each, laid over each other. The last three steps don't touch them."""
    shape, blocks = (len(left), len(right)), left.shape[1] // 16
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    free = np.empty(shape, np.uint32)
    for block in range(blocks):
        words = []  # of each: what depends on one side only, and what depends on both
        for k in range(16 * block, 16 * block + 16):
            x, y = left[:, k, None], right[None, :, k]
            words.append((y, None) if not x.any() else (x, None) if not y.any() else (0, x | y))
        before = [x.copy() for x in (a, b, c, d)] if block else _START
        steps = 61 if block == blocks - 1 else 64
        for i in range(steps):
            _mixed(i, b, c, d, free)
            free += a
            one, both = words[_PLACES[i]]
            free += one + np.uint32(_ADDED[i])
            if both is not None:
                free += both
            by = _SHIFTS[i // 16][i % 4]
            np.right_shift(free, np.uint32(32 - by), a)
            np.left_shift(free, np.uint32(by), free)
            free |= a
            free += b
            a, b, c, d, free = d, free, b, c, a
        if steps == 61:
            b += before[0]
            return b.byteswap()
        for x, y in zip((a, b, c, d), before):
            x += np.uint32(y) if isinstance(y, int) else y
    raise ValueError("no block")


def _by_length(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Places and bytes (one row a text) of the texts of each length, and whether they are texts; nulls are a group of no bytes."""
    groups: dict[int, tuple[list[int], list[bytes]]] = {}
    for i, text in enumerate(texts):
        own = b"" if text is None else text.encode()
        places, found = groups.setdefault(-1 if text is None else len(own), ([], []))
        places.append(i)
        found.append(own)
    for n, (places, found) in groups.items():
        yield np.array(places), np.frombuffer(b"".join(found), np.uint8).reshape(len(found), max(n, 0)), n >= 0


def low_pairs(left: list[str | None], right: list[str | None], between: str, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in left and in right of the pairs whose digest's first 32 bits are at most bound. A pair's message is both texts with between between them, or
    the one that is not null, as concat_ws has it."""
    mid = np.frombuffer(between.encode(), np.uint8)
    rows, columns = [np.empty(0, int)], [np.empty(0, int)]
    lefts, rights = list(_by_length(left)), list(_by_length(right))
    for i, x, given in lefts:
        for j, y, too in rights:
            at = x.shape[1] + len(mid) * (given and too)
            size = at + y.shape[1]
            first, last = (np.zeros((len(z), (size + 8) // 64 * 64 + 64), np.uint8) for z in (x, y))
            first[:, : x.shape[1]] = x
            first[:, x.shape[1] : at] = mid[: at - x.shape[1]]
            last[:, at:size] = y
            last[:, size] = 0x80
            last[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
            first, last = first.view("<u4"), last.view("<u4")
            for q in range(0, len(j), TILE):
                height = max(1, TILE // min(TILE, len(j) - q))
                for p in range(0, len(i), height):
                    hits = np.nonzero(_heads(first[p : p + height], last[q : q + TILE]) <= np.uint32(bound))
                    rows.append(i[p + hits[0]])
                    columns.append(j[q + hits[1]])
    return np.concatenate(rows), np.concatenate(columns)
