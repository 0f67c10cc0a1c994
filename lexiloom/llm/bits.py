"""Bit counts of 64-bit hashes by group, in numpy."""

from __future__ import annotations

from itertools import combinations

import numpy as np

_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each group have each bit set: int64 (groups, 64).

    ``starts``: first index of each group, ascending, none empty.  Eight sums
    are kept in the bytes of one word, so segments have at most 255 hashes."""
    n = len(hashes)
    ends = np.append(starts[1:], n)
    per = (ends - starts + 254) // 255
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    seg = np.repeat(starts - first * 255, per) + np.arange(per.sum()) * 255
    out = np.empty((len(seg), 8, 8), np.int64)
    for k in range(8):
        lane = (hashes >> np.uint64(k)) & _LANES
        out[:, :, k] = np.add.reduceat(lane, seg).view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(out.reshape(-1, 64), first, axis=0)


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per group the word whose bits are those set in over half its hashes."""
    ends = np.append(starts[1:], len(hashes))
    bits = 2 * bit_counts(hashes, starts) > (ends - starts)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def scheme(n: int, radius: int) -> tuple[int, int]:
    """Blocks of the 64 bits, and how many of them two words within the radius share, for n words:
    the fewest keys of at least 16 bits whose buckets of unrelated words hold about 64 or fewer."""
    for shared in range(1, 5):
        blocks = radius + shared
        bits = 64 * shared // blocks
        if bits >= 16 and n <= 64 << bits:
            break
    return blocks, shared


def masks(blocks: int, shared: int) -> list[int]:
    """The bits of every choice of ``shared`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    one = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in combinations(one, shared)]


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def free_bits(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]
