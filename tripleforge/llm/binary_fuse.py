"""Three-way binary fuse filters with 8-bit fingerprints, built and probed in numpy.

A filter is a static set of 64-bit keys: about 9 bits a key, no false negatives, one false positive in 256.
Construction peels all singly-occupied slots of a round together, so that a round is a few vector operations.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key + seed."""
    with np.errstate(over="ignore"):
        x = keys + _U(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> _U(shift))) * _U(factor)
        return x ^ (x >> _U(33))


def _shape(n: int) -> tuple[int, int]:
    """Length of a segment and number of start segments for n keys."""
    n = max(n, 2)
    segment = 1 << min(18, max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
    slots = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
    return segment, max(1, -(-slots // segment) - 2)


def _slots(hashes: np.ndarray, segment: int, starts: int) -> np.ndarray:
    """Three slots of each hash, in consecutive segments."""
    mask = _U(segment - 1)
    first = ((hashes >> _U(32)) * _U(segment * starts)) >> _U(32)
    second = (first + _U(segment)) ^ ((hashes >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _print8(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> _U(32))) & _U(255)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, start segments and slots of a filter that holds the given uint64 keys."""
    keys = np.unique(keys.astype(np.uint64))
    segment, starts = _shape(len(keys))
    size = segment * (starts + 2)
    for seed in range(1, 200):
        hashes = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        at = _slots(hashes, segment, starts)
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            own, first = np.unique(owner[single], return_index=True)
            rounds.append((own, single[first]))
            for row in at[:, own]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, own)
            left -= len(own)
        if left:
            continue
        slots, prints = np.zeros(size, np.uint8), _print8(hashes)
        for own, slot in reversed(rounds):
            a, b, c = at[:, own]
            slots[slot] = prints[own] ^ slots[a] ^ slots[b] ^ slots[c]
        return seed, segment, starts, slots.tobytes()
    raise ValueError(f"no binary fuse filter found for {len(keys)} keys")


def contains(keys: np.ndarray, seed: int, segment: int, starts: int, slots: bytes) -> np.ndarray:
    """Whether each uint64 key may be in the filter; never false for one that is."""
    hashes = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    table = np.frombuffer(slots, np.uint8)
    a, b, c = _slots(hashes, segment, starts)
    return _print8(hashes) == (table[a] ^ table[b] ^ table[c])
