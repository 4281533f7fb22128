"""Of numbered items, those that share most topics, counted in blocks of items.

A topic is a sorted list of its items' numbers.  Items are cut into an odd number of blocks, thought of as a circle.  A
block receives the lists that hold one of its items, of each only what lies in the block and in the half of the circle
behind it; so each two blocks meet in one of them, and it tells both sides.  Numbers are moved as planes of the bytes of
their differences, about two bytes each, and pairs are counted where the lists arrive.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in lists that a block receives, about; 4 bytes each.
RECEIVED = 16_000_000
#: Pairs of a topic's items from which on a further block is worth while.
PAIRS = 1_000_000
#: Numbers of lists that are taken together when they are dealt, and numbers that are sent together.
TAKEN, SENT = 262_144, 1_048_576


def block_count(sizes: Mapping[int, int], items: int, least: int) -> int:
    """An odd number of blocks, from how many topics have how many items: so many that a block receives about ``RECEIVED`` numbers.

    Long lists go to all blocks however many there are, so blocks are doubled only as long as that tells.
    """
    size, n = (np.array(list(x), float) for x in (sizes.keys(), sizes.values()))
    received = lambda blocks: float((n * size * (1 - (1 - 1 / blocks) ** size)).sum()) / 2
    blocks = min(least, int((n * size * size).sum() / PAIRS)) | 1
    while received(blocks) > RECEIVED and 2 * blocks < items and received(2 * blocks + 1) < 0.75 * received(blocks):
        blocks = 2 * blocks + 1
    return blocks


def planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next, as many as the largest number has."""
    most = max(1, (int(x.max()).bit_length() + 7) // 8)
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :most].T.tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    own = np.frombuffer(data, np.uint8).reshape(-1, n)
    out[:, : len(own)] = own.T
    return out.view("<u4").ravel().astype(np.int32)


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each list, n of them."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _differences(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each list's first number, and what is between the others."""
    out = np.diff(x, prepend=0)
    first = np.cumsum(n) - n
    out[first] = x[first]
    return out


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers whose ``_differences`` are given."""
    first, whole = np.cumsum(n) - n, np.cumsum(x, dtype=np.int64)
    return (whole - np.repeat(whole[first] - x[first], n)).astype(np.int32)


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring lists of so many numbers, at least one list."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def deal(n: np.ndarray, values: np.ndarray, blocks: int, width: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """block, lists, numbers, planes of their lengths and of their differences, from lists of ``n`` numbers."""
    block, first = values // width, np.cumsum(n) - n
    new = np.diff(block, prepend=-1) != 0
    new[first] = True
    own, to = np.repeat(np.arange(len(n)), n)[new], block[new]
    by = np.argsort(to, kind="stable")
    own, to = own[by], to[by]
    for a, b in _runs(np.cumsum(n[own]), SENT):
        at, part = _places(first[own[a:b]], n[own[a:b]]), np.repeat(np.arange(b - a), n[own[a:b]])
        kept = (block[at] - to[a:b][part]) % blocks <= blocks // 2
        at, part = at[kept], part[kept]
        held = np.bincount(part, minlength=b - a)
        x, k, whose = values[at[held[part] > 1]], held[held > 1], to[a:b][held > 1]  # a single item makes no pair
        ends, cuts = np.cumsum(k), np.flatnonzero(np.diff(whose, prepend=-1, append=-1))
        for i, j in zip(cuts, cuts[1:], strict=False):
            mine = x[ends[i] - k[i] : ends[j - 1]]
            yield int(whose[i]), int(j - i), len(mine), planes(k[i:j]), planes(_differences(mine, k[i:j]))


def best_of(block: int, n: np.ndarray, values: np.ndarray, items: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, other and how many topics they share: for the block's items and those that it meets, the other with most here, of equals the first."""
    low, high, ends = block * width, (block + 1) * width, np.cumsum(n)
    at = np.flatnonzero((values >= low) & (values < high))
    by = np.argsort(values[at], kind="stable")
    who, lists = values[at][by], np.searchsorted(ends, at, side="right")[by]
    cuts = np.flatnonzero(np.diff(who, prepend=-1, append=-1))
    most, whose = np.zeros(items, np.int32), np.zeros(items, np.int32)  # of all items, as those of other blocks are told too
    own, own_whose = np.zeros(width, np.int32), np.zeros(width, np.int32)
    for i, j in zip(cuts, cuts[1:], strict=False):
        me, mine = int(who[i]), lists[i:j]
        met = values[_places(ends[mine] - n[mine], n[mine])]
        met.sort()
        first = np.flatnonzero(np.diff(met, prepend=-1))
        other, shared = met[first], np.diff(first, append=len(met)).astype(np.int32)
        shared[np.searchsorted(other, me)] = 0
        k = int(shared.argmax())
        own[me - low], own_whose[me - low] = shared[k], other[k]
        more = shared > most[other]
        most[other[more]], whose[other[more]] = shared[more], me
    top = min(high, items)
    most[low:top], whose[low:top] = own[: top - low], own_whose[: top - low]
    found = np.flatnonzero(most)
    return found, whose[found], most[found]


def most_shared(topics: DataFrame, items: int, least: int) -> DataFrame:
    """nth, b, shared: candidates for the item that shares most topics with each one, the best of each block where they meet.

    ``topics`` has stored rows ``others``, the sorted numbers (int) of a topic's items, at least two.
    """
    sizes = {r["size"]: r["count"] for r in topics.groupBy(F.size("others").alias("size")).count().collect()}  # few sizes: n of them take n^2 / 2 numbers
    blocks = block_count(sizes, items, least) if sizes else 1
    width = -(-items // blocks) or 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            n, values = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n, dtype=np.int64)
            for a, b in _runs(ends, TAKEN):
                rows = list(deal(n[a:b].astype(np.int64), values[ends[a] - n[a] : ends[b - 1]], blocks, width))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["block", "lists", "numbers", "lengths", "differences"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: int, parts: list) -> pa.RecordBatch:
            n, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            columns = [pa.array(c.astype(np.int64)) for c in best_of(block, n, values, items, width)]
            made = pa.StructArray.from_arrays(columns, ["nth", "b", "shared"])
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made)], ["others"])

        now, parts = None, []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                block, lists, numbers, lengths, differences = (x.as_py() for x in row)
                if parts and block != now:
                    yield told(now, parts)
                now, n = block, from_planes(lengths, lists).astype(np.int64)
                parts.append((n, _sums(from_planes(differences, numbers), n)))
        if parts:
            yield told(now, parts)

    sent = topics.select("others").mapInArrow(dealt, "block int, lists long, numbers long, lengths binary, differences binary")
    sent = sent.repartition(blocks, "block").sortWithinPartitions("block")
    return sent.mapInArrow(counted, "others array<struct<nth: long, b: long, shared: long>>").select(F.explode("others").alias("o")).select("o.*")
