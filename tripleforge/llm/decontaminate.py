"""Benchmark decontamination through suffix arrays of the training texts.

The words of the documents are dealt into shards, each of whole documents.  A shard holds its words as numbers, with a
separator behind each document, and their suffix array.  Every suffix of every test item is binary-searched in every
shard, a word deeper at a time, while its interval isn't empty: where it ends is the suffix's longest verbatim match.
The interval at the depth of a window lists all places where that window stands.

Building and searching a shard is one pass over the documents that shuffles nothing, as long as the items fit one
block.  More items come in blocks: the shards are then written to the shared folder once and searched by each block.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased.  A null or
empty text has no words and no hits; an item without words has no windows.  Items of equal text each count; rows that
repeat an item's id count as one item with the windows of all of them; an item without an id makes hits but is not
counted as an item.  Repeated documents are found alike, rows without an id are rows, empty tables give empty results
or no hits.  Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, remove as remove_table, staged

WINDOW = 10
#: Words of one shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 19
#: Bytes of the items' texts that one block holds, about; blocks grow in number.
BLOCK_BYTES = 1 << 23
#: Places where windows stand that are looked at together.
CHUNK = 1 << 21

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Places of the words (codes from 1) in the order of their suffixes, each ending with its document, whose separator is 0.

    Prefix doubling: suffixes are ranked by their first 1, 2, 4, ... words; those with a rank of their own are done.
    Equal suffixes follow the order of their documents.
    """
    n = len(codes)
    ends = np.flatnonzero(codes == 0)
    first = codes.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    order = np.argsort(first, kind="stable")
    slots, rank, key, k = np.arange(n), np.zeros(n, np.int64), first[order], 1
    places = order
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(key)))
        rank[places] = np.repeat(slots[at], size)
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            return order[len(ends) :].astype(np.int32)
        slots, places = slots[open_], places[open_]
        key = rank[places] * n + rank[places + k]
        by = np.argsort(key)
        places, key = places[by], key[by]
        order[slots] = places
        k *= 2


class Shard:
    """The words of whole documents with their suffix array."""

    def __init__(self, vocabulary: list[bytes], codes: np.ndarray, array: np.ndarray | None = None):
        self.vocabulary, self.codes = vocabulary, codes
        self.array = suffix_array(codes) if array is None else array
        self.ends = np.flatnonzero(codes == 0)  # a separator for each document
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))

    def bound(self, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
        """For each interval whose suffixes agree on ``depth`` words, the first place whose next word is not below ``wanted``."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = self.array[np.minimum(mid, len(self.array) - 1)] + depth  # beyond the words only for intervals that have closed
            below = open_ & (self.codes[np.minimum(at, len(self.codes) - 1)] < wanted)
            low, high = np.where(below, mid + 1, low), np.where(open_ & ~below, mid, high)
        return low

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each suffix of the block's items: its longest match in words, a place of it, and the interval of its window (empty without one)."""
        n = len(block.rest)
        longest, place = np.zeros(n, np.int32), np.full(n, -1, np.int64)
        low_w, high_w = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(self.array):
            return longest, place, low_w, high_w
        known = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        codes = np.array([0, *(known.get(w, -1) for w in block.vocabulary)], np.int32)[block.codes]
        alive = np.flatnonzero(codes[block.at] > 0)
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(self.array), np.int64)
        depth = 0
        while len(alive):
            wanted = codes[block.at[alive] + depth]
            low, high = self.bound(low, high, depth, wanted), self.bound(low, high, depth, wanted + 1)
            depth += 1
            met = low < high
            alive, low, high = alive[met], low[met], high[met]
            longest[alive], place[alive] = depth, self.array[low]
            whole = block.need[alive] == depth
            low_w[alive[whole]], high_w[alive[whole]] = low[whole], high[whole]
            on = block.rest[alive] > depth
            on[on] = codes[block.at[alive[on]] + depth] > 0
            alive, low, high = alive[on], low[on], high[on]
        return longest, place, low_w, high_w

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents, first and last words (exclusive) of the runs of hit words; and pairs of documents and the block's items."""
        _, _, low, high = self.search(block)
        asked = np.flatnonzero((block.window >= 0) & (low < high))
        asked = asked[np.unique(block.window[asked], return_index=True)[1]]  # a window that several items share is looked up once
        change, pairs = np.zeros(len(self.codes) + 1, np.int32), []
        size = high[asked] - low[asked]
        cut = np.searchsorted(np.cumsum(size), np.arange(CHUNK, size.sum() + CHUNK, CHUNK)) + 1 if len(asked) else []
        for own in np.split(np.arange(len(asked)), np.unique(np.minimum(cut, len(asked)))) if len(asked) else []:
            if not len(own):
                continue
            n = size[own]
            at = self.array[np.repeat(low[asked[own]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())].astype(np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + np.repeat(block.need[asked[own]], n), -1)
            doc = np.searchsorted(self.starts, at, "right") - 1
            pairs.append(np.unique(doc * len(block.first) + np.repeat(block.window[asked[own]], n)))
        hit = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
        turn = np.diff(hit)
        begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        doc = np.searchsorted(self.starts, begin, "right") - 1
        who, items = block.items_of(np.unique(np.concatenate(pairs))) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return doc, begin - self.starts[doc], end - self.starts[doc], who, items


class Block:
    """Items of a benchmark, as numbers: their suffixes and their windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = [(name, w) for name, text in items if (w := words(text))]
        self.texts = [name for name, _ in texts]
        self.names = sorted({name for name in self.texts if name is not None})
        number, code = {name: i for i, name in enumerate(self.names)}, defaultdict(itertools.count(1).__next__)
        codes: list[int] = []
        at, rest, need, own, held = [], [], [], [], defaultdict(set)
        numbers: dict[bytes, int] = {}
        for name, w in texts:
            n, span = len(w), min(window, len(w))
            for i in range(n):
                at.append(len(codes) + i)
                rest.append(n - i)
                need.append(span if i + span <= n else 0)
                own.append(numbers.setdefault(b" ".join(w[i : i + span]), len(numbers)) if i + span <= n else -1)
                if own[-1] >= 0 and name is not None:
                    held[own[-1]].add(number[name])
            codes += [code[x] for x in w] + [0]
        self.vocabulary, self.codes = list(code), np.array(codes, np.int32)
        self.at, self.rest, self.need, self.window = (np.array(x, np.int64) for x in (at, rest, need, own))
        # The items that hold each window, one after another.
        self.first = np.concatenate(([0], np.cumsum([len(held[i]) for i in range(len(numbers))]))).astype(np.int64)
        self.items = np.array([x for i in range(len(numbers)) for x in sorted(held[i])], np.int64)

    def items_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct documents and items, from distinct numbers of documents and windows."""
        doc, own = pairs // len(self.first), pairs % len(self.first)
        n = self.first[own + 1] - self.first[own]
        out, total = [np.zeros(0, np.int64)], max(1, len(self.names))
        for part in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(np.cumsum(n) // CHUNK)) + 1):
            m = n[part]
            at = np.repeat(self.first[own[part]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            out.append(np.unique(np.repeat(doc[part], m) * total + self.items[at]))
        both = np.unique(np.concatenate(out))
        return both // total, both % total


def _blocks(tests: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK_BYTES``, each of them read to the driver when it is asked for; one block at least."""
    rows = tests.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    for i in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == i)
        yield Block([(r.name, r.text) for r in own.select("name", "text").collect()], window)


def _grouped(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[Shard, pa.RecordBatch]]:
    """Shards, and the rows that each was built from."""
    code, codes, held = defaultdict(itertools.count(1).__next__), [], []

    def made() -> tuple[Shard, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        return Shard(list(code), np.array(codes, np.int32)), rows[0]

    for batch in batches:
        begin = 0
        for i, text in enumerate(batch.column(text_col)):
            codes.extend(map(code.__getitem__, words(text.as_py())))
            codes.append(0)
            if len(codes) >= SHARD_WORDS:
                held.append(batch.slice(begin, i + 1 - begin))
                yield made()
                code, codes, held, begin = defaultdict(itertools.count(1).__next__), [], [], i + 1
        if begin < len(batch):
            held.append(batch.slice(begin))
    if held:
        yield made()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards as a table: shard, ids, vocabulary, codes, places (the suffix array).  For more than one search."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, own in _grouped(batches, "text"):
            ids = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.column("doc_id"))
            binary = [b" ".join(shard.vocabulary), shard.codes.tobytes(), shard.array.tobytes()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in binary)], ["ids", "vocabulary", "codes", "places"])

    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"ids array<{kind}>, vocabulary binary, codes binary, places binary")
    return out.select(F.monotonically_increasing_id().alias("shard"), "*")


def _found(shard: Shard, block: Block, ids: pa.Array, number: pa.Array) -> pa.RecordBatch:
    doc, begin, end, who, items = shard.hits(block)
    n = len(ids)
    lists = lambda of, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)
    names = pa.array([block.names[i] for i in items], pa.string())
    spans = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"])
    columns = [number, pa.array(np.arange(n), pa.int64()), ids, pa.array(shard.ends - shard.starts, pa.int64()), lists(doc, spans), lists(who, names)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "row", "doc_id", "n_words", "spans", "items"])


def search(shards: DataFrame, block: Block) -> DataFrame:
    """shard, row, doc_id, n_words, spans, items of all documents of an index that is stored."""
    kind = shards.select("ids").schema[0].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                vocabulary, codes, places = (batch.column(c)[i].as_py() for c in ("vocabulary", "codes", "places"))
                shard = Shard(vocabulary.split(), np.frombuffer(codes, np.int32), np.frombuffer(places, np.int32))
                ids = batch.column("ids")[i].values
                yield _found(shard, block, ids, pa.repeat(batch.column("shard")[i], len(ids)))

    return shards.select("shard", "ids", "vocabulary", "codes", "places").mapInArrow(run, _schema(kind))


def _schema(kind: str) -> str:
    return f"shard long, row long, doc_id {kind}, n_words long, spans array<struct<begin: long, end: long>>, items array<string>"


def matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, spans (begin, end: the runs of words that windows of items cover), items (the distinct ids as strings, sorted)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    blocks = _blocks(tests, item_col, item_text_col, window)
    first, second = next(blocks), next(blocks, None)
    if second is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, own in _grouped(batches, "text"):
                yield _found(shard, first, own.column("doc_id"), pa.nulls(len(own), pa.int64()))

        return rows.mapInArrow(run, _schema(kind)).select("doc_id", "n_words", "spans", "items")
    stored = staged(index(rows), path := new_path(docs.sparkSession))
    parts = []
    for block in itertools.chain([first, second], blocks):
        found = staged(search(stored, block).where("size(items) + size(spans) > 0").drop("doc_id", "n_words"))
        parts.append(found)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    run_end = lambda s, x: F.struct(  # noqa: E731  a span either goes on or begins a new one
        F.when((F.size(s["done"]) > 0) & (x["begin"] <= F.element_at(s["done"], -1)["end"]), F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(F.struct(F.element_at(s["done"], -1)["begin"].alias("begin"), F.greatest(F.element_at(s["done"], -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(s["done"], F.array(x))).alias("done")
    )
    none = F.struct(F.array().cast("array<struct<begin: long, end: long>>").alias("done"))
    joined = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), none, run_end, lambda s: s["done"])
    merged = every.groupBy("shard", "row").agg(joined.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    texts = search(stored, Block([])).select("shard", "row", "doc_id", "n_words")
    out = texts.join(merged, ["shard", "row"], "left")
    empty = lambda c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c]))
    out = staged(out.select("doc_id", "n_words", empty("spans").alias("spans"), empty("items").alias("items")))
    remove_table(docs.sparkSession, path)
    return out


def longest(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 1) -> DataFrame:
    """item_id (as string), n_words, item_at, doc_id, doc_at: of each item that has one, the longest verbatim match of at least ``least`` words.

    Of equally long ones, the first in the item, then the smallest id.  Each shard tells one match an item.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def told(block: Block) -> Callable:
        ends = np.flatnonzero(block.codes == 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, own in _grouped(batches, "text"):
                size, place, _, _ = shard.search(block)
                item = np.searchsorted(ends, block.at)
                by = np.lexsort((block.at, -size, item))
                by = by[np.unique(item[by], return_index=True)[1]]
                by = by[size[by] >= max(1, least)]
                doc = np.searchsorted(shard.starts, place[by], "right") - 1
                names = pa.array([block.texts[item[i]] for i in by], pa.string())
                at = block.at[by] - np.concatenate(([0], ends[:-1] + 1))[item[by]]
                columns = [names, pa.array(size[by], pa.int64()), pa.array(at, pa.int64()), own.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(place[by] - shard.starts[doc], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "n_words", "item_at", "doc_id", "doc_at"])

        return run

    out = None
    for block in _blocks(tests, item_col, item_text_col, WINDOW):
        part = rows.mapInArrow(told(block), f"item_id string, n_words long, item_at long, doc_id {kind}, doc_at long")
        out = part if out is None else out.unionByName(part)
    best = F.min(F.struct((-F.col("n_words")).alias("less"), "item_at", F.col("doc_id").isNull().alias("none"), "doc_id", "doc_at")).alias("b")
    return out.groupBy("item_id").agg(best).select("item_id", (-F.col("b.less")).alias("n_words"), "b.item_at", "b.doc_id", "b.doc_at")


def remove(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item stands, with all their columns."""

    def kept(block: Block) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, own in _grouped(batches, text_col):
                clean = np.ones(len(own), bool)
                clean[shard.hits(block)[0]] = False
                yield own.filter(pa.array(clean))

        return run

    schema = docs.schema
    for block in _blocks(tests, item_col, item_text_col, window):
        docs = docs.mapInArrow(kept(block), schema)
    return docs
