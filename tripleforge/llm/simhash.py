"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most 4 of 64 bits agree on at least b - 4 of any b blocks of bits.  For each choice of
b - 4 blocks there is a table: the fingerprints with those blocks moved to the front, sorted by Gray rank.  The blocks
in front are the shared masked pattern of an upper node, at which nothing differs yet; below it, runs of neighbours in
Gray order share further bits.  A query goes down the levels with the differences accumulated so far, counting at each
node only the bits that the node's parent doesn't share already, and leaves a whole group as soon as more than 4 differ.
Groups whose members are linked already are left as well, so a dense group costs about its size.

Only distinct fingerprints enter; copies follow their fingerprint.  Tables are cut by rank into even ranges, so a hot
group is spread over tasks; what then lies in several ranges is compared across them in a second pass.

Links are between fingerprints, so rows without an id and ids with several texts link like all others; a component's id
is the smallest of all ids that links reach, null if none of its rows has one.  A null or empty text has fingerprint zero
and is linked like any other.  Repeated rows are rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, unused, with_facts
from .graphs import components

BITS = 64
SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Nodes of the lowest level hold so many fingerprints.
LEAF = 16
#: Part of a group that one task of the second pass takes.
CHUNK = 2048
#: Rows of the tables that one range holds, about; the ranges grow in number, not in size.
RANGE_ROWS = 1 << 20
#: Shingles hashed at a time, so that a long text needs no more memory than its words.
BATCH = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit j is 1 if it is set in over half of the XXH64 values of the text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    count = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BATCH):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(first[at : at + BATCH], last[at : at + BATCH], strict=True)], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * count > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """doc_id, raw, fp (64 bits as a signed long); raw is ``mark``, a number that tells rows of one id apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "raw": pdf["raw"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(0) if mark is None else mark).cast("long").alias("raw"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, raw long, fp long")


def tables(blocks: int, distance: int = DISTANCE) -> tuple[list[list[int]], int]:
    """Orders of the bits, highest first, one for each choice of blocks in front; and the least number of bits in front."""
    cut = np.array_split(np.arange(BITS - 1, -1, -1), blocks)
    orders, least = [], BITS
    for front in itertools.combinations(range(blocks), blocks - distance):
        bits = [int(x) for b in front for x in cut[b]]
        least = min(least, len(bits))
        orders.append(bits + [int(x) for b in range(blocks) if b not in front for x in cut[b]])
    return orders, least


def moved(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with their bits in the given order, highest first; runs of bits move together."""
    out, at, to = np.zeros_like(fp), 0, BITS
    while at < BITS:
        run = 1
        while at + run < BITS and order[at + run] == order[at] - run:
            run += 1
        low, to = order[at] - run + 1, to - run
        out |= ((fp >> np.uint64(low)) & np.uint64((1 << run) - 1)) << np.uint64(to)
        at += run
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Sets:
    """Disjoint sets of 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i], all together: the larger root hangs below the smaller until all agree."""
        while len(a):
            x, y = self.roots(a), self.roots(b)
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.up[at]
        while (again := self.up[found]).tobytes() != found.tobytes():
            found = again
        self.up[at] = found
        return found

    def all(self) -> np.ndarray:
        return self.roots(np.arange(len(self.up)))


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Masks and patterns of the nodes of each level, root first.  Node i of a level has children 2i and 2i + 1."""
    starts = np.arange(0, len(codes), LEAF)
    both, any_ = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    out = []
    while True:
        out.append((~(both ^ any_), both))
        if len(both) == 1:
            return out[::-1]
        at = np.arange(0, len(both), 2)
        both, any_ = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(any_, at)


def link(codes: np.ndarray, sets: _Sets, asking: np.ndarray | None = None, distance: int = DISTANCE) -> None:
    """Joins in ``sets`` all codes of one group, sorted by Gray rank, that a path of links connects.

    With ``asking`` (places in ``codes``), at least all links of those codes are found.
    """
    n = len(codes)
    for lag in range(1, min(n, LEAF)):
        near = np.flatnonzero(np.bitwise_count(codes[lag:] ^ codes[:-lag]) <= distance)
        sets.join(near, near + lag)
    of = sets.all()
    if n <= LEAF or (of == of[0]).all():
        return
    if asking is None:  # every link between two sets has an end outside the largest set
        asking = np.flatnonzero(of != np.bincount(of).argmax())
    levels = _levels(codes)
    for at in range(0, len(asking), 256):
        q = asking[at : at + 256]
        of = sets.all()
        low, high = np.minimum.reduceat(of, np.arange(0, n, LEAF)), np.maximum.reduceat(of, np.arange(0, n, LEAF))
        alone = [np.where(low == high, low, -1)]
        while len(alone[-1]) > 1:
            a = alone[-1]
            left, right = a[::2], np.append(a[1::2], a[-1]) if len(a) % 2 else a[1::2]
            alone.append(np.where(left == right, left, -1))
        alone = alone[::-1]
        who, node, gone, above = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64)
        for level, (mask, pattern) in enumerate(levels):
            if level:
                who, gone, above = np.repeat(who, 2), np.repeat(gone, 2), np.repeat(above, 2)
                node = np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                real = node < len(mask)
                who, gone, above, node = who[real], gone[real], above[real], node[real]
            gone = gone + np.bitwise_count((codes[q[who]] ^ pattern[node]) & mask[node] & ~above)
            keep = (gone <= distance) & (alone[level][node] != of[q[who]])
            who, node, gone = who[keep], node[keep], gone[keep]
            above = mask[node]
        for part in range(0, len(who), 1 << 16):
            w, leaf = who[part : part + (1 << 16)], node[part : part + (1 << 16)]
            member = leaf[:, None] * LEAF + np.arange(LEAF)
            real = member < n
            member = np.minimum(member, n - 1)
            hit = (np.bitwise_count(codes[member] ^ codes[q[w]][:, None]) <= distance) & real
            sets.join(np.broadcast_to(q[w][:, None], hit.shape)[hit], member[hit])


def _stars(rep: np.ndarray, sets: _Sets) -> pd.DataFrame:
    """A link from each member to the smallest member of its set."""
    of = sets.all()
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, of, rep)
    at = least[of] != rep
    return pd.DataFrame({"a": rep[at], "b": least[of][at]})


def _range_links(batches: Iterator[pd.DataFrame], front: int) -> Iterator[pd.DataFrame]:
    """Links inside each group of one range of the tables; and, with b null, the groups at the range's two ends."""
    parts = [(p["t"].to_numpy(), p["rank"].to_numpy(), p["rep"].to_numpy()) for p in batches if len(p)]
    if not parts:
        return
    t, rank, rep = (np.concatenate(x) for x in zip(*parts, strict=True))
    code = rank.view(np.uint64) ^ np.uint64(1 << 63)
    code = code ^ (code >> np.uint64(1))
    key = code >> np.uint64(BITS - front)
    cut = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True])))
    size, sets = np.diff(cut), _Sets(len(t))
    group = np.repeat(np.arange(len(size)), size)
    for lag in range(1, min(int(size.max()), LEAF)):  # small groups are leaves of the tables: all pairs of a leaf
        near = np.flatnonzero(group[lag:] == group[:-lag])
        near = near[np.bitwise_count(code[near + lag] ^ code[near]) <= DISTANCE]
        sets.join(near, near + lag)
    for g in np.flatnonzero(size > LEAF):
        own = _Sets(int(size[g]))
        link(code[cut[g] : cut[g + 1]], own)
        sets.join(np.arange(cut[g], cut[g + 1]), cut[g] + own.all())
    for g in {0, len(size) - 1}:
        yield pd.DataFrame({"a": [int(t[cut[g]])], "b": pd.array([None], "Int64"), "key": pd.array([int(key[cut[g]])], "Int64")})
    out = _stars(rep, sets)
    yield out.assign(b=out["b"].astype("Int64"), key=pd.array([None] * len(out), "Int64"))


def _chunk_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the asking members and the part of a group that came with them."""
    pdf = pdf.drop_duplicates("rep")
    code = gray_rank(pdf["code"].to_numpy().view(np.uint64))
    pdf = pdf.iloc[np.argsort(code, kind="stable")]
    codes, sets = pdf["code"].to_numpy().view(np.uint64), _Sets(len(pdf))
    link(codes, sets, np.flatnonzero(pdf["asks"].to_numpy()))
    return _stars(pdf["rep"].to_numpy(), sets)


def near_links(distinct: DataFrame) -> DataFrame:
    """node, component (as ``components``) of all fingerprints (fp, rep) that are linked to others, rep being a distinct number each."""
    spark = distinct.sparkSession
    n = distinct.count()
    blocks = next(b for b in (6, 7, 8, 9) if b == 9 or n <= 64 << tables(b)[1])
    orders, front = tables(blocks)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
            for t, order in enumerate(orders):
                rank = gray_rank(moved(fp, order)) ^ np.uint64(1 << 63)
                yield pd.DataFrame({"t": np.full(len(fp), t, np.int32), "rank": rank.view(np.int64), "rep": rep})

    dealt = distinct.mapInPandas(deal, "t int, rank long, rep long")
    cuts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(orders) // RANGE_ROWS))
    ranges = dealt.repartitionByRange(cuts, "t", "rank").sortWithinPartitions("t", "rank")
    found = durable(ranges.mapInPandas(lambda x: _range_links(x, front), "a long, b long, key long"))
    first = components(found.where("b is not null").select("a", "b"))
    # The second pass: groups that lie in several ranges.  There are fewer of them than ranges.
    ends = found.where("b is null").groupBy(F.col("a").cast("int").alias("t"), "key").agg(F.count(F.lit(1)).alias("ends")).where("ends > 1").select("t", "key")
    if not (wide := ends.collect()):
        return first
    ends = F.broadcast(spark.createDataFrame(wide, "t int, key long"))  # two rows for each range at most
    rank = F.col("rank").bitwiseXOR(F.lit(-(1 << 63)))
    code = rank.bitwiseXOR(F.shiftrightunsigned(rank, 1))
    members = dealt.select("t", code.alias("code"), F.shiftrightunsigned(code, BITS - front).alias("key"), "rep").join(ends, ["t", "key"])
    members = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("of", F.coalesce("component", "rep")).drop("component")
    members = durable(members)
    sizes = members.groupBy("t", "key", "of").agg(F.count(F.lit(1)).alias("n")).groupBy("t", "key").agg(F.max_by("of", "n").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    open_ = members.join(F.broadcast(sizes.where("most < all")), ["t", "key"])  # no more rows than ``ends``
    chunks = F.ceil(F.col("all") / CHUNK).cast("int")
    asks = F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int")
    open_ = open_.withColumn("i", F.pmod(F.xxhash64("rep"), chunks)).withColumn("j", F.pmod(F.xxhash64("rep", F.lit(1)), asks))
    hosts = open_.withColumn("j", F.explode(F.sequence(F.lit(0), asks - 1))).select("t", "key", "i", "j", "code", "rep", F.lit(False).alias("asks"))
    askers = open_.where("of != main").withColumn("i", F.explode(F.sequence(F.lit(0), chunks - 1))).select("t", "key", "i", "j", "code", "rep", F.lit(True).alias("asks"))
    both = hosts.withColumn("i", F.col("i").cast("int")).unionByName(askers.withColumn("j", F.col("j").cast("int")))
    met = both.groupBy("t", "key", "i", "j", "code", "rep").agg(F.max("asks").alias("asks"))
    more = met.groupBy("t", "key", "i", "j").applyInPandas(_chunk_links, "a long, b long")
    return components(durable(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))


def _classes(docs: DataFrame, id_col: str, text_col: str, mark: Column | None) -> DataFrame:
    """doc_id, raw, fp, class (a fingerprint that stands for all that links join), component_id: links are between fingerprints, ids follow them."""
    rows = durable(fingerprints(docs, id_col, text_col, mark))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")))
    linked = near_links(distinct.select("fp", F.col("fp").alias("rep"))).withColumnRenamed("node", "fp")
    of = durable(distinct.join(linked, "fp", "left").withColumn("class", F.coalesce("component", "fp")).drop("component"))
    ids = of.groupBy("class").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    n, total = of.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    of = with_facts(of, ids, "class", "members", n).select("fp", "class", "component_id", "times")
    return with_facts(rows, of, "fp", "times", total)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach), raw (``mark``)."""
    rows = _classes(docs, id_col, text_col, mark)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "raw")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay for what links join, with all their columns.

    Of each class the row with the smallest id stays, of rows without an id none if another row of the class has one.  Of
    several texts with this id, or without any id, the one with the smallest hash stays; rows that repeat id and text
    can't be told apart and stay together.
    """
    name, same = unused(docs, "_stays_id", "_stays_raw")
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("b")
    stays = _classes(docs, id_col, text_col, raw).groupBy("class").agg(first)
    stays = stays.select(F.col("b.doc_id").alias(name), F.col("b.raw").alias(same))
    return docs.join(stays, F.col(id_col).eqNullSafe(F.col(name)) & (raw == F.col(same)), "left_semi")
