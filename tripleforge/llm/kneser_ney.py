"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams, one for each language.

The model is counted over all trusted texts but every HELD_OUT-th: raw counts for the longest n-grams, continuation counts
below, three discounts an order from the counts of counts.  It stays a sharded table (language, key, value) of weights:
what an n-gram adds at its order, and what a context passes on to the order below.

Texts are dealt into buckets of about BUCKET_BYTES by a hash of the id, packed and compressed by batch, bucket and
language, so that shuffling them costs less than they take on disk.  Trusted texts are counted where they are read if
their ids are few enough to broadcast; otherwise a bucket meets the ids of its trusted texts.  Scoring never joins single
positions: each bucket asks for the distinct n-grams it holds, those join the sharded weights, and what comes back meets
the bucket's texts again, whose positions are then read off a table.

A text is kept if its perplexity is at most a quantile of the held-out trusted texts' perplexities in its language (of all
trusted texts if none is held out, of all texts if none is trusted).  A null text counts as empty; an empty text has the
perplexity of its end alone and is judged like any other.  A null language is a language of its own; without a model every
byte is equally likely.  Rows with a null id are never trusted.  Repeated rows are rows, and an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

ORDER = 4  # n-grams are read as two pairs of bytes
SYMBOLS = 257
QUANTILE = 0.999
#: Of so many trusted texts one is not counted, so that thresholds come from texts that the model hasn't seen.
HELD_OUT = 5
#: Bytes of a bucket's texts, about; what a bucket asks for grows much more slowly than its texts.
BUCKET_BYTES = 10 << 20
#: Trusted ids that are broadcast; more meet the texts by bucket.
MOST_BROADCAST = 1 << 20
#: N-grams that a task holds before it gives out their counts.
MOST_HELD = 1 << 21
#: Thresholds of so many languages are broadcast; more are joined by shuffling.
FEW_LANGUAGES = 10_000
FIRST, LAST = 0, 1
_CLEAN = bytes([32 if i < 33 else i for i in range(256)])
#: Keys: order, then whether it is a context's weight, then the bytes.
_ORDER, _CONTEXT = 1 << 40, 1 << 36
_DENSE = 1 << 24


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each between its marks, and how many n-grams each has."""
    parts, sizes = [], []
    for t in texts:
        data = (t or "").lower().encode("utf-8", "surrogatepass").translate(_CLEAN)
        parts.append(bytes([FIRST] * (ORDER - 1)) + data + bytes([LAST]))
        sizes.append(len(data) + 1)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(sizes, np.int64)


class _Grams:
    """The n-grams of some texts as places in a table of their distinct pairs of bytes."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        self.pairs = np.flatnonzero(np.bincount(pair, minlength=65536))
        number = np.zeros(65536, np.int64)
        number[self.pairs] = np.arange(len(self.pairs))
        code = number[pair]
        place = code[:-2] * len(self.pairs) + code[2:]
        starts = np.concatenate(([0], np.cumsum(self.sizes + ORDER - 1)[:-1]))
        inside = np.ones(len(place) + 1, np.int8)
        cut = np.concatenate([starts[1:] - k for k in range(1, ORDER)]) if len(starts) > 1 else np.zeros(0, np.int64)
        inside[cut] = 0
        place = place[inside[: len(place)].astype(bool)]
        if len(self.pairs) ** 2 <= _DENSE:
            count = np.bincount(place, minlength=len(self.pairs) ** 2)
            self.distinct = np.flatnonzero(count)
            self.counts = count[self.distinct]
            at = np.zeros(len(count), np.int32)
            at[self.distinct] = np.arange(len(self.distinct), dtype=np.int32)
            self.at = at[place]
        else:
            self.distinct, self.at, self.counts = np.unique(place, return_inverse=True, return_counts=True)

    def codes(self) -> np.ndarray:
        """The distinct n-grams, four bytes in a number."""
        return self.pairs[self.distinct // len(self.pairs)] << 16 | self.pairs[self.distinct % len(self.pairs)]

    def sums(self, value: np.ndarray) -> np.ndarray:
        """For each text, the sum over its n-grams of a value given for each distinct n-gram."""
        return np.add.reduceat(value[self.at], np.concatenate(([0], np.cumsum(self.sizes)[:-1])))


def _deal(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, lang, ids, sizes, packed: the texts of docs (doc_id, lang, text) of a batch, bucket and language."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            for (bucket, lang), own in pdf.groupby(["bucket", "lang"], sort=True):
                data, sizes = _joined(list(own["text"]))
                yield pd.DataFrame({"bucket": np.int32([bucket]), "lang": [lang], "ids": [list(own["doc_id"])], "sizes": [sizes], "packed": [squeeze.compress(data.tobytes())]})

    rows = docs.select(_spread(buckets), "doc_id", "lang", "text")
    return rows.mapInPandas(pack, f"bucket int, lang string, ids array<{dict(docs.dtypes)['doc_id']}>, sizes array<long>, packed binary")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket")


def _spread(buckets: int) -> Column:
    """The bucket of a row; rows without an id are spread by their text and the part of the table they are read in."""
    loose = F.pmod(F.xxhash64("text", F.spark_partition_id()), F.lit(buckets)).cast("int")
    return F.when(F.col("doc_id").isNull(), loose).otherwise(_bucket(buckets)).alias("bucket")


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)


def count(dealt: DataFrame, trusted: DataFrame) -> DataFrame:
    """lang, code, c: the counts of the longest n-grams of the dealt texts whose id is in trusted (bucket, doc_id)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, good = [], set(right["doc_id"])
        for lang, ids, sizes, packed in zip(left["lang"], left["ids"], left["sizes"], left["packed"], strict=True):
            own = np.array([i in good for i in ids], bool)
            if own.any():
                sizes = np.asarray(sizes)
                data = _unpacked(packed)[np.repeat(own, sizes + ORDER - 1)]
                grams = _Grams(data, sizes[own])
                out.append(pd.DataFrame({"lang": lang, "code": grams.codes(), "c": grams.counts}))
        none = pd.DataFrame({"lang": pd.Series(dtype=object), "code": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64")})
        return pd.concat(out).groupby(["lang", "code"], as_index=False)["c"].sum() if out else none

    found = dealt.groupBy("bucket").cogroup(trusted.groupBy("bucket")).applyInPandas(run, "lang string, code long, c long")
    return found.groupBy("lang", "code").agg(F.sum("c").alias("c"))


def count_read(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The same counts of docs (doc_id, lang, text), by tasks that read them; for few trusted ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def given() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "c": np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)})
            held.clear()

        for pdf in batches:
            for lang, own in pdf.groupby("lang"):
                for i in range(0, len(own), 512):
                    grams = _Grams(*_joined(list(own["text"].iloc[i : i + 512])))
                    held.setdefault(lang, []).append((grams.codes(), grams.counts))
                    size += len(grams.distinct)
                    if size > MOST_HELD:
                        yield from given()
                        size = 0
        yield from given()

    mine = docs.join(F.broadcast(trusted), "doc_id", "left_semi").select("lang", "text")
    return mine.mapInPandas(run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))


def weights(top: DataFrame) -> DataFrame:
    """lang, key, value: weights of n-grams and contexts of all orders, from the counts of the longest n-grams."""
    counts = durable(top.withColumn("k", F.lit(ORDER)))
    below = counts
    for k in range(ORDER - 1, 0, -1):  # the number of different bytes before an n-gram
        below = below.groupBy("lang", F.col("code").bitwiseAND((1 << 8 * k) - 1).alias("code")).agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.lit(k))
        counts = counts.unionByName(below)
    counts = durable(counts)
    of = [F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]
    ratio = lambda i: F.coalesce(F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.0))
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))
    cut = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * F.col("y") * ratio(i))).alias(f"d{i}") for i in range(1, 4)]
    discounts = durable(counts.groupBy("lang", "k").agg(*of).withColumn("y", y).select("lang", "k", *cut))
    few = F.broadcast(discounts) if discounts.count() <= ORDER * FEW_LANGUAGES else discounts
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    context = F.shiftright("code", 8)
    rows = counts.join(few, ["lang", "k"]).select("lang", "k", "code", context.alias("h"), "c", d.alias("d"))
    held = rows.groupBy("lang", "k", "h").agg(F.sum("c").alias("all"), F.sum("d").alias("cut"))
    level = F.col("k").cast("long") * _ORDER
    seen = rows.join(held.select("lang", "k", "h", "all"), ["lang", "k", "h"]).select("lang", (level + F.col("code")).alias("key"), ((F.col("c") - F.col("d")) / F.col("all")).alias("value"))
    passed = held.select("lang", (level + _CONTEXT + F.col("h")).alias("key"), (F.col("cut") / F.col("all")).alias("value"))
    return seen.unionByName(passed)


def keys(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of the n-grams that end the given ones and of their contexts, from the shortest."""
    return [(k * _ORDER + (codes & ((1 << 8 * k) - 1)), k * _ORDER + _CONTEXT + ((codes & ((1 << 8 * k) - 1)) >> 8)) for k in range(1, ORDER + 1)]


def log_probabilities(codes: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of the last byte of each n-gram after the others; ``key`` is sorted and has at least the known keys among theirs."""

    def look(wanted: np.ndarray, without: float) -> np.ndarray:
        if not len(key):
            return np.full(len(wanted), without)
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.where(key[at] == wanted, value[at], without)

    p = np.full(len(codes), 1.0 / SYMBOLS)
    for gram, context in keys(codes):
        p = look(gram, 0.0) + look(context, 1.0) * p
    return np.log(p)


def perplexities(dealt: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity of dealt texts; both uses of them share one exchange."""
    kind = dict(dealt.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    dealt = dealt.repartition("bucket")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, str], np.ndarray] = {}  # distinct n-grams of the partition's buckets
        for pdf in batches:
            for bucket, lang, sizes, packed in zip(pdf["bucket"], pdf["lang"], pdf["sizes"], pdf["packed"], strict=True):
                codes = _Grams(_unpacked(packed), np.asarray(sizes)).codes()
                held[bucket, lang] = np.union1d(held[bucket, lang], codes) if (bucket, lang) in held else codes
        for (bucket, lang), codes in held.items():
            yield pd.DataFrame({"bucket": np.int32(bucket), "lang": lang, "key": np.unique(np.concatenate([x for pair in keys(codes) for x in pair]))})

    # A bucket lies in one partition, so each of its keys is asked for once.
    asked = dealt.mapInPandas(ask, "bucket int, lang string, key long")
    told = asked.join(model, ["lang", "key"])

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"doc_id": pd.Series(dtype=object), "lang": pd.Series(dtype=object), "n_bytes": pd.Series(dtype="int64"), "perplexity": pd.Series(dtype="float64")})]
        known = {lang: own.sort_values("key") for lang, own in right.groupby("lang")}
        for lang, ids, sizes, packed in zip(left["lang"], left["ids"], left["sizes"], left["packed"], strict=True):
            grams, table = _Grams(_unpacked(packed), np.asarray(sizes)), known.get(lang)
            key, value = (table["key"].to_numpy(), table["value"].to_numpy()) if table is not None else (np.zeros(0, np.int64), np.zeros(0))
            total = grams.sums(log_probabilities(grams.codes(), key, value))
            out.append(pd.DataFrame({"doc_id": pd.Series(list(ids), dtype=object), "lang": lang, "n_bytes": grams.sizes - 1, "perplexity": np.exp(-total / grams.sizes)}))
        return pd.concat(out[1:] or out)

    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(answer, f"doc_id {kind}, lang string, n_bytes long, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, trusted, n_bytes, perplexity, threshold, kept; ``trusted`` holds the ids (doc_id) of trusted texts."""
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    buckets = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    good = trusted.select("doc_id").where("doc_id is not null").distinct()
    good = durable(good.withColumn("seen", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) > 0))
    seen = good.where("seen").select("doc_id")
    dealt = _deal(rows, buckets)
    counts = count_read(rows, seen) if seen.count() <= MOST_BROADCAST else count(dealt, seen.select(_bucket(buckets), "doc_id"))
    model = durable(weights(counts))
    scored = durable(perplexities(dealt, model).join(good, "doc_id", "left").withColumn("trusted", F.col("seen").isNotNull()))
    at = lambda which: F.percentile_approx(F.when(which, F.col("perplexity")), F.lit(quantile), F.lit(10_000))
    limit = durable(scored.groupBy("lang").agg(F.coalesce(at(~F.col("seen")), at(F.col("trusted")), at(F.lit(True))).alias("threshold")))
    out = scored.join(F.broadcast(limit) if limit.count() <= FEW_LANGUAGES else limit, "lang")
    name = F.when(F.col("lang") == "", F.lit(None)).otherwise(F.substring("lang", 2, 1_000_000))
    return out.select("doc_id", name.alias("lang"), "trusted", "n_bytes", "perplexity", "threshold", (F.col("perplexity") <= F.col("threshold")).alias("kept"))
