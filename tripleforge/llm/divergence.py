"""How far the sources of a language differ in their words, counted behind a sketch.

A first pass adds up a count-min sketch of document frequencies by (language, term).  Its cells count up to the least
frequency that matters and never too little, so a term with a cell below that cannot be kept.  A second pass counts
exactly, and only the terms that the sketch lets through are shuffled.  Pairs of sources are then joined by the terms that
both have; what one source has and the other hasn't is summed by (source, count), since all terms with one count have one
probability, and what neither has is one number.

Null texts, languages and sources count as empty strings.  Texts without terms make their group occur.  Rows are
documents, whatever their ids; repeated rows count as often as they stand there.  A language without a kept term gives
each pair the value 0.  A language with one source has no pairs.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, with_facts

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
#: Rows of the sketch; cells of a row: a power of two that grows with the text up to a bit each in ``MOST_CELLS``, the size of a broadcast.
DEPTH = 3
LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 27
#: Cells that are merged together.
PIECE = 1 << 16
#: Groups that are broadcast.
FEW_GROUPS = 100_000
#: Distinct terms that a task counts before it hands them on.
MOST_HELD = 400_000

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of what is beyond ASCII in a text in UTF-8; only A-Z are lower-cased."""
    return text.translate(_TERMS).split()


def cells(lang: str, found: list[bytes], width: int) -> np.ndarray:
    """The cells of terms in each row of the sketch, numbered through: DEPTH x terms."""
    salt = lang.encode("utf-8", "surrogatepass") + b"\0"
    h = np.fromiter((xxhash.xxh3_64_intdigest(salt + t) for t in found), np.uint64, len(found))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(row) * step) & np.uint64(width - 1)).astype(np.int64) + row * width for row in range(DEPTH)])


def sketch(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """One bit a cell: whether it counted up to ``least``.  docs: lang, source, text.

    Each task adds up its documents; pieces of all tasks are merged where their cells are dealt to, in batches, and come
    to the driver as bits.
    """
    least = min(least, 127)  # as far as a byte counts; the exact count decides

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}
        squeeze, size = zstandard.ZstdCompressor(level=1), 0

        def given() -> Iterator[pa.RecordBatch]:
            at, n = [], []
            for lang, own in held.items():
                at.append(cells(lang, list(own), width).ravel())
                n.append(np.tile(np.minimum(np.fromiter(own.values(), np.int64, len(own)), least), DEPTH))
            held.clear()
            if not at:
                return
            cell, place = np.unique(np.concatenate(at), return_inverse=True)
            total = np.minimum(np.bincount(place, np.concatenate(n)), least).astype(np.uint8)
            piece = cell // PIECE
            cut = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            packed = [squeeze.compress((cell[i:j] % PIECE).astype(np.uint16).tobytes() + total[i:j].tobytes()) for i, j in zip(cut, np.append(cut[1:], len(cell)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(piece[cut], pa.int32()), pa.array(packed, pa.binary())], ["piece", "packed"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(set(terms(text.as_py())))
                size += len(own)
                if size > MOST_HELD:
                    yield from given()
                    size = 0
        yield from given()

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for piece, packed in zip(pdf["piece"], pdf["packed"], strict=True):
                data = zstandard.ZstdDecompressor().decompress(packed)
                n = len(data) // 3
                own = total.setdefault(piece, np.zeros(PIECE, np.uint8))
                at = np.frombuffer(data, np.uint16, n)
                own[at] = np.minimum(own[at] + np.frombuffer(data, np.uint8, n, 2 * n), least)  # no more than twice ``least``, below 256
        for piece, own in total.items():
            yield pd.DataFrame({"piece": np.int32([piece]), "bits": [np.packbits(own >= least).tobytes()]})

    pieces = docs.select("lang", "text").mapInArrow(count, "piece int, packed binary")
    merged = pieces.repartition(max(1, DEPTH * width // PIECE // 16), "piece").mapInPandas(merge, "piece int, bits binary")
    out = np.zeros((DEPTH * width // PIECE, PIECE // 8), np.uint8)
    for r in merged.collect():  # DEPTH x MOST_CELLS bits at most
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def counted(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """lang, source, term, n, df: occurrences and documents of the terms that the sketch lets through."""
    told = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        size = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                if not n:
                    continue
                at = cells(lang, list(n), width)
                on = pa.array(((told.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))
                found = pa.array(n, pa.binary()).filter(on).cast(pa.string())
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(found), np.int8))) for x in (lang, source)]
                counts = [pa.array(np.fromiter(c, np.int64, len(n))).filter(on) for c in (n.values(), map(df.__getitem__, n))]
                yield pa.RecordBatch.from_arrays([*names, found, *counts], ["lang", "source", "term", "n", "df"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                own = terms(text.as_py())
                size -= len(n)
                n.update(own)
                df.update(set(own))
                size += len(n)
                if size > MOST_HELD:
                    yield from given()
                    size = 0
        yield from given()

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")
    # What tasks have counted is dealt by term, where the next two sums need no other exchange.
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 kept)), whatever the size of the numbers."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * big(n + 2), big(total + 2 * kept)) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each other source of the language is (``pair``), and what the source says oftener than its language (``term``)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    groups = durable(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("size")))
    n_groups, size = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    width = min(MOST_CELLS, max(LEAST_CELLS, 1 << int(size // 64).bit_length()))
    by_term = counted(rows, sketch(rows, width, least), width).groupBy("lang", "term")
    kept = by_term.agg(F.sum("df").alias("df"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("counts"))  # a row a source
    kept = durable(kept.where(F.col("df") >= least).select("lang", "term", "all", "counts"))
    own = kept.select("lang", "term", "all", F.explode("counts").alias("c")).select("lang", "c.source", "term", "c.n", "all")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"))
    lang = kept.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    none = lambda *c: [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in c]
    groups = groups.join(totals, ["lang", "source"], "left").join(lang, "lang", "left").select("lang", "source", *none("total", "has", "lang_total", "v"))
    # p0 is the probability of a term that a source doesn't have.
    groups = durable(groups.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))))
    few = F.broadcast if n_groups <= FEW_GROUPS else lambda df: df
    n_own = groups.agg(F.sum("has")).first()[0] or 0
    p = own.join(F.broadcast(groups), ["lang", "source"]) if n_groups <= FEW_GROUPS else with_facts(own, groups, ["lang", "source"], "has", n_own)
    p = p.select("lang", "source", "term", "p0", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("all"), F.col("lang_total"), F.col("v")).alias("q"))
    p = durable(p)

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = p.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Sums over the terms of one source, as if the other had none of them: all terms with one probability are one row.
    one = groups.select("lang", "source", "p0", "has", "v")
    two = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("has").alias("item_has"))
    counts = p.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = counts.join(few(two), "lang").where("source != item").groupBy("lang", "source", "item").agg(F.sum(_apart(F.col("p"), F.col("q0")) * F.col("times")).alias("value"))
    # Terms that both have, once for each two sources: what they give more than that.
    x, y = p.select("lang", "term", "source", "p", "p0"), p.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    gain = _apart(F.col("p"), F.col("q")) - _apart(F.col("p"), F.col("q0")) - _apart(F.col("p0"), F.col("q")) + _apart(F.col("p0"), F.col("q0"))
    both = x.join(y, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(gain).alias("value"))
    # Terms that neither has, with those that both or one has in their place, which ``gain`` and this correct.
    zeros = (F.col("v") - F.col("has") - F.col("item_has")) * _apart(F.col("p0"), F.col("q0"))
    rest = one.join(few(two), "lang").where("source != item").select("lang", "source", "item", F.when(F.col("v") > 0, zeros).otherwise(0).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = rest.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(best).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
