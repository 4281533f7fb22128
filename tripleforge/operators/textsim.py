"""Text-overlap baselines: ROUGE with and without stems, BLEU, longest common subsequence, sequence ratio.

N-gram measures are aggregations of counts by (pair, n-gram): both texts are exploded once, counted in one pass and
summed by pair.  What needs an alignment of two sequences is an Arrow function on the two texts of a row.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.stemming import stem

#: Words of more characters than this are stemmed.
UNSTEMMED = 3


def tokens(text: Column, stemmed: bool = False) -> Column:
    """Lower-cased runs of a-z and 0-9; null gives null."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return stems(found) if stemmed else found


def stems(words: Column) -> Column:
    """An array of words with those of more than ``UNSTEMMED`` characters stemmed; each worker remembers the stems of the words it met.

    A batch's lists stay in Arrow, and only its distinct words become Python's, so a worker holds no object a token.
    """

    def run(lists: pa.Array) -> pa.Array:
        found = lists.flatten().dictionary_encode()
        made = pa.array([None if w is None else stem(w) if len(w) > UNSTEMMED else w for w in found.dictionary.to_pylist()], pa.string())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, made.take(found.indices), mask=lists.is_null())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(words)


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of words in order, joined by spaces."""

    def made(w: Column) -> Column:
        gram = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]) if n > 1 else F.get(w, i)
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), gram)).otherwise(F.array().cast("array<string>"))

    return once(words, made)


def counts(pairs: DataFrame, n: int, reference: str = "reference", candidate: str = "candidate", stemmed: bool = False) -> DataFrame:
    """pair_id, r, c: how often each n-gram stands in the pair's reference and candidate."""
    side = lambda text, k: pairs.select("pair_id", tokens(F.col(text), stemmed).alias("w")).select("pair_id", F.explode(ngrams(F.col("w"), n)).alias("g"), F.lit(k).alias("k"))
    rows = side(reference, 0).unionByName(side(candidate, 1))
    return rows.groupBy("pair_id", "g").agg(F.sum(1 - F.col("k")).alias("r"), F.sum("k").alias("c"))


def rouge_n(pairs: DataFrame, n: int, stemmed: bool = False) -> DataFrame:
    """pair_id, p, r, f: overlap of n-gram multisets; 0 without any, as for a null or empty text.  Pairs are told apart by pair_id."""
    s = counts(pairs, n, stemmed=stemmed).groupBy("pair_id").agg(F.sum(F.least("r", "c")).alias("both"), F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    s = pairs.select("pair_id").join(s, "pair_id", "left").na.fill(0, ["both", "nr", "nc"])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    s = s.select("pair_id", share("both", "nc").alias("p"), share("both", "nr").alias("r"))
    return s.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def spaced(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


#: Pairs whose n-grams are counted together.
ROWS = 256


def _numbered(*lists: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """For each array of lists of words: the words as numbers, and where each list begins and ends; and the distinct words.  A null list has no words."""
    flat = [x.flatten() for x in lists]
    held = pa.concat_arrays(flat).dictionary_encode()
    numbers = held.indices.to_numpy().astype(np.int64)
    ends = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy())]).astype(np.int64) for x in lists]
    return np.split(numbers, np.cumsum([len(x) for x in flat])[:-1]), ends, held.dictionary


def _clipped(reference: pa.Array, candidate: pa.Array, most: int) -> np.ndarray:
    """A row a pair: the numbers of words of both sides, and for each n to ``most`` how many n-grams they share."""
    sides, ends, words = _numbered(reference, candidate)
    rows, width = len(reference), max(1, len(words))
    size = [np.diff(e) for e in ends]
    row = [np.repeat(np.arange(rows), n) for n in size]
    left = [np.repeat(e[1:], n) - np.arange(len(x)) for e, n, x in zip(ends, size, sides, strict=True)]  # words from here to the list's end
    grams, out = sides, [*size]
    for n in range(1, most + 1):
        if n > 1:
            longer = [np.concatenate([g[: len(g) - 1] * width + x[n - 1 :], np.zeros(1, np.int64)])[: max(0, len(x) - n + 1)] for g, x in zip(grams, sides, strict=True)]
            told = np.unique(np.concatenate(longer), return_inverse=True)[1]
            grams = np.split(told, [len(longer[0])])
        here = [own[: len(g)][rest[: len(g)] >= n] * (len(sides[0]) + len(sides[1]) + 1) + g[rest[: len(g)] >= n] for own, rest, g in zip(row, left, grams, strict=True)]
        (one, a), (two, b) = (np.unique(x, return_counts=True) for x in here)
        _, i, j = np.intersect1d(one, two, assume_unique=True, return_indices=True)
        shared = np.zeros(rows, np.int64)
        np.add.at(shared, one[i] // (len(sides[0]) + len(sides[1]) + 1), np.minimum(a[i], b[j]))
        out.append(shared)
    return np.stack(out, axis=1)


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """pair_id, bleu: clipped n-gram precisions to ``most``, 0.1 in place of no match, brevity penalty; 0 for an empty side or no common word.

    Words lie between white space.  A row is a pair: the n-grams are numbered and counted where both texts lie, so none is shuffled.
    """

    def run(reference: pa.Array, candidate: pa.Array) -> pa.Array:
        found = [_clipped(reference.slice(at, ROWS), candidate.slice(at, ROWS), most) for at in range(0, len(reference), ROWS)]
        table = np.concatenate(found) if found else np.zeros((0, most + 2), np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * (most + 2)), pa.array(table.ravel()))

    run.__annotations__ = {"reference": pa.Array, "candidate": pa.Array, "return": pa.Array}
    counted = F.arrow_udf(run, "array<bigint>")(spaced(F.col("reference")), spaced(F.col("candidate")))
    out = pairs.select("pair_id", counted.alias("c")).select("pair_id", *[F.get("c", F.lit(i)).alias(x) for i, x in enumerate(["lr", "lc", *(f"m{n}" for n in range(1, most + 1))])])
    logs = F.lit(0.0)
    for n in range(1, most + 1):
        logs = logs + F.log(F.when(F.col(f"m{n}") > 0, F.col(f"m{n}")).otherwise(0.1) / F.greatest(F.lit(1), F.col("lc") - n + 1)) / most
    brevity = F.when(F.col("lc") > F.col("lr"), 0.0).otherwise(1 - F.col("lr") / F.col("lc"))
    return out.select("pair_id", F.when(F.col("m1") > 0, F.exp(logs + brevity)).otherwise(0.0).alias("bleu"))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two lists of numbers, a row of the table at a time."""
    if not len(x) or not len(y):
        return 0
    row = np.zeros(len(y) + 1, np.int32)
    for w in x:
        step = np.concatenate(([0], row[:-1] + (y == w)))
        row = np.maximum.accumulate(np.maximum(row, step))
    return int(row[-1])


def _pairwise(measure):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([measure(a, b) for a, b in zip(x, y, strict=True)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def rouge_l(reference: Column, candidate: Column, stemmed: bool = False) -> Column:
    """F of the longest common subsequence of two texts' tokens; 0 for a null or empty text."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a))
        for at in range(0, len(a), ROWS):  # words stay in Arrow and become numbers; only a few rows' distinct ones become Python's
            (x, y), (i, j), words = _numbered(a.slice(at, ROWS), b.slice(at, ROWS))
            if stemmed:
                made = pa.array([w if w is None or len(w) <= UNSTEMMED else stem(w) for w in words.to_pylist()], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64)
                x, y = made[x], made[y]
            for k in range(len(i) - 1):
                one, two = x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]
                if n := _common(one, two):
                    out[at + k] = 2 * n / (len(one) + len(two))
        return pa.array(out)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(tokens(reference), tokens(candidate))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two short texts, as the standard library computes it."""
    return _pairwise(lambda x, y: difflib.SequenceMatcher(None, x or "", y or "").ratio())(a, b)
