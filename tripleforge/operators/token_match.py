"""Token-level best-match scores of pairs of texts: precision over the candidate's tokens, recall over the reference's.

A token encoder is a plug-in: a function from a list of texts to the tokens of each and a matrix with a row a token, so
that the vectors may depend on the text around them.  Matching is greedy and goes in blocks of both texts, of which only
the best cosine of each token is held.  What leaves a pair is one row a distinct token and side, so weights by document
frequency are joined to tokens, not to texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import durable

TokenEncoder = Callable[[Sequence[str]], list[tuple[list[str], np.ndarray]]]
#: Tokens of each text that are compared at a time.
BLOCK = 512
#: Tokens whose weights are broadcast.
FEW_TOKENS = 200_000


def letter_tokens(texts: Sequence[str]) -> list[tuple[list[str], np.ndarray]]:
    """Lower-cased runs of a-z and 0-9, each as its counts of the letters a to z, which SQL can state as well; for checks."""
    out = []
    for text in texts:
        words = re.findall("[a-z0-9]+", text.lower())
        out.append((words, np.array([[w.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for w in words], float).reshape(-1, 26)))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1.0)


def best_cosines(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """For each row of either matrix the largest cosine with a row of the other, to ten digits; never more than block x block at once.  A zero row has cosine 0."""
    a, b = _unit(a), _unit(b)
    one, two = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            near = np.round(a[i : i + block] @ b[j : j + block].T, 10)
            one[i : i + block] = np.maximum(one[i : i + block], near.max(axis=1))
            two[j : j + block] = np.maximum(two[j : j + block], near.max(axis=0))
    return one, two


def token_matches(pairs: DataFrame, encode: TokenEncoder, most_chars: int | None = None) -> DataFrame:
    """pair_id, side (r: reference, c: candidate), token, n, best: how often a token stands there, and the sum of its best cosines.

    Pairs of which a text is null or has no token give no rows.  ``most_chars`` cuts both texts, as some harnesses do; by
    default whole texts are matched.
    """
    kind = dict(pairs.dtypes)["pair_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, one, two in zip(pdf["pair_id"], pdf["reference"], pdf["candidate"], strict=True):
                if one is None or two is None:
                    continue
                (x, a), (y, b) = encode([one[:most_chars], two[:most_chars]])
                if not len(x) or not len(y):
                    continue
                for side, tokens, best in zip("rc", (x, y), best_cosines(a, b), strict=True):
                    own = pd.DataFrame({"token": tokens, "best": best}).groupby("token", sort=False)["best"].agg(["size", "sum"])
                    yield pd.DataFrame({"pair_id": [name] * len(own), "side": side, "token": own.index, "n": own["size"].to_numpy(np.int64), "best": own["sum"].to_numpy()})

    return pairs.select("pair_id", "reference", "candidate").mapInPandas(run, f"pair_id {kind}, side string, token string, n long, best double")


def token_scores(pairs: DataFrame, encode: TokenEncoder = letter_tokens, weighted: bool = False, most_chars: int | None = None) -> DataFrame:
    """pair_id, p, r, f of pairs (pair_id, reference, candidate), pair_id telling them apart; 0 for a pair without tokens on both sides.

    ``weighted``: a token counts by log((N + 1) / (its references + 1)), N being the pairs with tokens; a side all of
    whose tokens weigh nothing scores 0.
    """
    rows = token_matches(pairs, encode, most_chars)
    if weighted:
        rows = durable(rows)
        n = rows.where("side = 'r'").select("pair_id").distinct().count()
        held = rows.where("side = 'r'").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        held = durable(held.select("token", F.log((n + 1) / (F.col("df") + 1)).alias("weight")))
        held = F.broadcast(held) if held.count() <= FEW_TOKENS else held
        rows = rows.join(held, "token", "left").withColumn("weight", F.coalesce("weight", F.log(F.lit(n + 1.0))))
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    mean = lambda side: F.coalesce(F.try_divide(F.sum(F.when(F.col("side") == side, F.col("weight") * F.col("best"))), F.sum(F.when(F.col("side") == side, F.col("weight") * F.col("n")))), F.lit(0.0))
    scores = rows.groupBy("pair_id").agg(mean("c").alias("p"), mean("r").alias("r"))
    out = pairs.select("pair_id").join(scores, "pair_id", "left").na.fill(0.0, ["p", "r"])
    return out.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
