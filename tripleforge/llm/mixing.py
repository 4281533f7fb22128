"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r, the expected number of its copies.  Of all rates that give each source its target number
of words, the ones nearest to 1 in relative entropy (measured over words) are exponential tilts r = exp(lambda[source]).
The lambdas minimise the convex dual  sum_s size_s * exp(lambda_s) - lambda_s * target_s,  found by Newton's method whose
gradient and Hessian are aggregated over the cluster.  Rates are then rounded into whole copies: within a source, from
the longest documents to the shortest, each length takes the number of additional copies that keeps the running total
nearest to its target, and a hash of the id says which documents of that length get them.

A null text has no words; null is a source of its own and sorts last.  A source without words gets nothing.
Rows that repeat an id are separate rows.  An empty table gives an empty result.  Reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, durable, unused, with_facts

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3
NEWTON_STEPS = 40
TOLERANCE = 1e-10
#: Sources whose facts are broadcast; those of more are joined by shuffling.
MOST_BROADCAST = 100_000


def _source_key(source_col: str) -> Column:
    """The source as a non-null key: ``=`` and its name, or nothing."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mark: Column | None = None) -> DataFrame:
    """doc_id, k (the source's key), size, raw: ``mark``, a number that tells rows of one id apart."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        _source_key(source_col).alias("k"),
        (F.lit(0) if mark is None else mark).cast("long").alias("raw"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sizes: dict[str, int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> dict[str, float]:
    """Target words of each source, given its words; one entry a source, so this is small.

    Sources by code point, the null source last, take the weights in turn and share the sum of all words; what a source
    would have above ``most`` times its words is shared among the others by weight, until none is above.
    """
    order = sorted(sizes, key=lambda k: (k == "", k))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[k] for k in order if k in open_)
        share = {k: left * weight[k] / total for k in open_}
        above = [k for k in order if k in open_ and share[k] > most * sizes[k]]
        if not above:
            return out | share
        for k in above:
            out[k] = float(most * sizes[k])
            open_.discard(k)
        left = sum(sizes.values()) - math.fsum(out.values())
    return out


def balance(histogram: DataFrame, target: dict[str, float]) -> dict[str, float]:
    """Rates exp(lambda) of the sources whose target is above zero, by distributed Newton steps on the dual.

    ``histogram`` (k, size, n) is the sufficient statistic; each step sums the tilted words of each source over it.
    The gradient of a source is tilted words - target and its Hessian entry the tilted words.
    """
    spark = histogram.sparkSession
    tilt = {k: 0.0 for k, t in target.items() if t > 0}
    for _ in range(NEWTON_STEPS):
        if not tilt:
            return {}
        at = spark.createDataFrame(list(tilt.items()), "k string, tilt double")
        mass = histogram.join(at, "k").groupBy("k").agg(F.sum(F.col("n") * F.col("size") * F.exp("tilt")).alias("mass")).collect()
        worst = 0.0
        for row in mass:
            worst = max(worst, abs(row.mass - target[row.k]) / target[row.k])
            tilt[row.k] += min(2.0, target[row.k] / row.mass - 1)
        if worst < TOLERANCE:
            break
    return {k: math.exp(v) for k, v in tilt.items()}


def _additional(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source's lengths: how many of the n documents of each length get a copy above the whole part of the rate."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    rate = float(pdf["rate"].iloc[0])
    base = math.floor(rate + 1e-9)
    part = max(0.0, rate - base)
    owed, extra = 0.0, np.zeros(len(pdf), np.int64)
    for i, (size, n) in enumerate(zip(pdf["size"].to_numpy(), pdf["n"].to_numpy(), strict=True)):
        if size > 0:
            owed += part * float(n) * float(size)
            extra[i] = min(n, max(0, round(owed / float(size)))) if base < MOST_COPIES else 0
            owed -= float(extra[i]) * float(size)
    return pdf[["k", "size", "n", "rate"]].assign(base=base, extra=extra)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mark: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate; with a ``mark``, also k and raw (the mark)."""
    spark = docs.sparkSession
    rows = durable(word_counts(docs, id_col, text_col, source_col, mark))
    histogram = durable(rows.groupBy("k", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r.k: int(r.words) for r in histogram.groupBy("k").agg(F.sum(F.col("n") * F.col("size")).alias("words")).collect()}
    target = targets(sizes)
    rate = balance(histogram, target)
    facts = spark.createDataFrame(
        [(k, sizes[k], target[k], rate.get(k, 0.0)) for k in sizes], "k string, source_size long, target double, rate double"
    )
    # A source's group is its distinct lengths, whatever the number of its documents.
    plan = histogram.join(facts.select("k", "rate"), "k").groupBy("k").applyInPandas(_additional, "k string, size long, n long, rate double, base long, extra long")
    planned = with_facts(rows, durable(plan), ["k", "size"], "n", rows.count())
    few = F.broadcast(facts) if len(sizes) <= MOST_BROADCAST else facts
    settled = (F.col("extra") == 0) | (F.col("extra") == F.col("n"))
    whole = planned.where(settled).withColumn("more", F.when(F.col("extra") > 0, 1).otherwise(0).cast("long"))
    # Documents of one source and length are dealt into sqrt(n) blocks; blocks get copies in order, and one block is cut.
    block = F.pmod(F.xxhash64("doc_id", "raw", F.lit("mix")), F.ceil(F.sqrt("n")))
    some = planned.where(~settled).withColumn("block", block).repartition("k", "size", "block")
    held = some.groupBy("k", "size", "block").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("k", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("k", "size", "block", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("k", "size", "block").orderBy(F.xxhash64("doc_id"), "doc_id", "raw"))
    cut = some.withColumn("nth", nth).join(held, ["k", "size", "block"])
    cut = cut.withColumn("more", (F.col("before") + F.col("nth") <= F.col("extra")).cast("long"))
    columns = ["doc_id", "k", "raw", "size", "base", "more"]
    both = whole.select(columns).unionByName(cut.select(columns))
    copies = (F.col("base") + F.col("more")).alias("copies")
    return both.join(few, "k").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies, "rate", *([] if mark is None else ["k", "raw"]))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it has copies, with all its columns.

    A row is known by its id, source and text.  Rows that are equal in all three, or have no id and are equal in the other
    two, share what the mix takes of them as evenly as whole copies allow.
    """
    name, key, same, copies, held, nth = unused(docs, "_mixed_id", "_mixed_k", "_mixed_raw", "_copies", "_held", "_nth")
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    plan = mix(docs, id_col, text_col, source_col, raw).groupBy(F.col("doc_id").alias(name), F.col("k").alias(key), F.col("raw").alias(same))
    plan = durable(plan.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(held)).where(F.col(copies) > 0))
    met = docs.join(plan, F.col(id_col).eqNullSafe(F.col(name)) & (_source_key(source_col) == F.col(key)) & (raw == F.col(same)))
    alone = met.where(F.col(held) == 1).withColumn(nth, F.lit(1))
    window = Window.partitionBy(name, key, same).orderBy(F.lit(1))
    equal = met.where(F.col(held) > 1).withColumn(nth, F.row_number().over(window))
    equal = equal.withColumn(copies, F.floor(F.col(copies) / F.col(held)) + (F.col(nth) <= F.col(copies) % F.col(held)).cast("long"))
    out = alone.unionByName(equal.where(F.col(copies) > 0))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(nth, copies, held, name, key, same)
