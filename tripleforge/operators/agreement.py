"""Aligned precision and recall of triples, and agreement of three annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column, none: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(none))


def aligned_prf(gold: DataFrame, said: DataFrame) -> DataFrame:
    """row_id, tp, fp, fn, p, r, f1 over distinct keys (row_id, key); without any said p is 1, without any gold r is 1."""
    rows = gold.select("row_id", "key", F.lit(1).alias("g"), F.lit(0).alias("s")).unionByName(said.select("row_id", "key", F.lit(0).alias("g"), F.lit(1).alias("s")))
    keys = rows.groupBy("row_id", "key").agg(F.max("g").alias("g"), F.max("s").alias("s"))
    out = keys.groupBy("row_id").agg(F.sum(F.col("g") * F.col("s")).alias("tp"), F.sum((1 - F.col("g")) * F.col("s")).alias("fp"), F.sum(F.col("g") * (1 - F.col("s"))).alias("fn"))
    out = out.withColumns({"p": _share(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), "r": _share(F.col("tp"), F.col("tp") + F.col("fn"), 1.0)})
    return out.withColumn("f1", _share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"), 0.0))


def first_rows(gold: DataFrame, said: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Both tables (row_id, key) with the first ``most`` of the rows that both have, by id."""
    both = gold.select("row_id").distinct().join(said.select("row_id").distinct(), "row_id", "left_semi").orderBy("row_id").limit(most)
    chosen = F.broadcast(both)  # ``most`` ids
    return gold.join(chosen, "row_id", "left_semi"), said.join(chosen, "row_id", "left_semi")


def averages(rows: DataFrame, digits: int = 4) -> DataFrame:
    """Micro averages from summed counts; macro averages of the values as rounded, ties to even, in each row."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    p, r = _share(tp, tp + fp, 1.0), _share(tp, tp + fn, 1.0)
    mean = lambda c: F.avg(F.bround(c, digits)).alias(f"macro_{c}")
    return rows.agg(p.alias("micro_p"), r.alias("micro_r"), _share(2 * p * r, p + r, 0.0).alias("micro_f1"), mean("p"), mean("r"), mean("f1"), F.count(F.lit(1)).alias("n"))


def votes(marks: DataFrame, annotators: int = 3) -> DataFrame:
    """row_id, item, a1..an, votes: which annotators gave an item; marks are (row_id, item, annotator 1..n)."""
    given = [F.max((F.col("annotator") == k).cast("int")).alias(f"a{k}") for k in range(1, annotators + 1)]
    out = marks.groupBy("row_id", "item").agg(*given)
    return out.withColumn("votes", sum((F.col(f"a{k}") for k in range(2, annotators + 1)), F.col("a1")))


def fleiss(votes_: DataFrame, n: int = 3) -> DataFrame:
    """items, percent (unanimous), kappa over the two answers of n annotators."""
    v = F.col("votes").cast("double")
    agree = (v * (v - 1) + (n - v) * (n - v - 1)) / (n * (n - 1))
    yes = F.avg(v / n)
    chance = yes * yes + (1 - yes) * (1 - yes)
    kappa = F.try_divide(F.avg(agree) - chance, 1 - chance)
    return votes_.agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("votes").isin(0, n).cast("int")).alias("percent"), kappa.alias("kappa"))


def pairwise(votes_: DataFrame, annotators: int = 3) -> DataFrame:
    """pair, f1, jaccard of annotators over items pooled without their row; 1 if both gave none."""
    pooled = votes_.groupBy("item").agg(*[F.max(f"a{k}").alias(f"a{k}") for k in range(1, annotators + 1)])
    couples = [(i, j) for i in range(1, annotators + 1) for j in range(i + 1, annotators + 1)]
    rows = F.array(*[F.struct(F.lit(f"{i}-{j}").alias("pair"), F.col(f"a{i}").alias("x"), F.col(f"a{j}").alias("y")) for i, j in couples])
    s = pooled.select(F.explode(rows).alias("c")).select("c.*").groupBy("pair").agg(F.sum(F.col("x") * F.col("y")).alias("both"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    b, x, y = F.col("both"), F.col("nx"), F.col("ny")
    return s.select("pair", _share(2 * b, x + y, 1.0).alias("f1"), _share(b, x + y - b, 1.0).alias("jaccard"))
