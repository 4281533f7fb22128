"""Evaluation of scores as binary classifiers.

Inputs are long tables: a label (0 or 1), a score, and the columns of ``by`` that name a group (a method, a data set).
Every metric starts from one aggregation to distinct scores or to threshold bins, so rows are shuffled once and
already reduced; running totals are two-level, within score buckets and over them, and no group is sorted in one task.
A null score counts as 0 (``missing="zero"``) or its row is left out (``missing="drop"``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def present(df: DataFrame, missing: str = "zero", score: str = "score") -> DataFrame:
    """The rows to evaluate under a policy for missing scores."""
    known = F.when(~F.isnan(score), F.col(score))
    if missing == "zero":
        return df.withColumn(score, F.coalesce(known, F.lit(0.0)))
    if missing == "drop":
        return df.where(known.isNotNull())
    raise ValueError(f"unknown policy {missing!r}")


def by_score(df: DataFrame, by: list[str]) -> DataFrame:
    """by, score, pos, neg, then pos_above and neg_above: how many rows have a greater score."""
    counts = df.groupBy(*by, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    bucket = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(F.col("score") * BUCKETS)))
    counts = counts.withColumn("bucket", bucket)
    totals = counts.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    over = Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "bucket", F.coalesce(F.sum("bp").over(over), F.lit(0)).alias("bp"), F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("bn"))
    inner = Window.partitionBy(*by, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    joined = counts.join(totals, [*by, "bucket"])
    above = lambda c, b: (F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(b)).alias(f"{c}_above")
    return joined.select(*by, "score", "pos", "neg", above("pos", "bp"), above("neg", "bn"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    whole = 2 * tp + fp + fn
    return F.when(whole > 0, 2.0 * tp / whole).otherwise(0.0)


def at_grid(df: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """by, k, threshold (k / steps), tp, fp, fn, tn for k from 0 to ``steps``; a row is positive if score >= threshold."""
    k = F.floor(F.col("score") * steps)
    k = k + F.when((k + 1) / float(steps) <= F.col("score"), 1).when(k / float(steps) > F.col("score"), -1).otherwise(0)
    bins = df.groupBy(*by, F.least(F.lit(steps), F.greatest(F.lit(-1), k)).alias("k")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    grid = bins.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))))
    over = Window.partitionBy(*by).orderBy(F.desc("k"))
    rows = grid.join(bins, [*by, "k"], "left").withColumns({"tp": F.sum(F.coalesce("pos", F.lit(0))).over(over), "fp": F.sum(F.coalesce("neg", F.lit(0))).over(over)})
    return rows.select(*by, "k", (F.col("k") / float(steps)).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn"))


def best_on_grid(df: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, tp, fp, fn, tn, f1: the smallest threshold of the grid with the largest F1; 0.5 if every F1 is 0."""
    rows = at_grid(df, by).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    order = F.struct("f1", F.when(F.col("f1") > 0, -F.col("k")).otherwise(-F.abs(F.col("k") - 50)))
    best = rows.groupBy(*by).agg(F.max_by(F.struct("threshold", "tp", "fp", "fn", "tn", "f1"), order).alias("b"))
    return best.select(*by, "b.*")


def best_on_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, f1 over the distinct scores as thresholds; the smallest of equals."""
    rows = by_score(df, by)
    totals = df.groupBy(*by).agg(F.sum("label").alias("p"))
    rows = rows.join(totals, by).withColumn("tp", F.col("pos_above") + F.col("pos")).withColumn("fp", F.col("neg_above") + F.col("neg"))
    rows = rows.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp")))
    return rows.groupBy(*by).agg(F.max_by(F.struct("score", "f1"), F.struct("f1", -F.col("score"))).alias("b")).select(*by, F.col("b.score").alias("threshold"), "b.f1")


def roc_auc(df: DataFrame, by: list[str]) -> DataFrame:
    """by, auc; equal scores count half; null if a group has one class only."""
    rows = by_score(df, by)
    area = F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0))
    return rows.groupBy(*by).agg(F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def roc_points(df: DataFrame, by: list[str]) -> DataFrame:
    """by, score, fpr, tpr at each distinct score as threshold; groups with one class or one score are left out."""
    totals = df.groupBy(*by).agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = by_score(df, by).join(totals.where("p > 0 and n > 0 and lo < hi"), by)
    return rows.select(*by, "score", ((F.col("neg_above") + F.col("neg")) / F.col("n")).alias("fpr"), ((F.col("pos_above") + F.col("pos")) / F.col("p")).alias("tpr"))


def evaluate(df: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, accuracy, precision, recall, f1, roc_auc, n at each group's own best threshold of the grid."""
    best, auc = best_on_grid(df, by), roc_auc(df, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = best.select(*by, "threshold", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), "f1", (tp + fp + fn + tn).alias("n"))
    return out.join(auc.withColumnRenamed("auc", "roc_auc"), by)


def unpivot(df: DataFrame, ids: list[str], methods: list[str]) -> DataFrame:
    """ids, method, score: one row for each of the methods that the table has a column of."""
    return df.unpivot(ids, [m for m in methods if m in df.columns], "method", "score")


def decided(df: DataFrame, thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``correct``: whether score >= threshold says the label; ``thresholds`` is a row a group, so it is small."""
    joined = df.join(thresholds.select(*by, "threshold"), by)
    return joined.withColumn("correct", ((F.col("score") >= F.col("threshold")).cast("int") == F.col("label")).cast("int"))


def complementarity(correct: DataFrame, ids: list[str]) -> DataFrame:
    """method1 < method2 with m1_only, m2_only, both, neither, over rows (ids, method, correct)."""
    a, b = correct.select(*ids, F.col("method").alias("method1"), F.col("correct").alias("c1")), correct.select(*ids, F.col("method").alias("method2"), F.col("correct").alias("c2"))
    count = lambda c: F.sum(c.cast("long"))
    x, y = F.col("c1") == 1, F.col("c2") == 1
    return a.join(b, ids).where("method1 < method2").groupBy("method1", "method2").agg(count(x & ~y).alias("m1_only"), count(~x & y).alias("m2_only"), count(x & y).alias("both"), count(~x & ~y).alias("neither"))


def oracle_ensemble(correct: DataFrame, ids: list[str]) -> DataFrame:
    """accuracy of an ensemble that is right where any method is."""
    return correct.groupBy(*ids).agg(F.max("correct").alias("any")).agg(F.avg("any").alias("accuracy"), F.count(F.lit(1)).alias("n"))


LENGTH_BINS = [(0, 40), (40, 60), (60, 80), (80, 100), (100, 150), (150, 200)]


def length_bin(words: Column) -> Column:
    """Right-closed bins of a word count; null outside."""
    return reduce(lambda c, b: c.when((words > b[0]) & (words <= b[1]), f"({b[0]}, {b[1]}]"), LENGTH_BINS, F.when(F.lit(False), None))


def domain_transfer(df: DataFrame, domain: str, by: list[str]) -> DataFrame:
    """by, train, test, threshold, f1_transfer, f1_optimal, gap: each domain's best threshold applied to every domain.

    All thresholds of the grid are counted once for each domain; thresholds then only look up their counts.
    """
    grid = at_grid(df, [*by, domain]).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    best = best_on_grid(df, [*by, domain])
    train = best.select(*by, F.col(domain).alias("train"), "threshold")
    test = best.select(*by, F.col(domain).alias("test"), F.col("f1").alias("f1_optimal"))
    looked = grid.select(*by, F.col(domain).alias("test"), "threshold", F.col("f1").alias("f1_transfer"))
    out = train.join(looked, [*by, "threshold"]).join(test, [*by, "test"])
    return out.select(*by, "train", "test", "threshold", "f1_transfer", "f1_optimal", (F.col("f1_optimal") - F.col("f1_transfer")).alias("gap"))


def confusion_from_rates(precision: Column, recall: Column, positives: Column, total: Column) -> list[Column]:
    """tp, fp, fn, tn from rates, rounded half to even."""
    tp = F.bround(recall * positives).cast("long")
    fp = F.coalesce(F.bround(F.try_divide(tp.cast("double"), precision)).cast("long") - tp, F.lit(0))
    return [tp.alias("tp"), fp.alias("fp"), (positives - tp).alias("fn"), (total - positives - fp).alias("tn")]


def best_variant(results: DataFrame, group: str, variant: str, value: str) -> DataFrame:
    """For each group the row of the variant with the largest value; the first by name of equals."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), variant))
    return results.withColumn("_nth", rank).where("_nth = 1").drop("_nth")


def min_rank(results: DataFrame, group: str, value: str) -> DataFrame:
    """Rank within the group by falling value; equals share the smallest rank."""
    return results.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc(value))))


def verdict(delta: Column) -> Column:
    return F.when(delta >= 0.03, "Strong").when(delta >= 0, "Comparable").when(delta >= -0.05, "Slight gap").otherwise("Underperforms")


def blend(structure: Column, meaning: Column, alpha: Column) -> Column:
    """alpha * structure + (1 - alpha) * meaning, the latter clipped to [0, 1]."""
    return alpha * structure + (1 - alpha) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), meaning))


def append_unseen(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old, key, "left_anti"))


def only_first_by(correct: DataFrame, ids: list[str], stratum: str) -> DataFrame:
    """method1, method2, stratum, n: where rows lie that the first method has right and the second has wrong."""
    a = correct.where("correct = 1").select(*ids, stratum, F.col("method").alias("method1"))
    b = correct.where("correct = 0").select(*ids, F.col("method").alias("method2"))
    return a.join(b, ids).groupBy("method1", "method2", stratum).agg(F.count(F.lit(1)).alias("n"))


def override(rows: DataFrame, other: DataFrame, method: str, ids: list[str]) -> DataFrame:
    """Rows (ids, method, score, ...) in which one method's scores come from another table (ids, score), and only where it has them."""
    own = rows.where(F.col("method") == method).drop("score").join(other.select(*ids, "score"), ids).select(*rows.columns)
    return rows.where(F.col("method") != method).unionByName(own)


def first_seen(df: DataFrame, key: list[str], place: str) -> DataFrame:
    """Of rows that share a key, the one that comes first by ``place``."""
    columns = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.col(place)).alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in columns])
