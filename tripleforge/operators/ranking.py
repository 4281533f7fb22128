"""Rank agreement, group statistics and summaries of scores.

Groups of ranked candidates hold one row a level, so pairs are made inside a group of a few rows only.  Everything else
is one aggregation with map-side partial sums, or a rank that is computed from counts of distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions


def rank_agreement(df: DataFrame, group: list[str], level: str = "level", score: str = "score") -> DataFrame:
    """group, tau (Kendall's tau-b) and rho (Spearman's) of score against level; null where either is constant."""
    a = df.select(*group, F.col(level).alias("l1"), F.col(score).alias("s1"))
    b = df.select(*group, F.col(level).alias("l2"), F.col(score).alias("s2"))
    sign = lambda x: F.signum(x.cast("double"))
    pairs = a.join(b, group).where("l1 > l2")  # levels are distinct in a group
    tau = pairs.groupBy(*group).agg(F.sum(sign(F.col("s1") - F.col("s2"))).alias("c"), F.count(F.lit(1)).alias("n0"), F.sum((F.col("s1") == F.col("s2")).cast("int")).alias("ties"))
    tau = tau.select(*group, F.try_divide(F.col("c"), F.sqrt(F.col("n0") * (F.col("n0") - F.col("ties")))).alias("tau"))
    by = lambda c: Window.partitionBy(*group).orderBy(c)
    mean_rank = lambda c: F.rank().over(by(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, c)) - 1) / 2.0
    ranks = df.select(*group, mean_rank(level).alias("rl"), mean_rank(score).alias("rs"))
    n, x, y = F.count(F.lit(1)), F.sum("rl"), F.sum("rs")
    top = n * F.sum(F.col("rl") * F.col("rs")) - x * y
    rho = ranks.groupBy(*group).agg(F.try_divide(top, F.sqrt((n * F.sum(F.col("rl") ** 2) - x * x) * (n * F.sum(F.col("rs") ** 2) - y * y))).alias("rho"))
    return tau.join(rho, group, "full_outer")


def levels_wide(df: DataFrame, group: list[str], levels: list[int], level: str = "level", score: str = "score") -> DataFrame:
    """One column a level: l<level>."""
    return df.groupBy(*group).agg(*[F.max(F.when(F.col(level) == k, F.col(score))).alias(f"l{k}") for k in levels])


def boundary_accuracy(wide: DataFrame, levels: list[int]) -> DataFrame:
    """boundary, accuracy, correct, total: strictly higher score at the higher of two adjacent levels; incomplete groups are left out."""
    rows = [F.struct(F.lit(f"L{hi}>L{lo}").alias("boundary"), F.col(f"l{hi}").alias("hi"), F.col(f"l{lo}").alias("lo")) for hi, lo in zip(levels, levels[1:], strict=False)]
    pairs = wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*").where("hi is not null and lo is not null")
    right = (F.col("hi") > F.col("lo")).cast("long")
    return pairs.groupBy("boundary").agg(F.avg(right).alias("accuracy"), F.sum(right).alias("correct"), F.count(F.lit(1)).alias("total"))


def inversion_rate(wide: DataFrame, levels: list[int]) -> DataFrame:
    """boundary, rate: share of all groups whose higher level scores no higher; incomplete groups count as not inverted."""
    rows = [F.struct(F.lit(f"L{hi}>L{lo}").alias("boundary"), F.coalesce(F.col(f"l{hi}") <= F.col(f"l{lo}"), F.lit(False)).alias("bad")) for hi, lo in zip(levels, levels[1:], strict=False)]
    return wide.select(F.explode(F.array(*rows)).alias("p")).groupBy("p.boundary").agg(F.avg(F.col("p.bad").cast("int")).alias("rate"))


def perfect(wide: DataFrame, levels: list[int]) -> Column:
    """Whether all levels are there and strictly ordered; ties are not perfect."""
    ok = F.lit(True)
    for hi, lo in zip(levels, levels[1:], strict=False):
        ok = ok & (F.col(f"l{hi}") > F.col(f"l{lo}"))
    return F.coalesce(ok, F.lit(False))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


#: Parts that the distinct values of a group are ranked in.
PARTS = 256


def below(distinct: DataFrame, by: list[str], value: str) -> DataFrame:
    """``distinct`` (by, value, n) with ``below``: how many rows of the group have a smaller value; null values are below all.

    The values of a group are cut at approximate quantiles of theirs into parts, which are counted and ranked apart, so no
    task orders a group, however its values are spread.
    """
    key = F.struct(*by) if by else F.lit(0)
    rows = distinct.withColumn("_key", key)
    cuts = rows.groupBy("_key").agg(F.percentile_approx(F.col(value).cast("double"), [i / PARTS for i in range(1, PARTS)], F.lit(4 * PARTS)).alias("_cuts"))
    part = F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col(value))))
    rows = rows.join(cuts, "_key").withColumn("_part", part).drop("_cuts")
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("_key", "_part").agg(F.sum("n").alias("_n")).select("_key", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("_key", "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(counts, ["_key", "_part"]).withColumn("below", F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_key", "_part", "_before")


def percentiles(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """by, name: the percentile of a group's values that aren't null, linear between neighbours; groups without any are left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = below(counts, by, "_v")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    met = ranked.join(totals, by) if by else ranked.crossJoin(totals)  # one row
    at = F.lit(share) * (F.col("_all") - 1)
    holds = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("_v")))
    out = met.groupBy(*by).agg(holds(F.floor(at)).alias("_low"), holds(F.ceil(at)).alias("_high"), F.max(at - F.floor(at)).alias("_rest"))
    return out.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_rest")).alias(name))


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, median, std, min, max, near_one, high, rmse_vs_one; null values are left out, a group of nulls has null statistics."""
    v = F.col(value)
    share = lambda t: F.avg((v >= t).cast("int"))
    out = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        share(0.99).alias("near_one"), share(0.8).alias("high"), F.sqrt(F.avg((1 - v) * (1 - v))).alias("rmse_vs_one"),
    )
    median = percentiles(df, by, value, 0.5, "median")
    out = out.join(median, by, "left") if by else out.crossJoin(median)  # one row
    return out.select(*by, "n", "mean", "median", "std", "min", "max", "near_one", "high", "rmse_vs_one")


def anova(df: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """by, f, df1, df2 of a one-way analysis of variance over the levels."""
    per = df.groupBy(*by, level).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("_within"))
    n, k = F.sum("_n"), F.count(F.lit(1))
    grand = F.sum(F.col("_n") * F.col("_mean")) / n
    between = F.sum(F.col("_n") * F.col("_mean") * F.col("_mean")) - n * grand * grand
    out = per.groupBy(*by).agg(between.alias("_b"), F.sum("_within").alias("_w"), (k - 1).alias("df1"), (n - k).alias("df2"))
    return out.select(*by, F.try_divide(F.col("_b") / F.col("df1"), F.col("_w") / F.col("df2")).alias("f"), "df1", "df2")


def adjacent_tests(df: DataFrame, by: list[str], level: str, value: str) -> DataFrame:
    """by, hi, lo, t (Welch), df, d (Cohen, signed, ddof 1) for each level and the one below it."""
    s = df.groupBy(*by, level).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    a = s.select(*by, F.col(level).alias("hi"), *[F.col(c).alias(f"{c}1") for c in ("n", "mean", "var")])
    b = s.select(*by, F.col(level).alias("lo"), (F.col(level) + 1).alias("hi"), *[F.col(c).alias(f"{c}2") for c in ("n", "mean", "var")])
    u, v = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    t = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(u + v))
    free = F.try_divide((u + v) ** 2, u * u / (F.col("n1") - 1) + v * v / (F.col("n2") - 1))
    d = F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt((F.col("var1") + F.col("var2")) / 2))
    return a.join(b, [*by, "hi"]).select(*by, "hi", "lo", t.alias("t"), free.alias("df"), d.alias("d"))


def with_p(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """``df`` with ``p``, from the columns that the distribution ``kind`` (f, t or normal) takes.  For small results."""
    tail = {"f": distributions.f_tail, "t": distributions.t_two_sided, "normal": distributions.normal_two_sided}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            yield pd.Series([None if any(pd.isna(x) for x in row) else tail(*row) for row in pdf.itertuples(index=False)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn("p", F.pandas_udf(run, "double")(F.struct(*[F.col(c).cast("double") for c in columns])))


def metric_matrix(df: DataFrame, row: str, column: str, columns: list[str], metrics: list[str], digits: int = 4, empty: str = "N/A") -> DataFrame:
    """row and a column <column>_<metric> for each: means as texts of so many digits, ``empty`` where there is none."""
    mean = lambda c, m: F.avg(F.when(F.col(column) == c, F.col(m)))
    cell = lambda x: F.coalesce(F.regexp_replace(F.format_number(x, digits), ",", ""), F.lit(empty))
    return df.groupBy(row).agg(*[cell(mean(c, m)).alias(f"{c}_{m}") for c in columns for m in metrics])


def wide_statistics(df: DataFrame, by: list[str], levels: list[int], group: list[str], level: str = "level", score: str = "score") -> DataFrame:
    """One row for each of ``by`` (one column at least): n, mean, std, min and max of each level, F over the levels, and t, df, d and the inversion rate of each two neighbouring ones.

    Scores that are missing or no numbers are left out.  ``group`` tells the candidates' questions apart.
    """
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    stats = ("n", "mean", "std", "min", "max")
    wide = describe(rows, [*by, level], score).groupBy(*by).agg(*[F.max(F.when(F.col(level) == k, F.col(s))).alias(f"{s}_l{k}") for k in levels for s in stats])
    tests = adjacent_tests(rows, by, level, score)
    tests = tests.groupBy(*by).agg(*[F.max(F.when(F.col("hi") == k, F.col(s))).alias(f"{s}_l{k}_l{k - 1}") for k in levels[:-1] for s in ("t", "df", "d")])
    inverted = [F.avg(F.coalesce(F.col(f"l{hi}") <= F.col(f"l{lo}"), F.lit(False)).cast("int")).alias(f"inversions_l{hi}_l{lo}") for hi, lo in zip(levels, levels[1:], strict=False)]
    rates = levels_wide(rows, [*by, *group], levels, level, score).groupBy(*by).agg(*inverted)
    return wide.join(anova(rows, by, level, score), by, "left").join(tests, by, "left").join(rates, by, "left")


def statistics_text(row: dict) -> str:
    """A summary of one row of ``wide_statistics``, a line a level and a line a pair of levels."""
    shown = lambda x: "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    levels = sorted({int(c.rsplit("_l", 1)[1]) for c in row if c.startswith("mean_l")}, reverse=True)
    lines = [f"level {k}: n {shown(row[f'n_l{k}'])}, mean {shown(row[f'mean_l{k}'])}, std {shown(row[f'std_l{k}'])}, from {shown(row[f'min_l{k}'])} to {shown(row[f'max_l{k}'])}" for k in levels]
    lines.append(f"F {shown(row['f'])} ({shown(row['df1'])}, {shown(row['df2'])})")
    for hi, lo in zip(levels, levels[1:], strict=False):
        lines.append(f"level {hi} to {lo}: t {shown(row[f't_l{hi}_l{lo}'])}, d {shown(row[f'd_l{hi}_l{lo}'])}, inverted {shown(row[f'inversions_l{hi}_l{lo}'])}")
    return "\n".join(lines)


def harmonic(a: Column, b: Column) -> Column:
    """Harmonic mean of two scores, null counting as 0; 0 if they don't add up to more."""
    a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def win_rates(df: DataFrame, keys: list[str], model: str, value: str) -> DataFrame:
    """model1 < model2, wins, losses, ties, n over rows that share the keys; a key has one row a model."""
    a = df.select(*keys, F.col(model).alias("model1"), F.col(value).alias("v1"))
    b = df.select(*keys, F.col(model).alias("model2"), F.col(value).alias("v2"))
    share = lambda c: F.avg(c.cast("int"))
    v1, v2 = F.col("v1"), F.col("v2")
    return a.join(b, keys).where("model1 < model2").groupBy("model1", "model2").agg(share(v1 > v2).alias("wins"), share(v1 < v2).alias("losses"), share(v1 == v2).alias("ties"), F.count(F.lit(1)).alias("n"))


def _mean_ranks(df: DataFrame, by: list[str], value: str, counts: list[Column]) -> DataFrame:
    """by, value, the counts, and the mean rank of the value's rows: from distinct values, so a group isn't sorted by row."""
    distinct = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *counts)
    return below(distinct, by, value).withColumn("rank", F.col("below") + (F.col("n") + 1) / 2.0).drop("below")


def mann_whitney(df: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """by, u, z, n1, n2, tied, spread: U of the rows that ``first`` marks against the others, its normal approximation with ties, and whether there are any.

    Null values count as rows of the lowest rank, equal ones of each other; give rows that have a value.
    """
    r = _mean_ranks(df, by, value, [F.sum(first.cast("int")).alias("k")])
    n1, n, ties = F.sum("k"), F.sum("n"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n"))
    out = r.groupBy(*by).agg((F.sum(F.col("k") * F.col("rank")) - n1 * (n1 + 1) / 2.0).alias("u"), n1.alias("n1"), (n - n1).alias("n2"), ties.alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    spread = F.sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - F.col("ties") / ((n1 + n2) * (n1 + n2 - 1))))
    return out.select(*by, "u", F.try_divide(F.col("u") - n1 * n2 / 2.0, spread).alias("z"), "n1", "n2", (F.col("ties") > 0).alias("tied"), spread.alias("spread"))


def wilcoxon(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """by, w, z, n, tied, zeros: signed-rank statistic min(W+, W-) over differences that aren't zero, whether there are ties, and the zeros left out.

    Null differences are left out; a group of zeros alone gives no row.
    """
    d = F.col(difference)
    zeros = df.where(d == 0).groupBy(*by).agg(F.count(F.lit(1)).alias("zeros"))
    rows = df.where(d != 0).select(*by, F.abs(d).alias("size"), (d > 0).cast("int").alias("up"))
    r = _mean_ranks(rows, by, "size", [F.sum("up").alias("k")])
    up, down = F.sum(F.col("k") * F.col("rank")), F.sum((F.col("n") - F.col("k")) * F.col("rank"))
    out = r.groupBy(*by).agg(F.least(up, down).alias("w"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    out = out.select(*by, "w", F.try_divide(F.col("w") - n * (n + 1) / 4.0, spread).alias("z"), "n", (F.col("ties") > 0).alias("tied"))
    met = out.join(zeros, by, "left") if by else out.crossJoin(zeros)  # without groups both are one row
    return met.withColumn("zeros", F.coalesce("zeros", F.lit(0)))


#: Signed ranks of up to so many differences, and rank sums whose smaller sample has up to so many rows, have exact p.
EXACT_SIGNED, EXACT_SAMPLE = 50, 8
#: Exact rank sums are counted up to this U; beyond, the normal approximation differs by less than rounding shows.
MOST_U = 1 << 20
LEAST_ROWS = 5


def _p(df: DataFrame, columns: list[str], tail: Callable) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            yield pd.Series([tail(*row) for row in pdf.itertuples(index=False)], dtype="float64")

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn("p", F.pandas_udf(run, "double")(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])))


def wilcoxon_p(stats: DataFrame) -> DataFrame:
    """``wilcoxon``'s rows with p and stars: exact for up to ``EXACT_SIGNED`` differences without ties and zeros, else by the normal approximation.

    Groups of fewer than ``LEAST_ROWS`` rows, zeros included, are left out.
    """

    def tail(w, z, n, tied, zeros) -> float:
        if n <= EXACT_SIGNED and not tied and not zeros:
            return distributions.wilcoxon_exact(w, int(n))
        return distributions.normal_two_sided(z) if z == z else float("nan")

    rows = stats.where(F.col("n") + F.col("zeros") >= LEAST_ROWS)
    return starred(_p(rows, ["w", "z", "n", "tied", "zeros"], tail))


def mann_whitney_p(stats: DataFrame) -> DataFrame:
    """``mann_whitney``'s rows with p and stars: exact if the smaller sample has up to ``EXACT_SAMPLE`` rows and there are no ties, else by the normal
    approximation, half a step nearer the middle.  Groups of which a sample has fewer than ``LEAST_ROWS`` rows are left out.
    """

    def tail(u, spread, n1, n2, tied) -> float:
        if min(n1, n2) <= EXACT_SAMPLE and not tied and n1 * n2 <= MOST_U:
            return distributions.mann_whitney_exact(u, int(n1), int(n2))
        far = abs(u - n1 * n2 / 2) - 0.5
        return min(1.0, distributions.normal_two_sided(max(far, 0.0) / spread)) if spread > 0 else 1.0

    rows = stats.where((F.col("n1") >= LEAST_ROWS) & (F.col("n2") >= LEAST_ROWS))
    return starred(_p(rows, ["u", "spread", "n1", "n2", "tied"], tail))


def starred(df: DataFrame) -> DataFrame:
    """With ``stars``: *** below 0.001, ** below 0.01, * below 0.05, else ns; empty without a p."""
    p = F.col("p")
    return df.withColumn("stars", F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns"))


def percentile_filter(df: DataFrame, by: list[str], columns: list[str], share: float = 0.05) -> DataFrame:
    """``df`` with low_<column> for each column and ``passes``: below the group's percentile (linear), and above all of them."""
    clean = df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)) for c in columns})
    out = clean
    for c in columns:
        cut = percentiles(clean, by, c, share, f"_cut_{c}")
        out = out.join(cut, by) if by else out.crossJoin(cut)  # one row
    out = out.withColumns({f"low_{c}": F.col(c) < F.col(f"_cut_{c}") for c in columns})
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~F.col(f"low_{c}")
    return out.withColumn("passes", ok).drop(*[f"_cut_{c}" for c in columns])


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 20) -> DataFrame:
    """by, bin (from 0), n: equal bins over each group's own range; the largest value is in the last bin."""
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.floor(F.try_divide((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    return df.join(ends, by).groupBy(*by, F.least(F.lit(bins - 1), F.coalesce(at, F.lit(0))).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def flag_best(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with ``best``: ``*`` on a group's largest value."""
    return df.withColumn("best", F.when(F.col(value) == F.max(value).over(Window.partitionBy(group)), "*").otherwise(""))
