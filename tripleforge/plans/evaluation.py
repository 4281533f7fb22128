"""Queries of the evaluation operators.  Labels are document quality; scores are fixed functions of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from .registry import query, read

METHODS = ["hash_score", "length_score", "mixed_score"]


def scored(spark, sf_dir):
    """pair_id, stratum, dataset, words, label and three score columns."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")  # noqa: E741
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("pair_id"), F.col("lang").alias("stratum"), F.col("source").alias("dataset"), F.size(F.split(F.trim("text"), r"[ \n]+")).alias("words"), F.col("quality").alias("label"),
        (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("hash_score"), (F.least(F.col("n_chars"), F.lit(6000)) / 6000.0).alias("length_score"),
        ((F.col("quality") * 35 + F.pmod(F.col("doc_id") * 53, F.lit(66))) / 100.0).alias("mixed_score"),
    )


def long(spark, sf_dir):
    s = scored(spark, sf_dir)
    return m.present(m.unpivot(s, ["pair_id", "stratum", "dataset", "words", "label"], METHODS))


S = """
with s as (
  select doc_id as pair_id, lang as stratum, source as dataset, quality as label, len(regexp_split_to_array(trim(text), '[ \\n]+')) as words,
    ((doc_id * 37) % 101) / 100.0::double as hash_score, least(n_chars, 6000) / 6000.0::double as length_score, (quality * 35 + (doc_id * 53) % 66) / 100.0::double as mixed_score
  from documents join labels using (doc_id)),
long as (
  select pair_id, stratum, dataset, words, label, 'hash_score' as method, hash_score as score from s
  union all select pair_id, stratum, dataset, words, label, 'length_score', length_score from s
  union all select pair_id, stratum, dataset, words, label, 'mixed_score', mixed_score from s)
"""


def grid(by):
    """SQL: counts at each of the thresholds 0.00 to 1.00, then the best, for the groups of ``by``."""
    return f"""
, t as (select range as k, range / 100.0::double as threshold from range(101)),
swept as (
  select {by}, k, threshold, sum((score >= threshold and label = 1)::int) as tp, sum((score >= threshold and label = 0)::int) as fp,
    sum((score < threshold and label = 1)::int) as fn, sum((score < threshold and label = 0)::int) as tn
  from long, t group by {by}, k, threshold),
f as (select *, case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end::double as f1 from swept),
best as (select * from f qualify row_number() over (partition by {by} order by f1 desc, case when f1 > 0 then k else abs(k - 50) end) = 1)
"""


def auc(by):
    return f"""
, ranked as (select {by}, label, rank() over (partition by {by} order by score) + (count(*) over (partition by {by}, score) - 1) / 2.0 as r from long),
auc as (
  select {by}, case when count(*) filter (label = 1) > 0 and count(*) filter (label = 0) > 0 then
    (sum(r) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0) / (count(*) filter (label = 1) * count(*) filter (label = 0)) end as auc
  from ranked group by {by})
"""


@query("threshold_sweep_grid", S + grid("method") + "select method, threshold, tp, fp, fn, tn, round(f1, 6) as f1 from best")
def threshold_sweep_grid(spark, sf_dir):
    return m.best_on_grid(long(spark, sf_dir), ["method"]).withColumn("f1", F.round("f1", 6))


@query("threshold_curve", S + grid("method") + "select method, threshold, tp, fp, round(f1, 6) as f1 from f")
def threshold_curve(spark, sf_dir):
    rows = m.at_grid(long(spark, sf_dir), ["method"])
    return rows.select("method", "threshold", "tp", "fp", F.round(m.f1(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))


@query(
    "threshold_sweep_unique",
    S
    + """
, c as (
  select a.method, a.score as threshold, sum((b.score >= a.score and b.label = 1)::int) as tp, sum((b.score >= a.score and b.label = 0)::int) as fp, sum(b.label) as p
  from (select distinct method, score from long) a join long b on a.method = b.method group by a.method, a.score)
select method, threshold, round(2.0 * tp / (tp + fp + p), 6) as f1 from c qualify row_number() over (partition by method order by 2.0 * tp / (tp + fp + p) desc, threshold) = 1
""",
)
def threshold_sweep_unique(spark, sf_dir):
    return m.best_on_scores(long(spark, sf_dir), ["method"]).withColumn("f1", F.round("f1", 6))


@query("roc_auc_ties", S + auc("dataset, method") + "select dataset, method, round(auc, 6) as auc from auc")
def roc_auc_ties(spark, sf_dir):
    return m.roc_auc(long(spark, sf_dir), ["dataset", "method"]).withColumn("auc", F.round("auc", 6))


@query(
    "roc_points",
    S
    + """
select a.method, a.score, round(sum((b.score >= a.score and b.label = 0)::int) / sum(1 - b.label), 6) as fpr, round(sum((b.score >= a.score and b.label = 1)::int) / sum(b.label), 6) as tpr
from (select distinct method, score from long where method <> 'length_score') a join long b on a.method = b.method group by a.method, a.score
""",
)
def roc_points(spark, sf_dir):
    rows = long(spark, sf_dir).where("method <> 'length_score'")
    return m.roc_points(rows, ["method"]).select("method", "score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def rates(q):
    return f"""
select {q}, threshold, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision,
  round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(f1, 6) as f1, round(auc, 6) as roc_auc, (tp + fp + fn + tn)::bigint as n
from best join auc using ({q})
"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")})


@query("evaluate_methods", S + grid("method") + auc("method") + rates("method"))
def evaluate_methods(spark, sf_dir):
    return rounded(m.evaluate(long(spark, sf_dir), ["method"]))


@query("stratified_metrics", S + grid("stratum, method") + auc("stratum, method") + rates("stratum, method"))
def stratified_metrics(spark, sf_dir):
    return rounded(m.evaluate(long(spark, sf_dir), ["stratum", "method"]))


BINS = "case when words > 0 and words <= 40 then '(0, 40]' when words <= 60 and words > 40 then '(40, 60]' when words <= 80 and words > 60 then '(60, 80]' when words <= 100 and words > 80 then '(80, 100]' when words <= 150 and words > 100 then '(100, 150]' when words <= 200 and words > 150 then '(150, 200]' end"
DECIDED = ", d as (select l.*, ((score >= threshold)::int = label)::int as correct, (score >= threshold)::int as said from long l join (select method, threshold from best) using (method))"


@query(
    "length_bin_metrics",
    S + grid("method") + DECIDED
    + f"""
select method, {BINS} as length_bin, round(avg(words), 6) as avg_length, count(*) as n, round(avg(correct), 6) as accuracy,
  round(case when sum(label) + sum(said) > 0 then 2.0 * sum(label * said) / (sum(label) + sum(said)) else 0 end, 6) as f1
from d where {BINS} is not null group by 1, 2
""",
)
def length_bin_metrics(spark, sf_dir):
    rows = long(spark, sf_dir)
    rows = m.decided(rows, m.best_on_grid(rows, ["method"]), ["method"]).withColumn("length_bin", m.length_bin(F.col("words"))).where("length_bin is not null")
    said = (F.col("score") >= F.col("threshold")).cast("int")
    tp, p, s = F.sum(F.col("label") * said), F.sum("label"), F.sum(said)
    return rows.groupBy("method", "length_bin").agg(F.round(F.avg("words"), 6).alias("avg_length"), F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("accuracy"), F.round(m.f1(tp, s - tp, p - tp), 6).alias("f1"))


def correct(spark, sf_dir):
    rows = long(spark, sf_dir)
    return m.decided(rows, m.best_on_grid(rows, ["method"]), ["method"]).select("pair_id", "method", "correct")


@query(
    "complementarity",
    S + grid("method") + DECIDED
    + """
select a.method as method1, b.method as method2, sum((a.correct = 1 and b.correct = 0)::int) as m1_only, sum((a.correct = 0 and b.correct = 1)::int) as m2_only,
  sum((a.correct = 1 and b.correct = 1)::int) as both, sum((a.correct = 0 and b.correct = 0)::int) as neither
from d a join d b on a.pair_id = b.pair_id and a.method < b.method group by 1, 2
""",
)
def complementarity(spark, sf_dir):
    return m.complementarity(correct(spark, sf_dir), ["pair_id"])


@query("oracle_ensemble", S + grid("method") + DECIDED + "select round(avg(x), 6) as accuracy, count(*) as n from (select pair_id, max(correct) as x from d group by pair_id)")
def oracle_ensemble(spark, sf_dir):
    return m.oracle_ensemble(correct(spark, sf_dir), ["pair_id"]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "domain_transfer",
    S + grid("method, dataset")
    + """
select a.method, a.dataset as train, b.dataset as test, a.threshold, round(c.f1, 6) as f1_transfer, round(b.f1, 6) as f1_optimal, round(b.f1 - c.f1, 6) as gap
from best a join best b on a.method = b.method join f c on c.method = a.method and c.dataset = b.dataset and c.k = a.k
""",
)
def domain_transfer(spark, sf_dir):
    return m.domain_transfer(long(spark, sf_dir), "dataset", ["method"]).withColumns({c: F.round(c, 6) for c in ("f1_transfer", "f1_optimal", "gap")})


ALPHAS = S + """
, a as (select range / 10.0::double as alpha from range(11)),
b as (select dataset, label, alpha, alpha * hash_score + (1 - alpha) * mixed_score as score from s, a),
ranked as (select dataset, alpha, label, rank() over (partition by dataset, alpha order by score) + (count(*) over (partition by dataset, alpha, score) - 1) / 2.0 as r from b),
auc as (select dataset, alpha, case when sum(label) > 0 and sum(1 - label) > 0 then (sum(r) filter (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)) end as auc from ranked group by 1, 2)
"""


def blended(spark, sf_dir):
    s = scored(spark, sf_dir)
    a = F.explode(F.array(*[F.lit(k / 10.0) for k in range(11)]))
    return s.withColumn("alpha", a).withColumn("score", m.blend(F.col("hash_score"), F.col("mixed_score"), F.col("alpha")))


@query("alpha_blend_sweep", ALPHAS + "select dataset, alpha, round(auc, 6) as auc from auc")
def alpha_blend_sweep(spark, sf_dir):
    return m.roc_auc(blended(spark, sf_dir), ["dataset", "alpha"]).withColumn("auc", F.round("auc", 6))


@query("alpha_matrix", ALPHAS + "select dataset, " + ", ".join(f"round(max(auc) filter (alpha = {k}/10.0::double), 6) as alpha_{k}" for k in range(11)) + " from auc group by dataset")
def alpha_matrix(spark, sf_dir):
    rows = m.roc_auc(blended(spark, sf_dir), ["dataset", "alpha"]).withColumn("name", F.concat(F.lit("alpha_"), F.round(F.col("alpha") * 10).cast("int")))
    return rows.groupBy("dataset").pivot("name", [f"alpha_{k}" for k in range(11)]).agg(F.round(F.first("auc"), 6))


PER = S + grid("dataset, method")


def per_dataset(spark, sf_dir):
    return m.best_on_grid(long(spark, sf_dir), ["dataset", "method"])


@query("best_variant_per_dataset", PER + "select dataset, method, round(f1, 6) as f1 from best qualify row_number() over (partition by dataset order by round(f1, 6) desc, method) = 1")
def best_variant_per_dataset(spark, sf_dir):
    rows = per_dataset(spark, sf_dir).select("dataset", "method", F.round("f1", 6).alias("f1"))
    return m.best_variant(rows, "dataset", "method", "f1")


@query("min_rank", PER + "select dataset, method, round(f1, 6) as f1, rank() over (partition by dataset order by round(f1, 6) desc) as rank from best")
def min_rank(spark, sf_dir):
    rows = per_dataset(spark, sf_dir).select("dataset", "method", F.round("f1", 6).alias("f1"))
    return m.min_rank(rows, "dataset", "f1")


@query(
    "verdict",
    PER
    + """
, w as (select dataset, round(max(f1) filter (method = 'mixed_score'), 6) as own, round(max(f1) filter (method <> 'mixed_score'), 6) as other from best group by dataset)
select dataset, own, other, case when own - other >= 0.03::double then 'Strong' when own - other >= 0 then 'Comparable' when own - other >= -0.05::double then 'Slight gap' else 'Underperforms' end as verdict from w
""",
)
def verdict(spark, sf_dir):
    own = F.col("method") == "mixed_score"
    rows = per_dataset(spark, sf_dir).groupBy("dataset").agg(F.round(F.max(F.when(own, F.col("f1"))), 6).alias("own"), F.round(F.max(F.when(~own, F.col("f1"))), 6).alias("other"))
    return rows.withColumn("verdict", m.verdict(F.col("own") - F.col("other")))


@query(
    "confusion_from_rates",
    PER
    + """
, r as (select dataset, method, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r, tp + fn as np, tp + fp + fn + tn as n from best),
c as (select *, round_even(r * np, 0)::bigint as tp from r), c2 as (select *, case when p > 0 then round_even(tp / p, 0)::bigint - tp else 0 end as fp from c)
select dataset, method, tp, fp, np - tp as fn, n - np - fp as tn from c2
""",
)
def confusion_from_rates(spark, sf_dir):
    rows = m.evaluate(long(spark, sf_dir), ["dataset", "method"])
    positives = long(spark, sf_dir).groupBy("dataset", "method").agg(F.sum("label").alias("np"))
    cells = m.confusion_from_rates(F.col("precision"), F.col("recall"), F.col("np"), F.col("n"))
    return rows.join(positives, ["dataset", "method"]).select("dataset", "method", *cells)


@query("append_unseen", "select doc_id, quality as value, 'old' as origin from labels union all select doc_id, null, 'new' from documents where doc_id not in (select doc_id from labels)")
def append_unseen(spark, sf_dir):
    old = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"), F.lit("old").alias("origin"))
    new = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("value"), F.lit("new").alias("origin"))
    return m.append_unseen(old, new, ["doc_id"])


@query("dataset_summary", PER + auc("dataset, method") + """
select dataset, max(tp + fp + fn + tn)::bigint as n, round(max(f1) filter (method = 'hash_score'), 6) as f1_hash_score, round(max(f1) filter (method = 'mixed_score'), 6) as f1_mixed_score,
  round(max(auc) filter (method = 'hash_score'), 6) as auc_hash_score, round(max(auc) filter (method = 'mixed_score'), 6) as auc_mixed_score
from best join auc using (dataset, method) group by dataset""")  # fmt: skip
def dataset_summary(spark, sf_dir):
    rows = m.evaluate(long(spark, sf_dir), ["dataset", "method"])
    of = lambda c, k: F.round(F.max(F.when(F.col("method") == k, F.col(c))), 6)
    keep = ["hash_score", "mixed_score"]
    return rows.groupBy("dataset").agg(F.max("n").alias("n"), *[of("f1", k).alias(f"f1_{k}") for k in keep], *[of("roc_auc", k).alias(f"auc_{k}") for k in keep])
