"""Queries of ranking and statistics, over the event stream as ranked candidates and as model scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as r
from .registry import query, read

LEVELS = [4, 3, 2, 1]


def quads(spark, sf_dir):
    """user_id, week, level 4..1, score: the first four events of a user and week."""
    e = read(spark, sf_dir, "events").withColumn("week", F.floor((F.dayofyear("ts") - 1) / 7).cast("int"))
    nth = F.row_number().over(Window.partitionBy("user_id", "week").orderBy("event_id"))
    return e.withColumn("nth", nth).where("nth <= 4").select("user_id", "week", (5 - F.col("nth")).alias("level"), F.col("value").alias("score"))


Q = """
with q as (
  select user_id, week, 5 - nth as level, value as score from (
    select *, floor((dayofyear(ts) - 1) / 7)::int as week, row_number() over (partition by user_id, floor((dayofyear(ts) - 1) / 7) order by event_id) as nth from events) where nth <= 4),
wide as (select user_id, week, max(score) filter (level = 4) as l4, max(score) filter (level = 3) as l3, max(score) filter (level = 2) as l2, max(score) filter (level = 1) as l1 from q group by 1, 2)
"""
GROUP = ["user_id", "week"]
TAU = """
select a.user_id, a.week, round(sum(sign(a.score - b.score)) / nullif(sqrt(count(*) * (count(*) - sum((a.score = b.score)::int))), 0), 6) as tau
from q a join q b on a.user_id = b.user_id and a.week = b.week and a.level > b.level group by 1, 2
"""


@query("kendall_tau_b", Q + TAU)
def kendall_tau_b(spark, sf_dir):
    return r.rank_agreement(quads(spark, sf_dir), GROUP).where("tau is not null").select(*GROUP, F.round("tau", 6).alias("tau"))


@query(
    "spearman_group",
    Q
    + """
, k as (select *, rank() over (partition by user_id, week order by level) as rl, rank() over (partition by user_id, week order by score) + (count(*) over (partition by user_id, week, score) - 1) / 2.0 as rs from q)
select user_id, week, round(corr(rl, rs), 6) + 0.0 as rho from k group by 1, 2 having count(*) > 1
""",
)
def spearman_group(spark, sf_dir):
    return r.rank_agreement(quads(spark, sf_dir), GROUP).where("rho is not null").select(*GROUP, F.round("rho", 6).alias("rho"))


@query("ranking_summary", Q + f", t as ({TAU}) select round(avg(tau), 6) as mean_tau, round(stddev_pop(tau), 6) as std_tau, count(tau) as n from t")
def ranking_summary(spark, sf_dir):
    return r.rank_agreement(quads(spark, sf_dir), GROUP).agg(F.round(F.avg("tau"), 6).alias("mean_tau"), F.round(F.stddev_pop("tau"), 6).alias("std_tau"), F.count("tau").alias("n"))


PAIRS = "(select 'L4>L3' as boundary, l4 as hi, l3 as lo from wide union all select 'L3>L2', l3, l2 from wide union all select 'L2>L1', l2, l1 from wide)"


@query("boundary_accuracy", Q + f"select boundary, round(avg((hi > lo)::int), 6) as accuracy, sum((hi > lo)::int) as correct, count(*) as total from {PAIRS} where hi is not null and lo is not null group by 1")
def boundary_accuracy(spark, sf_dir):
    return r.boundary_accuracy(r.levels_wide(quads(spark, sf_dir), GROUP, LEVELS), LEVELS).withColumn("accuracy", F.round("accuracy", 6))


@query("inversion_rate", Q + f"select boundary, round(avg(coalesce(hi <= lo, false)::int), 6) as rate from {PAIRS} group by 1")
def inversion_rate(spark, sf_dir):
    return r.inversion_rate(r.levels_wide(quads(spark, sf_dir), GROUP, LEVELS), LEVELS).withColumn("rate", F.round("rate", 6))


@query("perfect_rank", Q + "select round(100.0 * avg(coalesce(l4 > l3 and l3 > l2 and l2 > l1, false)::int), 6) as percent, count(*) as n from wide")
def perfect_rank(spark, sf_dir):
    wide = r.levels_wide(quads(spark, sf_dir), GROUP, LEVELS)
    return wide.agg(F.round(100 * F.avg(r.perfect(wide, LEVELS).cast("int")), 6).alias("percent"), F.count(F.lit(1)).alias("n"))


@query("level_stats", Q + "select level, count(score) as n, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, min(score) as min, max(score) as max from q group by 1")
def level_stats(spark, sf_dir):
    return r.describe(quads(spark, sf_dir), ["level"], "score").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    "anova_f",
    Q
    + """
, p as (select week, level, count(*) as n, avg(score) as m, var_pop(score) * count(*) as w from q group by 1, 2),
g as (select week, sum(n * m) / sum(n) as mm from p group by 1)
select week, round((sum(n * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 4) as f, count(*) - 1 as df1, (sum(n) - count(*))::bigint as df2 from p join g using (week) group by 1
""",
)
def anova_f(spark, sf_dir):
    return r.anova(quads(spark, sf_dir), ["week"], "level", "score").withColumn("f", F.round("f", 4))


TESTS = Q + """
, s as (select level, count(*) as n, avg(score) as m, var_samp(score) as v from q group by 1)
select a.level as hi, b.level as lo, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) as t,
  round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 4) as df, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) as d
from s a join s b on a.level = b.level + 1
"""


@query("welch_t_cohens_d", TESTS)
def welch_t_cohens_d(spark, sf_dir):
    out = r.adjacent_tests(quads(spark, sf_dir), [], "level", "score")
    return out.withColumns({"t": F.round("t", 6), "df": F.round("df", 4), "d": F.round("d", 6)})


def _simpson(density: str, to: str, n: int = 2000) -> str:
    """SQL of the integral from 0 to ``to`` of a density of u, by Simpson's rule over n steps."""
    weight = f"case when i in (0, {n}) then 1 when i % 2 = 1 then 4 else 2 end"
    return f"list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * ({density.replace('@', f'({to} * i / {n})')}))) * {to} / {3 * n}"


def _rounded(p: str) -> str:
    return f"round(greatest(0, least(1, {p})), 6) + 0.0"


T_TAIL = "1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * " + _simpson("power(1 + @ * @ / df, -(df + 1) / 2)", "abs(t)")
NORMAL_TAIL = "1 - 2 / sqrt(2 * pi()) * " + _simpson("exp(-@ * @ / 2)", "abs(z)")
#: With x = f u^2, whose density has no steep end at 0 for two or more degrees of freedom.
F_TAIL = "1 - 2 * exp(lgamma((df1 + df2) / 2) - lgamma(df1 / 2) - lgamma(df2 / 2)) * power(df1 * f / df2, df1 / 2) * " + _simpson("power(@, df1 - 1) * power(1 + df1 * f * @ * @ / df2, -(df1 + df2) / 2)", "1.0::double")
WEEKS = Q + """
, s as (select week, level, count(*) as n, avg(score) as m, var_samp(score) as v from q group by 1, 2),
x as (select a.week, a.level as hi, b.level as lo, (a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) as t,
  power(a.v / a.n + b.v / b.n, 2) / nullif(power(a.v / a.n, 2) / nullif(a.n - 1, 0) + power(b.v / b.n, 2) / nullif(b.n - 1, 0), 0) as df, (a.m - b.m) / nullif(sqrt((a.v + b.v) / 2), 0) as d
  from s a join s b on a.week = b.week and a.level = b.level + 1)
"""


@query("adjacent_tests_p", WEEKS + f"select week, hi, lo, round(t, 6) as t, round(df, 4) as df, round(d, 6) as d, case when t is not null and df is not null then {_rounded(T_TAIL)} end as p from x")
def adjacent_tests_p(spark, sf_dir):
    """Checked by integrating the density."""
    out = r.with_p(r.adjacent_tests(quads(spark, sf_dir), ["week"], "level", "score"), "t", ["t", "df"])
    return out.withColumns({"t": F.round("t", 6), "df": F.round("df", 4), "d": F.round("d", 6), "p": F.round("p", 6)})


@query(
    "anova_p",
    Q
    + f"""
, p as (select week, level, count(*) as n, avg(score) as m, var_pop(score) * count(*) as w from q group by 1, 2),
g as (select week, sum(n * m) / sum(n) as mm from p group by 1),
x as (select week, (sum(n * (m - mm) * (m - mm)) / nullif(count(*) - 1, 0)) / nullif(sum(w) / nullif(sum(n) - count(*), 0), 0) as f, (count(*) - 1)::double as df1, (sum(n) - count(*))::double as df2 from p join g using (week) group by 1)
select week, round(f, 4) as f, df1::bigint as df1, df2::bigint as df2, case when f is not null then {_rounded(F_TAIL)} end as p from x
""",
)
def anova_p(spark, sf_dir):
    """Checked by integrating the density."""
    out = r.with_p(r.anova(quads(spark, sf_dir), ["week"], "level", "score"), "f", ["f", "df1", "df2"])
    return out.withColumns({"f": F.round("f", 4), "p": F.round("p", 6)})


def answers(spark, sf_dir):
    """item, model, temperature, dataset, gold, context, cus."""
    e = read(spark, sf_dir, "events").select(
        (F.floor(F.col("event_id") / 12)).alias("item"), F.concat(F.lit("m"), F.col("event_id") % 4).alias("model"), (F.floor(F.col("event_id") / 4) % 3).alias("temperature"), F.col("event_type").alias("dataset"),
        (F.col("event_id") * 31 % 101 / 100.0).alias("gold"), (F.col("event_id") * 17 % 89 / 88.0).alias("context"),
    )
    return e.withColumn("cus", r.harmonic(F.col("gold"), F.col("context")))


A = """
with a as (
  select event_id // 12 as item, 'm' || (event_id % 4) as model, (event_id // 4) % 3 as temperature, event_type as dataset, event_id * 31 % 101 / 100.0::double as gold, event_id * 17 % 89 / 88.0::double as context from events),
c as (select *, case when gold + context > 0 then 2 * gold * context / (gold + context) else 0.0 end::double as cus from a)
"""


@query("cus_by_group", A + "select model, temperature, round(avg(gold), 6) as gold, round(avg(context), 6) as context, round(avg(cus), 6) as cus, count(*) as n from c group by grouping sets ((model), (temperature), (model, temperature))")
def cus_by_group(spark, sf_dir):
    """All three groupings in one pass."""
    rows = answers(spark, sf_dir).groupingSets([["model"], ["temperature"], ["model", "temperature"]], "model", "temperature")
    return rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("gold", "context", "cus")], F.count(F.lit(1)).alias("n"))


@query("cus_matrix", A + "select model, " + ", ".join(f"round(avg(cus) filter (temperature = {t}), 6) as t{t}" for t in range(3)) + " from c group by 1")
def cus_matrix(spark, sf_dir):
    rows = answers(spark, sf_dir).withColumn("t", F.concat(F.lit("t"), F.col("temperature")))
    return rows.groupBy("model").pivot("t", ["t0", "t1", "t2"]).agg(F.round(F.avg("cus"), 6))


@query("cus_leaderboard", A + "select *, case when cus = max(cus) over (partition by dataset) then '*' else '' end as best from (select dataset, model, round(avg(cus), 6) as cus from c group by 1, 2)")
def cus_leaderboard(spark, sf_dir):
    rows = answers(spark, sf_dir).groupBy("dataset", "model").agg(F.round(F.avg("cus"), 6).alias("cus"))
    return r.flag_best(rows, "dataset", "cus").orderBy("dataset", F.desc("cus"), "model")


@query(
    "summary_distribution",
    A
    + """
select model, count(cus) as n, round(avg(cus), 6) as mean, round(quantile_cont(cus, 0.5), 6) as median, round(stddev_pop(cus), 6) as std, round(min(cus), 6) as min, round(max(cus), 6) as max,
  round(avg((cus >= 0.99::double)::int), 6) as near_one, round(avg((cus >= 0.8::double)::int), 6) as high, round(sqrt(avg((1 - cus) * (1 - cus))), 6) as rmse_vs_one from c group by 1
""",
)
def summary_distribution(spark, sf_dir):
    out = r.distribution(answers(spark, sf_dir), ["model"], "cus")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("model", "n")})


@query(
    "pairwise_winrate",
    A
    + """
select x.model as model1, y.model as model2, round(avg((x.cus > y.cus)::int), 6) as wins, round(avg((x.cus < y.cus)::int), 6) as losses, round(avg((x.cus = y.cus)::int), 6) as ties, count(*) as n
from c x join c y on x.item = y.item and x.temperature = y.temperature and x.model < y.model group by 1, 2
""",
)
def pairwise_winrate(spark, sf_dir):
    out = r.win_rates(answers(spark, sf_dir), ["item", "temperature"], "model", "cus")
    return out.withColumns({c: F.round(c, 6) for c in ("wins", "losses", "ties")})


@query(
    "mannwhitney_u",
    A
    + """
, k as (select dataset, model, rank() over (partition by dataset order by gold) + (count(*) over (partition by dataset, gold) - 1) / 2.0 as r from c where model in ('m0', 'm1'))
select dataset, sum(r) filter (model = 'm0') - count(*) filter (model = 'm0') * (count(*) filter (model = 'm0') + 1) / 2.0 as u, count(*) filter (model = 'm0') as n1, count(*) filter (model = 'm1') as n2 from k group by 1
""",
)
def mannwhitney_u(spark, sf_dir):
    rows = answers(spark, sf_dir).where(F.col("model").isin("m0", "m1"))
    return r.mann_whitney(rows, ["dataset"], "gold", F.col("model") == "m0").select("dataset", "u", "n1", "n2")


U = """
, k as (select g, first, rank() over (partition by g order by v) + (count(*) over (partition by g, v) - 1) / 2.0 as r from rows),
e as (select g, sum(c * c * c - c) as ties from (select g, v, count(*) as c from rows group by 1, 2) group by 1),
u as (select g, sum(r) filter (first) - count(*) filter (first) * (count(*) filter (first) + 1) / 2.0 as u, count(*) filter (first) as n1, count(*) filter (not first) as n2, any_value(ties) as ties from k join e using (g) group by 1),
s as (select *, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) as s from u)
"""


@query("mannwhitney_p", A + ", rows as (select dataset as g, gold as v, model = 'm0' as first from c where model in ('m0', 'm1'))" + U + f", x as (select *, (u - n1 * n2 / 2.0) / s as z from s) select g as dataset, u, round(z, 6) as z, n1, n2, {_rounded(NORMAL_TAIL)} as p from x")
def mannwhitney_p(spark, sf_dir):
    """The normal approximation alone."""
    rows = answers(spark, sf_dir).where(F.col("model").isin("m0", "m1"))
    out = r.with_p(r.mann_whitney(rows, ["dataset"], "gold", F.col("model") == "m0"), "normal", ["z"])
    return out.select("dataset", "u", F.round("z", 6).alias("z"), "n1", "n2", F.round("p", 6).alias("p"))


STARS = "case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end as stars"
#: The number of partitions of U into n1 parts of n2 at most is a product of (1 - x^(n2 + k)) / (1 - x^k): a step a factor.
RANK_SUMS = """
, need as (select distinct least(n1, n2) as a, greatest(n1, n2) as b from s where n1 >= 5 and n2 >= 5 and least(n1, n2) <= 8 and ties = 0),
l as (select a, b, 0 as k, list_transform(range(0, a * b + 1), lambda i: case when i = 0 then 1.0 else 0.0 end::double) as c from need
  union all select a, b, k + 1, list_transform(range(0, a * b + 1), lambda i: list_sum(list_transform(range(0, i // (k + 1) + 1), lambda j: c[i - j * (k + 1) + 1] - coalesce(c[i - j * (k + 1) - (b + k + 1) + 1], 0) * (i - j * (k + 1) >= b + k + 1)::int))) from l where k < a),
counts as (select a, b, c, list_sum(c) as total from l where k = a)
"""


@query(
    "mannwhitney_exact_p",
    "with recursive rows as (select user_id as g, value as v, event_type = 'click' as first from events where event_type in ('click', 'view'))" + U + RANK_SUMS
    + f"""
, x as (select *, (abs(u - n1 * n2 / 2.0) - 0.5) / s as zz from s left join counts on a = least(n1, n2) and b = greatest(n1, n2) and ties = 0 where n1 >= 5 and n2 >= 5),
y as (select g, u, n1, n2, c, total, greatest(zz, 0) as z from x),
p as (select g, u, n1, n2, case when c is not null then least(1, 2 * list_sum(c[1:floor(least(u, n1 * n2 - u))::int + 1]) / total) else greatest(0, least(1, {NORMAL_TAIL})) end as p from y)
select g as user_id, u, n1, n2, round(p, 6) + 0.0 as p, {STARS} from p
""",
)
def mannwhitney_exact_p(spark, sf_dir):
    """Users' clicks against their views: exact where one of them is few and nothing is tied, else approximated."""
    e = read(spark, sf_dir, "events").where("event_type in ('click', 'view')").select("user_id", "event_type", "value")
    out = r.mann_whitney_p(r.mann_whitney(e, ["user_id"], "value", F.col("event_type") == "click"))
    return out.select("user_id", "u", "n1", "n2", F.round("p", 6).alias("p"), "stars")


@query(
    "wilcoxon_p",
    f"""
with recursive d as (select user_id, event_type, round(value * 100)::bigint - 4000 as diff from events),
k as (select user_id, event_type, diff, rank() over (partition by user_id, event_type order by abs(diff)) + (count(*) over (partition by user_id, event_type, abs(diff)) - 1) / 2.0 as r from d where diff <> 0),
e as (select user_id, event_type, sum(c * c * c - c) as ties from (select user_id, event_type, abs(diff) as a, count(*) as c from d where diff <> 0 group by all) group by all),
o as (select user_id, event_type, count(*) filter (diff = 0) as zeros from d group by all),
w as (select user_id, event_type, least(coalesce(sum(r) filter (diff > 0), 0), coalesce(sum(r) filter (diff < 0), 0)) as w, count(*) as n from k group by all),
x as (select *, (w - n * (n + 1) / 4.0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 0) as z from w join e using (user_id, event_type) join o using (user_id, event_type) where n + zeros >= 5),
l as (select 0 as k, [1.0::double] as c union all select k + 1, list_transform(range(0, (k + 1) * (k + 2) // 2 + 1), lambda i: (coalesce(c[i + 1], 0) + case when i > k then coalesce(c[i - k], 0) else 0 end) / 2) from l where k < 50),
p as (select user_id, event_type, w, n, case when ties = 0 and zeros = 0 and c is not null then least(1, 2 * list_sum(c[1:floor(w)::int + 1])) else greatest(0, least(1, {NORMAL_TAIL})) end as p from x left join l on l.k = x.n)
select user_id, event_type, w, n, round(p, 6) + 0.0 as p, {STARS} from p
""",
)
def wilcoxon_p(spark, sf_dir):
    """Whether a user's values of one kind lie about 40: exact for up to fifty without ties and zeros, else approximated."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", (F.round(F.col("value") * 100).cast("long") - 4000).alias("diff"))
    out = r.wilcoxon_p(r.wilcoxon(e, ["user_id", "event_type"], "diff"))
    return out.select("user_id", "event_type", "w", "n", F.round("p", 6).alias("p"), "stars")


@query(
    "wilcoxon_w",
    A
    + """
, d as (select temperature, (x.event_id * 31 % 101) - (y.event_id * 31 % 101) as diff from (select event_id, event_id // 12 as item, (event_id // 4) % 3 as temperature from events where event_id % 4 = 0) x join (select event_id, event_id // 12 as item, (event_id // 4) % 3 as temperature from events where event_id % 4 = 1) y using (item, temperature)),
k as (select temperature, diff, rank() over (partition by temperature order by abs(diff)) + (count(*) over (partition by temperature, abs(diff)) - 1) / 2.0 as r from d where diff <> 0)
select temperature, least(sum(r) filter (diff > 0), sum(r) filter (diff < 0)) as w, count(*)::bigint as n from k group by 1
""",
)
def wilcoxon_w(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 12).alias("item"), (F.floor(F.col("event_id") / 4) % 3).alias("temperature"), (F.col("event_id") % 4).alias("m"), (F.col("event_id") * 31 % 101).alias("v"))
    x, y = e.where("m = 0").withColumnRenamed("v", "v0").drop("m"), e.where("m = 1").withColumnRenamed("v", "v1").drop("m")
    rows = x.join(y, ["item", "temperature"]).withColumn("diff", F.col("v0") - F.col("v1"))
    return r.wilcoxon(rows, ["temperature"], "diff").select("temperature", "w", "n")


@query(
    "percentile_filter",
    """
with c as (select o_orderstatus, quantile_cont(o_totalprice, 0.05) as p, quantile_cont(o_custkey::double, 0.05) as k from orders group by 1)
select o_orderkey, o_totalprice < p as low_o_totalprice, o_custkey < k as low_o_custkey, o_totalprice >= p and o_custkey >= k as passes from orders join c using (o_orderstatus)
""",
)
def percentile_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    return r.percentile_filter(rows, ["o_orderstatus"], ["o_totalprice", "o_custkey"]).select("o_orderkey", "low_o_totalprice", "low_o_custkey", "passes")


@query(
    "histogram_bins",
    """
with e as (select event_type, min(user_id) as lo, max(user_id) as hi from events group by 1)
select event_type, least(19, coalesce(floor((user_id - lo) * 20 / (hi - lo)), 0))::int as bin, count(*) as n from events join e using (event_type) group by 1, 2
""",
)
def histogram_bins(spark, sf_dir):
    return r.histogram(read(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("linear_trend", A + "select model, round(regr_slope(gold, context), 6) as slope, round(regr_intercept(gold, context), 6) as intercept from c group by 1")
def linear_trend(spark, sf_dir):
    return answers(spark, sf_dir).groupBy("model").agg(F.round(F.regr_slope("gold", "context"), 6).alias("slope"), F.round(F.regr_intercept("gold", "context"), 6).alias("intercept"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("metric_matrix", A + "select model, " + ", ".join(f"coalesce(printf('%.4f', avg({m}) filter (dataset = '{c}')), 'N/A') as {c}_{m}" for c in [*TYPES, "none"] for m in ("gold", "context", "cus")) + " from c group by 1")
def metric_matrix(spark, sf_dir):
    """Models by data set and metric, as texts; a data set that the table lacks has none."""
    return r.metric_matrix(answers(spark, sf_dir), "model", "dataset", [*TYPES, "none"], ["gold", "context", "cus"])


PER_LEVEL = ", ".join(f"max({s}) filter (level = {k}) as {s}_l{k}" for k in LEVELS for s in ("n", "mean", "std", "min", "max"))


@query(
    "wide_statistics",
    Q
    + f"""
, s as (select week, level, count(*) as n, avg(score) as mean, stddev_pop(score) as std, min(score) as min, max(score) as max, var_samp(score) as v, var_pop(score) * count(*) as w from q group by 1, 2),
g as (select week, sum(n * mean) / sum(n) as mm from s group by 1),
an as (select week, round((sum(n * (mean - mm) * (mean - mm)) / nullif(count(*) - 1, 0)) / nullif(sum(w) / nullif(sum(n) - count(*), 0), 0), 4) as f, count(*) - 1 as df1, (sum(n) - count(*))::bigint as df2 from s join g using (week) group by 1),
t as (select a.week, a.level as hi, (a.mean - b.mean) / nullif(sqrt(a.v / a.n + b.v / b.n), 0) as t,
  power(a.v / a.n + b.v / b.n, 2) / nullif(power(a.v / a.n, 2) / nullif(a.n - 1, 0) + power(b.v / b.n, 2) / nullif(b.n - 1, 0), 0) as df, (a.mean - b.mean) / nullif(sqrt((a.v + b.v) / 2), 0) as d from s a join s b on a.week = b.week and a.level = b.level + 1),
tw as (select week, {", ".join(f"round(max({x}) filter (hi = {k}), 4) as {x}_l{k}_l{k - 1}" for k in LEVELS[:-1] for x in ("t", "df", "d"))} from t group by 1),
iv as (select week, {", ".join(f"round(avg(coalesce(l{k} <= l{k - 1}, false)::int), 6) as inversions_l{k}_l{k - 1}" for k in LEVELS[:-1])} from wide group by 1),
ds as (select week, {PER_LEVEL} from s group by 1)
select ds.week, {", ".join(f"n_l{k}, round(mean_l{k}, 6) as mean_l{k}, round(std_l{k}, 6) as std_l{k}, min_l{k}, max_l{k}" for k in LEVELS)}, f, df1, df2, tw.* exclude (week), iv.* exclude (week)
from ds left join an using (week) left join tw using (week) left join iv using (week)
""",
)
def wide_statistics(spark, sf_dir):
    """One row a week with the statistics of all levels and of neighbouring ones."""
    out = r.wide_statistics(quads(spark, sf_dir), ["week"], LEVELS, ["user_id"])
    six = {c: F.round(c, 6) for c in out.columns if c.startswith(("mean_", "std_", "inversions_"))}
    return out.withColumns({**six, **{c: F.round(c, 4) for c in out.columns if c.startswith(("t_", "df_", "d_")) or c == "f"}})
