"""Queries of matching inside pairs, text overlap, triplet classes and annotator agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, matching, textsim
from .registry import query, read


def sides(spark, sf_dir):
    """Vectors 10k to 10k + 9 are a pair: the first five its one side, the others its second."""
    e = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("pair_id"), (F.col("vec_id") % 10).alias("at"), F.col("embedding").alias("v"))
    return e.where("at < 5").select("pair_id", F.col("at").alias("pos"), "v"), e.where("at >= 5").select("pair_id", (F.col("at") - 5).alias("pos"), "v")


COS = """
with e as (select vec_id // 10 as pair_id, vec_id % 10 as pos, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
one as (select * from e where pos < 5), two as (select pair_id, pos - 5 as pos, v, n from e where pos >= 5),
c as (select pair_id, a.pos as pos1, b.pos as pos2, list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8::double) as cos from one a join two b using (pair_id)),
best as (select * from c qualify row_number() over (partition by pair_id, pos1 order by round(cos, 6) desc, pos2) = 1)
"""


def cosines(spark, sf_dir):
    return matching.pair_cosines(*sides(spark, sf_dir))


@query("embedding_cosine_pairs", COS + "select pair_id, pos1, pos2, round(cos, 5) as cos from c")
def embedding_cosine_pairs(spark, sf_dir):
    return cosines(spark, sf_dir).withColumn("cos", F.round("cos", 5))


@query("embedding_top1_match", COS + "select pair_id, pos1, pos2, round(cos, 5) as cos from best")
def embedding_top1_match(spark, sf_dir):
    return matching.best_match(cosines(spark, sf_dir)).withColumn("cos", F.round("cos", 5))


@query("soft_label_mapping", COS + "select pair_id, pos1, case when cos >= 0.65::double then pos2 end as anchor from best")
def soft_label_mapping(spark, sf_dir):
    return matching.soft_mapping(matching.best_match(cosines(spark, sf_dir))).select("pair_id", "pos1", "anchor")


@query("matched_filter", COS + "select distinct pair_id, pos2 from best")
def matched_filter(spark, sf_dir):
    return matching.best_match(cosines(spark, sf_dir)).select("pair_id", "pos2").distinct()


@query(
    "mean_pool_cosine",
    COS
    + """
, m as (select pair_id, i, avg(x) filter (side = 0) as x, avg(x) filter (side = 1) as y from (select pair_id, (pos >= 5)::int as side, unnest(range(len(v))) as i, unnest(v) as x from e) group by 1, 2)
select pair_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-8::double), 5) as cos from m group by 1 having count(x) > 0 and count(y) > 0
""",
)
def mean_pool_cosine(spark, sf_dir):
    return matching.pooled_cosine(*sides(spark, sf_dir)).withColumn("cos", F.round("cos", 5))


PR = """
, p as (select pair_id, avg(m) as p from (select pair_id, pos2, max(cos) as m from c group by 1, 2) group by 1), r as (select pair_id, avg(m) as r from (select pair_id, pos1, max(cos) as m from c group by 1, 2) group by 1)
"""


@query("bertscore_prf", COS + PR + "select pair_id, round(p, 5) as p, round(r, 5) as r, round(2 * p * r / (p + r), 5) as f1 from p join r using (pair_id)")
def bertscore_prf(spark, sf_dir):
    return matching.match_f1(cosines(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("p", "r", "f1")})


@query("gaussian_label_similarity", COS + "select pair_id, round(avg(m), 5) as similarity from (select pair_id, pos1, max(exp(-(2 - 2 * cos) / 2)) as m from c group by 1, 2) group by 1")
def gaussian_label_similarity(spark, sf_dir):
    return matching.gaussian_similarity(cosines(spark, sf_dir)).withColumn("similarity", F.round("similarity", 5))


def parts(spark, sf_dir):
    """Couples of triples with the cosines of their parts: a vector's first 20 numbers are the head, then relation and tail."""
    part = lambda v, a, n: F.slice(v, a, n)
    one, two = sides(spark, sf_dir)
    a, b = one.select("pair_id", F.col("pos").alias("pos1"), F.col("v").alias("v1")), two.select("pair_id", F.col("pos").alias("pos2"), F.col("v").alias("v2"))
    cut = {"head": (1, 20), "rel": (21, 20), "tail": (41, 24)}
    return a.join(b, "pair_id").select("pair_id", "pos1", "pos2", *[matching.cosine(part(F.col("v1"), *c), part(F.col("v2"), *c)).alias(k) for k, c in cut.items()])


def _part(a, b):
    return f"list_dot_product(x.v[{a}:{b}], y.v[{a}:{b}]) / (sqrt(list_dot_product(x.v[{a}:{b}], x.v[{a}:{b}])) * sqrt(list_dot_product(y.v[{a}:{b}], y.v[{a}:{b}])) + 1e-8::double)"


CLASSES = COS + f"""
, q as (select pair_id, x.pos as pos1, y.pos as pos2, {_part(1, 20)} as h, {_part(21, 40)} as r, {_part(41, 64)} as t from one x join two y using (pair_id)),
o as (select *, round((h + r + t) / 3, 6) as overall from q qualify row_number() over (partition by pair_id, pos1 order by round((h + r + t) / 3, 6) desc, pos2) = 1),
k as (select *, case when overall < 0.5 then 'missing' when h >= 0.7::double and r >= 0.7::double and t >= 0.7::double then 'aligned' when h >= 0.7::double and t >= 0.7::double then 'relation_substitution'
  when r >= 0.7::double and (h >= 0.7::double or t >= 0.7::double) then 'entity_substitution' else 'unclassified' end as class from o)
"""


@query("partwise_match_classes", CLASSES + "select pair_id, pos1, pos2, overall, class from k")
def partwise_match_classes(spark, sf_dir):
    return matching.partwise_classes(parts(spark, sf_dir)).select("pair_id", "pos1", "pos2", "overall", "class")


@query("extra_antijoin", CLASSES + "select two.pair_id, two.pos from two where not exists (select 1 from k where k.pair_id = two.pair_id and k.pos2 = two.pos and class not in ('missing', 'unclassified'))")
def extra_antijoin(spark, sf_dir):
    return matching.extras(sides(spark, sf_dir)[1], matching.partwise_classes(parts(spark, sf_dir))).select("pair_id", "pos")


@query("class_counts", CLASSES + "select class, count(*) as n from k group by 1")
def class_counts(spark, sf_dir):
    return matching.partwise_classes(parts(spark, sf_dir)).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def turns(spark, sf_dir):
    """Each message and the one after it: pair_id, reference, candidate."""
    c = read(spark, sf_dir, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("reference")), c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("candidate"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "reference", "candidate")


T = """
with p as (select a.conv_id * 1000 + a.turn as pair_id, regexp_extract_all(lower(a.text), '[a-z0-9]+') as x, regexp_extract_all(lower(b.text), '[a-z0-9]+') as y from conversations a join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn)
"""


def _grams(n):
    g = lambda c: f"unnest(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' ')))"
    return f", g{n} as (select pair_id, g, sum(1 - k) as r, sum(k) as c from (select pair_id, {g('x')} as g, 0 as k from p union all select pair_id, {g('y')}, 1 from p) group by 1, 2), s{n} as (select pair_id, sum(least(r, c)) as m, sum(r) as nr, sum(c) as nc from g{n} group by 1)"


def _rouge(n):
    return T + _grams(n) + f", f as (select p.pair_id, coalesce(m / nullif(nc, 0), 0) as p, coalesce(m / nullif(nr, 0), 0) as r from p left join s{n} using (pair_id)) select pair_id, round(p, 6) as p, round(r, 6) as r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f from f"


@query("rouge1_f", _rouge(1))
def rouge1_f(spark, sf_dir):
    return textsim.rouge_n(turns(spark, sf_dir), 1).withColumns({c: F.round(c, 6) for c in ("p", "r", "f")})


@query("rouge2_f", _rouge(2))
def rouge2_f(spark, sf_dir):
    return textsim.rouge_n(turns(spark, sf_dir), 2).withColumns({c: F.round(c, 6) for c in ("p", "r", "f")})


SPACED = T[: T.index("regexp_extract_all(lower(a.text)")] + "list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda w: w <> '') as x, list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> '') as y" + T[T.index(" from conversations a join") :]


@query(
    "bleu4",
    SPACED + _grams(1) + _grams(2) + _grams(3) + _grams(4)
    + ", l as (select p.pair_id, len(x) as lr, len(y) as lc, "
    + ", ".join(f"coalesce(s{n}.m, 0) as m{n}" for n in range(1, 5)) + " from p " + " ".join(f"left join s{n} on s{n}.pair_id = p.pair_id" for n in range(1, 5)) + ")"
    + " select pair_id, round(case when m1 > 0 and lc > 0 then exp(" + " + ".join(f"ln(case when m{n} > 0 then m{n} else 0.1 end::double / greatest(1, lc - {n - 1})) / 4" for n in range(1, 5)) + " + case when lc > lr then 0 else 1 - lr / lc end) else 0 end, 6) as bleu from l",
)
def bleu4(spark, sf_dir):
    return textsim.bleu(turns(spark, sf_dir)).withColumn("bleu", F.round("bleu", 6))


@query(
    "rouge_l",
    T.replace("with p as", "with recursive p as")
    + """
, r as (select pair_id, 0 as i, list_transform(y, lambda w: 0) as row from p union all
  select r.pair_id, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], case when y[k] = x[i + 1] then coalesce(row[k - 1], 0) + 1 else 0 end)))) from r join p using (pair_id) where i < len(x)),
d as (select p.pair_id, len(x) as lx, len(y) as ly, row[len(y)] as n from p join r on r.pair_id = p.pair_id and i = len(x))
select pair_id, round(case when n > 0 then 2 * n / (lx + ly) else 0 end, 6) as f from d
""",
)
def rouge_l(spark, sf_dir):
    return turns(spark, sf_dir).select("pair_id", F.round(textsim.rouge_l(F.col("reference"), F.col("candidate")), 6).alias("f"))


#: The longest common run of both texts, the first in the one and in the other, and then what lies left and right of it.
RATIO = """
with recursive p as (select c_custkey as k, lag(c_name) over (partition by c_nationkey, c_mktsegment order by c_custkey) as a, c_name as b from customer),
r as (select k, a, b, 0::bigint as n from p where a is not null
  union all select k, unnest([left(a, strpos(a, m)::int - 1), substr(a, strpos(a, m)::int + length(m))]), unnest([left(b, strpos(b, m)::int - 1), substr(b, strpos(b, m)::int + length(m))]), unnest([length(m), 0])
  from (select k, a, b, list_filter(flatten(list_transform(range(length(a), 0, -1), lambda n: list_transform(range(1, length(a) - n + 2), lambda i: substr(a, i, n)))), lambda x: contains(b, x))[1] as m from r where a <> '' and b <> '') where m is not null)
select k as c_custkey, round(2 * sum(n) / max(t), 6) as ratio from r join (select k, length(a) + length(b) as t from p where a is not null) using (k) group by 1
"""


@query("sequence_ratio", RATIO)
def sequence_ratio(spark, sf_dir):
    """Names of customers of a nation and segment that follow one another."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "customer")
    before = F.lag("c_name").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    return c.withColumn("before", before).where("before is not null").select("c_custkey", F.round(textsim.sequence_ratio(F.col("before"), F.col("c_name")), 6).alias("ratio"))


def marks(spark, sf_dir):
    """Three annotators' items: users by day, marked by the kind of event."""
    e = read(spark, sf_dir, "events")
    return e.select(F.dayofmonth("ts").cast("long").alias("row_id"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("item"), (F.col("event_id") % 3 + 1).cast("int").alias("annotator"))


MARKS = """
with m as (select day(ts) as row_id, event_type || '|' || user_id as item, event_id % 3 + 1 as annotator from events),
v as (select row_id, item, max((annotator = 1)::int) as a1, max((annotator = 2)::int) as a2, max((annotator = 3)::int) as a3 from m group by 1, 2),
w as (select *, a1 + a2 + a3 as votes from v)
"""


@query("annotator_votes", MARKS + "select * from w")
def annotator_votes(spark, sf_dir):
    return agreement.votes(marks(spark, sf_dir))


@query(
    "fleiss_kappa",
    MARKS
    + """
, s as (select count(*) as items, avg((votes in (0, 3))::int) as percent, avg((votes * (votes - 1) + (3 - votes) * (2 - votes)) / 6) as agree, avg(votes / 3) as yes from w)
select items, round(percent, 6) as percent, round((agree - (yes * yes + (1 - yes) * (1 - yes))) / (1 - (yes * yes + (1 - yes) * (1 - yes))), 6) as kappa from s
""",
)
def fleiss_kappa(spark, sf_dir):
    return agreement.fleiss(agreement.votes(marks(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("percent", "kappa")})


@query(
    "pairwise_jaccard",
    MARKS
    + """
, p as (select item, max(a1) as a1, max(a2) as a2, max(a3) as a3 from v group by 1),
c as (select '1-2' as pair, a1 as x, a2 as y from p union all select '1-3', a1, a3 from p union all select '2-3', a2, a3 from p)
select pair, round(2 * sum(x * y) / (sum(x) + sum(y)), 6) as f1, round(sum(x * y) / (sum(x) + sum(y) - sum(x * y)), 6) as jaccard from c group by 1
""",
)
def pairwise_jaccard(spark, sf_dir):
    return agreement.pairwise(agreement.votes(marks(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("f1", "jaccard")})


PRF = MARKS + """
, k as (select row_id, item, a1 as g, a2 as s from v where a1 + a2 > 0),
t as (select row_id, sum(g * s) as tp, sum((1 - g) * s) as fp, sum(g * (1 - s)) as fn from k group by 1),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 1) as p, coalesce(tp / nullif(tp + fn, 0), 1) as r from t),
f as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from r)
"""


def prf(spark, sf_dir):
    m = marks(spark, sf_dir).withColumnRenamed("item", "key")
    return agreement.aligned_prf(m.where("annotator = 1"), m.where("annotator = 2"))


@query("aligned_prf", PRF + "select row_id, tp, fp, fn, round(p, 6) as p, round(r, 6) as r, round(f1, 6) as f1 from f")
def aligned_prf(spark, sf_dir):
    return prf(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("p", "r", "f1")})


@query(
    "aligned_prf_averages",
    PRF
    + """
, a as (select sum(tp) / (sum(tp) + sum(fp)) as p, sum(tp) / (sum(tp) + sum(fn)) as r, avg(round_even(p, 4)) as mp, avg(round_even(r, 4)) as mr, avg(round_even(f1, 4)) as mf, count(*) as n from f)
select round(p, 6) as micro_p, round(r, 6) as micro_r, round(2 * p * r / (p + r), 6) as micro_f1, round(mp, 6) as macro_p, round(mr, 6) as macro_r, round(mf, 6) as macro_f1, n from a
""",
)
def aligned_prf_averages(spark, sf_dir):
    out = agreement.averages(prf(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "n"})


@query("aligned_prf_first", PRF + "select row_id, tp, fp, fn, round(p, 6) as p, round(r, 6) as r, round(f1, 6) as f1 from f where row_id in (select row_id from (select distinct row_id from v where a1 = 1 intersect select distinct row_id from v where a2 = 1) order by row_id limit 12)")
def aligned_prf_first(spark, sf_dir):
    """The first twelve of the days that both annotators marked."""
    m = marks(spark, sf_dir).withColumnRenamed("item", "key")
    return agreement.aligned_prf(*agreement.first_rows(m.where("annotator = 1"), m.where("annotator = 2"), 12)).withColumns({c: F.round(c, 6) for c in ("p", "r", "f1")})


THREE = CLASSES + """
, b as (select *, round((h + r + t) / 3, 6) as score from q qualify row_number() over (partition by pair_id, pos1 order by round((h + r + t) / 3, 6) desc, pos2) = 1)
select pair_id, pos1, pos2, score, case when score >= 0.3::double then 'aligned' when h >= 0.2::double and t >= 0.2::double and not r >= 0.1::double then 'relation_different'
  when r >= 0.1::double and (h >= 0.2::double or t >= 0.2::double) then 'entity_different' else 'unclassified' end as class from b
"""


@query("triplet_classes", THREE)
def triplet_classes(spark, sf_dir):
    """Three classes by a whole score and, below it, by parts; thresholds that tell random vectors apart."""
    couples = parts(spark, sf_dir).withColumn("score", (F.col("head") + F.col("rel") + F.col("tail")) / 3)
    return matching.three_classes(couples, 0.3, 0.2, 0.1).select("pair_id", "pos1", "pos2", "score", "class")


KINDS = ["aligned", "relation_substitution", "entity_substitution", "missing", "unclassified"]


@query("partwise_json", CLASSES + "select pair_id, " + ", ".join(f"to_json(coalesce(list([pos1, pos2] order by pos1) filter (class = '{k}'), []))::varchar as {k}" for k in KINDS) + " from k group by 1")
def partwise_json(spark, sf_dir):
    """The couples of each class in a column of their own, as JSON."""
    return matching.class_columns(matching.partwise_classes(parts(spark, sf_dir)), KINDS)
