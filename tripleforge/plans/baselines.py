"""Queries of text baselines: overlap of stems, matches of tokens, and a stored inner-product index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stemming
from ..operators import textsim, token_match, vector_index
from ..sources import storage
from .pairs import T, _grams, turns
from .registry import query, read

# --- stems: the rules as SQL, a step a table, over the distinct words


def _is(pattern, x):
    return f"regexp_matches({x}, '{pattern}')"


def _rules(x, table, condition):
    """CASE branches for each suffix, the longest first."""
    out = ""
    for suffix in sorted(table, key=len, reverse=True):
        stem = f"left({x}, -{len(suffix)})"
        out += f" when {x} like '%{suffix}' then case when {condition(stem, suffix)} then {stem} || '{table[suffix]}' else {x} end"
    return out


_SOME = lambda stem, suffix: _is(stemming.SOME, stem)
_SECOND = lambda x: f"case{_rules(x, stemming.LATER_2, _SOME)} when {x} like '%logi' and {_is(stemming.SOME, f'left({x}, -3)')} then left({x}, -1) else {x} end"
_FOURTH = {s: "" for s in stemming.STEP_4}
_CUT = "regexp_replace(a, '(ed|ing)$', '')"
STEMS = f"""
, w0 as (select distinct w from (select unnest(x) as w from p union all select unnest(y) from p) where length(w) > 3),
w1 as (select w, case when w like '%sses' then left(w, -2) when w like '%ies' then case when length(w) = 4 then left(w, -1) else left(w, -2) end when w like '%s' and w not like '%ss' then left(w, -1) else w end as a from w0),
w2 as (select w, a, {_CUT} as b from w1),
w3 as (select w, case when a like '%ied' then case when length(a) = 4 then left(a, -1) else left(a, -2) end when a like '%eed' then case when {_is(stemming.SOME, 'left(a, -3)')} then left(a, -1) else a end
  when a = b or not {_is(stemming.VOWEL, 'b')} then a when {_is('(at|bl|iz)$', 'b')} then b || 'e'
  when length(b) > 1 and right(b, 1) = left(right(b, 2), 1) and not {_is('[aeiouylsz]$', 'b')} then left(b, -1) when {_is(stemming.ONE, 'b')} and {_is(stemming.SHORT_LATER, 'b')} then b || 'e' else b end as a from w2),
w4 as (select w, case when length(a) > 2 and {_is('[^aeiouy]y$|[aeiou]yy$', 'a')} then left(a, -1) || 'i' else a end as a from w3),
w5 as (select w, {_SECOND('a')} as b, a like '%alli' and {_is(stemming.SOME, 'left(a, -4)')} as again from w4), w6 as (select w, case when again then {_SECOND('b')} else b end as a from w5),
w7 as (select w, case{_rules('a', stemming.STEP_3, _SOME)} else a end as a from w6),
w8 as (select w, case{_rules('a', _FOURTH, lambda stem, suffix: _is(stemming.MORE, stem) + (f" and {_is('[st]$', stem)}" if suffix == 'ion' else ''))} else a end as a from w7),
w9 as (select w, case when a like '%e' and ({_is(stemming.MORE, 'left(a, -1)')} or {_is(stemming.ONE, 'left(a, -1)')} and not {_is(stemming.SHORT_LATER, 'left(a, -1)')}) then left(a, -1) else a end as a from w8),
stems as (select w, case {' '.join(f"when w = '{k}' then '{v}'" for k, v in stemming.IRREGULAR.items())} when a like '%ll' and {_is(stemming.MORE, 'left(a, -1)')} then left(a, -1) else a end as s from w9),
q as (select pair_id, {', '.join(f"coalesce((select list(coalesce(s, t.w) order by i) from (select unnest({c}) as w, unnest(range(len({c}))) as i) t left join stems on stems.w = t.w), []) as {c}" for c in 'xy')} from p)
"""


def _stemmed(n):
    grams = _grams(n).replace(" from p ", " from q ").replace(" from p)", " from q)")
    return T + STEMS + grams + f", f as (select q.pair_id, coalesce(m / nullif(nc, 0), 0) as p, coalesce(m / nullif(nr, 0), 0) as r from q left join s{n} using (pair_id)) select pair_id, round(p, 6) as p, round(r, 6) as r, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f from f"


@query("rouge1_stemmed", _stemmed(1))
def rouge1_stemmed(spark, sf_dir):
    return textsim.rouge_n(turns(spark, sf_dir), 1, stemmed=True).withColumns({c: F.round(c, 6) for c in ("p", "r", "f")})


@query("rouge2_stemmed", _stemmed(2))
def rouge2_stemmed(spark, sf_dir):
    return textsim.rouge_n(turns(spark, sf_dir), 2, stemmed=True).withColumns({c: F.round(c, 6) for c in ("p", "r", "f")})


@query(
    "rouge_l_stemmed",
    T.replace("with p as", "with recursive p as")
    + STEMS
    + """
, u as (select pair_id, 0 as i, list_transform(y, lambda w: 0) as row from q union all
  select u.pair_id, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(row[k], case when y[k] = x[i + 1] then coalesce(row[k - 1], 0) + 1 else 0 end)))) from u join q using (pair_id) where i < len(x)),
d as (select q.pair_id, len(x) as lx, len(y) as ly, row[len(y)] as n from q join u on u.pair_id = q.pair_id and i = len(x))
select pair_id, round(case when n > 0 then 2 * n / (lx + ly) else 0 end, 6) as f from d
""",
)
def rouge_l_stemmed(spark, sf_dir):
    return turns(spark, sf_dir).select("pair_id", F.round(textsim.rouge_l(F.col("reference"), F.col("candidate"), stemmed=True), 6).alias("f"))


# --- tokens

_LETTERS = "[" + ", ".join(f"'{c}'" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
TOKENS = T + f"""
, t as (select pair_id, 'r' as side, unnest(x) as w from p union all select pair_id, 'c', unnest(y) from p),
v as materialized (select w, v, sqrt(list_dot_product(v, v)) as n from (select w, list_transform({_LETTERS}, lambda c: (length(w) - length(replace(w, c, '')))::double) as v from (select distinct w from t))),
k as (select pair_id, side, w, count(*) as n from t group by all),
a as (select x.pair_id, x.w as one, y.w as two, case when a.n > 0 and b.n > 0 then round(list_dot_product(a.v, b.v) / (a.n * b.n), 10) else 0 end as cos
  from k x join k y on x.pair_id = y.pair_id and x.side = 'r' and y.side = 'c' join v a on a.w = x.w join v b on b.w = y.w),
b as (select pair_id, 'r' as side, one as w, max(cos) as best from a group by all union all select pair_id, 'c', two, max(cos) from a group by all),
df as (select w, count(*) as df from k where side = 'r' and pair_id in (select pair_id from k where side = 'c') group by 1), n as (select count(*) as pairs from p where len(x) > 0 and len(y) > 0),
s as (select b.pair_id, b.side, sum(k.n * best * u) / nullif(sum(k.n * u), 0) as m from b join k using (pair_id, side, w) join (select w, WEIGHT as u from v left join df using (w), n) using (w) group by all)
select pair_id, round(p, 5) as p, round(r, 5) as r, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 5) as f from (
  select p.pair_id, coalesce(max(m) filter (side = 'c'), 0) as p, coalesce(max(m) filter (side = 'r'), 0) as r from p left join s using (pair_id) group by 1)
"""


@query("token_bertscore", TOKENS.replace("WEIGHT", "1"))
def token_bertscore(spark, sf_dir):
    """Greedy matches of the tokens of each message and the one after it, with an encoder that SQL can state."""
    return token_match.token_scores(turns(spark, sf_dir)).withColumns({c: F.round(c, 5) for c in ("p", "r", "f")})


@query("token_bertscore_idf", TOKENS.replace("WEIGHT", "ln((pairs + 1) / (coalesce(df, 0) + 1))"))
def token_bertscore_idf(spark, sf_dir):
    """The same, each token weighted by how few of the table's messages hold it."""
    return token_match.token_scores(turns(spark, sf_dir), weighted=True).withColumns({c: F.round(c, 5) for c in ("p", "r", "f")})


# --- an index

BRUTE = """
select a.vec_id as query_id, rank, b.vec_id as id, round(score, 6) as score from (
  select a, b, list_dot_product(a.embedding::double[], b.embedding::double[]) as score, row_number() over (partition by a.vec_id order by list_dot_product(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as rank
  from embeddings a, embeddings b where a.vec_id % 20 = 0) where rank <= 5
"""


@query("inner_product_search", BRUTE)
def inner_product_search(spark, sf_dir):
    """The five largest inner products of every twentieth vector, by an index that is built, stored, opened and searched exactly."""
    e, path = read(spark, sf_dir, "embeddings"), storage.new_path(spark)
    vector_index.build(e, path, "vec_id", "embedding")
    found = vector_index.Index(spark, path).search(e.where("vec_id % 20 = 0"), 5, exact=True, id_col="vec_id", vector_col="embedding")
    return found.withColumn("score", F.round("score", 6))
