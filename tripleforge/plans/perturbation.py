"""Queries that build labelled pairs from documents and triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import not_null
from ..operators import kg, perturb
from . import graphs
from .registry import query, read

#: Common words of the synthetic texts and what stands for their opposite there.
SWAPS = {"the": "that", "of": "from", "la": "le", "der": "die", "que": "para"}


def draw(seed, *columns):
    return "('0x' || substr(md5('" + seed + "' || '|' || " + " || '|' || ".join(columns) + "), 1, 8))::bigint"


def hashed(x):
    """A long text as its md5, so that results stay narrow."""
    return F.md5(x)


def changed(df, made):
    """doc_id and digest of the rows for which something was made."""
    return not_null(df, ["doc_id"], made, "digest")


S = """
with s as (select doc_id, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as s from documents)
"""


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query("balanced_sample_md5", f"with d as (select *, row_number() over (partition by toxic order by {draw('42', 'doc_id')}, doc_id) as n from labels) select doc_id, toxic from d where n <= (select min(c) from (select count(*) as c from labels group by toxic))")
def balanced_sample_md5(spark, sf_dir):
    return perturb.balanced_sample(read(spark, sf_dir, "labels"), "toxic", ["doc_id"]).select("doc_id", "toxic")


@query("binarize_rescale", "select doc_id, (((doc_id * 13) % 101) / 100.0::double * 5 >= 3)::int as label from documents")
def binarize_rescale(spark, sf_dir):
    return perturb.binarize(docs(spark, sf_dir).select("doc_id", ((F.col("doc_id") * 13) % 101 / 100.0).alias("score")), "score").select("doc_id", "label")


@query("prose_filter", "select doc_id from documents where not regexp_matches(text, '\\[\\[|\\{\\{|==') and len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) between 80 and 400 and length(text) - length(replace(text, '.', '')) >= 2")
def prose_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(perturb.is_prose(F.col("text"))).select("doc_id")


@query("proper_phrases", "select doc_id, list_sort(list_distinct(regexp_extract_all(text, '[a-z,;] ([A-Z][a-z]{3,})', 1))) as phrases from documents")
def proper_phrases(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_sort(perturb.phrases(F.col("text"))).alias("phrases"))


@query("sentence_reorder", S + "select doc_id, md5(array_to_string(list_concat(s[1:1], list_reverse(s[2:-2]), s[-1:]), ' ')) as digest from s where len(s) >= 4")
def sentence_reorder(spark, sf_dir):
    return changed(docs(spark, sf_dir), hashed(perturb.reorder(F.col("text"))))


@query("sentence_deletion", S + ", h as (select doc_id, s, list_filter(s, lambda x: not contains(x, 'th')) as k from s) select doc_id, md5(array_to_string(k, ' ')) as digest from h where len(k) > 0 and len(k) < len(s)")
def sentence_deletion(spark, sf_dir):
    return changed(docs(spark, sf_dir), hashed(perturb.delete_sentence(F.col("text"), F.lit("th"))))


KEYS = ", ".join(f"'{k}'" for k in SWAPS)
CASE = "case " + " ".join(f"when x = '{k}' then '{v}'" for k, v in SWAPS.items()) + " else x end"


@query("relation_replacement", f"with w as (select doc_id, string_split(text, ' ') as w from documents), p as (select doc_id, w, list_position(list_transform(w, lambda x: x in ({KEYS})), true) as pos from w) select doc_id, md5(array_to_string(list_transform(w, lambda x, i: case when i = pos then {CASE} else x end), ' ')) as digest from p where pos > 0")
def relation_replacement(spark, sf_dir):
    return changed(docs(spark, sf_dir), hashed(perturb.replace_relation(F.col("text"), SWAPS)))


IMPORTANCE = "2 * len(regexp_extract_all(x, '[A-Z][a-z]+')) + case when regexp_matches(x, '[0-9]') then 1.5 else 0 end + case when contains(lower(x), lang) then 3 else 0 end + len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) / 30.0::double"


@query("fact_omission", S.replace("select doc_id, text,", "select doc_id, text, lang,") + f"""
, r as (select doc_id, s, list_transform(s, lambda x: ({IMPORTANCE})::double) as v from s where len(s) > 1),
d as (select doc_id, s, v, list_position(v, list_max(v)) as d1 from r), e as (select *, list_transform(v, lambda x, i: case when i = d1 then -1 else x end) as v2 from d),
f as (select *, case when len(s) >= 5 then list_position(v2, list_max(v2)) else 0 end as d2 from e)
select doc_id, md5(array_to_string(list_filter(s, lambda x, i: i <> d1 and i <> d2), ' ')) as digest from f
""")  # fmt: skip
def fact_omission(spark, sf_dir):
    """Texts without their one or two most important sentences; the decision named is the language's code."""
    return changed(docs(spark, sf_dir), hashed(perturb.omit_facts(F.col("text"), F.col("lang"))))


def distorted(text, seed, most, years=True, factors=perturb.RANKED_FACTORS):
    """SQL of changed numbers: CTEs up to ``made`` (doc_id, text, new), the latter null if nothing could change; ``text`` and ``seed`` over table ``d``."""
    (low, end), (high, top) = factors
    year = "and not regexp_full_match(x, '19[0-9][0-9]|20[01][0-9]|202[0-4]')" if years else ""
    fine = f"(x::double > 0 and length(regexp_extract(x, '^[0-9]+')) <= 9 {year})"
    scaled = f"x::double * case when step < {end - low + 1} then {low} + step else {high - (end - low + 1)} + step end / 100"
    place = f"(((seed + 7 * (i - 1)) % {end - low + top - high + 2})::double)"
    tenths = f"floor({scaled} * 10 + 0.5)::bigint::varchar".replace("step", place)
    whole = f"floor({scaled} + 0.5)::bigint::varchar".replace("step", place)
    one = f"case when length({tenths}) = 1 then '0.' || {tenths} else left({tenths}, -1) || '.' || right({tenths}, 1) end"
    return f"""
, n as (select *, {text} as x0, {seed} as seed, regexp_extract_all({text}, '[0-9]+(?:\\.[0-9]+)?') as nums, regexp_split_to_array({text}, '[0-9]+(?:\\.[0-9]+)?') as between from d),
k as (select *, list_filter(list_transform(nums, lambda x, i: case when {fine} then i end), lambda i: i is not null)[1:{most}] as spots from n),
made as (select * exclude (x0, nums, between, spots, seed), case when len(spots) > 0 then
  array_to_string(list_transform(between, lambda b, j: b || coalesce(list_transform(nums, lambda x, i: case when not list_contains(spots, i) then x when x::double = floor(x::double) then {whole} else {one} end)[j], '')), '') end as new from k)
"""


@query("number_distortion", "with d as (select doc_id, text from documents)" + distorted("text", draw("3", "doc_id"), 3) + "select doc_id, md5(new) as digest from made where new is not null")
def number_distortion(spark, sf_dir):
    """Up to three numbers that are no years, decimals included."""
    return changed(docs(spark, sf_dir), hashed(perturb.distort_numbers(F.col("text"), perturb.draw("3", "doc_id"))))


@query("triple_inversion", graphs.KG + "select pair_id, side, pos, o as s, p, s as o from kg")
def triple_inversion(spark, sf_dir):
    return perturb.invert_triples(graphs.sentences(spark, sf_dir)).select("pair_id", "side", "pos", "s", "p", "o")


@query("inversion_blindness", graphs.KG + graphs.EDGES + "select count(*) as same from e")
def inversion_blindness(spark, sf_dir):
    """Inverting triples leaves the undirected graph as it is: edges of both that are equal."""
    t = graphs.sentences(spark, sf_dir)
    return kg.edges(t).intersect(kg.edges(perturb.invert_triples(t))).agg(F.count(F.lit(1)).alias("same"))


def brands(spark, sf_dir):
    """Suppliers and the parts that they delivered: id, topic."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("topic"))


def overlap_sql(by):
    return f"""
with t as (select distinct l_suppkey as id, l_partkey as topic from lineitem),
p as (select a.s_suppkey as id, b.s_suppkey as other from supplier a join supplier b on a.s_suppkey <> b.s_suppkey),
c as (select p.id, p.other, count(y.topic) as shared from p left join t x on x.id = p.id left join t y on y.id = p.other and y.topic = x.topic group by 1, 2)
select id, other, shared from c qualify row_number() over (partition by id order by {by}, {draw('7', 'other')}, other) = 1
"""


@query("least_overlap", overlap_sql("shared"))
def least_overlap(spark, sf_dir):
    """Of all other suppliers the one that shares fewest parts."""
    return perturb.overlap_partner(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), brands(spark, sf_dir))


@query("same_domain_partner", overlap_sql("shared desc"))
def same_domain_partner(spark, sf_dir):
    """Of all other suppliers the one that shares most parts."""
    return perturb.overlap_partner(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), brands(spark, sf_dir), most=True)


QUADS = S + f"""
, w as (select doc_id, string_split(text, ' ') as w from documents), p as (select doc_id, w, list_position(list_transform(w, lambda x: x in ({KEYS})), true) as pos from w),
c as (select doc_id, array_to_string(list_transform(w, lambda x, i: case when i = pos then {CASE} else x end), ' ') as t from p where pos > 0),
a as (select doc_id, text, array_to_string(list_concat(s[1:1], list_reverse(s[2:-2]), s[-1:]), ' ') as t from s where len(s) >= 4),
b as (select doc_id, array_to_string(k, ' ') as t from (select doc_id, s, list_filter(s, lambda x: not contains(x, 'th')) as k from s) where len(k) > 0 and len(k) < len(s))
select doc_id, unnest([4, 3, 2, 1]) as level, unnest([md5(a.text), md5(a.t), md5(b.t), md5(c.t)]) as digest from a join b using (doc_id) join c using (doc_id)
"""


@query("quadruplets", QUADS)
def quadruplets(spark, sf_dir):
    """The four texts of every document that has one at each level."""
    d, text = docs(spark, sf_dir), F.col("text")
    made = {4: text, 3: perturb.reorder(text), 2: perturb.delete_sentence(text, F.lit("th")), 1: perturb.replace_relation(text, SWAPS)}
    return perturb.quadruplets({k: d.select("doc_id", c.alias("text")) for k, c in made.items()}, "doc_id").select("doc_id", "level", hashed(F.col("text")).alias("digest"))


@query("domain_union", "select 'labels.' || n as domain, count(*) as n from (select case when quality = 1 then 'good' else 'bad' end as n from labels) group by 1 union all select 'documents.' || lang, count(*) from documents group by lang")
def domain_union(spark, sf_dir):
    a = read(spark, sf_dir, "labels").select(F.concat(F.lit("labels."), F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("domain"))
    return a.unionByName(docs(spark, sf_dir).select(F.concat(F.lit("documents."), "lang").alias("domain"))).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
