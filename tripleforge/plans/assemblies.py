"""Queries that put whole data sets together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import inflection
from ..operators import assemble, perturb
from .language import FORMS, FOUND, VERBS
from .perturbation import IMPORTANCE, S, distorted, docs, draw, hashed
from .registry import query

PATTERN, ENTITY, LEAST = "[A-Z][a-z]{3,}", "[A-Z][a-z]{4,}", 10
NONE = ", ".join(f"'{w}'" for w in assemble.NO_NAMES)
KEPT = ", ".join(f"'{w}'" for w in perturb.KEPT_VERBS)


def _once(x):
    """SQL of a list without later repetitions."""
    return f"list_filter({x}, lambda w, i: list_position({x}, w) = i)"


def _words(x):
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"


def _kept(k):
    return f"case when len({k}) < len(s) and len({k}) >= 2 and {_words(f'''array_to_string({k}, ' ')''')} >= {LEAST} then array_to_string({k}, ' ') end"


PAIRED = f"""
select row_number() over (order by kind, doc_id) - 1 as pair_id, EXTRA md5(one) as response1, md5(two) as response2, case when kind in ('similar', 'correct_paraphrase') then 1 else 0 end as label, kind as perturbation_type, 'NAME' as dataset_name
from made where two is not null and one <> two
"""
PARAGRAPHS = S + f"""
, a as (select doc_id, text, s, {draw('17', 'doc_id')} as h, list_transform(s, lambda x: list_filter(regexp_extract_all(regexp_replace(x, '^\\S+\\s*', ''), '{PATTERN}'), lambda w: length(w) > 3 and w not in ({NONE}))) as n0 from s),
b as (select *, list_transform(n0, lambda l: {_once('l')}) as n from a),
c as (select *, list_filter(flatten(n[2:]), lambda w: not list_contains(n[1], w)) as later,
  list_filter(s, lambda x, i: len(n[i]) >= 2 and len(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: length(w) > 3 and w not in ({KEPT}))) > 0) as links from b where len(s) >= 3),
nd as (select doc_id, text, s, list_filter(s, lambda x: not contains(x, later[h % len(later) + 1])) as k from c where len(later) > 0),
ed as (select doc_id, text, s, list_filter(s, lambda x: x <> links[h % len(links) + 1]) as k from c where len(links) > 0),
v(word, other) as (values {FORMS}), u as (select doc_id, i, x from (select doc_id, unnest(range(len(s))) as i, unnest(s) as x from s)),
hit as (select doc_id, i, regexp_extract(x, '{FOUND}', 1) as a, regexp_extract(x, '{FOUND}', 2) as w, regexp_extract(x, '{FOUND}', 3) as b from u
  where regexp_matches(x, '{FOUND}') and len(regexp_extract_all(x, '{PATTERN}')) >= 1 qualify row_number() over (partition by doc_id order by i) = 1),
new as (select doc_id, hit.i, a || case when left(w, 1) <> lower(left(w, 1)) then upper(left(other, 1)) || substr(other, 2) else other end || b as x from hit join v on v.word = lower(w)),
er as (select new.doc_id, string_agg(case when u.i = new.i then new.x else u.x end, ' ' order by u.i) as x from u join new using (doc_id) group by 1),
d as (select doc_id, lang, source, text, {draw('11', 'doc_id')} as h from documents),
nr as (select *, row_number() over w as nth, lead(doc_id) over w as other, lead(text) over w as theirs, lead(source) over w as title from d window w as (partition by lang order by h, doc_id)),
r as (select doc_id, text, array_to_string(list_concat(s[1:1], list_reverse(s[2:-2]), s[-1:]), ' ') as x from s where len(s) >= 4),
made as (select 'node_replacement' as kind, doc_id, text as one, theirs as two from nr where nth % 2 = 1 and other is not null and source <> title
  union all select 'node_deletion', doc_id, text, {_kept('k')} from nd union all select 'edge_deletion', doc_id, text, {_kept('k')} from ed
  union all select 'edge_replacement', doc_id, text, x from er join documents using (doc_id) union all select 'similar', doc_id, text, case when {_words('x')} >= {LEAST} then x end from r)
""" + PAIRED.replace("EXTRA", "").replace("NAME", "paragraphs")


@query("paragraph_pairs", PARAGRAPHS)
def paragraph_pairs(spark, sf_dir):
    """All pairs that the five generators make of the documents as paragraphs of articles."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("kind"), "text")
    return assemble.paragraph_pairs(rows, inflection.inflected(VERBS), pattern=PATTERN, least_words=LEAST, at_least=1, finish=hashed)


PARTNERS = f"""
with o as (select doc_id, lang, source, row_number() over (order by {draw('7', 'doc_id')}, doc_id) - 1 as nth, count(*) over () as n from documents),
p as (select a.doc_id, b.doc_id as other, row_number() over (partition by a.doc_id order by (b.nth - a.nth + a.n) % a.n) as k from o a join o b on a.lang <> b.lang and a.source <> b.source)
"""


def topics(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("topic")).unionByName(d.select(F.col("doc_id").alias("id"), F.col("source").alias("topic")))


@query("disjoint_partner", PARTNERS + "select doc_id as id, other, true as disjoint from p where k = 1")
def disjoint_partner(spark, sf_dir):
    """For each document the next in hash order of another language and another source."""
    return assemble.disjoint_partner(docs(spark, sf_dir).select(F.col("doc_id").alias("id")), topics(spark, sf_dir))


CLAUSE = "(?s)^([A-Za-z]+) ([a-z]+) ([a-z]+)(.*)$"


def _first(text, what, by):
    """SQL of the first occurrence replaced."""
    return f"case when {what} is not null and {by} is not null and strpos({text}, {what}) > 0 then left({text}, strpos({text}, {what})::int - 1) || {by} || substr({text}, strpos({text}, {what})::int + length({what})) else {text} end"


def _entities(x):
    return f"regexp_extract_all({x}, '{ENTITY}')"


ANSWERS = PARTNERS.replace("with o as", S.strip() + ", o as") + f"""
, e as (select doc_id, {_once(_entities('text'))} as own from documents),
q as (select d.doc_id, d.text, d.lang, d.source, s.s, e.own, list_filter(t.own, lambda w: not list_contains(e.own, w)) as fresh, x.text as theirs
  from documents d join s using (doc_id) join e using (doc_id) left join p on p.doc_id = d.doc_id and p.k = 1 left join documents x on x.doc_id = p.other left join e t on t.doc_id = p.other),
h1 as (select *, {_first('text', 'own[1]', 'fresh[1]')} as t1 from q), h2 as (select *, {_first('t1', 'own[2]', 'fresh[2]')} as t2 from h1),
d as (select doc_id, text as old, {_first('t2', 'own[3]', 'fresh[3]')} as text from h2 where len(own) > 0)
""" + distorted("text", draw("19", "doc_id"), 1, False, perturb.COMPOUND_FACTORS).replace("made as", "numbers as") + f"""
, i0 as (select *, list_transform(s, lambda x: case when regexp_matches(x, '{CLAUSE}') then regexp_extract(x, '{CLAUSE}', 3) || ' ' || regexp_extract(x, '{CLAUSE}', 2) || ' ' || regexp_extract(x, '{CLAUSE}', 1) || regexp_extract(x, '{CLAUSE}', 4) end) as inv from q),
i1 as (select *, list_position(list_transform(inv, lambda x: x is not null), true) as a from i0), i2 as (select *, list_position(list_transform(s, lambda x, i: i <> a and len({_entities('x')}) > 0), true) as b from i1 where a > 0),
i3 as (select doc_id, text, s, array_to_string(list_transform(s, lambda x, i: case when i = a then inv[i] when i = b then {_first('x', f"{_entities('x')}[1]", 'fresh[1]')} else x end), ' ') as x from i2),
f0 as (select *, list_transform(s, lambda x: ({IMPORTANCE})::double) as w from q where len(s) > 1), f1 as (select *, list_position(w, list_max(w)) as d1 from f0),
f2 as (select *, list_transform(w, lambda x, i: case when i = d1 then -1 else x end) as w2 from f1), f3 as (select *, case when len(s) >= 5 then list_position(w2, list_max(w2)) else 0 end as d2 from f2),
f4 as (select doc_id, text, fresh, array_to_string(list_filter(s, lambda x, i: i <> d1 and i <> d2), ' ') as x from f3),
made as (select 'entity_hallucination' as kind, doc_id, old as one, coalesce(new, text) as two from numbers union all select 'relation_inversion', doc_id, text, case when x <> array_to_string(s, ' ') then x end from i3
  union all select 'context_ignoring', doc_id, text, case when {_words('theirs')} >= {LEAST} then theirs end from q union all select 'fact_omission', doc_id, text, case when {_words('x')} >= {LEAST // 2} then {_first('x', f"{_entities('x')}[1]", 'fresh[1]')} end from f4
  union all select 'correct_paraphrase', doc_id, text, array_to_string(list_concat(s[1:1], list_reverse(s[2:-2]), s[-1:]), ' ') from s where len(s) >= 4)
""" + PAIRED.replace("EXTRA", "source as question, lang as context,").replace("NAME", "answers").replace("from made", "from made join (select doc_id, source, lang from documents) using (doc_id)")


def inverted(sentences):
    """Of each sentence that begins with three words, the first and the third exchanged."""
    part = lambda x, k: F.regexp_extract(x, CLAUSE, k)
    return F.transform(sentences, lambda x: F.when(x.rlike(CLAUSE), F.concat(part(x, 3), F.lit(" "), part(x, 2), F.lit(" "), part(x, 1), part(x, 4))))


@query("answer_pairs", ANSWERS)
def answer_pairs(spark, sf_dir):
    """All pairs that the five generators make of the documents as answers, their languages and sources as topics."""
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("question"), F.col("lang").alias("context"), F.col("text").alias("answer"), F.col("lang").alias("decision"))
    return assemble.answer_pairs(rows, topics(spark, sf_dir), lambda x: F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0)), inverted, lambda text, seed: perturb.reorder(text), least_words=LEAST, finish=hashed)
