"""Queries of changes that need grammar: verbs in their forms, and synonyms gated by tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import inflection
from ..operators import perturb, tagging
from .perturbation import S, changed, docs, hashed
from .registry import query

#: Words of the synthetic texts that have what looks like forms, and the verbs put in their place.
VERBS = {"nd": "say", "es": "carry", "er": "win", "an": "stop"}
FORMS = """
  ('nd', 'say'), ('nds', 'says'), ('nded', 'said'), ('nding', 'saying'), ('es', 'carry'), ('eses', 'carries'), ('esed', 'carried'), ('esing', 'carrying'),
  ('er', 'win'), ('ers', 'wins'), ('ered', 'won'), ('ering', 'winning'), ('an', 'stop'), ('ans', 'stops'), ('aned', 'stopped'), ('aning', 'stopping')
"""
FOUND = "(?is)^(|.*?[^a-z0-9_])(nd|nds|nded|nding|es|eses|esed|esing|er|ers|ered|ering|an|ans|aned|aning)($|[^a-z0-9_].*)$"


@query("verb_replacement", S + f"""
, v(word, other) as (values {FORMS}), u as (select doc_id, i, x from (select doc_id, unnest(range(len(s))) as i, unnest(s) as x from s)),
h as (select doc_id, i, regexp_extract(x, '{FOUND}', 1) as a, regexp_extract(x, '{FOUND}', 2) as w, regexp_extract(x, '{FOUND}', 3) as b from u
  where regexp_matches(x, '{FOUND}') and len(regexp_extract_all(x, '[A-Z][a-z]+')) >= 1 qualify row_number() over (partition by doc_id order by i) = 1),
n as (select doc_id, h.i, a || case when left(w, 1) <> lower(left(w, 1)) then upper(left(other, 1)) || substr(other, 2) else other end || b as x from h join v on v.word = lower(w))
select n.doc_id, md5(string_agg(case when u.i = n.i then n.x else u.x end, ' ' order by u.i)) as digest from u join n using (doc_id) group by 1
""")  # fmt: skip
def verb_replacement(spark, sf_dir):
    """The first word that is a verb's form, in the same form of another verb."""
    made = perturb.replace_verb(F.col("text"), inflection.inflected(VERBS), phrase="[A-Z][a-z]+", at_least=1)
    return changed(docs(spark, sf_dir), hashed(made))


def ending(word):
    """The tag of a word of the sample: by its end."""
    return F.when(word.rlike("^[a-z].*(tion|ment)$"), "NN").when(word.rlike("^[a-z].*ble$"), "JJ").when(word.rlike("^[a-z].*ly$"), "RB").when(word.rlike("^[A-Z]"), "NNP").otherwise("XX")


def lexicon(word: str, kind: str) -> str | None:
    """Words put together by rule, in the place of a dictionary."""
    return {"noun": f"{word}s", "adjective": f"un{word}", "adverb": f"most{word}"}[kind]


def tagger(spark, sf_dir):
    words = docs(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), F.lit(0))).alias("pos", "word"))
    return tagging.train(words.select(F.col("doc_id").alias("sentence"), "pos", "word", ending(F.col("word")).alias("tag")))


SYNONYMS = """
with t as (select doc_id, regexp_extract_all(text, '\\p{L}+(?:[''’-]\\p{L}+)*|[^\\p{L}]') as t from documents),
n as (select doc_id, t, list_transform(t, lambda w: case when length(w) < 4 or w = 'stable' then w when regexp_matches(w, '^[a-z].*(tion|ment)$') then w || 's' when regexp_matches(w, '^[a-z].*ble$') then 'un' || w when regexp_matches(w, '^[a-z].*ly$') then 'most' || w else w end) as n from t)
select doc_id, md5(array_to_string(n, '')) as digest from n where len(list_filter(list_zip(t, n), lambda p: p[1] <> p[2])) >= 3
"""


@query("synonym_paraphrase", SYNONYMS)
def synonym_paraphrase(spark, sf_dir):
    """All nouns, adjectives and adverbs, as a tagger trained on the table's words tells them, with a lexicon's synonyms."""
    made = tagging.synonyms(F.col("text"), F.col("doc_id"), tagger(spark, sf_dir), lexicon, stop=["stable"], most=1_000_000)
    return changed(docs(spark, sf_dir), hashed(made))


@query("tag_counts", """
with w as (select unnest(regexp_extract_all(text, '\\p{L}+(?:[''’-]\\p{L}+)*')) as w from documents)
select case when regexp_matches(w, '^[a-z].*(tion|ment)$') then 'NN' when regexp_matches(w, '^[a-z].*ble$') then 'JJ' when regexp_matches(w, '^[a-z].*ly$') then 'RB' when regexp_matches(w, '^[A-Z]') then 'NNP' else 'XX' end as tag, count(*) as n from w group by 1
""")  # fmt: skip
def tag_counts(spark, sf_dir):
    """How many words of the documents the tagger gives each tag."""
    return tagging.tag_counts(docs(spark, sf_dir), "text", tagger(spark, sf_dir))
