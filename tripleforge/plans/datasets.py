"""Queries of sources, prompts, relabelled graphs and the building of data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kg, matching, metrics, perturb
from ..sources import extraction, tables
from . import evaluation as ev
from . import graphs
from .perturbation import SWAPS, S, changed, distorted, docs, draw, hashed
from .registry import query, read

# --- sources and extraction


@query(
    "path_metadata",
    """
select event_id, event_type as dataset, 'm_' || user_id % 5 as model, case when event_id % 4 = 3 then 0.0 else event_id % 4 / 2 end::double as temperature from events
""",
)
def path_metadata(spark, sf_dir):
    """Paths of scored files, one an event, taken apart; a folder that is no number counts as 0."""
    e = read(spark, sf_dir, "events")
    folder = F.when(F.col("event_id") % 4 == 3, "notes").otherwise((F.col("event_id") % 4 / 2).cast("string"))
    path = F.concat(F.lit("/data/"), folder, F.lit("/"), "event_type", F.lit("_m_"), F.col("user_id") % 5, F.lit(".csv"))
    return e.select("event_id", *tables.path_metadata(path))


@query("prompt_build", "select c_custkey, 'Extract triples [subject, relation, object] from each text as JSON.' || chr(10) || 'Text 1 (kg_1): ' || c_name || chr(10) || 'Text 2 (kg_2): ' || c_mktsegment as prompt from customer")
def prompt_build(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", extraction.prompt([F.col("c_name"), F.col("c_mktsegment")]).alias("prompt"))


@query("answer_recovery", "select s_suppkey, s_name as s, 'in' as p, n_name as o from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 5 <> 4")
def answer_recovery(spark, sf_dir):
    """Answers that are plain JSON, fenced, or in the middle of talk; every fifth is broken off and gives nothing."""
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    json = F.to_json(F.create_map(F.lit("kg_1"), F.array(F.array("s_name", F.lit("in"), "n_name"))))
    kind = F.col("s_suppkey") % 5
    answer = F.when(kind == 0, json).when(kind == 1, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(kind == 4, F.substring(json, 1, 12)).otherwise(F.concat(F.lit("Here it is: "), json, F.lit(" as asked.")))
    out = rows.select("s_suppkey", F.explode(extraction.recover(answer)["kg_1"]).alias("t"))
    return out.select("s_suppkey", *[F.get("t", F.lit(i)).alias(c) for i, c in enumerate(("s", "p", "o"))])


# --- graphs

MAPPING = ", m as (select distinct pair_id, label, left(label, 2) as anchor from (select pair_id, s as label from kg union all select pair_id, o from kg) where length(label) > 4)"


def mapping(triples):
    labels = triples.select("pair_id", F.explode(F.array("s", "o")).alias("label")).where("length(label) > 4").distinct()
    return labels.withColumn("anchor", F.substring("label", 1, 2))


RELABELLED = graphs.KG + MAPPING + ", t as (select kg.pair_id, side, pos, coalesce(a.anchor, s) as s, p, coalesce(b.anchor, o) as o from kg left join m a on a.pair_id = kg.pair_id and a.label = kg.s left join m b on b.pair_id = kg.pair_id and b.label = kg.o)"


@query("kg_relabel", RELABELLED + " select pair_id, side, pos, s, p, o from t")
def kg_relabel(spark, sf_dir):
    t = graphs.sentences(spark, sf_dir)
    return kg.relabel(t, mapping(t)).select("pair_id", "side", "pos", "s", "p", "o")


@query("kg_contract", RELABELLED + " select pair_id, side, least(s, o) as u, greatest(s, o) as v, arg_min(p, pos) as relation from t group by 1, 2, 3, 4")
def kg_contract(spark, sf_dir):
    t = graphs.sentences(spark, sf_dir)
    return kg.contract(t, mapping(t))


@query("kg_first_seen_nodes", graphs.KG + ", e as (select pair_id, side, s as label, 2 * pos as spot from kg union all select pair_id, side, o, 2 * pos + 1 from kg), f as (select pair_id, side, label, min(spot) as spot from e group by 1, 2, 3) select pair_id, side, label, row_number() over (partition by pair_id, side order by spot) - 1 as id from f")
def kg_first_seen_nodes(spark, sf_dir):
    return kg.first_seen(graphs.sentences(spark, sf_dir))


@query(
    "kg_triple_ids",
    graphs.KG
    + """
, v as (select pair_id, 'entity' as kind, s as label from kg where side = 0 union select pair_id, 'entity', o from kg where side = 0 union select pair_id, 'relation', p from kg where side = 0),
n as (select *, row_number() over (partition by pair_id, kind order by label) - 1 as id from v)
select kg.pair_id, side, pos, coalesce(a.id, 0) as h, coalesce(b.id, 0) as r, coalesce(c.id, 0) as t from kg left join n a on a.pair_id = kg.pair_id and a.kind = 'entity' and a.label = s
  left join n b on b.pair_id = kg.pair_id and b.kind = 'relation' and b.label = p left join n c on c.pair_id = kg.pair_id and c.kind = 'entity' and c.label = o
""",
)
def kg_triple_ids(spark, sf_dir):
    """Both graphs of a pair in the numbers of the first one's vocabulary."""
    t = graphs.sentences(spark, sf_dir)
    return kg.triple_ids(t, kg.vocabulary(t.where("side = 0")))


@query("label_clusters")
def label_clusters(spark, sf_dir):
    return matching.label_clusters(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


# --- evaluation


@query("only_first_strata", ev.S + ev.grid("method") + ev.DECIDED + " select a.method as method1, b.method as method2, a.stratum, count(*) as n from d a join d b on a.pair_id = b.pair_id and a.correct = 1 and b.correct = 0 group by 1, 2, 3")
def only_first_strata(spark, sf_dir):
    rows = ev.long(spark, sf_dir)
    return metrics.only_first_by(metrics.decided(rows, metrics.best_on_grid(rows, ["method"]), ["method"]), ["pair_id"], "stratum")


@query("method_override", ev.S + ", o as (select pair_id, dataset, label, method, case when method = 'hash_score' then (pair_id % 10) / 10.0::double else score end as score from long where method <> 'hash_score' or pair_id % 3 = 0) select method, count(*) as n, round(avg(score), 6) as mean from o group by 1")
def method_override(spark, sf_dir):
    """One method's scores from another table, which lacks two rows of three: methods have counts of their own."""
    rows = ev.long(spark, sf_dir)
    other = ev.scored(spark, sf_dir).where("pair_id % 3 = 0").select("pair_id", (F.col("pair_id") % 10 / 10.0).alias("score"))
    return metrics.override(rows, other, "hash_score", ["pair_id"]).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("joined_scores", "with s as (select event_id % 997 as doc_id, min(value) as value from events where event_id % 997 % 2 = 0 group by 1) select l.doc_id, l.quality, coalesce(value, 0) as value from labels l left join s using (doc_id)")
def joined_scores(spark, sf_dir):
    """Scores with repeated keys joined to labels by the first key that both have; missing ones are 0."""
    scores = read(spark, sf_dir, "events").select((F.col("event_id") % 997).alias("doc_id"), "value").where("doc_id % 2 = 0")
    out = tables.join_scores(read(spark, sf_dir, "labels"), scores, "value", ("pair_id", "doc_id", "id"))
    return out.select("doc_id", "quality", F.coalesce("value", F.lit(0.0)).alias("value"))


@query("first_seen_rows", "select user_id, event_type, arg_min(event_id, ts) as event_id, min(ts) as ts from (select * from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1) group by 1, 2")
def first_seen_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", F.struct("ts", "event_id").alias("place"))
    return metrics.first_seen(rows, ["user_id", "event_type"], "place").drop("place")


# --- data sets

KINDS = {"english": ["the", "and", "that", "with"], "german": ["der", "die", "und", "nicht"], "romance": ["la", "que", "les", "los"]}


def _kind(x):
    held = {k: f"len(list_intersect(list_distinct(regexp_split_to_array(lower({x}), '[^a-z]+')), {v}))" for k, v in KINDS.items()}
    most = f"greatest({', '.join(held.values())})"
    return f"case when {most} = 0 then 'other' " + " ".join(f"when {n} = {most} then '{k}'" for k, n in held.items()) + " end"


@query("paragraph_kind", f"select doc_id, {_kind('text')} as kind from documents")
def paragraph_kind(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", perturb.text_kind(F.col("text"), KINDS, "other").alias("kind"))


@query("first_paragraph", "select doc_id, md5(p) as digest from (select doc_id, list_filter(string_split(text, chr(10))[1:4], lambda x: not regexp_matches(x, '\\[\\[|\\{\\{|==') and len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) between 20 and 400 and length(x) - length(replace(x, '.', '')) >= 2)[1] as p from documents) where p is not null")
def first_paragraph(spark, sf_dir):
    return changed(docs(spark, sf_dir), hashed(perturb.first_paragraph(F.col("text"), least=20)))


@query("node_replacement", f"""
with d as (select doc_id, lang, source, {draw('11', 'doc_id')} as h from documents),
n as (select doc_id, source, row_number() over w as nth, lead(doc_id) over w as other, lead(source) over w as title from d window w as (partition by lang order by h, doc_id))
select doc_id, other from n where nth % 2 = 1 and other is not null and source <> title
""")  # fmt: skip
def node_replacement(spark, sf_dir):
    """Texts of one language two by two, from different sources."""
    return perturb.consecutive(docs(spark, sf_dir).select("doc_id", "lang", "source"), "lang", "source", "doc_id")


@query("edge_deletion", S + ", p as (select doc_id, s, list_position(list_transform(s, lambda x: len(regexp_extract_all(x, '[a-z]{8,}')) >= 2), true) as hit from s where len(s) > 1) select doc_id, md5(array_to_string(list_filter(s, lambda x, i: i <> hit), ' ')) as digest from p where hit > 0")
def edge_deletion(spark, sf_dir):
    return changed(docs(spark, sf_dir), hashed(perturb.delete_linked_sentence(F.col("text"), "[a-z]{8,}")))


ENTITY = "[a-z]{3,}(?:tion|ment|heit|keit)"


@query("entity_pool", f"select entity, count(*) as n from (select unnest(regexp_extract_all(text, '{ENTITY}')) as entity from documents) group by 1")
def entity_pool(spark, sf_dir):
    return perturb.entity_pool(docs(spark, sf_dir), "text", ENTITY)


def swapped(vocabulary, most, source="documents", text="text"):
    """SQL of swapped words: CTEs up to ``w`` and the number of entries, with doc_id, x, n."""
    sql, last = f"w0 as (select *, {text} as x, 0 as n from {source})", 0
    for i, (a, b) in enumerate(vocabulary.items(), 1):
        whole = f"(?is)^(|.*?[^a-z0-9_]){a}($|[^a-z0-9_])"
        sql += f", w{i} as (select * exclude (x, n), case when n < {most} then regexp_replace(x, '{whole}', '\\1{b}\\2') else x end as x, n + (n < {most} and regexp_matches(x, '{whole}'))::int as n from w{last})"
        last = i
    return sql, f"w{last}"


SWAPPED = swapped(SWAPS, 2)


@query("vocabulary_swap", f"with {SWAPPED[0]} select doc_id, md5(x) as digest from {SWAPPED[1]} where n > 0")
def vocabulary_swap(spark, sf_dir):
    return changed(docs(spark, sf_dir), hashed(perturb.swap_words(F.col("text"), SWAPS, 2)))


ONE_SWAPPED = swapped(SWAPS, 1, "made")


@query("factual_corruption", "with d as (select doc_id, text from documents)" + distorted("text", draw("3", "doc_id"), 3) + f", {ONE_SWAPPED[0]} select doc_id, case when new is null then 'entity' else 'number' end as subtype, md5(coalesce(new, x)) as digest from {ONE_SWAPPED[1]} where new is not null or n > 0")
def factual_corruption(spark, sf_dir):
    """Numbers changed, or else a word, and which of the two it was."""
    made = perturb.corrupt(F.col("text"), perturb.draw("3", "doc_id"), SWAPS)
    return docs(spark, sf_dir).select("doc_id", made.alias("m")).where("m is not null").select("doc_id", "m.subtype", hashed(F.col("m.text")).alias("digest"))


@query("changed_until_enough", S + f", h as (select doc_id, list_filter(s, lambda x: not contains(x, 'th')) as k, s from s) select doc_id from h where len(k) > 0 and len(k) < len(s) order by {draw('13', 'doc_id')}, doc_id limit 50")
def changed_until_enough(spark, sf_dir):
    made = docs(spark, sf_dir).select("doc_id", hashed(perturb.delete_sentence(F.col("text"), F.lit("th"))).alias("made"))
    return perturb.until_enough(made, "made", 50, "doc_id").select("doc_id")


@query("papers", S + ", w as (select doc_id, s, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from s) select doc_id, md5(array_to_string(w[1:300], ' ')) as digest from w where len(w) >= 30 and len(s) >= 2")
def papers(spark, sf_dir):
    return perturb.papers(docs(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", hashed(F.col("context")).alias("digest"))
