"""Queries that read and write files, join and lay out scores, and assemble data sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import perturb
from ..sources import storage, tables
from .datasets import swapped
from .perturbation import SWAPS, S, brands, changed, distorted, docs, draw, hashed, overlap_sql
from .registry import query, read

# --- files


@query("csv_round_trip", "select s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) as s_acctbal, case when s_suppkey % 4 = 0 then '' else 'say \"x, y\"' end as note from supplier")
def csv_round_trip(spark, sf_dir):
    """Suppliers written as CSV, appended to, and read as text with empty cells and by a schema."""
    note = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise('say "x, y"')
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"), note.alias("note"))
    path = storage.new_path(spark)
    tables.write_csv(rows.where("s_suppkey % 2 = 0"), path)
    tables.write_csv(rows.where("s_suppkey % 2 = 1"), path, append=True)
    text = tables.read_csv(spark, path, keep_empty=True).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "note")
    typed = tables.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double, note string").drop("note")
    return typed.join(text, "s_suppkey")


@query("scored_tree", "select event_id, round(value, 3) as value, case event_id % 3 when 0 then 0.0 when 1 then 0.5 else 0.0 end::double as temperature from events")
def scored_tree(spark, sf_dir):
    """Scored files in folders named by a temperature, one of them by a word, read as one table."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.round("value", 3).alias("value"))
    path = storage.new_path(spark)
    for k, folder in enumerate(("0", "0.5", "notes")):
        tables.write_csv(e.where(F.col("event_id").cast("long") % 3 == k), f"{path}/{folder}")
    return tables.read_scored(spark, path, ["value"], line_breaks=False).select(F.col("event_id").cast("long").alias("event_id"), "value", "temperature")


@query("file_base_names", "select user_id, event_type as name from events group by all")
def file_base_names(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    end = F.when(F.col("user_id") % 3 == 0, "_alpha_0p5_results.csv").when(F.col("user_id") % 3 == 1, "_results.csv").otherwise(".csv")
    return rows.select("user_id", tables.base_name(F.concat(F.lit("/d/x/"), "event_type", end)).alias("name"))


@query("fallback_source", "select count(*) as n from region")
def fallback_source(spark, sf_dir):
    """The first of three sources that is there."""
    attempts = [lambda: spark.read.parquet(f"{sf_dir}/none.parquet"), lambda: spark.read.csv(f"{sf_dir}/none"), lambda: read(spark, sf_dir, "region")]
    return tables.first_source(attempts).agg(F.count(F.lit(1)).alias("n"))


# --- scores


@query("scores_keep_first", "select l.doc_id, s.value from labels l left join (select event_id % 997 as doc_id, arg_min(value, event_id) as value from events where event_id % 997 % 2 = 0 group by 1) s using (doc_id)")
def scores_keep_first(spark, sf_dir):
    """Scores whose key is ``id`` joined to the pairs' ``pair_id``; of repeated keys the first row stays."""
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 997).alias("id"), "event_id", "value").where("id % 2 = 0")
    pairs = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair_id"))
    return tables.join_scores(pairs, e, "value", order=["event_id"]).select(F.col("pair_id").alias("doc_id"), "value")


@query("scores_by_place", "with a as (select doc_id, row_number() over (order by doc_id) as n from labels), b as (select value, row_number() over (order by event_id) as n from events where event_id % 30 = 0) select doc_id, value from a left join b using (n)")
def scores_by_place(spark, sf_dir):
    """Scores without a key joined by their place; pairs beyond the scores have none."""
    scores = read(spark, sf_dir, "events").where("event_id % 30 = 0").select(F.col("event_id").alias("line"), "value")
    return tables.join_scores(read(spark, sf_dir, "labels").select("doc_id"), scores, "value", order=["line"], pair_order=["doc_id"])


@query("alpha_split", "select * from (select vec_id, alpha, case when (vec_id + (alpha * 10)::int) % 4 = 0 then null else round(alpha * vec_id, 3) end as score from embeddings, (select unnest([0.0, 0.5, 1.0]::double[]) as alpha)) where score is not null")
def alpha_split(spark, sf_dir):
    """A wide table of scores as rows by alpha, without missing ones."""
    e, columns = read(spark, sf_dir, "embeddings").select("vec_id"), {"alpha_0.0": 0.0, "alpha_0.5": 0.5, "alpha_1.0": 1.0}
    wide = {c: F.when((F.col("vec_id") + int(a * 10)) % 4 != 0, F.round(F.lit(a) * F.col("vec_id"), 3)) for c, a in columns.items()}
    return tables.split_by(e.withColumns(wide), ["vec_id"], columns)


TYPES = ["view", "purchase", "never", "click"]


@query("pivot_reindexed", "with o as (select unnest(['view', 'purchase', 'never', 'click']) as event_type) select event_type, " + ", ".join(f"nullif(count(*) filter (u = {k}), 0) as k{k}" for k in range(3)) + " from o left join (select event_type, user_id % 3 as u from events) using (event_type) group by 1")
def pivot_reindexed(spark, sf_dir):
    """Counts laid out by stated rows and columns; a row that the table lacks is null."""
    n = read(spark, sf_dir, "events").groupBy("event_type", F.concat(F.lit("k"), F.col("user_id") % 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return tables.pivot_reindexed(n, "event_type", "k", "n", TYPES, ["k0", "k1", "k2"])


@query("ordered_rows", "select event_type, user_id % 5 as u, count(*) as n from events where event_type in ('view', 'purchase', 'click') group by 1, 2")
def ordered_rows(spark, sf_dir):
    """Rows in a stated order of their type; other types are dropped."""
    n = read(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    return tables.ordered_by(n, {"event_type": TYPES}).select("event_type", "u", "n")


# --- data sets


@query("standard_pairs", """
with p as (select a.text as x, b.text as y, case when a.turn % 3 = 0 then null else a.turn % 3 - 1 end as l, a.conv_id as c, a.turn as t from conversations a join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn)
select row_number() over (order by c, t) - 1 as pair_id, md5(x) as response1, md5(y) as response2, l as label, case l when 0 then 'different' when 1 then 'same' else 'unknown' end as perturbation_type, 'talk' as dataset_name from p where l is not null order by c, t limit 40
""")  # fmt: skip
def standard_pairs(spark, sf_dir):
    """The first forty pairs with a label, from columns of other names."""
    c = read(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    rows = c.select("conv_id", "turn", F.col("text").alias("sentence1")).join(b, ["conv_id", "turn"])
    rows = rows.withColumn("gold", F.when(F.col("turn") % 3 != 0, (F.col("turn") % 3 - 1).cast("string")))
    out = tables.standardize(rows, {"response1": ["text1", "sentence1"], "response2": ["text2", "sentence2"], "label": ["label", "gold"]}, {0: "different", 1: "same"}, "talk", 40, ["conv_id", "turn"])
    return out.withColumns({k: hashed(F.col(k)) for k in ("response1", "response2")})


@query("label_value_counts", "select quality, count(*) as n from labels group by 1")
def label_value_counts(spark, sf_dir):
    return tables.label_counts(read(spark, sf_dir, "labels"), "quality")


@query("united_domains", "with u as (select 'a' as domain, doc_id as id from labels union all select 'b', item_id from benchmark) select domain, id, row_number() over (order by domain, id) - 1 as pair_id from u")
def united_domains(spark, sf_dir):
    """Rows of two domains under one numbering."""
    a = read(spark, sf_dir, "labels").select(F.lit("a").alias("domain"), F.col("doc_id").alias("id"))
    return storage.ordinals(a.unionByName(read(spark, sf_dir, "benchmark").select(F.lit("b").alias("domain"), F.col("item_id").alias("id"))), ["domain", "id"], "pair_id")


REORDERED = "case when len(s) >= 4 then array_to_string(list_concat(s[1:1], list_reverse(s[2:-2]), s[-1:]), ' ') end"
WORDS, LAST = swapped(SWAPS, 2, "s")


@query("composite_paraphrase", S + f", {WORDS}, m as (select doc_id, {draw('21', 'doc_id')} % 2 as turn, {REORDERED} as a, case when n > 0 then x end as b from {LAST}) select doc_id, md5(case turn when 0 then coalesce(a, b) else coalesce(b, a) end) as digest from m where coalesce(a, b) is not null")
def composite_paraphrase(spark, sf_dir):
    """Reordered sentences or swapped words, whichever the hash says first; the other where that fails."""
    made = perturb.first_success(perturb.draw("21", "doc_id"), [perturb.reorder(F.col("text")), perturb.swap_words(F.col("text"), SWAPS)])
    return changed(docs(spark, sf_dir), hashed(made))


@query("entity_hallucination", "with d as (select doc_id, text as old, list_sort(list_distinct(regexp_extract_all(text, '[a-z]{9,}'))) as e, " + "replace(" * 3 + "text" + "".join(f", coalesce(list_sort(list_distinct(regexp_extract_all(text, '[a-z]{{9,}}')))[{k}], ''), 'Zanzibar')" for k in (1, 2, 3)) + " as text from documents)" + distorted("text", draw("5", "doc_id"), 1, False, perturb.COMPOUND_FACTORS) + "select doc_id, md5(coalesce(new, text)) as digest from made where coalesce(new, text) <> old")
def entity_hallucination(spark, sf_dir):
    """Up to three long words replaced by a foreign name, and one number changed."""
    entities = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0))))
    made = perturb.hallucinate(F.col("text"), entities, F.lit("Zanzibar"), perturb.draw("5", "doc_id"))
    return changed(docs(spark, sf_dir), hashed(made))


@query("span_inversion", "select s_suppkey, 'In ' || n_name || ' ' || s_name || ' delivers.' as inverted from supplier join nation on s_nationkey = n_nationkey")
def span_inversion(spark, sf_dir):
    """Subject and object exchanged in a sentence."""
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    text = F.concat(F.lit("In "), "s_name", F.lit(" "), "n_name", F.lit(" delivers."))
    return rows.select("s_suppkey", perturb.swap_spans(text, F.col("s_name"), F.col("n_name")).alias("inverted"))


def replaced_sql(by):
    return f"with p as ({overlap_sql(by)}), e as (select l_suppkey as id, min(p_name || '#' || l_partkey) as entity from lineitem join part on l_partkey = p_partkey group by 1) select p.id, 'We buy ' || b.entity || '.' as text from p join e a on a.id = p.id join e b on b.id = p.other where a.entity <> b.entity"


def replaced(spark, sf_dir, most):
    """A sentence that names an entity of a supplier, with that of a partner in its place.

    Entities are numbered in order, so that the first of an item is the least of numbers, not of texts, which would be sorted.
    """
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit("#"), "p_partkey").alias("entity")).where("entity is not null")
    part = storage.ordinals(part, ["entity", "l_partkey"], "nth", storage.written)
    least = read(spark, sf_dir, "lineitem").join(part.select("l_partkey", "nth"), "l_partkey").groupBy(F.col("l_suppkey").alias("id")).agg(F.min("nth").alias("nth"))
    entity = storage.written(least.join(part.select("nth", "entity"), "nth").select("id", "entity"))  # a row an item, used for it and for its partner
    partner = perturb.overlap_partner(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), brands(spark, sf_dir), most=most)
    rows = partner.join(entity, "id").join(entity.select(F.col("id").alias("other"), F.col("entity").alias("theirs")), "other")
    text = F.concat(F.lit("We buy "), "entity", F.lit("."))
    return rows.where("entity <> theirs").select("id", perturb.replace_entities(text, F.array("entity"), F.col("theirs")).alias("text"))


@query("replacement_entity", replaced_sql("shared"))
def replacement_entity(spark, sf_dir):
    """The entity of the supplier that shares fewest parts."""
    return replaced(spark, sf_dir, False)


@query("entity_substitution", replaced_sql("shared desc"))
def entity_substitution(spark, sf_dir):
    """The entity of the supplier that shares most parts."""
    return replaced(spark, sf_dir, True)


GENERATED = f"""
, m as (select doc_id, 'reorder' as k, text, {REORDERED} as made from s union all
  select doc_id, 'deletion', text, case when len(f) > 0 and len(f) < len(s) then array_to_string(f, ' ') end from (select *, list_filter(s, lambda x: not contains(x, 'th')) as f from s))
select row_number() over (order by doc_id, k) - 1 as pair_id, doc_id, md5(text) as response1, md5(made) as response2, 0 as label, k as perturbation_type from m where made is not null
"""


@query("contextual_pairs", S + GENERATED)
def contextual_pairs(spark, sf_dir):
    """All texts that two generators change, with what they made, numbered."""
    d, text = docs(spark, sf_dir).select("doc_id", "text"), F.col("text")
    out = perturb.pair_table({"reorder": d.withColumn("made", perturb.reorder(text)), "deletion": d.withColumn("made", perturb.delete_sentence(text, F.lit("th")))}, "doc_id")
    return out.withColumns({k: hashed(F.col(k)) for k in ("response1", "response2")})
