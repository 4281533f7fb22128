"""Queries over knowledge graphs: one triple a sentence of every document, or of customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import once
from ..operators import kg, ranking, similarity
from ..sources import extraction
from .registry import query, read


def as_triples(texts):
    """pair_id, side, pos, s, p, o of texts (pair_id, side, text): a triple is a sentence's first, second and last word."""
    ends = lambda w: F.when(F.size(w) >= 3, F.struct(F.get(w, F.lit(0)).alias("s"), F.get(w, F.lit(1)).alias("p"), F.element_at(w, -1).alias("o")))
    triples = F.transform(F.split(F.lower("text"), r"[.\n]+"), lambda x: once(F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0)), ends))
    return texts.select("pair_id", "side", F.posexplode(triples).alias("pos", "t")).where("t is not null").select("pair_id", "side", "pos", "t.s", "t.p", "t.o")


def sentences(spark, sf_dir):
    """The triples of all documents; documents 2k and 2k + 1 are a pair."""
    return as_triples(read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair_id"), (F.col("doc_id") % 2).cast("int").alias("side"), "text"))


KG = """
with x as (select doc_id // 2 as pair_id, (doc_id % 2)::int as side, unnest(range(len(a)))::int as pos, unnest(a) as x from (select doc_id, regexp_split_to_array(lower(text), '[.\\n]+') as a from documents)),
w as (select *, regexp_extract_all(x, '[a-z]+') as w from x),
kg as (select pair_id, side, pos, w[1] as s, w[2] as p, w[-1] as o from w where len(w) >= 3)
"""
EDGES = ", e as (select pair_id, side, least(s, o) as u, greatest(s, o) as v, arg_max(p, pos) as relation from kg group by 1, 2, 3, 4)"


def _wl(levels: int, name: str = "", edges: str = "e", label: str = "u") -> str:
    """CTEs of the kernel over the given edges; the last, ``t`` and the name, has a pair's three sums."""
    b, c, t, l = (f"{x}{name}" for x in ("b", "c", "t", "l"))
    sql = f", {b} as (select pair_id, side, u, v from {edges} union select pair_id, side, v, u from {edges}), {l}0 as (select distinct pair_id, side, u, {label} as label from {b})"
    for k in range(1, levels + 1):
        sql += f", {l}{k} as (select a.pair_id, a.side, a.u, md5(any_value(a.label) || '#' || string_agg(n.label, ',' order by n.label)) as label from {l}{k - 1} a join {b} b using (pair_id, side, u) join {l}{k - 1} n on n.pair_id = b.pair_id and n.side = b.side and n.u = b.v group by 1, 2, 3)"
    parts = " union all ".join(f"select {k} as h, pair_id, label, sum((side = 0)::int) as c0, sum((side = 1)::int) as c1 from {l}{k} group by 1, 2, 3" for k in range(levels + 1))
    return sql + f", {c} as ({parts}), {t} as (select pair_id, sum(c0 * c1) as k01, sum(c0 * c0) as k00, sum(c1 * c1) as k11 from {c} group by 1)"


WL = "select pair_id, round(case when k00 > 0 and k11 > 0 then k01 / sqrt(k00::double * k11::double) end, 6) as wl from (select distinct doc_id // 2 as pair_id from documents) left join t using (pair_id)"


def wl(spark, sf_dir, iterations):
    pairs = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair_id"))
    return kg.wl_grouped(sentences(spark, sf_dir), pairs, iterations).withColumn("wl", F.round("wl", 6))


@query("wl_kernel_h2", KG + EDGES + _wl(2) + WL)
def wl_kernel_h2(spark, sf_dir):
    """The kernel over the first three levels."""
    return wl(spark, sf_dir, 2)


@query("wl_kernel", KG + EDGES + _wl(5) + WL)
def wl_kernel(spark, sf_dir):
    """The kernel over all six levels."""
    return wl(spark, sf_dir, 5)


@query("kg_undirected_edges", KG + EDGES + "select * from e")
def kg_undirected_edges(spark, sf_dir):
    return kg.edges(sentences(spark, sf_dir))


@query("kg_vocabulary", KG + ", v as (select pair_id, 'entity' as kind, s as label from kg union select pair_id, 'entity', o from kg union select pair_id, 'relation', p from kg) select *, row_number() over (partition by pair_id, kind order by label) - 1 as id from v")
def kg_vocabulary(spark, sf_dir):
    return kg.vocabulary(sentences(spark, sf_dir))


@query("kg_node_counts", KG + EDGES + "select pair_id, side, count(distinct n) as nodes, count(distinct (u, v)) as edges, count(distinct relation) as relations from (select *, unnest([u, v]) as n from e) group by 1, 2")
def kg_node_counts(spark, sf_dir):
    return kg.node_counts(sentences(spark, sf_dir))


@query("kg_normal_labels", "select p_partkey, trim(regexp_replace(lower(replace(replace(p_name || '__' || p_type, ' ', '_'), '_', ' ')), ' {2,}', ' ', 'g')) as label from part")
def kg_normal_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", kg.normal_label(F.replace(F.concat("p_name", F.lit("__"), "p_type"), F.lit(" "), F.lit("_"))).alias("label"))


PLACES = ", ".join(f"'{x}'" for x in kg.PLACEHOLDERS)


NAMES = "case c_custkey % 7 when 0 then ' Entity' || c_custkey % 5 when 1 then 'relation' when 2 then null else c_name end"


@query("kg_valid_triples", f"with t as (select c_custkey, {NAMES} as s, case when c_custkey % 3 = 0 then 'relation' else c_mktsegment end as p, n_name as o from customer join nation on c_nationkey = n_nationkey) select * from t where s is not null and lower(trim(s)) not in ({PLACES}) and lower(trim(o)) not in ({PLACES})")
def kg_valid_triples(spark, sf_dir):
    """Tokens of the prompt are rejected as subjects and objects, not as relations."""
    rows = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    k = F.col("c_custkey") % 7
    s = F.when(k == 0, F.concat(F.lit(" Entity"), F.col("c_custkey") % 5)).when(k == 1, "relation").when(k == 2, None).otherwise(F.col("c_name"))
    rows = rows.select("c_custkey", s.alias("s"), F.when(F.col("c_custkey") % 3 == 0, "relation").otherwise(F.col("c_mktsegment")).alias("p"), F.col("n_name").alias("o"))
    return rows.where(kg.valid(F.col("s"), F.col("p"), F.col("o")))


HOLES = "select user_id as pair_id, (event_id % 2)::int as side, event_id as pos, case when event_id % 5 = 0 then null else event_type end as s, 'did' as p, case when event_id % 7 = 0 then null else 'User ' || user_id % 10 end as o from events"


@query("kg_edges_with_holes", f"with h as ({HOLES}) select pair_id, side, least(lower(s), lower(o)) as u, greatest(lower(s), lower(o)) as v, arg_max(p, pos) as relation from h where s is not null and o is not null group by 1, 2, 3, 4")
def kg_edges_with_holes(spark, sf_dir):
    """Triples without a subject or an object are no edges."""
    e = read(spark, sf_dir, "events")
    s, o = F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_type")), F.when(F.col("event_id") % 7 == 0, None).otherwise(F.concat(F.lit("User "), F.col("user_id") % 10))
    return kg.edges(e.select(F.col("user_id").alias("pair_id"), (F.col("event_id") % 2).cast("int").alias("side"), F.col("event_id").alias("pos"), s.alias("s"), F.lit("did").alias("p"), o.alias("o")))


@query("kg_light_strip", "select s_suppkey, s_name as s, 'in' as p, '' as o from supplier")
def kg_light_strip(spark, sf_dir):
    t = kg.light(F.array(F.concat(F.lit("  "), "s_name", F.lit(" ")), F.lit("in "), F.lit(None).cast("string")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", *[F.get(t, F.lit(i)).alias(c) for i, c in enumerate("spo")])


@query("kg_filled_triples", "select s_suppkey, case when s_suppkey % 3 = 0 then ' ' else s_name end as s, case when s_suppkey % 4 = 0 then 'related' else 'in' end as p, case when s_suppkey % 5 = 0 then ' ' else 'x' end as o from supplier")
def kg_filled_triples(spark, sf_dir):
    k = F.col("s_suppkey")
    s, p, o = F.when(k % 3 == 0, "  ").otherwise(F.col("s_name")), F.when(k % 4 == 0, None).otherwise(F.lit("in")), F.when(k % 5 == 0, "").otherwise(F.lit("x"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", *kg.filled(s, p, o))


@query("kg_canonical_key", "select s_suppkey, lower(s_name) || '|in nation|' || lower(trim(n_name)) as key from supplier join nation on s_nationkey = n_nationkey")
def kg_canonical_key(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", kg.canonical(F.col("s_name"), F.lit(" In  Nation"), F.col("n_name")).alias("key"))


@query("kg_parse_cells", KG + "select pair_id, side, count(*) as triples, count(distinct p) as relations from kg group by 1, 2")
def kg_parse_cells(spark, sf_dir):
    """Graphs written to cells, as JSON or as tuples, and parsed again."""
    triple = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit("'"), c, F.lit("'")) for c in ("s", "p", "o")]), F.lit("]")))
    triple = triple.otherwise(F.concat(F.lit("("), F.concat_ws(", ", *[F.concat(F.lit("'"), c, F.lit("'")) for c in ("s", "p", "o")]), F.lit(")")))
    rows = sentences(spark, sf_dir).select("pair_id", "side", "pos", triple.alias("t"))
    cells = rows.groupBy("pair_id", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("l"))
    cells = cells.select("pair_id", "side", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["t"]), ", "), F.lit("]")).alias("cell"))
    out = kg.parse_cells(cells, "cell").select("pair_id", "side", F.explode("kg").alias("t"))
    return out.groupBy("pair_id", "side").agg(F.count(F.lit(1)).alias("triples"), F.countDistinct(F.get("t", F.lit(1))).alias("relations"))


@query("paragraphs_until_blank", """
with t as (select conv_id, max(text) filter (turn = 0) as p1, max(case when turn = 1 and role = 'assistant' then text end) as p2, max(text) filter (turn = 2) as p3 from conversations group by 1)
select conv_id, 0 as place, p1 as text from t where p1 is not null union all select conv_id, 1, p2 from t where p1 is not null and p2 is not null union all select conv_id, 2, p3 from t where p1 is not null and p2 is not null and p3 is not null
""")  # fmt: skip
def paragraphs_until_blank(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    wide = c.groupBy("conv_id").agg(at(0).alias("p1"), F.max(F.when((F.col("turn") == 1) & (F.col("role") == "assistant"), F.col("text"))).alias("p2"), at(2).alias("p3"))
    return kg.until_blank(wide, ["conv_id"], ["p1", "p2", "p3"])


@query("resume_left_anti", "select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 1 or toxic = 1)")
def resume_left_anti(spark, sf_dir):
    """Documents without a graph in either cell of an earlier run; empty lists, empty cells and none are no graph."""
    done = read(spark, sf_dir, "labels")
    cell = lambda c, none: F.when(F.col(c) == 1, "[['a', 'b', 'c']]").otherwise(F.lit(none))
    done = done.select("doc_id", cell("quality", " [] ").alias("kg_1"), cell("toxic", None).alias("kg_2"))
    return extraction.not_done(read(spark, sf_dir, "documents").select("doc_id", "source"), done, "doc_id", ["kg_1", "kg_2"])


@query("kg_similarity_all")
def kg_similarity_all(spark, sf_dir):
    """Every method on the graphs of customers' nations: one pair of graphs for each market segment and nation."""
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.groupBy(F.col("n_nationkey").alias("pair_id"), F.pmod(F.xxhash64("c_mktsegment", F.floor(F.col("c_acctbal") / 500)), F.lit(2)).cast("int").alias("side"), "c_mktsegment", F.floor(F.col("c_acctbal") / 500).alias("band"), "n_name", "r_name").agg(F.min("c_custkey").alias("pos"))
    triples = rows.select("pair_id", "side", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("segment "), F.lower("c_mktsegment"), F.lit(" band "), "band").alias("s"), F.concat(F.lit("buys in "), "r_name").alias("p"), F.col("n_name").alias("o"))
    return similarity.score_pairs(triples)


#: Methods that SQL states as well, and the digits to which they are compared.
CHECKED, DIGITS = ["wl", "aligned_wl", "pooled", "gaussian", "best_match", "aligned_best_match", "graph_p", "graph_r", "triple_p", "triple_r", "triple_f1"], 5
LETTERS = "[" + ", ".join(f"'{c}'" for c in "abcdefghijklmnopqrstuvwxyz") + "]"


def _vector(text):
    return f"list_transform({LETTERS}, lambda c: (length({text}) - length(replace({text}, c, '')))::double)"


def _labels(name, source):
    """A CTE of labels with their vectors and norms; ``source`` gives pair_id, k, label."""
    return f", {name}_ as ({source}), {name} as (select pair_id, k, label, {_vector('label')} as v from {name}_), {name}n as materialized (select *, sqrt(list_dot_product(v, v)) as n from {name})"


def _near(name, one, two):
    """A CTE of the cosines of two tables of labels."""
    return f", {name} as materialized (select pair_id, a.k as a, a.label as la, b.k as b, b.label as lb, round(list_dot_product(a.v, b.v) / (a.n * b.n + 1e-8::double), 10) as cos, list_dot_product(a.v, b.v) / (a.n * b.n) as plain from {one}n a join {two}n b using (pair_id))"


def _prf(name, near):
    return f", {name} as (select pair_id, p, r, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f from (select pair_id, avg(m) as p from (select pair_id, b, max(cos) as m from {near} group by 1, 2) group by 1) join (select pair_id, avg(m) as r from (select pair_id, a, max(cos) as m from {near} group by 1, 2) group by 1) using (pair_id))"


def _mapping(name, one, two, near, prefix):
    best = f"select pair_id, la as label, lb, cos from {near} qualify row_number() over (partition by pair_id, la order by cos desc, lb) = 1"
    return f""", {name} as materialized (select coalesce(x.pair_id, y.pair_id) as pair_id, coalesce(x.label, y.label) as label,
      case when x.cos >= 0.65::double then '{prefix}_' || x.lb when y.label is not null then '{prefix}_' || y.label else x.label end as anchor from ({best}) x full join {two}_ y on x.pair_id = y.pair_id and x.label = y.label)"""


def _distinct(table, *columns):
    return "select distinct pair_id, label as k, label from (" + " union ".join(f"select pair_id, {c} as label from {table}" for c in columns) + ")"


SIMILARITIES = (
    KG + EDGES + _wl(5)
    + ", g0 as (select * from kg where side = 0), g1 as (select * from kg where side = 1), whole as (select distinct pair_id from g0 where pair_id in (select pair_id from g1))"
    + _labels("t0", "select pair_id, pos as k, s || ' ' || p || ' ' || o as label from g0") + _labels("t1", "select pair_id, pos as k, s || ' ' || p || ' ' || o as label from g1") + _near("tt", "t0", "t1")
    + ", kept as materialized (select * from g1 where (pair_id, pos) in (select (pair_id, b) from (select * from tt qualify row_number() over (partition by pair_id, a order by cos desc, b) = 1)))"
    + ", means as (select pair_id, i, avg(v[i]) filter (side = 0) as x, avg(v[i]) filter (side = 1) as y from (select pair_id, 0 as side, v, unnest(range(1, 27)) as i from t0 union all select pair_id, 1, v, unnest(range(1, 27)) from t1 where (pair_id, k) in (select (pair_id, pos) from kept)) group by 1, 2)"
    + ", pooled as (select pair_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)) + 1e-8::double), 10) as pooled from means group by 1)"
    + _labels("n0", _distinct("g0", "s", "o")) + _labels("n1", _distinct("kept", "s", "o")) + _near("nn", "n0", "n1") + _mapping("nodemap", "n0", "n1", "nn", "node")
    + _labels("r0", _distinct("g0", "p")) + _labels("r1", _distinct("kept", "p")) + _near("rr", "r0", "r1") + _mapping("edgemap", "r0", "r1", "rr", "edge")
    + ", anchors as (select pair_id, label, coalesce(e.anchor, n.anchor) as anchor from nodemap n left join edgemap e using (pair_id, label))"
    + ", ea_ as (select pair_id, side, least(s, o) as u, greatest(s, o) as v from (select * from g0 union all select * from kept) group by all), ea as (select x.pair_id, side, u, v from ea_ x)"
    + _wl(5, "a", "ea", "(select anchor from anchors m where m.pair_id = ba.pair_id and m.label = ba.u)")
    + _labels("a0", _distinct("g0", "s", "p", "o")) + _labels("a1", _distinct("g1", "s", "p", "o")) + _near("aa", "a0", "a1")
    + ", gaussian as (select pair_id, avg(m) as gaussian from (select pair_id, a, max(exp(-greatest(0, 2 - 2 * plain) / 2)) as m from aa group by 1, 2) group by 1)"
    + _labels("w0", _distinct("g0", "s", "o")) + _labels("w1", _distinct("g1", "s", "o")) + _near("ww", "w0", "w1") + _prf("fn", "ww")
    + _labels("p0", "select pair_id, pos as k, p as label from g0") + _labels("p1", "select pair_id, pos as k, p as label from g1") + _near("pp", "p0", "p1") + _prf("fe", "pp") + _prf("ft", "tt")
    + ", amap as materialized (select coalesce(e.pair_id, n.pair_id) as pair_id, coalesce(e.label, n.label) as label, coalesce(e.anchor, n.anchor) as anchor from nodemap n full join edgemap e on e.pair_id = n.pair_id and e.label = n.label)"
    + "".join(
        _labels(f"x{i}", f"select pair_id, label as k, anchor as label from n{i}_ n join amap using (pair_id, label)")
        + _labels(f"y{i}", f"select g.pair_id, pos as k, anchor as label from {g} g join amap m on m.pair_id = g.pair_id and m.label = g.p")
        + _labels(f"z{i}", f"select g.pair_id, pos as k, string_agg(anchor, ' ' order by nth) as label from (select pair_id, pos, unnest([1, 2, 3]) as nth, unnest([s, p, o]) as label from {g}) g join amap m on m.pair_id = g.pair_id and m.label = g.label group by 1, 2")
        for i, g in ((0, "g0"), (1, "kept"))
    )
    + _near("xx", "x0", "x1") + _near("yy", "y0", "y1") + _near("zz", "z0", "z1") + _prf("fx", "xx") + _prf("fy", "yy") + _prf("fz", "zz")
    + ", scores as (select least(1, greatest(0, 0.5 * (0.6 * fx.f + 0.4 * fy.f) + 0.5 * fz.f)) as aligned_best_match, pair_id, t.k01 / sqrt(t.k00::double * t.k11) as wl, ta.k01 / sqrt(ta.k00::double * ta.k11) as aligned_wl, pooled, gaussian, 0.6 * fn.p + 0.4 * fe.p as graph_p, 0.6 * fn.r + 0.4 * fe.r as graph_r, ft.p as triple_p, ft.r as triple_r, ft.f as triple_f1, "
    + "least(1, greatest(0, 0.5 * (0.6 * fn.f + 0.4 * fe.f) + 0.5 * ft.f)) as best_match from whole join t using (pair_id) join ta using (pair_id) join pooled using (pair_id) join gaussian using (pair_id) join fn using (pair_id) join fe using (pair_id) join ft using (pair_id) join fx using (pair_id) join fy using (pair_id) join fz using (pair_id))"
)


@query(
    "kg_similarity_texts",
    SIMILARITIES + " select pair_id, " + ", ".join(f"round({m}::double, {DIGITS}) as {m}" for m in CHECKED) + ", "
    + ", ".join(f"round({k / 10}::double * aligned_wl + (1 - {k / 10}::double) * least(1, greatest(0, pooled)), {DIGITS}) as blend_{k}" for k in range(11)) + " from (select distinct pair_id from kg) left join scores using (pair_id)",
)
def kg_similarity_texts(spark, sf_dir):
    """Kernel and matching methods and all blends on the sentence graphs of all pairs of documents, with an encoder that SQL can state."""
    out = similarity.score_pairs(sentences(spark, sf_dir), CHECKED, similarity.letter_encoder)
    return out.withColumns({c: F.round(c, DIGITS) for c in out.columns if c != "pair_id"})


TRIPLETS = KG.replace("doc_id // 2 as pair_id, (doc_id % 2)::int as side,", "doc_id // 3 * 2 + j as pair_id, (doc_id % 3 > 0)::int as side,").replace("regexp_split_to_array(lower(text), '[.\\n]+') as a from documents", "j, regexp_split_to_array(lower(text), '[.\\n]+') as a from documents, (select unnest([0, 1]) as j) where doc_id % 3 in (0, j + 1)")


@query("gold_context_similarity", SIMILARITIES.replace(KG, TRIPLETS) + """
, bl as (select pair_id, 0.5 * aligned_wl + 0.5 * least(1, greatest(0, pooled)) as x from scores), it as (select pair_id // 2 as item, max(x) filter (pair_id % 2 = 0) as gold, max(x) filter (pair_id % 2 = 1) as context from (select distinct pair_id from kg) left join bl using (pair_id) group by 1)
select item, round(gold, 5) as gold, round(context, 5) as context, round(case when coalesce(gold, 0) + coalesce(context, 0) > 0 then 2 * coalesce(gold, 0) * coalesce(context, 0) / (coalesce(gold, 0) + coalesce(context, 0)) else 0 end, 5) as cus from it
""")  # fmt: skip
def gold_context_similarity(spark, sf_dir):
    """Of documents 3k, 3k + 1 and 3k + 2 as an answer's, the gold and the context's graph: the answer's blend with each, and their harmonic mean."""
    d = read(spark, sf_dir, "documents").withColumn("j", F.explode(F.array(F.lit(0), F.lit(1))))
    d = d.where((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 3 == F.col("j") + 1))
    triples = as_triples(d.select((F.floor(F.col("doc_id") / 3) * 2 + F.col("j")).alias("pair_id"), (F.col("doc_id") % 3 > 0).cast("int").alias("side"), "text"))
    scores = similarity.score_pairs(triples, ["aligned_wl", "pooled"], similarity.letter_encoder, (0.5,))
    both = scores.groupBy(F.floor(F.col("pair_id") / 2).alias("item")).agg(*[F.max(F.when(F.col("pair_id") % 2 == j, F.col("blend_5"))).alias(c) for j, c in enumerate(("gold", "context"))])
    out = both.withColumn("cus", ranking.harmonic(F.col("gold"), F.col("context")))
    return out.withColumns({c: F.round(c, 5) for c in ("gold", "context", "cus")})


@query("kg_similarity_texts_all")
def kg_similarity_texts_all(spark, sf_dir):
    """Every method on the sentence graphs of all pairs of documents; a pair without two graphs has null scores."""
    pairs = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("pair_id")).distinct()
    return pairs.join(similarity.score_pairs(sentences(spark, sf_dir)), "pair_id", "left")


METHODS = [*similarity.METHODS, *(f"blend_{k}" for k in range(11))]


@query("kg_coverage", KG + ", f as (select pair_id, count(distinct side) = 2 as ok from kg group by 1), c as (select count(*) as n, count(*) filter (ok) as valid from (select distinct doc_id // 2 as pair_id from documents) left join f using (pair_id)) select unnest([" + ", ".join(f"'{m}'" for m in METHODS) + "]) as method, valid, n - valid as missing from c")
def kg_coverage(spark, sf_dir):
    """Pairs of documents for which each method has a score, and those for which it has none."""
    return similarity.coverage(kg_similarity_texts_all(spark, sf_dir))
