"""The subpackage's queries over the synthetic tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, decontaminate, divergence, exact_dedup, html_text, kneser_ney, language_id, mixing, quotes, sentencepiece_viterbi, simhash, spelling, toxicity
from .common import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "op10_exact_dedup",
    r"""
    with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
    from d window w as (partition by text_sha256)
    """,
)
def op10(spark, sf_dir):
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).drop("raw")


@query("op4_mixing")
def op4(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op8_simhash")
def op8(spark, sf_dir):
    return simhash.near_dedup(read(spark, sf_dir, "documents")).drop("raw")


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    return sentencepiece_viterbi.encode(read(spark, sf_dir, "documents"), sentencepiece_viterbi.model_bytes())


@query("op1_language_id")
def op1(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op5_nearest")
def op5(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op3_html_text")
def op3(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


@query("op6_quality")
def op6(spark, sf_dir):
    good = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    return kneser_ney.classify(read(spark, sf_dir, "documents"), good)


@query("op2_reply_order")
def op2(spark, sf_dir):
    return quotes.reply_ordered(read(spark, sf_dir, "conversations"))


QUOTED = r"""
with recursive m as (select conv_id, turn, coalesce(text, '') as text, trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) as said from conversations),
q as (select a.conv_id, a.turn, b.said from m a join m b on a.conv_id = b.conv_id and b.turn = a.turn - case when a.turn % 3 = 0 then 2 else 1 end where a.turn % 5 <> 4),
r as (select q.conv_id, q.turn, min(m.turn) as reply_to from q join m using (conv_id, said) where said <> '' and m.turn < q.turn group by 1, 2),
t as (select m.conv_id, m.turn, m.turn as thread, 0 as depth, null::bigint as reply_to from m left join r using (conv_id, turn) where r.reply_to is null
  union all select r.conv_id, r.turn, t.thread, t.depth + 1, r.reply_to from r join t on t.conv_id = r.conv_id and t.turn = r.reply_to)
select t.conv_id, t.turn, thread, depth, reply_to, md5(regexp_replace(m.text, '^\s+|\s+$', '', 'g')) as digest, (q.turn is not null)::bigint as n_quotes, (reply_to is not null)::bigint as n_linked
from t join m using (conv_id, turn) left join q on q.conv_id = t.conv_id and q.turn = t.turn
"""


@query("quoted_conversations", QUOTED)
def quoted_conversations(spark, sf_dir):
    """Conversations in which most messages quote the one before them, or the one before that, in reply order and without the quotes."""
    c = read(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    back = F.when(F.col("turn") % 3 == 0, 2).otherwise(1)
    quoted = c.select("conv_id", F.col("turn").alias("at"), F.regexp_replace("text", "(?m)^", "> ").alias("quote"))
    rows = c.withColumn("at", F.when(F.col("turn") % 5 != 4, F.col("turn") - back)).join(quoted, ["conv_id", "at"], "left")
    rows = rows.select("conv_id", "turn", "role", F.concat_ws("\n", "quote", "text").alias("text"))
    out = quotes.reply_ordered(rows)
    return out.select("conv_id", "turn", "thread", "depth", "reply_to", F.md5("text").alias("digest"), "n_quotes", "n_linked")


DECONTAMINATED = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
g as (select distinct item_id, l, array_to_string(w[i : i + l - 1], ' ') as gram
  from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) as i from (select *, least(10, len(w)) as l from b where len(w) > 0))),
o as (select doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') as gram
  from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) as i from d, (select distinct l from g) where len(w) >= l)),
m as (select o.doc_id, o.i, o.l, g.item_id from o join g using (l, gram)),
h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + l)) as k from m) group by 1),
s as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct doc_id, item_id::varchar as item_id from m) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join s using (doc_id)
"""


@query("op11_decontaminate", DECONTAMINATED)
def op11(spark, sf_dir):
    found = decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    rows = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


#: The crc32 of each document's distinct runs goes on a byte a step, from the table of the 256 bytes.
SPELLING = r"""
with recursive b as (select i::bigint as i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as t from range(256) r(i)),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') as w from documents),
u as (select doc_id, run, count(*) as n from (select r, doc_id, unnest(w) as run from d) group by all),
x as (select doc_id, run, n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as h from u),
c as (select doc_id, run, n, h, 0 as j, 4294967295::bigint as c from x
  union all select doc_id, run, n, h, j + 1, xor(c.c >> 8, b.t) from c join b on b.i = xor(c.c & 255, ('0x' || substr(h, 2 * j + 1, 2))::bigint) where 2 * j < length(h)),
e as (select run, n, xor(c, 4294967295) as c from c where 2 * j = length(h)),
f as (select case when c % 97 = 0 then left(run, (c % length(run))::int) || substr(run, (c % length(run))::int + 2) else run end as word, n from e),
w as (select word, sum(n)::bigint as n from f where length(word) >= 5 group by 1 having sum(n) >= 3),
k as (select word, k, unnest([left(word, k) || '_' || substr(word, k + 2)]) as hole, left(word, k) || substr(word, k + 2) as less from (select word, unnest(range(length(word)))::int as k from w)),
p as (select a.word, z.word as near from k a join k z on a.hole = z.hole and a.word <> z.word
  union select k.word, w.word from k join w on k.less = w.word union select w.word, k.word from k join w on k.less = w.word),
m as (select p.word, count(*) as n_near, first(p.near order by w.n desc, p.near) as best, max(w.n) as best_n from p join w on w.word = p.near group by 1),
o as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * w.n then best end as form, case when best_n >= 2 * w.n then best_n end as form_n from w left join m using (word)),
z as (select word, word as tip, 0 as step from o union all select z.word, o.form, step + 1 from z join o on o.word = z.tip where o.form is not null),
y as (select word, arg_max(tip, step) as root from z group by 1)
select word, form, root, n, n_near, form_n from o join y using (word)
"""


@query("op12_spelling", SPELLING)
def op12(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


DIVERGENCE = r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select lang, source, i, term, count(*) as n from (select lang, source, i, unnest(w) as term from d) where term <> '' group by all),
k as (select lang, term, sum(n)::hugeint as n from t group by all having count(*) >= 10),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, k.n as all_n, coalesce(s.n, 0)::hugeint as n
  from g join k using (lang) left join (select lang, source, term, sum(n) as n from t group by all) s on s.lang = g.lang and s.source = g.source and s.term = k.term),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by 1),
u as (select lang, source, sum(n)::hugeint as total from c group by all),
p as (select c.lang, c.source, c.term, c.n, 1 + 1000000000 * (c.n + 2) // (u.total + 2 * v.v) as p, 1 + 1000000000 * (c.all_n + 2) // (v.total + 2 * v.v) as q
  from c join u using (lang, source) join v using (lang)),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
term as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pair.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all select lang, source, 'term', item, value from term)
select lang, source, part, item, value::bigint as value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from r) where part = 'pair' or rank <= 10
"""


@query("op13_divergence", DIVERGENCE)
def op13(spark, sf_dir):
    return divergence.audit(read(spark, sf_dir, "documents"))
