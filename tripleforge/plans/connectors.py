"""Queries through sources and sinks: sharded data sets, trees of files, workbooks, stored answers and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import perturb
from ..sources import extraction, memo, shards, storage, tables, workbook
from .perturbation import S, docs, hashed
from .registry import query, read


def _sharded(spark, sf_dir):
    """Documents as compressed JSON lines in several files, below a hub's root."""
    root = storage.new_path(spark)
    rows = docs(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars")
    rows.repartition(6, "doc_id").write.option("compression", "gzip").json(f"{root}/corpus/train")
    return root


@query("sharded_documents", "select doc_id, md5(text) as digest, lang, n_chars from documents")
def sharded_documents(spark, sf_dir):
    """A split of a data set by name; of its columns only the asked ones are parsed."""
    hub = shards.Hub(spark, _sharded(spark, sf_dir))
    df = hub.load("corpus", schema="doc_id long, text string, lang string, source string, n_chars long", columns=["doc_id", "lang", "n_chars", "text"])
    return df.select("doc_id", hashed(F.col("text")).alias("digest"), "lang", "n_chars")


@query("sharded_stream", "select lang, count(*) as n, sum(n_chars) as n_chars from documents group by 1")
def sharded_stream(spark, sf_dir):
    """The same split read as a stream to its end."""
    hub, out = shards.Hub(spark, _sharded(spark, sf_dir)), storage.new_path(spark)
    stream = hub.load("corpus", columns=["lang", "n_chars"], schema="lang string, n_chars long", stream=True)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema("lang string, n_chars long").parquet(f"{out}/rows").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


TREE = """
select event_id, case when event_id % 4 = 1 then event_type end as kind, round(value, 3) as gold, case when event_id % 7 = 0 then null else round(value / 2, 3) end as context, 'm' || event_id % 4 as model, (event_id % 4) / 2.0::double as temperature
from events where event_id % 4 < 2
"""


@query("tree_union", TREE)
def tree_union(spark, sf_dir):
    """Files with headers of their own: other orders, other columns, without scores, and results of earlier runs."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.round("value", 3).alias("gold"), F.round(F.col("value") / 2, 3).alias("half"))
    e = e.withColumn("context", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("half").cast("string"))).drop("half")
    root = storage.new_path(spark)
    part = lambda k, *columns: e.where(f"event_id % 4 = {k}").select(*columns)
    for k, folder, columns in ((0, "0.0", ["event_id", "gold", "context"]), (1, "0.5", ["context", "kind", "gold", "event_id"]), (2, "1.0", ["event_id", "kind"]), (3, "Analysis_plot_temps", ["event_id", "gold", "context"])):
        tables.write_csv(part(k, *columns), f"{root}/{folder}/news_m{k}.csv")
    out = tables.read_tree(spark, root, ["gold", "context"])
    folder = F.regexp_extract("source_file", r"/([0-9.]+)/news_(m[0-9])\.csv/", 1)
    return out.select(F.col("event_id").cast("long").alias("event_id"), "kind", "gold", "context", F.regexp_extract("source_file", r"news_(m[0-9])\.csv/", 1).alias("model"), folder.cast("double").alias("temperature"))


@query("workbook_round_trip", "select 'suppliers' as sheet, s_suppkey as id, s_name as name, round(s_acctbal, 2) as amount, s_acctbal > 0 as good from supplier union all select 'regions', r_regionkey, r_name, null, null from region")
def workbook_round_trip(spark, sf_dir):
    """Two sheets of a workbook, written and read with their types."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("amount"), (F.col("s_acctbal") > 0).alias("good"))
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    path = f"{storage.new_path(spark)}/results.xlsx"
    workbook.write_workbook({"suppliers": (s, ["id"]), "regions": (r, ["id"])}, path)
    kinds = "id long, name string, amount double, good boolean"
    parts = [workbook.read_workbook(spark, path, name, kinds).select(F.lit(name).alias("sheet"), "*") for name in ("suppliers", "regions")]
    return parts[0].unionByName(parts[1])


def _there():
    return lambda texts: [t.replace("th", "tʰ") for t in texts]


def _back():
    return lambda texts: [t.replace("tʰ", "d") for t in texts]


@query("translated_and_back", S + "select doc_id, md5(replace(array_to_string(s, ' '), 'th', 'd')) as digest from s where contains(array_to_string(s, ' '), 'th')")
def translated_and_back(spark, sf_dir):
    """Paraphrases by a stub translator, there and back, each distinct sentence asked once and stored."""
    d = docs(spark, sf_dir).select("doc_id", "text")
    made = memo.there_and_back(d, "doc_id", perturb.sentences(F.col("text")), storage.new_path(spark), _there, _back, perturb.sentences)
    return made.where("made is not null").select("doc_id", hashed(F.col("made")).alias("digest"))


def _failing():
    def ask(text):
        if text.endswith(("0", "3", "6", "9")):
            raise RuntimeError("429 try again in 0.1s")
        return '{"kg_1": []}' if text.endswith(("1", "4")) else '```json\n{"kg_1": [["a", "is in", "b"]]}\n```'

    return ask


def _working():
    return lambda text: '{"kg_1": [["a", "is in", "c"]]}'


ANSWERED = """
select s_suppkey, case when s_suppkey % 10 in (0, 3, 6, 9) then 'c' when s_suppkey % 10 in (1, 4) then null else 'b' end as object, case when s_suppkey % 10 in (0, 3, 6, 9) then 2 else 1 end::bigint as asked from supplier
"""


@query("stored_answers", ANSWERED)
def stored_answers(spark, sf_dir):
    """Two runs of an extraction: what failed in the first is asked again in the second, all else is taken from the store."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Text "), "s_suppkey").alias("prompt"))
    path, pause = storage.new_path(spark), lambda seconds: None
    extraction.extract_stored(rows, "s_suppkey", "prompt", path, _failing, pause=pause)
    out = extraction.extract_stored(rows, "s_suppkey", "prompt", path, _working, pause=pause)
    asked = spark.read.parquet(path).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("asked"))
    triples = extraction.recover(F.col("answer"))["kg_1"]
    return out.select("s_suppkey", F.get(F.get(triples, F.lit(0)), F.lit(2)).alias("object")).join(asked, "s_suppkey")
