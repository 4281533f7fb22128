import pytest

import corpus_pipeline
from tripleforge.llm import queries


def test_stages_keep_columns_and_effects(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs.count()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert seen["exact_dedup"] < seen["language_id"] and seen["simhash_near_dedup"] <= seen["exact_dedup"]
    assert seen["mixing"] == seen["sentencepiece"] and docs.where("not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(cur.fetchall(), key=repr)


def test_a_query_for_each_operator():
    assert sorted({n.split("_")[0] for n in queries.QUERIES if n.startswith("op")}, key=lambda x: int(x[2:])) == [f"op{i}" for i in range(1, 14)]
