"""Partners of rows that are rare in a large table."""

import numpy as np
from pyspark.sql import functions as F

from tripleforge.operators import perturb, shared_topics


def test_rare_kinds_are_paired(spark):
    kind = F.when(F.col("id") % 1000 == 0, "rare").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise("hot")
    df = spark.range(20001).select(F.col("id").alias("key"), kind.alias("kind"), F.col("id").cast("string").alias("title"))
    got = perturb.consecutive(df, "kind", "title", "key").collect()
    used = [k for r in got for k in r]
    assert len(used) == len(set(used))
    held = lambda m: sum(k % 1000 == m for k in used)
    assert (held(0), held(1), len(used)) == (20, 20, 20000)
    assert all((r.key % 1000 == 0) == (r.other % 1000 == 0) and (r.key % 1000 == 1) == (r.other % 1000 == 1) for r in got)


def test_sparse_topics_find_all_partners(spark):
    items = spark.range(600)
    topics = items.select("id", F.concat(F.lit("t"), F.floor(F.col("id") / 2)).alias("topic")).where("id < 599")
    got = {r.id: r for r in perturb.overlap_partner(items, topics, most=True).collect()}
    assert len(got) == 600 and all((got[i].other, got[i].shared) == (i ^ 1, 1) for i in range(598))
    assert {(got[i].shared, got[i].other != i) for i in (598, 599)} == {(0, True)}
    # all but the last share a topic, so only the last shares nothing with the others
    hub = items.where("id < 599").select("id", F.lit("hub").alias("topic"))
    least = {r.id: r for r in perturb.overlap_partner(items, hub).collect()}
    assert len(least) == 600 and all((least[i].other, least[i].shared) == (599, 0) for i in range(599)) and least[599].shared == 0
    every = items.where("id < 30")
    least = perturb.overlap_partner(every, every.select("id", F.lit("hub").alias("topic"))).collect()
    assert len(least) == 30 and all(r.shared == 1 and r.other != r.id for r in least)
    assert perturb.overlap_partner(items.limit(1), topics).count() == 0


def test_pairs_are_counted_where_they_are_made(spark, monkeypatch):
    """However topics are cut into lists; no more is moved than lists of items, not one row a pair."""
    items = spark.range(120)
    topics = items.select("id", F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(12)) for k in range(5)])).alias("topic")).distinct()
    held = {i: set() for i in range(120)}
    for r in topics.collect():
        held[r.id].add(r.topic)
    hash_order = [r.id for r in items.withColumn("h", perturb.draw("7", "id")).orderBy("h", "id").collect()]
    for most, size in ((True, 16384), (True, 7), (False, 7)):
        monkeypatch.setattr(perturb, "HOLDERS", size)
        got = {r.id: (r.other, r.shared) for r in perturb.overlap_partner(items, topics, most=most).collect()}
        sign = -1 if most else 1
        best = {i: min((x for x in hash_order if x != i), key=lambda x: sign * len(held[i] & held[x])) for i in held}
        assert got == {i: (x, len(held[i] & held[x])) for i, x in best.items()}
    plan = perturb.overlap_partner(items, topics, most=True)._jdf.queryExecution().toString()
    assert "explode(others" in plan and "explode(others" not in plan.split("REPARTITION_BY_NUM")[-1]


def test_each_two_items_meet_in_one_block(spark, monkeypatch):
    """Lists go to blocks as two bytes a number, and to each only what it has to compare."""
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(40_000, 30, replace=False)) for _ in range(400)]
    n, values, blocks, met, size = np.array([len(x) for x in lists]), np.concatenate(lists), 21, {}, 0
    width = -(-40_000 // blocks)
    for block, k, many, lengths, differences in shared_topics.deal(n, values, blocks, width):
        own = shared_topics.from_planes(lengths, k)
        got = shared_topics._sums(shared_topics.from_planes(differences, many), own)
        size += many
        for x in np.split(got, np.cumsum(own)[:-1]):
            for a in x[x // width == block]:
                for b in x[x != a]:
                    pair = (min(a, b), max(a, b))
                    met.setdefault(pair, set()).add(block)
    assert all(len(b) == 1 for b in met.values()) and len(met) == len({(a, b) for x in lists for i, a in enumerate(x) for b in x[i + 1 :]})
    assert size < 0.51 * 30 * len(values) and len(shared_topics.planes(values)) == 2 * len(values)
    for name, value in (("PAIRS", 50), ("RECEIVED", 200), ("TAKEN", 64), ("SENT", 100)):
        monkeypatch.setattr(shared_topics, name, value)
    items = spark.range(90)
    topics = items.select("id", F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(25)).cast("string") for k in range(5)], F.lit(None))).alias("topic")).where("id <> 7")
    topics = topics.unionByName(topics).unionByName(items.where("id < 3").select("id", F.lit("one").alias("topic")))
    held = {i: set() for i in range(90)}
    for r in topics.where("topic is not null").collect():
        held[r.id].add(r.topic)
    order = [r.id for r in items.withColumn("h", perturb.draw("7", "id")).orderBy("h", "id").collect()]
    found = perturb.overlap_partner(items, topics, most=True)
    best = {i: max((x for x in order if x != i), key=lambda x: len(held[i] & held[x])) for i in held}
    assert {r.id: (r.other, r.shared) for r in found.collect()} == {i: (x, len(held[i] & held[x])) for i, x in best.items()}
    assert "differences" in found._jdf.queryExecution().toString()
