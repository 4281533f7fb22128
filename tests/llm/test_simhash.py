import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripleforge.llm import simhash
from tripleforge.llm.graphs import components


def brute(fps, ids):
    """Smallest id reachable, by comparing all pairs."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids)}


def clusters(rng, n, centres, flips):
    base = rng.integers(0, 2**63, centres, dtype=np.uint64)
    out = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(out)


@pytest.mark.parametrize("n,centres,flips", [(400, 60, 3), (600, 4, 6), (3000, 3, 4), (900, 900, 0)])
def test_link_equals_brute_force(n, centres, flips):
    codes = clusters(np.random.default_rng(n), n, centres, flips)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    sets = simhash._Sets(len(codes))
    simhash.link(codes, sets)
    want = brute(codes, range(len(codes)))
    assert [want[i] for i in range(len(codes))] == sets.all().tolist()


@pytest.mark.parametrize("n,centres,flips", [(1500, 400, 4), (6000, 2, 5)])
def test_near_links_equal_brute_force(spark, n, centres, flips):
    codes = clusters(np.random.default_rng(n), n, centres, flips)
    ids = np.random.default_rng(1).permutation(len(codes)) * 3
    frame = spark.createDataFrame(pd.DataFrame({"fp": codes.view(np.int64), "rep": ids}))
    got = {r.node: r.component for r in simhash.near_links(frame).collect()}
    want = {a: b for a, b in brute(codes, ids.tolist()).items()}
    assert {d: got.get(d, d) for d in want} == want


def test_fingerprint_by_definition():
    import re

    import xxhash

    for text in ["", "one", "One two", "A b c d", "a b  c\td e\x0bf é Ü a b c d", "x " * 500, "  a b c d e"]:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(None) == 0


def test_moved_and_rank():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**63, 50, dtype=np.uint64)
    for order in simhash.tables(6)[0][::4]:
        got = simhash.moved(fp, order)
        assert all(int(g) == sum((int(f) >> b & 1) << (63 - i) for i, b in enumerate(order)) for f, g in zip(fp, got))
    rank = simhash.gray_rank(fp)
    assert ((rank ^ (rank >> np.uint64(1))) == fp).all()


def test_edge_rows(spark):
    schema = "doc_id long, text string, fp string"
    rows = [(5, None, "x"), (7, "", "x"), (9, "a b c", None), (3, "a  B\nc", "y"), (None, "other words here entirely", "z"), (9, "a b c", None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_dedup(spark.createDataFrame(rows, schema)).collect())
    assert [g[3] for g in got] == [3, 5, 5, 3, 3, None]
    assert got[1][2] == "0" * 16
    assert simhash.near_dedup(spark.createDataFrame([], schema)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 501), (7, 7)], "a long, b long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert set(got) == set(range(1, 301)) | {501} and set(got.values()) == {0, 500}


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pdf = docs.toPandas()
    want = brute([simhash.fingerprint(t) for t in pdf["text"]], pdf["doc_id"].tolist())
    assert {r.doc_id: r.component_id for r in simhash.near_dedup(docs).collect()} == want


def test_components_with_hubs_and_many_links(spark, monkeypatch):
    """A hub's neighbours are looked up by broadcast; the sign of the links cannot overflow in ANSI mode."""
    from tripleforge.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 8)
    star = spark.range(1, 3000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    path = spark.range(6000, 6040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in components(star.union(path).union(star.limit(5))).collect()}
    assert {k for k, v in got.items() if v == 1} == {*range(2, 3000), 5000}
    assert {k for k, v in got.items() if v == 6000} == set(range(6001, 6041)) and len(got) == 3039
    assert spark.range(1 << 22).agg(F.bit_xor(F.xxhash64("id"))).first()[0] is not None


def test_hot_keys_join_once(spark, monkeypatch):
    from tripleforge.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 3)
    rows = spark.createDataFrame([("x" if i % 3 else str(i), i) for i in range(60)] + [(None, 1)], "k string, _hot long")
    facts = rows.where("k != '0'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("_hot").alias("top"))
    got = common.with_facts(rows, facts, "k", "n", 61)
    assert got.columns == ["k", "_hot", "n", "top"]
    assert sorted(map(tuple, got.collect())) == sorted((("x", i, 40, 59) if i % 3 else (str(i), i, 1, i)) for i in range(1, 60))


@pytest.mark.parametrize("rows,want", [
    # A - B - C, B without an id: all reach 1.
    ([(1, 0), (None, 0b111), (3, 0b111111)], [(1, 1), (3, 1), (None, 1)]),
    # One id with two texts joins nothing of its own.
    ([(5, 0), (7, 0b1111), (5, (1 << 40) - 1), (9, (1 << 40) - 16)], [(5, 5), (5, 5), (7, 5), (9, 5)]),
    ([(5, 0), (7, 0b1111), (6, (1 << 40) - 1), (5, (1 << 40) - 1), (9, (1 << 40) - 16), (8, (1 << 40) - 16)], [(5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (9, 5)]),
    # Chains of rows without ids have none; with one at the end they have it.
    ([(None, 0), (None, 0b11)], [(None, None), (None, None)]),
    ([(None, 0), (None, 0b1111), (None, 0b11111111), (4, 0b111111111111)], [(4, 4), (None, 4), (None, 4), (None, 4)]),
])
def test_ids_follow_fingerprints(spark, monkeypatch, rows, want):
    stated = spark.createDataFrame([(i, 0, fp) for i, fp in rows], "doc_id long, raw long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: stated)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_dedup(stated).collect()), key=repr)
    assert got == sorted(want, key=repr)


def test_two_texts_of_an_id_do_not_join_others(spark, monkeypatch):
    far = ((1 << 30) - 1) << 20
    stated = spark.createDataFrame([(5, 0, 0), (7, 0, 0b11), (5, 0, far), (9, 0, far ^ 1)], "doc_id long, raw long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: stated)
    rows = simhash._classes(stated, "doc_id", "text", None).collect()
    of = {(r.doc_id, r.fp): r["class"] for r in rows}
    assert of[5, 0] == of[7, 0b11] != of[5, far] == of[9, far ^ 1]
    assert {r.component_id for r in rows} == {5}


def random_rows(rng, n):
    """Fingerprints near each other, some of rows without an id, some ids with several."""
    codes = clusters(rng, n, 12, 5)
    codes = codes[rng.integers(0, len(codes), n)]
    ids = [None if rng.random() < 0.4 else int(rng.integers(0, n // 2)) for _ in range(n)]
    return [(i, 0, int(np.int64(np.uint64(c)))) for i, c in zip(ids, codes)]


def brute_rows(rows):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, _, a) in enumerate(rows):
        for j in range(i):
            if bin((a ^ rows[j][2]) & (2**64 - 1)).count("1") <= 4:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[root(i)] = min([x for x in (d, least.get(root(i))) if x is not None], default=None)
    return [(d, least[root(i)]) for i, (d, _, _) in enumerate(rows)]


@pytest.mark.parametrize("seed,range_rows,parts", [(1, 1 << 20, None), (2, 40, "16")])
def test_null_and_repeated_ids_equal_brute_force(spark, monkeypatch, seed, range_rows, parts):
    """Also with so small ranges that groups lie in several, for the second pass."""
    monkeypatch.setattr(simhash, "RANGE_ROWS", range_rows)
    rows = random_rows(np.random.default_rng(seed), 240)
    stated = spark.createDataFrame(rows, "doc_id long, raw long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: stated)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_dedup(stated).collect()), key=repr)
    assert got == sorted(brute_rows(rows), key=repr)


def test_one_row_of_each_class_stays(spark):
    a = "one two three four five six seven eight nine ten eleven twelve " * 6
    rows = [(7, a, "x"), (3, a + "thirteen", "y"), (None, a, "z"), (9, "quite another text of other words altogether here", "x"), (None, "alone without an id and near nothing else", "y"), (None, None, "q"), (None, "", "q"), (3, "the id three once more with a far text of its own", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string")
    kept = simhash.keep_representatives(df)
    assert kept.columns == df.columns
    fps = {r.doc_id: r.component_id for r in simhash.near_dedup(df.where("doc_id in (7, 9)")).collect()}
    assert fps == {7: 7, 9: 9}
    got = sorted((repr(r.doc_id), (r.text or "")[:5]) for r in kept.collect())
    linked = bin(simhash.fingerprint(a) ^ simhash.fingerprint(a + "thirteen")).count("1") <= 4
    assert linked
    assert got == sorted([("3", "one t"), ("3", "the i"), ("9", "quite"), ("None", "alone"), ("None", ""), ("None", "")])
