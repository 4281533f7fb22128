"""Operators against hand-checked values and brute force."""

import math

import numpy as np
import pytest

from tripleforge.functions import distributions as dist
from tripleforge.operators import agreement, kg, metrics, ranking, similarity, textsim
from tripleforge.sources import extraction, tables

A = [("entity a", "discovered", "concept a"), ("entity a", "received", "award a"), ("entity a", "received", "award b")]
B = [("entity a", "found", "concept a"), ("entity a", "won", "award a"), ("entity a", "was awarded", "award c")]


def test_wl_values():
    a, b = similarity.graph(A), similarity.graph(B)
    assert similarity.wl_kernel(a, b) == pytest.approx(5 / 24)
    assert similarity.wl_kernel(a, b, 2) == pytest.approx(5 / 12)
    assert similarity.wl_kernel(a, a) == pytest.approx(1)
    assert similarity.wl_kernel(a, similarity.graph([(o, p, s) for s, p, o in A])) == pytest.approx(1)
    assert similarity.wl_kernel(a, {}) is None


def test_relational_kernel_equals_grouped(spark):
    rows = [(1, k, i, *t) for k, g in enumerate((A, B)) for i, t in enumerate(g)] + [(2, 0, 0, "x", "y", "x")]
    df = spark.createDataFrame(rows, "pair_id long, side int, pos int, s string, p string, o string")
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "pair_id long")
    got = {r.pair_id: r.wl for r in kg.wl_relational(df, pairs, 5).collect()}
    assert got[1] == pytest.approx(5 / 24) and got[2] is None and got[3] is None
    scores = {r.pair_id: r for r in similarity.score_pairs(df).collect()}
    assert scores[1].wl == pytest.approx(5 / 24) and scores[2].wl is None and scores[2].blend_5 is None
    for k in range(11):
        want = k / 10 * scores[1].aligned_wl + (1 - k / 10) * min(1, max(0, scores[1].pooled))
        assert scores[1][f"blend_{k}"] == pytest.approx(want)
    assert all(scores[1][m] is not None for m in similarity.METHODS)


def test_methods_on_identical_graphs():
    enc = similarity.hashed_encoder
    for name in ("wl", "aligned_wl", "pooled", "cluster_wl", "gaussian", "best_match", "transe", "rotate", "gnn"):
        assert similarity.METHODS[name](A, A, enc) == pytest.approx(1, abs=1e-6), name


def test_sweeps_and_auc(spark):
    rows = list(zip([1, 1, 1, 0, 0, 0], [0.9, 0.8, 0.4, 0.8, 0.3, 0.1]))
    df = spark.createDataFrame([("m", *r) for r in rows], "method string, label int, score double")
    best = metrics.best_on_grid(df, ["method"]).first()
    assert (best.threshold, best.f1) == (0.31, pytest.approx(6 / 7))
    best = metrics.best_on_scores(df, ["method"]).first()
    assert (best.threshold, best.f1) == (0.4, pytest.approx(6 / 7))
    assert metrics.roc_auc(df, ["method"]).first().auc == pytest.approx(0.8333333, abs=1e-6)
    assert metrics.roc_auc(df.where("label = 1"), ["method"]).first().auc is None
    assert metrics.roc_points(df.where("label = 1"), ["method"]).count() == 0
    holes = spark.createDataFrame([("m", 1, None), ("m", 0, float("nan")), ("m", 1, 0.5)], "method string, label int, score double")
    assert metrics.present(holes).count() == 3 and metrics.present(holes, "drop").count() == 1


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 39
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, s)], "method string, label int, score double")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert metrics.roc_auc(df, ["method"]).first().auc == pytest.approx(want)


def test_rank_agreement(spark):
    rows = [(1, lv, s) for lv, s in zip([4, 3, 2, 1], [0.9, 0.95, 0.5, 0.1])] + [(2, lv, s) for lv, s in zip([4, 3, 2, 1], [0.9, 0.9, 0.5, 0.1])] + [(3, lv, 0.5) for lv in (4, 3, 2, 1)]
    df = spark.createDataFrame(rows, "q long, level int, score double")
    got = {r.q: r for r in ranking.rank_agreement(df, ["q"]).collect()}
    assert got[1].tau == pytest.approx(2 / 3) and got[2].tau == pytest.approx(0.9128709, abs=1e-6) and got[3].tau is None


def test_distributions():
    assert dist.f_tail(4.0, 2, 10) == pytest.approx(0.0531, abs=2e-3)
    assert dist.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-3)
    assert dist.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.stars(0.0005) == "***" and dist.stars(0.5) == "ns"


def test_fleiss(spark):
    df = spark.createDataFrame([(3,), (2,), (1,), (3,)], "votes int")
    assert agreement.fleiss(df).first().kappa == pytest.approx(1 / 9)


def test_cells(spark):
    cells = ["[['White_board','is_a','Org'],['a','b','c']]", '[["it\'s", \'x\', \'y\']]', "[]", "[['a','b']]", "[('France','capital','Paris')]", "[['a', 'b', None]]", "['a','b','c']", "[['Caf\\xe9','b','c']]", "", None, "junk("]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, cell string")
    got = {r.id: r.kg for r in kg.parse_cells(df, "cell").collect()}
    assert [len(got[i]) for i in range(len(cells))] == [2, 1, 0, 0, 1, 1, 1, 1, 0, 0, 0]
    assert got[5] == [["a", "b", ""]] and got[7][0][0] == "Café"


def test_overlap(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat on the mat"), (2, "", "a"), (3, "a b c d e", "a b c d e")], "pair_id long, reference string, candidate string")
    one = {r.pair_id: r.f for r in textsim.rouge_n(df, 1).collect()}
    assert one[1] == pytest.approx(10 / 11) and one[2] == 0 and one[3] == 1
    rl = {r[0]: r[1] for r in df.select("pair_id", textsim.rouge_l(df.reference, df.candidate)).collect()}
    assert rl[1] == pytest.approx(10 / 11) and rl[2] == 0
    bl = {r.pair_id: r.bleu for r in textsim.bleu(df).collect()}
    assert bl[3] == pytest.approx(1) and bl[2] == 0 and 0 < bl[1] < 1
    ratio = spark.createDataFrame([("abcd", "bcde")], "a string, b string")
    assert ratio.select(textsim.sequence_ratio(ratio.a, ratio.b)).first()[0] == 0.75


def test_sources(spark, tmp_path):
    (tmp_path / "0.5").mkdir()
    (tmp_path / "0.5" / "news_model_a.csv").write_text('id,text,score\n1,"two\nlines",0.25\n2,x,bad\n')
    rows = {r.id: r for r in tables.read_scored(spark, str(tmp_path), ["score"]).collect()}
    assert (rows["1"].dataset, rows["1"].model, rows["1"].temperature, rows["1"].score, rows["1"].text) == ("news", "model_a", 0.5, 0.25, "two\nlines")
    assert rows["2"].score is None
    assert r"\toprule" in tables.to_latex(spark.createDataFrame([("a_b", 0.5)], "n string, v double"))
    df = spark.createDataFrame([(1, "t")], "id long, text string").withColumn("q", extraction.prompt([__import__("pyspark").sql.functions.col("text")]))
    out = extraction.extract(df, "q", lambda: lambda text: '```json\n{"kg_1": [["a", "b", "c"]]}\n```')
    assert out.select(extraction.recover(out.answer)["kg_1"][0][2]).first()[0] == "c"
    assert extraction.wait_seconds("try again in 1m2.5s") == 67.5 and math.isclose(extraction.wait_seconds("x"), 65.0)


def test_kernels_in_one_shuffle_are_those_by_joins(spark, monkeypatch):
    """Pairs across batches, loops, repeated edges, a side without edges and no pair at all."""
    rows = [(k, j % 2, j, f"n{j * j % 7}", "p", f"N{j * k % 5}") for k in range(40) for j in range(k % 9)] + [(50, 0, 0, "a", "p", None), (51, 1, 0, "a", "p", "a"), (None, 0, 0, "a", "p", "b")]
    df = spark.createDataFrame(rows, "pair_id long, side int, pos int, s string, p string, o string")
    pairs = spark.createDataFrame([(k,) for k in [*range(60), None]], "pair_id long")
    monkeypatch.setattr(kg, "TOGETHER", 7)
    got = {r.pair_id: r.wl for r in kg.wl_grouped(df, pairs, 3).collect()}
    sides = {k: [[(s, p, o) for q, i, _, s, p, o in rows if q == k and i == j and o] for j in (0, 1)] for k in range(60)}
    want = {k: similarity.wl_kernel(*map(similarity.graph, g), 3) for k, g in sides.items()}
    assert got.pop(None) is None and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) if want[k] is not None else got[k] is None for k in want)


def test_sizes_of_graphs_in_one_shuffle(spark):
    rows = [(1, 0, 0, "A", "p", "b"), (1, 0, 1, "B", "q", "a"), (1, 0, 2, "c", None, "c"), (1, 1, 0, "a", "p", None), (2, 1, 0, "x", "p", "y"), (2, 1, 1, "x", "P", "z"), (None, 0, 0, "a", "p", "b")]
    made = kg.node_counts(spark.createDataFrame(rows, "pair_id long, side int, pos int, s string, p string, o string"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, made.collect()), key=str) == [(1, 0, 3, 2, 1), (2, 1, 3, 2, 1), (None, 0, 2, 1, 1)]
