"""Stems, tokens, exact rank tests and the vector index against published values and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleforge.functions import distributions as dist
from tripleforge.functions.stemming import stem
from tripleforge.operators import ranking, textsim, token_match, vector_index

#: The examples of the published rules, each word with its stem after all steps.
PUBLISHED = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
""".split()


@pytest.mark.parametrize("word,want", list(zip(PUBLISHED[::2], PUBLISHED[1::2])))
def test_published_stems(word, want):
    assert stem(word, published=True) == want


def test_later_stems():
    want = {"dies": "die", "tied": "tie", "flies": "fli", "spied": "spi", "dying": "die", "skies": "sky", "enjoy": "enjoy", "cry": "cri", "by": "by", "usefully": "use", "geologically": "geolog", "possibly": "possibl", "radically": "radic", "news": "news", "owed": "owe", "is": "is", "a": "a", "": ""}
    assert {w: stem(w) for w in want} == want


def test_overlap_of_stems(spark):
    rows = [(1, "Running horses happily jumped", "the horse runs, happy jumping"), (2, None, "running"), (3, "", ""), (4, "cats ate", "cat ate")]
    df = spark.createDataFrame(rows, "pair_id long, reference string, candidate string")
    plain, stems = ({r.pair_id: r for r in textsim.rouge_n(df, 1, stemmed=s).collect()} for s in (False, True))
    assert plain[1].f == 0 and stems[1].p == pytest.approx(3 / 5) and stems[1].r == pytest.approx(3 / 4) and stems[2].f == stems[3].f == 0 and stems[4].f == 1 and plain[4].f == 0.5
    assert {r.pair_id: r.f for r in textsim.rouge_n(df, 2, stemmed=True).collect()}[4] == 1
    got = {r[0]: r[1] for r in df.select("pair_id", textsim.rouge_l(df.reference, df.candidate, stemmed=True)).collect()}
    assert got[1] == pytest.approx(2 * 2 / 9) and got[2] == got[3] == 0 and got[4] == 1
    assert textsim.rouge_n(df.limit(0), 1, stemmed=True).count() == 0


def test_exact_distributions():
    """Tables of the signed-rank and rank-sum distributions, and counting all cases."""
    assert [dist.wilcoxon_exact(w, n) for w, n in ((0, 5), (2, 6), (3, 8), (8, 10))] == pytest.approx([0.0625, 0.09375, 0.0390625, 0.048828125])
    assert [dist.mann_whitney_exact(u, a, b) for u, a, b in ((2, 5, 5), (0, 3, 4), (13, 8, 8), (4, 5, 6))] == pytest.approx([8 / 252, 2 / 35, 2 * 321 / 12870, 24 / 462])
    for a, b in ((2, 3), (5, 3), (4, 4), (6, 5)):
        count = np.zeros(a * b + 1)
        for own in itertools.combinations(range(a + b), a):
            count[sum(own) - a * (a - 1) // 2] += 1
        assert dist.rank_sum_counts(a, b) == pytest.approx(count / math.comb(a + b, a))
    for n in (1, 4, 9):
        count = np.zeros(n * (n + 1) // 2 + 1)
        for own in itertools.product((0, 1), repeat=n):
            count[sum((i + 1) * x for i, x in enumerate(own))] += 1
        assert dist.signed_rank_counts(n) == pytest.approx(count / 2**n)
    assert dist.rank_sum_counts(8, 3000).sum() == pytest.approx(1) and dist.signed_rank_counts(50).sum() == pytest.approx(1)


def test_rank_tests(spark):
    rows = [("exact", x) for x in (1, 2, -3, 4, 5, 6, 7, 8)] + [("few", x) for x in (1, 2, 3, 4)] + [("ties", x) for x in (1, 1, -1, 2, 3, 4)] + [("zeros", x) for x in (0, 1, 2, 3, -4, 5)] + [("none", None)] * 6 + [("all zeros", 0)] * 6
    got = {r.g: r for r in ranking.wilcoxon_p(ranking.wilcoxon(spark.createDataFrame(rows, "g string, d long"), ["g"], "d")).collect()}
    assert set(got) == {"exact", "ties", "zeros"} and got["exact"].p == pytest.approx(0.0390625) and got["exact"].stars == "*"
    assert got["ties"].p == pytest.approx(dist.normal_two_sided(got["ties"].z)) and got["zeros"].p == pytest.approx(dist.normal_two_sided(got["zeros"].z))
    rows = [("exact", v, v < 6) for v in range(1, 11)] + [("ties", v // 2, v < 5) for v in range(12)] + [("few", v, v < 2) for v in range(12)] + [("large", v, v % 2 == 0) for v in range(60)] + [("same", 1, v < 5) for v in range(10)]
    got = {r.g: r for r in ranking.mann_whitney_p(ranking.mann_whitney(spark.createDataFrame(rows, "g string, v long, first boolean"), ["g"], "v", F.col("first"))).collect()}
    assert set(got) == {"exact", "ties", "large", "same"} and got["exact"].p == pytest.approx(2 / 252) and got["exact"].stars == "**" and got["same"].p == 1 and got["same"].stars == "ns"
    r = got["large"]
    assert r.p == pytest.approx(dist.normal_two_sided((abs(r.u - 450) - 0.5) / math.sqrt(900 * 61 / 12)))


def brute_tokens(one, two, weight=lambda w: 1.0):
    (x, a), (y, b) = token_match.letter_tokens([one, two])
    if not x or not y:
        return 0.0, 0.0, 0.0
    near = np.array([[0.0 if not u.any() or not v.any() else u @ v / np.linalg.norm(u) / np.linalg.norm(v) for v in b] for u in a])
    mean = lambda best, words: sum(weight(w) * s for w, s in zip(words, best)) / sum(map(weight, words)) if sum(map(weight, words)) else 0.0
    p, r = mean(near.max(axis=0), y), mean(near.max(axis=1), x)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_token_scores(spark):
    rows = [(1, "the cat sat on the mat", "a cat is on a mat 12"), (2, "the dog", "the dog"), (3, None, "x"), (4, "", "x"), (5, "12 13", "12"), (6, "the the cat", "mat"), (7, "word " * 3000, "word other " * 2000)]
    df = spark.createDataFrame(rows, "pair_id long, reference string, candidate string")
    got = {r.pair_id: (r.p, r.r, r.f) for r in token_match.token_scores(df).collect()}
    for i, a, b in rows:
        assert got[i] == pytest.approx(brute_tokens(a or "", b or "") if i != 7 else got[7]), i
    assert got[7][1] == pytest.approx(1)
    held = [set(token_match.letter_tokens([a])[0][0]) for i, a, b in rows if a and b and token_match.letter_tokens([b])[0][0]]
    weight = lambda w: math.log((len(held) + 1) / (sum(w in h for h in held) + 1))
    got = {r.pair_id: (r.p, r.r, r.f) for r in token_match.token_scores(df, weighted=True).collect()}
    for i, a, b in rows[:6]:
        assert got[i] == pytest.approx(brute_tokens(a or "", b or "", weight)), i
    cut = token_match.token_scores(df, most_chars=3).where("pair_id = 1").first()
    assert (cut.p, cut.r, cut.f) == pytest.approx(brute_tokens("the", "a c"))
    assert token_match.token_scores(df.limit(0), weighted=True).count() == 0


def test_blocks_change_nothing():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((37, 5)), rng.standard_normal((23, 5))
    b[3] = 0
    for block in (1, 4, 100):
        for x, y in zip(token_match.best_cosines(a, b, block), token_match.best_cosines(a, b)):
            assert (x == y).all()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((40, 16))
    v = centre[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    v *= rng.uniform(0.5, 2, (3000, 1))  # lengths differ, so the largest products aren't the nearest vectors
    return v, spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


def true_neighbours(v, queries, k):
    out = set()
    for q in queries:
        score = v @ v[q]
        out |= {(q, int(i)) for i in np.lexsort((np.arange(len(v)), -score))[:k]}
    return out


@pytest.mark.parametrize("part,block", [(4096, 4096), (64, 16)])
def test_index_is_stored_opened_and_searched(spark, vectors, tmp_path, monkeypatch, part, block):
    """Also with parts of lists and blocks of queries that are small."""
    monkeypatch.setattr(vector_index, "PART", part)
    monkeypatch.setattr(vector_index, "BLOCK", block)
    v, df = vectors
    vector_index.build(df, str(tmp_path / "index"))
    index = vector_index.Index(spark, str(tmp_path / "index"))
    queries = df.where("id % 50 = 7")
    want = true_neighbours(v, range(7, 3000, 50), 10)
    exact = index.search(queries, 10, exact=True).collect()
    assert {(r.query_id, r.id) for r in exact} == want and sorted(r["rank"] for r in exact if r.query_id == 57) == list(range(1, 11))
    assert all(r.score == pytest.approx(v[r.query_id] @ v[r.id]) for r in exact)
    found = index.search(queries, 10, probes=12)
    assert vector_index.recall(found, spark.createDataFrame(list(want), "query_id long, id long")).first().recall >= 0.9
    assert {(r.query_id, r.id) for r in vector_index.brute_force(df, queries, 10).collect()} == want


def test_index_of_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, v array<double>, list string, part int")
    vector_index.build(df, str(tmp_path / "odd"))
    index = vector_index.Index(spark, str(tmp_path / "odd"))
    got = index.search(df.where("id in (1, 3, 5, 8)"), 3, exact=True).collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(1, 1, None, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 0.0), (8, 1, None, 0.0), (8, 2, 1, 0.0), (8, 3, 2, 0.0)]
    vector_index.build(df.limit(0), str(tmp_path / "empty"))
    assert vector_index.Index(spark, str(tmp_path / "empty")).search(df, 3).count() == 0


@pytest.mark.parametrize("size", [8192, 100, 1])
def test_queries_meet_shelves_of_lists(spark, vectors, tmp_path, monkeypatch, size):
    """Without clusters an exact search must visit nearly all; a query is sent once to a shelf of lists, not to each list."""
    monkeypatch.setattr(vector_index, "SHELF", size)
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    v = np.random.default_rng(5).standard_normal((2000, 24))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    vector_index.build(df, str(tmp_path / "index"))
    index, sent, visit = vector_index.Index(spark, str(tmp_path / "index")), [], vector_index.Index._visit
    shelves = vector_index._shelves(index.centres, index.n, size)
    held = [index.n[shelves == x] for x in range(shelves.max() + 1)]
    assert all(own.sum() <= size or len(own) == 1 for own in held) and len(index.numbers) > 30
    assert size != 100 or len(held) < 60 and max(map(len, held)) > 1
    monkeypatch.setattr(vector_index.Index, "_visit", lambda self, asked, visits, *more: sent.append(visits.count()) or visit(self, asked, visits, *more))
    got = index.search(df.where("id % 50 = 7"), 10, exact=True).collect()
    assert {(r.query_id, r.id) for r in got} == true_neighbours(v, range(7, 2000, 50), 10) and len(got) == 400
    assert len(sent) == 2 and sent[1] <= 40 * len(held)


def test_copies_in_an_index(spark, tmp_path):
    """Equal vectors have equal products wherever they lie, so the smaller ids come first; a vector without an id before them."""
    rng = np.random.default_rng(2)
    v = np.repeat(rng.standard_normal((7, 37)), 150, axis=0)[rng.permutation(1050)]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    vector_index.build(df, str(tmp_path / "index"), lists=3)
    got = vector_index.Index(spark, str(tmp_path / "index")).search(df.where("id < 40"), 5, probes=1, exact=True).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.id)
    for q, own in found.items():
        best = v[(v @ v[q]).argmax()]
        assert own == [int(i) for i in np.flatnonzero((v == best).all(axis=1))[:5]]
    assert len(found) == 40
    low, far = [1.0, 0.0], np.array([[1.0, 0.0]] * 3)
    who, at, score = vector_index._chosen(np.array([low]), far, np.array([np.nan]), 2)
    assert (who.tolist(), at.tolist(), score.tolist()) == ([0, 0], [0, 1], [1.0, 1.0])


def test_stems_of_null_words_and_lists(spark):
    rows = [(0, ["running", None, "running", "cat"]), (1, None), (2, []), (3, ["ponies"])]
    df = spark.createDataFrame(rows, "id int, w array<string>").coalesce(1).where("id <> 9")
    assert [r.x for r in df.select("id", textsim.stems(F.col("w")).alias("x")).orderBy("id").collect()] == [["run", None, "run", "cat"], None, [], ["poni"]]


def test_overlap_is_counted_where_both_texts_lie(spark):
    """BLEU shuffles no n-gram, and words of a batch are numbers, its distinct ones alone being Python's; results are those of plain counting."""
    from collections import Counter

    import pyarrow as pa

    data = [(1, "a b a b c", "A b a b"), (2, "a b", "c d"), (3, None, "a"), (4, "", ""), (5, "x y z", "x y z w"), (6, "running dogs ran", "run dog ran"), (7, "a b c", None)]
    df = spark.createDataFrame(data, "pair_id long, reference string, candidate string")
    plan = textsim.bleu(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    got = {r.pair_id: r.bleu for r in textsim.bleu(df).collect()}
    assert got[2] == got[3] == got[4] == got[7] == 0 and got[5] == pytest.approx((3 / 4 * 2 / 3 * 1 / 2 * 0.1) ** 0.25)
    lists = [[None if t is None else t.lower().split() for t in side] for side in list(zip(*data))[1:]]
    table = textsim._clipped(*[pa.array(side, pa.list_(pa.string())) for side in lists], 4)
    for a, b, row in zip(*lists, table.tolist(), strict=True):
        a, b = a or [], b or []
        grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        assert row == [len(a), len(b), *[(grams(a, n) & grams(b, n)).total() for n in range(1, 5)]]
    (one, two), ends, words = textsim._numbered(*[pa.array(side, pa.list_(pa.string())) for side in lists])
    assert len(words) == len({w for side in lists for x in side if x for w in x}) and ends[0][-1] == len(one) and ends[1][-1] == len(two)
    out = df.select("pair_id", textsim.rouge_l(F.col("reference"), F.col("candidate"), stemmed=True).alias("f")).collect()
    assert {r.pair_id: round(r.f, 6) for r in out} == {1: round(8 / 9, 6), 2: 0, 3: 0, 4: 0, 5: round(6 / 7, 6), 6: 1, 7: 0}
