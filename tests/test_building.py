"""Sources, sinks, clients and builders that SQL does not check."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleforge.operators import kg, perturb, similarity
from tripleforge.sources import extraction, storage, tables


def test_policies_and_families():
    assert [extraction.family(m) for m in ("Gemini-2", "gpt-4o", "llama-3-gpt", "mixtral-8x7b", "qwen")] == ["gemini", "openai", "openai", "groq", "local"]
    groq, gemini = extraction.POLICIES["groq"], extraction.POLICIES["gemini"]
    assert groq.wait("Error 429: try again in 1m10s", 0) == 75 and groq.wait("rate_limit", 0) == 65 and groq.wait("bad gateway", 3) == 40
    assert gemini.wait("429 please retry in 7.5s", 0) == 8.5 and gemini.wait("RESOURCE_EXHAUSTED", 1) == 30 and gemini.wait("other", 1) == 0
    made = []
    clients = extraction.Clients({"openai": lambda name: made.append(name) or (lambda text: text)})
    assert clients.get("gpt-4") is clients.get("gpt-4") and made == ["gpt-4"]
    with pytest.raises(ValueError):
        clients.get("llama")


def test_asked_until_a_graph_comes(spark):
    good, none = '{"kg_1": [["a", "b", "c"]]}', '{"kg_1": []}'

    def client():
        calls = {}

        def ask(text):
            n = calls[text] = calls.get(text, 0) + 1
            if text == "broken" or text == "late" and n == 1:
                raise RuntimeError("429")
            return {"none": none, "third": [none, "no json", "so: " + good][min(n, 3) - 1]}.get(text, good)

        return ask

    df = spark.createDataFrame([(x,) for x in ("good", "none", "third", "broken", "late")], "q string").coalesce(1)
    out = {r.q: r.answer for r in extraction.extract(df, "q", client, pause=lambda s: None).collect()}
    assert out == {"good": good, "none": none, "third": "so: " + good, "broken": None, "late": good}
    assert extraction.holds_graph("```json\n" + good + "\n```") and not extraction.holds_graph(None) and not extraction.holds_graph("[1]")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 'a "b"'), (2, None, "c")], "id int, score double, t string")
    assert tables.to_console(df).splitlines() == ["id  score   t", '1   0.5000  a "b"', "2   -       c"]
    with pytest.raises(ValueError):
        tables.to_console(df, 1)
    tables.copy_to(df, [f"{tmp_path}/a", f"{tmp_path}/b"])
    assert [r.t for p in "ab" for r in tables.read_csv(spark, f"{tmp_path}/{p}").orderBy("id").collect()] == ['a "b"', "c"] * 2
    tables.write_split(tables.split_by(df.selectExpr("id", "score as x", "score * 2 as y"), ["id"], {"x": 0.0, "y": 1.0}), f"{tmp_path}/s")
    assert sorted(p.rsplit("/", 1)[1] for p in glob.glob(f"{tmp_path}/s/alpha=*")) == ["alpha=0.0", "alpha=1.0"]
    tables.split_low(df.na.fill(0.0), ["score"], F.col("score") < 0.1, f"{tmp_path}/l")
    assert [tables.read_csv(spark, f"{tmp_path}/l/{n}").count() for n in ("all", "low", "filtered")] == [2, 1, 1]
    assert tables.ordered_by(df, {"t": ["c"]}, drop_others=False).first().t == "c"
    with pytest.raises(ValueError):
        tables.first_source([])
    with pytest.raises(ValueError):
        tables.join_scores(df, df.select("score"), "score")


def test_ordinals(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.lit("x").alias("_range_"))
    got = storage.ordinals(df, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000)) and storage.ordinals(df.limit(0), ["k"], "n").count() == 0


def test_average_linkage_equals_definition():
    rng = np.random.default_rng(0)
    for _ in range(40):
        v = rng.random((rng.integers(1, 18), 4)) - 0.3
        norm = v / np.linalg.norm(v, axis=1, keepdims=True)
        far, own = 1 - norm @ norm.T, [[i] for i in range(len(v))]
        while len(own) > 1:
            d, i, j = min((round(float(far[np.ix_(a, b)].mean()), 9), i, j) for i, a in enumerate(own) for j, b in enumerate(own) if i < j)
            if d > similarity.CLUSTER_CUT:
                break
            own[i] += own.pop(j)
        want = {k: n for n, members in enumerate(sorted(own, key=min)) for k in members}
        assert similarity.average_linkage(v) == [want[k] for k in range(len(v))]


def test_weights_and_graph_scores():
    a, b = [("a", "r", "b")], [("a", "r", "c"), ("d", "q", "b")]
    w = similarity.idf([a, b])
    assert w["a"] == 0 and w["c"] == pytest.approx(np.log(1.5))
    p, r, f = similarity.best_match_prf(["a", "c"], ["a"], similarity.hashed_encoder, {"a": 3.0, "c": 1.0})
    assert p == pytest.approx(1) and r < 1 and f == pytest.approx(2 * p * r / (p + r))
    assert similarity.best_match_prf([], ["a"], similarity.hashed_encoder) == (0.0, 0.0, 0.0)
    assert similarity.aligned_best_match(a, a, similarity.hashed_encoder) == pytest.approx(1)
    assert similarity.transe(a, b) == similarity.transe(a, b) and 0 <= similarity.rotate(a, b) <= 1


def test_odd_rows_of_builders(spark):
    rows = [(1, None), (2, ""), (3, "One. Two 12.5 and 1999, then 7 of 7."), (3, "One. Two 12.5 and 1999, then 7 of 7."), (4, "0 and 1234567890"), (5, "A b. C d. E 1. F. G h.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    t, h = F.col("text"), F.lit(1).cast("long")
    made = {
        "reorder": perturb.reorder(t), "omit": perturb.omit_facts(t), "numbers": perturb.distort_numbers(t, h), "words": perturb.swap_words(t, {"of": "from"}), "linked": perturb.delete_linked_sentence(t),
        "spans": perturb.swap_spans(t, F.lit("One"), F.lit("Two")), "delete": perturb.delete_sentence(t, F.lit("b")), "relation": perturb.replace_relation(t, {"and": "or"}), "invented": perturb.hallucinate(t, F.array(F.lit("One")), F.lit("Ten"), h),
    }
    got = df.select("doc_id", *[c.alias(k) for k, c in made.items()]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and not any(by[i][k] for i in (1, 2) for k in made)
    assert by[3].numbers == "One. Two 5.1 and 1999, then 4 of 4." and by[4].numbers is None
    assert by[3].words.endswith("7 from 7.") and by[3].spans == "Two. One 12.5 and 1999, then 7 of 7."
    assert by[5].omit == "C d. F. G h." and by[5].reorder == "A b. F. E 1. C d. G h." and by[3].relation.startswith("One. Two 12.5 or")
    assert by[3].invented.startswith("Ten. Two 5.1")
    assert perturb.balanced_sample(df.limit(0), "doc_id", ["text"]).count() == 0
    holes = spark.createDataFrame([(1, 0, 0, None, "p", "o"), (1, 0, 1, "s", None, "o"), (1, 0, 2, "S", "p", "O")], "pair_id long, side int, pos int, s string, p string, o string")
    assert [tuple(r) for r in kg.edges(holes).collect()] == [(1, 0, "o", "s", "p")]


def test_pairs_trained_side_by_side_are_as_trained_alone():
    """Rows that are moved when they are looked at end where Adam moves the whole table at each step; pairs don't meet."""
    pairs = [([("a", "p", "b"), ("b", "p", "a"), ("c", "q", "c")], [("A", "q", "d")]), ([("x", "p", "y")], [("z", "p", "x"), ("y", "r", "w"), ("w", "r", "z")]), ([("a", "p", "b")] * 3, [("b", "p", "a")] * 9)]

    def plain(one, two, width=50, epochs=100):
        e, r = ({x: i for i, x in enumerate(sorted({t[k].lower() for t in one + two for k in ks}))} for ks in ((0, 2), (1,)))
        rng, step = np.random.default_rng(0), 0
        table = np.concatenate([rng.uniform(-1, 1, (len(x), width)) * np.sqrt(6 / (len(x) + width)) for x in (e, r)])
        m, v = np.zeros_like(table), np.zeros_like(table)
        for _ in range(epochs):
            for (s, p, o), (a, b) in zip(one + two, rng.integers(0, len(e), (len(one + two), 2)), strict=True):
                h, q, t, step, g = e[s.lower()], len(e) + r[p.lower()], e[o.lower()], step + 1, np.zeros_like(table)
                near, away = table[h] + table[q] - table[t], table[a] + table[q] - table[b]
                if 1 + np.linalg.norm(near) - np.linalg.norm(away) > 0:
                    u, w = (x / (np.linalg.norm(x) + 1e-9) for x in (near, away))
                    for k, d in ((h, u), (q, u), (t, -u), (a, -w), (q, -w), (b, w)):
                        g[k] += d
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                table -= 0.01 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x, y = (table[[e[n] for n in sorted({n.lower() for t in g for n in (t[0], t[2])})]].mean(axis=0) for g in (one, two))
        return float(np.clip(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8), 0, 1))

    together = similarity.translated(pairs, False)
    assert np.allclose(together, [plain(*p) for p in pairs], atol=1e-7)
    assert together == [similarity.transe(*p) for p in pairs]
    assert similarity.translated(pairs, True) == [similarity.rotate(*p) for p in pairs]


def test_a_pair_is_compared_once(monkeypatch):
    """What several methods need of a pair is made once; the scores are those that each method gives alone."""
    a = [("ann", "met", "bob"), ("bob", "saw", "İda"), ("carl", "met", "ann"), ("ann", "met", "dora")]
    b = [("anne", "met", "bob"), ("bob", "sees", "ida"), ("carl", "met", "emil")]
    methods = {k: f for k, f in similarity.METHODS.items() if k in ("wl", "aligned_wl", "pooled", "gaussian", "best_match", "aligned_best_match", "graph_p", "graph_r", "triple_p", "triple_r", "triple_f1")}
    want = {k: f(a, b, similarity.letter_encoder) for k, f in methods.items()}
    seen, plain = [], similarity.cosines
    monkeypatch.setattr(similarity, "cosines", lambda x, y: seen.append(1) or plain(x, y))
    once = similarity.Remembering(similarity.letter_encoder)
    assert {k: f(a, b, once) for k, f in methods.items()} == want
    assert len(seen) == 9  # triples, two mappings, pooled, nodes, relations, and the three after alignment
    counts = similarity.letter_encoder(["Añb", "", "İi\nz", "\ud800a"])
    assert counts.shape == (4, 26) and counts.sum(axis=1).tolist() == [2, 0, 3, 1] and similarity.letter_encoder([]).shape == (0, 26)
