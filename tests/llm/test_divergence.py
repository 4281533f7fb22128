import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripleforge.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string"


def brute(docs, least=10, top=10):
    groups, n, df, all_n = set(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        groups.add((lang, source))
        n[lang, source].update(found)
        df[lang].update(found.keys())
        all_n[lang].update(found)
    p, out = {}, []
    for lang, source in groups:
        kept = sorted(t for t, c in df[lang].items() if c >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        p[lang, source], q = share(n[lang, source]), share(all_n[lang])
        own = p[lang, source]
        best = sorted(((-((own[t] - q[t]) ** 2 // (own[t] + q[t])), t) for t in kept if n[lang, source][t] and own[t] > q[t]), key=lambda x: (x[0], x[1].encode()))
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, t) in enumerate(best[:top])]
    for lang, source in groups:
        pairs = sorted(((-sum((a - p[lang, x][t]) ** 2 // (a + p[lang, x][t]) for t, a in p[lang, source].items()), x) for k, x in groups if k == lang and x != source), key=lambda x: (x[0], x[1].encode()))
        out += [(lang, source, "pair", x, -v, i + 1) for i, (v, x) in enumerate(pairs)]
    return sorted(out)


def told(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def made(n):
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("abcdé"), 3)) for _ in range(60)]
    rows = [(" ".join(rng.choice(words[: 20 + 10 * (i % 4)], int(rng.integers(0, 30)))), ["en", "fr", "en", None][i % 4], f"s{i % 7 % 3 if i % 5 else 3}") for i in range(n)]
    return [*rows, ("solo alone", "la", "s0"), ("", "en", "empty"), (None, None, None), ("one two", "la", "s1")]


@pytest.mark.parametrize("cells", [1 << 20, 1 << 16])
def test_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "LEAST_CELLS", cells)
    docs = made(200)
    df = spark.createDataFrame([(1, *r, "x", "y") for r in docs], SCHEMA)
    want = brute(docs)
    assert {r[0] for r in want if r[2] == "pair" and r[4] == 0} >= {"la"} and any(r[2] == "term" for r in want)
    assert told(divergence.audit(df)) == want


def test_sketch_never_underestimates(spark):
    docs = [r for r in made(300) if r[1]]
    df = spark.createDataFrame([(t or "", x, s) for t, x, s in docs], "text string, lang string, source string").repartition(5)
    width, least = 1 << 16, 10
    bits = divergence.sketch(df, width, least)
    found = defaultdict(Counter)
    for text, lang, _ in docs:
        found[lang].update(set(divergence.terms((text or "").encode())))
    rare = 0
    for lang, own in found.items():
        at = divergence.cells(lang, list(own), width)
        on = ((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)
        for c, passes in zip(own.values(), on):
            assert passes or c < least
            rare += not passes
    assert rare  # and what is rare is mostly left out
    assert divergence.sketch(df.limit(0), width, least).sum() == 0


def test_edges(spark):
    long = "wort " * 300_000
    docs = [(None, None, None), ("", "en", None), (long, "en", "a"), *[("Wort wort ÄRGER ärger", "en", "b")] * 12, *[("wort", "en", "a")] * 3, ("x", None, "a")]
    df = spark.createDataFrame([(None, *r, "x", "y") for r in docs], SCHEMA)
    assert told(divergence.audit(df)) == brute(docs)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
