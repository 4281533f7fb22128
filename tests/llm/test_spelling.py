import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tripleforge.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, form string, m string"


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def brute(docs, least_times=3):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least_times}
    form, out = {}, {}
    for w in n:
        around = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = around[0] if around and n[around[0]] >= 2 * n[w] else None
        out[w] = [len(around), n.get(form[w])]
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], *out[w]))
    return sorted(rows, key=repr)


def told(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_wavelet_tree_reports_the_points():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 100):
        value = rng.permutation(n)
        tree = spelling.WaveletTree(value)
        a = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        b = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        got = defaultdict(set)
        for q, v in zip(*tree.report(a[:, 0], a[:, 1], b[:, 0], b[:, 1])):
            assert v not in got[q]
            got[q].add(int(v))
        for q in range(50):
            assert got[q] == {int(v) for v in value[a[q, 0] : a[q, 1]] if b[q, 0] <= v < b[q, 1]}


@pytest.mark.parametrize("letters,m", [("ab", 4), ("abc", 5), ("aé", 3)])
def test_near_pairs_equal_brute_force(letters, m):
    rng = np.random.default_rng(m)
    words = sorted({"".join(rng.choice(list(letters), int(n))).encode("latin-1") for n in rng.integers(m, m + 2, 60)})
    got = Counter()
    for first, last in ((0, m // 2), (m // 2, m + 1)):
        for one, two in spelling.near_pairs(words, m, first, last):
            got.update((words[a], words[b]) for a, b in zip(one, two))
    want = {(x, y) for x in words for y in words if len(x) == m and near(x, y)}
    assert set(got) == want and set(got.values()) <= {1}


@pytest.mark.parametrize("shared", [20_000, 4])
def test_equals_brute_force(spark, monkeypatch, shared):
    """With a small ``MOST_SHARED`` the edit positions are halved down to single ones."""
    monkeypatch.setattr(spelling, "MOST_SHARED", shared)
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abé"), int(n))) for n in rng.integers(4, 9, 150)]
    weight = 1 / (1 + np.arange(150) % 15) ** 2
    docs = [(int(i), " ".join(rng.choice(vocabulary, 80, p=weight / weight.sum()))) for i in range(30)]
    want = brute(docs)
    assert any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)
    assert told(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"))) == want


def test_roots_of_a_chain(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}" if i < 40 else None) for i in range(41)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert got == {f"w{i:03}": "w040" for i in range(40)}


def test_edges(spark):
    long = "q" * 3000
    docs = [(1, None), (2, ""), (3, "1234 .. 5"), (None, "Hallo hallo HALLO"), (4, "hello Hello hello " * 4), (4, "hello Hello hello " * 4), (5, f"{long} {long} {long} {long}x {long}x {long}x"), (6, "über Über ÜBER straße straße straße strasse strasse strasse Ωmega")]
    df = spark.createDataFrame([(*r, "x", "y", "z", "0") for r in docs], SCHEMA)
    assert told(spelling.variants(df)) == brute(docs)
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(df.where("doc_id < 4")).count() == 0
