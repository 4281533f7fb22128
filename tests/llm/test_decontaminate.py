import itertools
import re

import numpy as np
import pytest

from tripleforge.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string, items string, spans string, shard string", "item_id string, text string, row string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    """Hit words and items of each document, by comparing every window with every place."""
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for item, other in items:
            x = split(other)
            n = min(window, len(x))
            grams = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= {item} - {None}
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def told(rows):
    return sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s.begin, s.end)], list(r["items"])) for r in rows), key=repr)


def made(seed, n_docs, n_items, letters):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join("".join(x) for x in rng.choice(list(letters), (n, 1)))
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in range(n_docs)]
    return docs, [(str(i % (n_items - 1)), text(int(rng.integers(0, 9)))) for i in range(n_items)]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for letters, copies in ((2, 1), (3, 4), (50, 2)):
        codes = np.concatenate([np.append(rng.integers(1, letters + 1, n), 0) for n in rng.integers(0, 30, 12)] * copies).astype(np.int32)
        ends = np.flatnonzero(codes == 0)
        suffix = lambda i: ([*codes[i : ends[np.searchsorted(ends, i)]].tolist(), 0], i)  # noqa: E731  equal suffixes in the order of their documents
        assert decontaminate.suffix_array(codes).tolist() == sorted(np.flatnonzero(codes).tolist(), key=suffix)
    assert decontaminate.suffix_array(np.zeros(3, np.int32)).tolist() == []


@pytest.mark.parametrize("window,block", [(3, 1 << 23), (4, 40), (10, 1 << 23)])
def test_equals_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = made(window, 60, 25, "abc")
    docs += [(60, "x " * 9), (60, "x x x"), (61, docs[3][1])]
    items += [("r", "x x x x x x"), ("r", "x"), ("s", "x x x x x x")]
    d = spark.createDataFrame([(*r, "", "", "") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "") for r in items], ITEMS)
    want = brute(docs, items, window)
    assert told(decontaminate.matches(d, b, window=window).collect()) == want
    left = sorted(r.doc_id for r in decontaminate.remove(d, b, window=window).collect())
    assert left == sorted(r[0] for r in want if not r[2])


def test_longest_equals_brute_force(spark):
    docs, items = made(5, 40, 12, "abcd")
    items = [(str(i), t) for i, (_, t) in enumerate(items)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r.item_id: r for r in decontaminate.longest(d, b).collect()}
    for item, text in items:
        x, best = split(text), 0
        for _, other in docs:
            w = split(other)
            best = max([best, *(n for i, j in itertools.product(range(len(x)), range(len(w))) for n in [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x[i:], w[j:])))])])
        assert (got[item].n_words if item in got else 0) == best
        if best:
            r = got[item]
            assert split(dict(docs)[r.doc_id])[r.doc_at : r.doc_at + best] == x[r.item_at : r.item_at + best]


def test_edges(spark):
    long = "lorem " * 300_000
    passage = "Ein  Gruß, an alle; die das hier LESEN und mehr"
    docs = [(1, None), (2, ""), (3, "... !"), (None, passage), (None, None), (4, long + passage), (4, "und mehr"), (5, "ein gruß an alle die das hier lesen UND mehr é")]
    items = [("b", passage), ("a", passage), (None, "lorem lorem"), ("b", None), ("c", " , ")]
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
    got = {(r.doc_id, r.n_words): r for r in decontaminate.matches(d, b).collect()}
    assert len(got) == 8 and all(not got[k].spans for k in [(1, 0), (2, 0), (3, 0), (None, 0), (4, 2)])
    assert list(got[None, 10]["items"]) == ["a", "b"] and [tuple(s) for s in got[None, 10].spans] == [(0, 10)]
    assert [tuple(s) for s in got[4, 300_010].spans] == [(0, 300_010)]
    assert [tuple(s) for s in got[5, 11].spans] == [(0, 10)]
    kept = decontaminate.remove(d, b)
    assert kept.columns == d.columns and kept.count() == 5
    none = spark.createDataFrame([], ITEMS)
    assert told(decontaminate.matches(d, none).collect()) == sorted(((i, len(split(t)), [], []) for i, t in docs), key=repr)
    assert decontaminate.remove(d, none).count() == 8 and decontaminate.longest(d, none).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert decontaminate.matches(empty, b).count() == decontaminate.remove(empty, b).count() == decontaminate.longest(empty, b).count() == 0
