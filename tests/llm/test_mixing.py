import random
import re

import pytest

from tripleforge.llm import mixing


def test_targets():
    t = mixing.targets({"=a": 100, "=b": 100, "=c": 100, "": 60})
    assert t == pytest.approx({"=a": 360 / 7, "=b": 720 / 7, "=c": 1080 / 7, "": 360 / 7})
    t = mixing.targets({"=a": 1000, "=b": 10, "=c": 10})
    assert t["=b"] == 30 and t["=c"] == 30 and sum(t.values()) == pytest.approx(1020)
    assert mixing.targets({"=a": 0}) == {"=a": 0.0} and mixing.targets({}) == {}


def corpus(n=1500):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "a", "b", "Z", None])
        words = 5 if rng.random() < 0.5 else rng.randint(0, 400)
        rows.append((i, " ".join(["w"] * words) if words else rng.choice([None, "", " \n"]), source))
    return rows


def test_mix_hits_targets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    assert len(got) == len(rows) and {r.doc_id: r["size"] for r in got} == size
    by = {}
    for i, _, s in rows:
        by[s] = by.get(s, 0) + size[i]
    want = mixing.targets({"" if s is None else f"={s}": n for s, n in by.items()})
    source, taken = {i: s for i, _, s in rows}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by[s] and r.target == pytest.approx(want["" if s is None else f"={s}"])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want["" if s is None else f"={s}"]) <= 5
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_repeat_and_edges(spark):
    df = spark.createDataFrame([(1, "a b", "s", "x"), (2, "c d e", "t", "y"), (3, None, None, "z")], "doc_id long, text string, source string, copies string")
    out = mixing.repeat(df)
    plan = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    assert out.columns == df.columns and out.count() == sum(plan.values())
    assert mixing.mix(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b", "s")] * 3, "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(twice).collect()] == [2, 2, 2]


def test_repeat_tells_rows_without_ids_apart(spark):
    """Rows without an id, and rows that share one, are taken as often as the mix says; equal rows share their copies."""
    rows = [(None, f"{'w ' * (i % 7 + 1)}{i}", "ab"[i % 3 == 0], i) for i in range(400)] + [(7, f"x {i}", "b", i) for i in range(60)] + [(None, "y y y", "b", i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _mixed_k long")
    out = mixing.repeat(df).collect()
    taken, size = {}, {}
    for _, t, s, _ in rows:
        size["=" + s] = size.get("=" + s, 0) + len(t.split())
    for r in out:
        taken["=" + r.source] = taken.get("=" + r.source, 0) + len(r.text.split())
    for k, n in mixing.targets(size).items():
        assert abs(taken[k] - n) <= 8
    times = {}
    for r in out:
        times[r.text, r._mixed_k] = times.get((r.text, r._mixed_k), 0) + 1
    equal = [times.get(("y y y", i), 0) for i in range(50)]
    assert max(equal) - min(equal) <= 1
    assert sum(r.copies for r in mixing.mix(df).collect()) == len(out)


def test_rates_and_rounding_by_definition(spark):
    """The dual in numpy, by plain Newton steps, and the rounding, length by length, over the documents themselves."""
    import math

    import numpy as np

    rows = corpus(600)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: "" if s is None else f"={s}" for i, _, s in rows}
    words = {k: sum(size[i] for i in source if source[i] == k) for k in set(source.values())}
    target = mixing.targets(words)
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for k, total in words.items():
        own = np.array([size[i] for i in source if source[i] == k], float)
        tilt = 0.0
        for _ in range(200):  # minimise sum(own) exp(tilt) - tilt target
            mass = float((own * np.exp(tilt)).sum())
            tilt -= max(-1.0, min(1.0, (mass - target[k]) / mass))
        rate = math.exp(tilt)
        ids = [i for i in source if source[i] == k]
        assert all(got[i].rate == pytest.approx(rate) for i in ids)
        base, owed = math.floor(rate + 1e-9), 0.0
        for length in sorted({size[i] for i in ids}, reverse=True):
            same = [i for i in ids if size[i] == length]
            extra = [got[i].copies - base for i in same]
            assert set(extra) <= {0, 1}
            if length:
                owed += (rate - base) * len(same) * length
                want = min(len(same), max(0, round(owed / length))) if base < 3 else 0
                assert sum(extra) == want
                owed -= want * length
