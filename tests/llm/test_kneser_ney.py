from collections import Counter

import numpy as np
import pytest

from tripleforge.llm import kneser_ney as kn


def brute(train, texts):
    """Interpolated modified Kneser-Ney over bytes, straight from its definition."""
    def grams(t):
        b = bytes([0] * 3) + (t or "").lower().encode().translate(kn._CLEAN) + bytes([1])
        return [b[i : i + 4] for i in range(len(b) - 3)]

    c = {4: Counter(g for t in train for g in grams(t))}
    for k in (3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d, total, passed = {}, {}, {}
    for k, own in c.items():
        n = [sum(v == i for v in own.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
        d[k] = [max(0.05, min(i - 0.05, i - (i + 1) * y * (n[i] / n[i - 1] if n[i - 1] else 0))) for i in (1, 2, 3)]
        for g, v in own.items():
            total[k, g[:-1]] = total.get((k, g[:-1]), 0) + v
            passed[k, g[:-1]] = passed.get((k, g[:-1]), 0) + d[k][min(v, 3) - 1]

    def p(g, k):
        if k == 0:
            return 1 / kn.SYMBOLS
        h = g[-k:][:-1]
        if (k, h) not in total:
            return p(g, k - 1)
        v = c[k][g[-k:]]
        return ((v - d[k][min(v, 3) - 1]) if v else 0) / total[k, h] + passed[k, h] / total[k, h] * p(g, k - 1)

    return [float(np.exp(-np.mean([np.log(p(g, 4)) for g in grams(t)]))) for t in texts]


@pytest.mark.parametrize("broadcast,held,size", [(1 << 20, 1 << 21, 6 << 20), (0, 1 << 21, 6 << 20), (1 << 20, 5, 40)])
def test_against_brute_force(spark, monkeypatch, broadcast, held, size):
    for name, value in (("HELD_OUT", 10**9), ("MOST_BROADCAST", broadcast), ("MOST_HELD", held), ("BUCKET_BYTES", size)):
        monkeypatch.setattr(kn, name, value)
    train = ["the cat sat on the mat", "a cat and a dog", "the dog sat"] * 2 + ["other words here"]
    rows = [(i, "en", t) for i, t in enumerate(train)] + [(20, "en", "the cat sat on a dog"), (21, "en", "zzqx %%% é"), (22, "en", None), (23, None, "no model"), (24, "fr", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    trusted = spark.createDataFrame([(i,) for i in range(len(train))], "doc_id long")
    got = {r.doc_id: r for r in kn.classify(df, trusted).collect()}
    for (i, _, _), want in zip(rows[:-2], brute(train, [t for _, _, t in rows[:-2]])):
        assert got[i].perplexity == pytest.approx(want)
    assert got[23].perplexity == pytest.approx(kn.SYMBOLS) and got[23].lang is None and got[24].n_bytes == 0
    assert got[20].kept and not got[21].kept and len(got) == len(rows)


def test_threshold_comes_from_held_out_texts(spark, monkeypatch):
    """The worst held-out text is kept, being the threshold itself; texts without an id are spread and never trusted."""
    monkeypatch.setattr(kn, "HELD_OUT", 2)
    monkeypatch.setattr(kn, "BUCKET_BYTES", 50)
    rows = [(i, "en", f"some words {'abcdefgh'[i % 8] * (i % 5 + 1)} here") for i in range(60)] + [(None, "en", "some words here")] * 40 + [(100, "en", "@@##")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("bucket", df_lit("x"))
    got = kn.classify(df, spark.createDataFrame([(i,) for i in range(60)] + [(None,)], "doc_id long"), quantile=1.0).collect()
    assert len(got) == len(rows) and sum(r.trusted for r in got) == 60
    worst = max(r.perplexity for r in got if r.kept)
    assert worst == got[0].threshold and any(r.perplexity == worst and r.trusted for r in got)
    assert not next(r for r in got if r.doc_id == 100).kept
    assert len({r.perplexity for r in got if r.doc_id is None}) == 1


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert kn.classify(df, df.select("doc_id")).count() == 0


def test_junk_is_dropped_and_clean_kept(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = kn.classify(docs, labels.where("quality = 1")).join(labels, "doc_id").toPandas()
    assert out.kept[out.quality == 1].mean() > 0.97 and out.kept[out.quality == 0].mean() < 0.5
