import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleforge.llm import language_id as li


def test_gradient():
    net = li.Network(["a", "b"])
    for name in ("embed", "bias", "dense", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters = [f.astype(np.float64) for f in net.filters]
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 20)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        net._freeze()
        return -np.log(net.probabilities(x)[np.arange(6), y]).mean()

    grads = net._gradient(x, y)
    for p, g in zip(net._parameters(), grads):
        flat = np.argsort(-np.abs(g), axis=None)[:2]
        for at in flat:
            i = np.unravel_index(at, p.shape)
            keep = p[i]
            p[i] = keep + 1e-5
            up = loss()
            p[i] = keep - 1e-5
            down = loss()
            p[i] = keep
            assert (up - down) / 2e-5 == pytest.approx(g[i], rel=1e-2, abs=1e-6)


def test_held_out_accuracy_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None), (9002, "", "en"), (9003, "123 !?", "en"), (None, "the and of that", "en")], "doc_id long, text string, lang string")
    rows = li.identify(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in lang]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    by = {r.doc_id: r for r in rows}
    assert {by[i].lang_pred for i in (9001, 9002, 9003)} == {"und"} and by[9001].score == 0
    assert by[None].held_out and all(0 <= r.score <= 1 for r in rows)


def test_nothing_labelled(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert li.identify(df).first().lang_pred == "und"
    assert li.identify(df.limit(0)).count() == 0 and li.keep_identified(df).count() == 0


def test_long_text_is_read_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = li.fit(docs, li.learnable(F.col("doc_id")))
    by = {r.lang: r.text for r in docs.where("n_chars > 300").select("lang", "text").collect()}
    a, b = by["en"], by["fr"]
    assert net.predict([a + b * 40])[0] == ["fr"] and net.predict([a * 40 + b])[0] == ["en"]


def test_numbers_and_signs_are_no_letters():
    network = li.Network(["a", "b"])._freeze()
    names, score = network.predict(["²³", "½ 12", "①②", "Ⅷ", "_", "٣", "ª", "中", "ʰ", "x²"])
    assert names[:6] == ["und"] * 6 and not score[:6].any()
    assert "und" not in names[6:] and score[6:].all()


def test_forward_pass_by_definition():
    """Windows, filters, maxima and softmax with plain loops give the same probabilities and predictions."""
    import numpy as np

    from tripleforge.llm import language_id as li

    rng = np.random.default_rng(3)
    net = li.Network(["a", "b", "c"])
    net.bias[:] = rng.standard_normal(net.bias.shape)
    net.offset[:] = rng.standard_normal(3)
    net._freeze()

    def probabilities(data):
        top = []
        for w, filters, bias in zip(li.WIDTHS, net.filters, net.bias):
            for f in range(li.FILTERS):
                top.append(max(sum(float(net.embed[data[at + j]] @ filters[j, :, f]) for j in range(w)) for at in range(li.WINDOW - w + 1)) + float(bias[f]))
        z = np.maximum(top, 0) @ net.dense + net.offset
        z = np.exp(z - z.max())
        return z / z.sum()

    texts = ["short één", "word and more words " * 17, None, "12 34", ""]
    names, score = net.predict(texts)
    assert names[2:] == ["und"] * 3 and list(score[2:]) == [0, 0, 0]
    for text, name, s in zip(texts[:2], names, score):
        data, total = text.encode(), np.zeros(3)
        for at in range(0, max(1, len(data) - max(li.WIDTHS) + 1), li.WINDOW - max(li.WIDTHS) + 1):
            part = data[at : at + li.WINDOW]
            total += len(part) * probabilities(part.ljust(li.WINDOW, b"\0"))
        assert name == "abc"[total.argmax()] and abs(s - total.max() / total.sum()) < 1e-5
