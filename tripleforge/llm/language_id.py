"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each keeps its maximum over the window, and a
softmax layer reads those maxima.  The network is trained in numpy, on the driver, on windows cut from a bounded sample
of labelled texts.  Every text is then cut whole into windows that overlap by the widest filter less one byte, windows
of many texts are run in one batch, and a text's probabilities are its windows' means weighted by their bytes.

A null text, or one without a letter (Unicode category L), is ``und`` with score 0, and so is every text if nothing is labelled.  Rows with a
null id are predicted but never learned from (held_out is true).  Repeated rows are predicted alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 12
#: Bound of the training sample: about so many texts, evenly over the languages, and windows of each.
SAMPLE_TEXTS = 3000
WINDOWS_PER_TEXT = 2
STEPS = 700
BATCH = 64
#: A pipeline keeps a text whose language has at least this probability.
LEAST_SCORE = 0.35
MOST_LANGUAGES = 1000


def sample(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """(lang, excerpt) of about SAMPLE_TEXTS learnable rows, chosen by a hash of the id; excerpts lie anywhere in the text."""
    known = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().orderBy(lang).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return []
    each = SAMPLE_TEXTS / len(counts)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])[F.col(lang)]
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.lit(1), F.length(text) - WINDOW + 1)
    cuts = [F.substr(F.col(text), (F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(WINDOWS_PER_TEXT)]
    rows = known.where(draw < share).select(lang, F.explode(F.array(*cuts)).alias("cut")).collect()
    return sorted((r[0], r[1]) for r in rows)


class Network:
    """Tables of the trained network: one for each place of each width's filters, and the softmax layer."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(7)
        f32 = np.float32
        self.languages = languages
        self.embed = (rng.standard_normal((256, EMBEDDING)) * 0.3).astype(f32)
        self.filters = [(rng.standard_normal((w, EMBEDDING, FILTERS)) * 0.3).astype(f32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), f32)
        self.dense = (rng.standard_normal((len(WIDTHS) * FILTERS, len(languages))) * 0.1).astype(f32)
        self.offset = np.zeros(len(languages), f32)
        self.pairs: list | None = None

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.dense, self.offset]

    def train(self, windows: np.ndarray, labels: np.ndarray) -> Network:
        """Adam on the cross entropy; batches draw every language equally often."""
        rng = np.random.default_rng(11)
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        parameters = self._parameters()
        m, v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        for step in range(1, STEPS + 1):
            at = np.array([rng.choice(of[k]) for k in rng.integers(0, len(of), BATCH)])
            rate = 0.01 * (1 - step / (STEPS + 1))
            for i, g in enumerate(self._gradient(windows[at], labels[at])):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                parameters[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self._freeze()

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        rows = np.arange(len(x))
        found, places = [], []
        for w, filters, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = x.shape[1] - w + 1
            out = sum((self.embed @ filters[j])[x[:, j : j + n]] for j in range(w))
            place = out.argmax(axis=1)
            places.append(place)
            found.append(np.take_along_axis(out, place[:, None, :], axis=1)[:, 0, :] + bias)
        top = np.concatenate(found, axis=1)
        active = np.maximum(top, 0)
        p = _softmax(active @ self.dense + self.offset)
        p[rows, y] -= 1
        p /= len(x)
        back = (p @ self.dense.T) * (top > 0)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], np.zeros_like(self.bias)
        for i, (w, filters) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            d_bias[i] = g.sum(axis=0)
            d = np.zeros_like(filters)
            for j in range(w):
                table = np.zeros((256, FILTERS), np.float32)
                np.add.at(table, (x[rows[:, None], places[i] + j], np.arange(FILTERS)[None, :]), g)
                d[j] = self.embed.T @ table
                d_embed += table @ filters[j].T
            d_filters.append(d)
        return [d_embed, *d_filters, d_bias, active.T @ p, p.sum(axis=0)]

    def _freeze(self) -> Network:
        """Tables by pairs of bytes, so that a filter of width 4 takes two look-ups instead of four."""
        self.pairs = []
        for w, filters in zip(WIDTHS, self.filters, strict=True):
            one = [self.embed @ filters[j] for j in range(w)]
            steps = [(j, (one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, w - 1, 2)]
            self.pairs.append((w, steps, one[-1] if w % 2 else None))
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for each window (a row of WINDOW bytes)."""
        x = x.astype(np.int32)
        two = x[:, :-1] * 256 + x[:, 1:]
        found = []
        for (w, steps, last), bias in zip(self.pairs, self.bias, strict=True):
            n = x.shape[1] - w + 1
            out = None
            for j, table in steps:
                part = table.take(two[:, j : j + n], axis=0)
                out = part if out is None else np.add(out, part, out=out)
            if last is not None:
                out += last.take(x[:, w - 1 : w - 1 + n], axis=0)
            found.append(out.max(axis=1) + bias)
        return _softmax(np.maximum(np.concatenate(found, axis=1), 0) @ self.dense + self.offset)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; windows of all texts are run together, so many at a time."""
        total = np.zeros((len(texts), len(self.languages)))
        queue: list[tuple[int, bytes]] = []
        held = 0

        def run() -> None:
            nonlocal held
            data = b"".join(part.ljust(WINDOW, b"\0") for _, part in queue)
            p = self.probabilities(np.frombuffer(data, np.uint8).reshape(-1, WINDOW))
            np.add.at(total, [i for i, _ in queue], p * np.array([len(part) for _, part in queue])[:, None])
            queue.clear()

        stride = WINDOW - max(WIDTHS) + 1
        seen = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                continue
            seen[i] = True
            data = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(data) - max(WIDTHS) + 1), stride):
                queue.append((i, data[at : at + WINDOW]))
                if len(queue) == 512:
                    run()
        if queue:
            run()
        best = total.argmax(axis=1) if len(self.languages) else np.zeros(len(texts), int)
        score = np.where(seen, total.max(axis=1, initial=0.0) / np.maximum(total.sum(axis=1), 1e-12), 0.0)
        return [self.languages[b] if s else "und" for b, s in zip(best, seen, strict=True)], np.minimum(score, 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def as_windows(excerpts: list[str]) -> np.ndarray:
    data = b"".join(x.encode("utf-8", "surrogatepass")[:WINDOW].ljust(WINDOW, b"\0") for x in excerpts)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW)


def fit(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> Network | None:
    """A trained network, or None if nothing is labelled."""
    rows = sample(docs, may_learn, text, lang, id_col)
    if not rows:
        return None
    languages = sorted({k for k, _ in rows})
    labels = np.array([languages.index(k) for k, _ in rows])
    return Network(languages).train(as_windows([x for _, x in rows]), labels)


def predicted(network: Network | None, text: Column) -> Column:
    """struct<lang_pred, score> of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            if network is None:
                yield pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts))})
                continue
            names, score = network.predict([None if t is None else t for t in texts])
            yield pd.DataFrame({"lang_pred": names, "score": score})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double")(text)


def learnable(id_col: Column) -> Column:
    """Held-out rows, every fifth by crc32 of the id, are never learned from."""
    return F.coalesce(fold(id_col, 5) != 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    network = fit(rows, learnable(F.col("doc_id")))
    out = rows.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), predicted(network, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``, with all their columns."""
    network = fit(docs.select(id_col, text_col, lang_col), learnable(F.col(id_col)), text_col, lang_col, id_col)
    told = predicted(network, F.col(text_col))
    name = "_told"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, told).where((F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= least)).drop(name)
