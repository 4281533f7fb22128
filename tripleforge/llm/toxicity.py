"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: insult, threat, target, negation, reported speech or other.  Small weighted transducers rewrite the
class sequence of a clause: a negation close before an insult marks it negated, a reporting verb before it marks it
reported, a target close before or behind it marks it aimed; a threat says something only if it is aimed and neither
negated nor reported.  They are composed into one transducer, whose states are made as clauses need them.  What a clause
comes to is the sum over the readings that it takes; isolated words have no score of their own outside a clause's reading.
A logistic layer turns a text's sums into a score, its prior being the weights of the arcs.

Insult stems are learned: stems that begin words of toxic training texts but hardly of others are chosen greedily, each
for the toxic texts that no earlier stem explains, so that words which merely stand in copies of one text are not taken
up.  Threat stems are learned alike from the words close to a target, for the toxic texts without an insult.  Targets,
negations and reporting verbs are closed word lists below.

Texts are scored whole.  A null or empty text, and every text if no label can be learned from, has the score of a text
without any match (0 if nothing could be learned).  Rows with a null id are held out.  Repeated rows are scored alike,
a document with several labels is learned from with each, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

THRESHOLD = 0.7
#: Bounds of the training sample, in texts.
TOXIC_TEXTS, CLEAN_TEXTS = 1500, 4000
#: A stem has so many letters at least; it must stand in so many toxic texts, and in clean ones so rarely.
STEM_LETTERS, STEM_TEXTS, STEM_PRECISION = 4, 3, 0.97
MOST_STEMS = 2000
#: Words that the transducers look back or ahead.
NEGATED_WITHIN, REPORTED_WITHIN, AIMED_WITHIN = 3, 8, 4
#: Words before a stem that its reading depends on.
BACK = max(NEGATED_WITHIN, REPORTED_WITHIN, AIMED_WITHIN)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
CLAUSE_END = re.compile(r"[.!?;\n]")

# Closed classes of English, French, German and Spanish.
TARGETS = set("you your yours they them he him she her people women men tu vous toi te il elle ils elles ihr du dich dir sie er ihn tú usted ustedes él ella ellos ellas vosotros".split())
NEGATIONS = set("not no never none nobody isn't aren't wasn't don't doesn't didn't won't can't ne pas jamais aucun nicht kein keine keinen nie niemals nunca jamás ningún ninguna".split())
REPORTS = set("said says say wrote writes called calls reported reports quoted quotes claimed alleged dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split())

class Transducer:
    """Rewrites symbols one by one: ``step`` gives the next state, the symbols that come out and the arc's weight (a logarithm).

    Every symbol comes out once, in order, at the latest at END.
    """

    start: object

    def step(self, state, symbol: str) -> tuple[object, tuple[str, ...], float]:
        raise NotImplementedError

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        """What the symbols of a clause become, and the weight of the way."""
        state, out, weight = self.start, [], 0.0
        for x in [*symbols, END]:
            state, more, w = self.step(state, x)
            out += more
            weight += w
        return [x for x in out if x != END], weight


class Behind(Transducer):
    """Rewrites what stands within ``reach`` words after a mark.  Its state is the number of words since the last mark."""

    def __init__(self, mark: str, reach: int, rewrite: dict[str, tuple[str, float]]):
        self.mark, self.reach, self.rewrite, self.start = mark, reach, rewrite, reach + 1

    def step(self, state, symbol):
        after = 1 if symbol == self.mark else min(state + 1, self.reach + 1)
        out, weight = self.rewrite.get(symbol, (symbol, 0.0)) if state <= self.reach else (symbol, 0.0)
        return after, (out,), weight


class Ahead(Transducer):
    """Rewrites what stands within ``reach`` words before a mark.  Its state is the symbols that may still be rewritten."""

    def __init__(self, mark: str, reach: int, rewrite: dict[str, tuple[str, float]]):
        self.mark, self.reach, self.rewrite, self.start = mark, reach, rewrite, ()

    def step(self, state, symbol):
        if symbol == END:
            return (), (*state, END), 0.0
        weight = 0.0
        if symbol == self.mark:
            weight = sum(self.rewrite.get(x, (x, 0.0))[1] for x in state)
            state = tuple(self.rewrite.get(x, (x, 0.0))[0] for x in state)
        state = (*state, symbol)
        return (state, (), weight) if len(state) <= self.reach else (state[1:], state[:1], weight)


class Composed(Transducer):
    """The composition: what ``first`` gives out is rewritten by ``second``.  Arcs are made when they are first taken."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second, self.start = first, second, (first.start, second.start)
        self.arcs: dict = {}

    def step(self, state, symbol):
        if (known := self.arcs.get((state, symbol))) is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            a, b = state
            a, between, weight = self.first.step(a, symbol)
            out: tuple[str, ...] = ()
            for x in between:
                b, more, w = self.second.step(b, x)
                out, weight = out + more, weight + w
            known = self.arcs[state, symbol] = (a, b), out, weight
        return known


END = "#"
#: Arcs of a composition that are remembered.
MOST_ARCS = 200_000
#: Readings of an insult or threat by the grammar, and the symbols that stand for them when all rewriting is done.
READINGS = ("plain", "aimed", "negated", "reported", "threat")
SYMBOLS = {"I": 0, "Ia": 1, "In": 2, "Ir": 3, "Ha": 4}
NEGATED, REPORTED, AIMED, THREAT = math.log(0.4), math.log(0.4), math.log(1.3), math.log(0.6)


def transducers() -> list[Transducer]:
    """Negation, reported speech, targets before and targets behind, in the order in which they apply."""
    aimed = {"I": ("Ia", AIMED), "H": ("Ha", THREAT)}
    return [
        Behind("N", NEGATED_WITHIN, {"I": ("In", NEGATED), "H": ("o", 0.0)}), Behind("R", REPORTED_WITHIN, {"I": ("Ir", REPORTED), "H": ("o", 0.0)}),
        Behind("T", AIMED_WITHIN, aimed), Ahead("T", AIMED_WITHIN, aimed),
    ]


def closed_class(word: str) -> str | None:
    return "N" if word in NEGATIONS else "R" if word in REPORTS else "T" if word in TARGETS else None


@cache
def composed() -> Transducer:
    """The composition of all transducers."""
    return reduce(Composed, transducers())


#: The logistic layer's prior: what the arcs that lead to a reading weigh.
PRIOR = np.exp([composed().run(x)[1] for x in (["I"], ["T", "I"], ["N", "I"], ["R", "I"], ["T", "H"])])


class Grammar:
    """Weighted stems of insults and threats, closed classes and the logistic layer."""

    def __init__(self, stems: dict[str, float], weights: np.ndarray | None = None, bias: float = 0.0, threats: dict[str, float] | None = None):
        self.stems, self.bias, self.threats = stems, bias, threats or {}
        self.weights = PRIOR if weights is None else weights
        self.finder = ahocorasick.Automaton()
        for stem in [*stems, *self.threats]:
            self.finder.add_word(stem, stem)
        self.finder.make_automaton()

    def __reduce__(self):
        return Grammar, (self.stems, self.weights, self.bias, self.threats)

    def _class(self, word: str) -> tuple[str, float]:
        if (known := closed_class(word)) is not None:
            return known, 0.0
        for symbol, stems in (("I", self.stems), ("H", self.threats)):
            for n in range(STEM_LETTERS, len(word) + 1):
                if (weight := stems.get(word[:n])) is not None:
                    return symbol, weight
        return "o", 0.0

    def _clauses(self, text: str) -> Iterator[list[str]]:
        """Words of the clauses in which a stem begins a word; parts of a clause out of every reach are left out."""
        if not len(self.finder):
            return
        at = sorted({end + 1 - len(stem) for end, stem in self.finder.iter(text)})
        at = [start for start in at if not start or not (text[start - 1].isalnum() or text[start - 1] == "_")]
        begin = end = k = 0
        while k < len(at):
            if at[k] >= end:  # the next clause that holds a stem
                begin = max(end, 1 + max(text.rfind(c, end, at[k]) for c in ".!?;\n"))
                after = CLAUSE_END.search(text, at[k])
                end = after.start() if after else len(text)
            words = list(WORD.finditer(text, begin, end))
            starts, spans = [m.start() for m in words], []
            while k < len(at) and at[k] < end:
                i = bisect_right(starts, at[k]) - 1
                first, last = max(0, i - BACK), i + 1 + AIMED_WITHIN
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last)
                elif i >= 0:
                    spans.append([first, last])
                k += 1
            for first, last in spans:
                yield [m[0] for m in words[first:last]]

    def features(self, text: str | None) -> np.ndarray:
        """Sums of the weights of the text's arcs, by reading; each sum is damped so that length alone doesn't decide."""
        out, machine = np.zeros(len(READINGS)), composed()
        for words in self._clauses((text or "").lower()):
            classes = [self._class(w) for w in words]
            symbols, _ = machine.run([c for c, _ in classes])
            for x, (_, weight) in zip(symbols, classes, strict=True):
                if (reading := SYMBOLS.get(x)) is not None:
                    out[reading] += weight
        return np.log1p(out)

    def score(self, features: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 1 / (1 + exp(-bias)) without any match."""
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def _words(text: str | None) -> tuple[set[str], set[str]]:
    """The words of a text that are long enough for a stem; and those of them that stand close to a target in a clause."""
    every, near = set(), set()
    for clause in CLAUSE_END.split((text or "").lower()):
        words = WORD.findall(clause)
        every.update(words)
        for i in (i for i, w in enumerate(words) if w in TARGETS):
            near.update(words[max(0, i - AIMED_WITHIN) : i + 1 + AIMED_WITHIN])
    return {w for w in every if len(w) >= STEM_LETTERS}, {w for w in near if len(w) >= STEM_LETTERS and closed_class(w) is None}


def _stems(word: str) -> Iterator[str]:
    yield from (word[:n] for n in range(STEM_LETTERS, len(word) + 1))


def _unlike(texts: list[set[str]]) -> list[set[str]]:
    """Texts without near copies: of those that share most of a small sketch of their words, the first."""
    out, seen = [], set()
    for words in texts:
        sketch = sorted(words, key=lambda w: zlib.crc32(w.encode()))[:4]
        pairs = {(a, b) for i, a in enumerate(sketch) for b in sketch[i + 1 :]} or {tuple(sketch)}
        if not pairs & seen:
            out.append(words)
        seen |= pairs
    return out


def learn_stems(toxic: list[set[str]], clean: list[set[str]], odds: float) -> dict[str, float]:
    """Stems with their weights, from the words of toxic and clean texts; ``odds``: clean texts in all per sampled one, over the same for toxic."""
    unlike = _unlike(toxic)
    toxic = unlike if len(unlike) > STEM_TEXTS else toxic
    holds: dict[str, set[int]] = defaultdict(set)
    for i, words in enumerate(toxic):
        for w in words:
            for s in _stems(w):
                holds[s].add(i)
    holds = {s: d for s, d in holds.items() if len(d) >= STEM_TEXTS}
    against: Counter = Counter()
    for words in clean:
        against.update({s for w in words for s in _stems(w) if s in holds})
    precise = {s: d for s, d in holds.items() if len(d) / (len(d) + odds * against[s]) >= STEM_PRECISION}
    out: dict[str, float] = {}
    left = set(range(len(toxic)))
    # A stem's unexplained texts only get fewer, so an old count is an upper bound.
    heap = [(-len(d), -len(s), s) for s, d in precise.items()]
    heapq.heapify(heap)
    while heap and left and len(out) < MOST_STEMS:
        _, _, s = heapq.heappop(heap)
        now = len(precise[s] & left)
        if now < STEM_TEXTS:
            continue
        if heap and (-now, -len(s), s) > heap[0]:
            heapq.heappush(heap, (-now, -len(s), s))
            continue
        out[s] = float(np.log((len(precise[s]) + 0.5) / (odds * against[s] + 0.5)))
        left -= precise[s]
    # Stems of texts that others explain as well, unless a chosen stem begins them or says as much at greater length.
    for s, d in sorted(precise.items(), key=lambda x: (-len(x[1]), -len(x[0]), x[0])):
        if len(out) < MOST_STEMS and len(d) > STEM_TEXTS and not any(p in out for p in _stems(s)) and not any(t.startswith(s) and len(precise[t]) == len(d) for t in out):
            out[s] = float(np.log((len(d) + 0.5) / (odds * against[s] + 0.5)))
    return {s: max(0.5, min(6.0, w)) for s, w in out.items()}


def fit(docs: DataFrame, labels: DataFrame) -> Grammar | None:
    """A grammar learned from a bounded sample of labelled rows (doc_id, text; doc_id, toxic), or None without both labels."""
    n = {int(r[0] == 1): r[1] for r in labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy((F.col("toxic") == 1).cast("int").alias("t")).count().collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, TOXIC_TEXTS / n[1])).otherwise(min(1.0, CLEAN_TEXTS / n[0]))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull() & (draw < share)).select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
    rows = docs.join(F.broadcast(chosen), "doc_id")  # the sample's bound is this broadcast's

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [_words(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": [" ".join(sorted(w)) for w, _ in words], "aimed": [" ".join(sorted(w)) for _, w in words]})

    found = sorted(rows.mapInPandas(gathered, f"doc_id {dict(rows.dtypes)['doc_id']}, toxic int, words string, aimed string").collect(), key=lambda r: (r.doc_id, r.toxic))
    as_set = lambda words: set(map(sys.intern, words.split()))
    toxic, clean = [as_set(r.words) for r in found if r.toxic], [as_set(r.words) for r in found if not r.toxic]
    if not toxic or not clean:
        return None
    odds = (n[0] / len(clean)) / (n[1] / len(toxic))
    stems = learn_stems(toxic, clean, odds)
    insulting = lambda words: any(s in stems for w in words for s in _stems(w))
    near = [as_set(r.aimed) for r in found if r.toxic and not insulting(r.words.split())]
    threats = learn_stems(near, [as_set(r.aimed) for r in found if not r.toxic], odds) if near else {}
    grammar = Grammar(stems, threats=threats)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "f": [grammar.features(t) for t in pdf["text"]]})

    data = rows.mapInPandas(measure, "toxic int, f array<double>").collect()
    data = sorted((r.toxic, *r.f) for r in data)
    y, x = np.array([d[0] for d in data], float), np.array([d[1:] for d in data])
    weights, bias = _logistic(x, y)
    return Grammar(stems, weights, bias, threats)


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.01) -> tuple[np.ndarray, float]:
    """Newton's method on the log loss, both classes weighing alike, pulled towards the prior weights."""
    w, b = PRIOR.copy(), -1.0
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    full = np.c_[x, np.ones(len(x))]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = full.T @ (each * (p - y)) + np.r_[pull * (w - PRIOR), 0.001 * b]
        h = (full * (each * p * (1 - p))[:, None]).T @ full + np.diag([*[pull] * len(w), 0.001])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / np.abs(step).max())
        w, b = w - step[:-1], b - step[-1]
        if np.abs(step).max() < 1e-6:
            break
    return w, float(b)


def learnable(id_col: Column) -> Column:
    """Rows whose crc32(id as text) leaves remainder 1 by 3 are held out."""
    return F.coalesce(fold(id_col, 3) != 1, F.lit(False))


def scored(grammar: Grammar | None, text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if grammar is None:
                yield pd.Series(np.zeros(len(texts)))
            else:
                yield pd.Series(grammar.score(np.array([grammar.features(t) for t in texts]).reshape(-1, len(READINGS))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    grammar = fit(rows, labels.select("doc_id", "toxic"))
    out = rows.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), scored(grammar, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
