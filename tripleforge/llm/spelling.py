"""Spelling variants by two-dimensional range reporting on wavelet trees.

Two words are near if one inserted, deleted or replaced code point makes them equal.  The words of one length are points:
their places in forward and in reverse order.  For an edit at position k of a word, the words that begin like it up to k
are an interval in forward order, those that end like it after k an interval in reverse order, and the near words are the
points in both, which a wavelet tree over the reverse places reports in time that grows with their number.

The words are spread over tasks by what an edit leaves whole: for edits at positions a to b of words of m code points,
near words share the first a and the last m - b code points.  They begin with the two halves of the positions; where more
than ``MOST_SHARED`` words share such a key, the positions are halved again for these, down to single ones, for which the
words of a key differ in one code point.  So no task holds more than its share, and each near pair meets exactly once.

Texts without letters, null texts and empty tables have no words.  A null id is written as an empty string where the id
is hashed.  Repeated rows count as often as they stand there.  Words of any length are words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, with_facts

#: One occurrence in so many has a code point deleted.
TYPO = 97
LEAST_LENGTH, LEAST_TIMES = 5, 3
#: A form has at least so many times the word's occurrences.
FORM_TIMES = 2
#: More words with one key are dealt by halves of their edit positions.
MOST_SHARED = 20_000
#: Code points of the words that one task indexes, about.
TASK_POINTS = 4_000_000
#: Distinct words that a task counts before it hands them on.
MOST_HELD = 300_000
#: Range queries that go down a tree together.
CHUNK = 1 << 18

#: Latin-1 code points of words; A-Z are lower-cased, all else is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """word, n: how often each word of at least ``least`` code points stands in the texts, after the deletions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def given() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return out

        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                if text is None:
                    continue
                salt = zlib.crc32(f"{name}:".encode("utf-8", "surrogatepass"))
                for run_, n in Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()).items():
                    h = zlib.crc32(run_ if run_.isascii() else run_.decode("latin-1").encode(), salt)
                    if h % TYPO == 0:
                        at = h % len(run_)
                        run_ = run_[:at] + run_[at + 1 :]
                    if len(run_) >= least:
                        held[run_] += n
                if len(held) > MOST_HELD:
                    yield given()
        if held:
            yield given()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """Points (i, value[i]) of a permutation, as one row of bits a level, highest bit first, with the numbers of ones before each place."""

    def __init__(self, value: np.ndarray):
        self.bits = max(1, int(len(value) - 1).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (value >> bit & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(one, dtype=np.int64))))
            self.zeros.append(int(len(value) - one.sum()))
            value = np.concatenate((value[~one], value[one]))

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries, and the values in [least, most) of their points with low <= i < high."""
        who, first = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level in range(self.bits):
            width = 1 << (self.bits - 1 - level)
            ones = self.ones[level]
            a, b = ones[low], ones[high]
            who, first = np.concatenate((who, who)), np.concatenate((first, first + width))
            low, high = np.concatenate((low - a, self.zeros[level] + a)), np.concatenate((high - b, self.zeros[level] + b))
            on = (low < high) & (first < most[who]) & (first + width > least[who])
            who, first, low, high = who[on], first[on], low[on], high[on]
        return who, first


def _order(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the words in sorted order, and how many code points each shares with the one before it there."""
    by = sorted(range(len(words)), key=words.__getitem__)
    shared = np.zeros(len(words), np.int64)
    for i in range(1, len(by)):
        x, y = words[by[i - 1]], words[by[i]]
        n = min(len(x), len(y))
        if x[:n] == y[:n]:
            shared[i] = n
        else:
            p, q = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
            shared[i] = int((p != q).argmax())
    return np.array(by, np.int64), shared


class _Side:
    """Words in one order, with the intervals of those that share a number of code points."""

    def __init__(self, words: list[bytes], of: np.ndarray):
        self.by, self.shared = _order(words)
        self.place = np.empty(len(words), np.int64)
        self.place[self.by] = np.arange(len(words))
        # How many words of either length stand before each place.
        self.before = [np.concatenate(([0], np.cumsum(of[self.by] == k))) for k in (0, 1)]

    def intervals(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the interval of the words that share ``depth`` code points with the word there."""
        cut = self.shared < depth
        cut[0] = True
        at = np.flatnonzero(cut)
        group = np.cumsum(cut) - 1
        return at[group], np.append(at[1:], len(cut))[group]


def near_pairs(words: list[bytes], m: int, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of m code points, and of the near ones of m or m + 1 that edits at the positions from first to before last make.

    A pair of words of equal length comes both ways, one of words of different length once.
    """
    of = np.array([len(w) - m for w in words], np.int64)
    ahead, back = _Side(words, of), _Side([w[::-1] for w in words], of)
    trees, members = {}, {}
    for k in (0, 1):
        own = ahead.by[of[ahead.by] == k]  # the words of this length in forward order
        value = back.before[k][back.place[own]]  # and their places among these in reverse order
        reverse = np.empty(len(own), np.int64)
        reverse[value] = own
        trees[k], members[k] = (WaveletTree(value) if len(own) else None), reverse
    asking = np.flatnonzero(of == 0)
    held: dict[int, list] = {0: [], 1: []}
    size = {0: 0, 1: 0}

    def answers(k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        who, at, low, high, least, most = (np.concatenate(x) for x in zip(*held[k], strict=True))
        held[k], size[k] = [], 0
        for i in range(0, len(who), CHUNK):
            part = slice(i, i + CHUNK)
            asked, value = trees[k].report(low[part], high[part], least[part], most[part])
            one, two = who[part][asked], members[k][value]
            if k:  # a code point put in beside an equal one makes the same word: only the first such place counts
                p = at[part][asked]
                new = np.array([x == 0 or words[w][x] != words[w][x - 1] for w, x in zip(two, p, strict=True)], bool)
            else:
                new = one != two
            if new.any():
                yield one[new], two[new]

    for at in range(first, last):
        for k in (0, 1):
            rest = m - at - 1 + k  # code points behind the edit
            if trees[k] is None or rest < 0:
                continue
            a, b = (x[ahead.place[asking]] for x in ahead.intervals(at))
            c, d = (x[back.place[asking]] for x in back.intervals(rest))
            low, high, least, most = ahead.before[k][a], ahead.before[k][b], back.before[k][c], back.before[k][d]
            on = (high - low > 1 - k) & (most - least > 1 - k)  # without an insertion the word itself is one of them
            if on.any():
                held[k].append((asking[on], np.full(int(on.sum()), at), low[on], high[on], least[on], most[on]))
                size[k] += int(on.sum())
                if size[k] > CHUNK:
                    yield from answers(k)
    for k in (0, 1):
        if held[k]:
            yield from answers(k)


def _dealt(words: DataFrame) -> DataFrame:
    """word, n, m, a, b, begin, end: each word by the edits of words of m code points at positions a to b, with the parts that they leave whole."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1))
    rows = words.select("word", "n", m.alias("m")).where("m > 0")
    half = F.floor(F.col("m") / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), (F.col("m") + 1).alias("b")))
    return _keyed(rows.withColumn("p", F.explode(parts)).select("word", "n", "m", "p.a", "p.b"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the code points before a, and the last m - b, which edits at a to before b leave as they are."""
    tail = F.greatest(F.col("m") - F.col("b"), F.lit(0))
    return rows.withColumn("begin", F.substring("word", F.lit(1), F.col("a"))).withColumn("end", F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise(""))


KEY = ["m", "a", "b", "begin", "end"]


def shared_keys(words: DataFrame) -> tuple[DataFrame, int]:
    """The words by keys that at least two words have, and no more than ``MOST_SHARED`` unless a key leaves one position; and their code points."""
    rows, done, points = _dealt(words), None, 0
    while True:
        sizes = durable(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
        wide = (F.col("times") > MOST_SHARED) & (F.col("b") - F.col("a") > 1)
        total, n_wide, length = sizes.agg(F.sum("times"), F.count_if(wide), F.sum(F.col("times") * (F.col("m") + 1))).first()
        if not total:
            return (done if done is not None else rows.limit(0)), points
        met = with_facts(rows, sizes, KEY, "times", total)
        if not n_wide:
            met = met.drop("times")
            return (done.unionByName(met) if done is not None else met), points + length
        met = durable(met)
        small = met.where(~wide).drop("times")
        points += met.where(~wide).agg(F.coalesce(F.sum(F.col("m") + 1), F.lit(0))).first()[0]
        done = small if done is None else done.unionByName(small)
        half = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        parts = F.array(F.struct("a", half.alias("b")), F.struct(half.alias("a"), "b"))
        rows = _keyed(met.where(wide).withColumn("p", F.explode(parts)).select("word", "n", "m", "p.a", "p.b"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n of all words (word, n) that have near ones: their number, and the one of largest n, the first of equals."""
    rows, points = shared_keys(words)
    tasks = max(1, -(-points // TASK_POINTS), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame(columns=["word", "n", "m", "a", "b"])])
        for (m, a, b), own in pdf.groupby(["m", "a", "b"]):
            text, n = own["word"].to_numpy(), own["n"].to_numpy(np.int64)
            words_ = [w.encode("latin-1") for w in text]
            length = np.fromiter(map(len, words_), np.int64, len(words_))
            rank = np.empty(len(words_), np.int64)
            rank[sorted(range(len(words_)), key=words_.__getitem__)] = np.arange(len(words_))
            count, best = np.zeros(len(words_), np.int64), np.full(len(words_), -1)

            def told(one: np.ndarray, two: np.ndarray) -> None:
                """Notes the words ``two`` as near to ``one``."""
                np.add.at(count, one, 1)
                seen = best[one]
                by = np.lexsort((rank[two], -n[two], one))
                one, two, seen = one[by], two[by], seen[by]
                at = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1])))
                one, two, seen = one[at], two[at], seen[at]
                better = (seen < 0) | (n[two] > n[seen]) | ((n[two] == n[seen]) & (rank[two] < rank[seen]))
                best[one[better]] = two[better]

            for one, two in near_pairs(words_, int(m), int(a), int(b)):
                told(one, two)
                if (longer := length[two] > m).any():
                    told(two[longer], one[longer])
            at = np.flatnonzero(count)
            if len(at):
                yield pd.DataFrame({"word": text[at], "n_near": count[at], "form": text[best[at]], "form_n": n[best[at]]})

    met = rows.select("word", "n", *KEY).repartition(tasks, *KEY).drop("begin", "end")
    found = met.mapInPandas(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of all rows (word, form) that have a form: the last word that following forms leads to.

    Pointers are doubled; a form stands at least twice as often as its word, so a chain of forms has at most the logarithm
    of the largest count of links, and the doubling ends after the logarithm of that.
    """
    now = durable(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        facts = now.groupBy("root").agg(F.count(F.lit(1)).alias("times"))
        facts = durable(facts.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left"))
        total, moving = facts.agg(F.sum("times"), F.count("next")).first()
        if not moving:
            return now
        now = durable(with_facts(now, facts, "root", "times", total).select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_times: int = LEAST_TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.  ``form`` is the near word of largest n if that is at least twice the word's."""
    words = durable(counted(docs, id_col, text_col).where(F.col("n") >= least_times))
    near = words.join(near_words(words), "word", "left")
    far = F.col("form_n") >= FORM_TIMES * F.col("n")
    rows = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n"))
    rows = durable(rows)
    out = rows.join(roots(rows), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
