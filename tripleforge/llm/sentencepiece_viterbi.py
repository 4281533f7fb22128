"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes through the boundaries between characters and extends the best way to each by the pieces that start there,
read off a tree.  A piece is at most ``longest`` characters long, so only the next ``longest`` boundaries are open; whenever
the ways to all of those go through one boundary, the ids before it are committed and forgotten.  What is held is the
characters behind that boundary, whatever the length of the text.  Nothing is committed earlier than that, as it could
change ids.

Unigram models: the way with the largest sum of scores.  BPE models: a sequence of pieces is what the merges make of a
text exactly if each piece alone, and each two neighbours together, come out of the merges unchanged; so every boundary
has just one way, that of the longest piece that stays apart from the one before it.  Both kinds give the ids of the
library.

Where no piece of a model goes on past the end of a word, every way meets there.  The search then commits at each word's
end, and may remember what it found for a word; with ``remember`` 0 it runs over whole texts and finds the same.

Null texts give null ids; an empty text gives no ids.  Repeated rows are encoded alike.  An empty table gives an empty
result.  Texts are encoded whole.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Default model; any other is a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of the words whose ids are remembered, in each of two generations; when the newer is full, the older is forgotten.
REMEMBERED = 64_000_000
#: Bytes that a remembered word takes besides its characters and ids, about.
ENTRY = 200
#: Pairs of pieces whose merging is remembered; then they are forgotten.
MOST_PAIRS = 250_000
LONGEST_REMEMBERED = 64
#: Characters that the search takes in at a time.
BLOCK = 64
#: Texts that are encoded before their ids are handed on.
ROWS = 256
NONE = -1
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


#: What has no UTF-8, so that its bytes are no text.
_SURROGATE = re.compile("[\ud800-\udfff]")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """Pieces, scores and normalisation of a serialised model."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.prefix, self.squeeze, rules = False, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, self.squeeze, rules = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if rules:
            raise ValueError("models with a character map need the library's normaliser")
        if USER in self.kinds:
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        #: Whether no piece goes on past the end of a word, so that every way passes there.
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.by_line = "\n" not in joined  # and whether the same holds for the ends of lines
        self.by_word = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]


class _Merges:
    """Which neighbours the merges of a BPE model leave apart."""

    def __init__(self, model: Model):
        self.pieces, self.rank = model.pieces, {p: -model.scores[i] for p, i in model.ids.items()}
        self.rows: dict[int, dict[int, bool]] = {}  # by ids, left and right
        self.held = 0

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging, again and again, the two neighbours whose join scores best; leftmost first."""
        parts, rank = list(text), self.rank.get
        joins = [rank(x + y, np.inf) for x, y in zip(parts, parts[1:], strict=False)]
        while joins:
            best = min(joins)
            if best == np.inf:
                break
            at = joins.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = rank(parts[at - 1] + parts[at], np.inf)
            if at < len(joins):
                joins[at] = rank(parts[at] + parts[at + 1], np.inf)
        return parts

    def row(self, left: int) -> dict[int, bool]:
        """What is known of the pieces behind ``left``."""
        if self.held > MOST_PAIRS:
            self.rows.clear()
            self.held = 0
        return self.rows.setdefault(left, {})

    def apart(self, left: int, right: int) -> bool:
        self.held += 1
        return left == NONE or self.merge(self.pieces[left] + self.pieces[right]) == [self.pieces[left], self.pieces[right]]


class Encoder:
    """Encodes and decodes texts with one model; ``remember``: bytes of words whose ids are kept, in each of two generations."""

    def __init__(self, data: bytes, remember: int = REMEMBERED):
        self.model, self.remember, self.held = Model(data), remember, 0
        self.lossy = False  # whether a word was met whose ids don't decode to it
        self.merges = _Merges(self.model)  # for BPE models
        self.known: dict[str, bytes] = {}  # of two generations, the newer
        self.older: dict[str, bytes] = {}
        self.text_of = [self._bytes(k) for k in range(len(self.model.pieces))]
        self.tree: dict = {}
        for piece, k in self.model.ids.items():
            if not self.model.bpe or len(piece) == 1 or self.merges.merge(piece) == [piece]:
                node = self.tree
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = k

    def _extend(self, window: str, ids: list[int], last: list[int], score: list[float], start: int, stop: int) -> None:
        """Extends the best ways to the boundaries from ``start`` until ``stop`` by the pieces that begin there.

        Of each boundary, ``ids`` and ``last`` are the id (NONE: a character that no piece covers) and the length of the
        last piece on the way to it.
        """
        tree, longest = self.tree, self.model.longest
        if self.model.bpe:  # of the pieces to a boundary, the first found, which is the longest, that stays apart from its left
            rows, merges = self.merges.rows, self.merges
            for at in range(start, stop):
                left, node, end = ids[at], tree, at
                row = rows.get(left)
                if row is None:
                    row = merges.row(left)
                for c in window[at : at + longest]:
                    node = node.get(c)
                    if node is None:
                        break
                    end += 1
                    if ids[end] < 0 and (k := node.get("")) is not None:
                        stays = row.get(k)
                        if stays is None:
                            stays = row[k] = merges.apart(left, k)
                        if stays:
                            ids[end], last[end] = k, end - at
            return
        scores, floor = self.model.scores, self.model.least - 10.0
        for at in range(start, stop):
            here, node, end = score[at], tree, at
            for c in window[at : at + longest]:
                node = node.get(c)
                if node is None:
                    break
                end += 1
                if (k := node.get("")) is not None and here + scores[k] > score[end]:
                    ids[end], last[end], score[end] = k, end - at, here + scores[k]
            if "" not in tree.get(window[at], ()) and here + floor > score[at + 1]:
                ids[at + 1], last[at + 1], score[at + 1] = NONE, 1, here + floor

    def stream(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of normalised text that comes in blocks; they are given out once they are certain."""
        longest = self.model.longest
        window, start, due = "", 0, 2 * longest
        ids, last, score = [NONE], [0], [0.0]
        unknown = False  # whether the last id given out is that of an unknown character
        for block in itertools.chain(blocks, (None,)):
            if block is not None:
                window += block
                ids += [NONE] * len(block)
                last += [1] * len(block)
                score += [-np.inf] * len(block)
            while start < (stop := len(window) - longest if block is not None else len(window)):
                to = min(stop, max(due, start + 1))
                self._extend(window, ids, last, score, start, to)
                start = to
                if start < due or start == len(window):
                    continue
                due = start + longest
                if meet := self._meeting(ids, last, start, min(len(window), start + longest)):
                    part, unknown = self._given(window, ids, last, meet, unknown)
                    yield part
                    window, ids, last = window[meet:], ids[meet:], last[meet:]
                    score = [x - score[meet] for x in score[meet:]]
                    last[0], start, due = 0, start - meet, due - meet
        if window:
            yield self._given(window, ids, last, len(window), unknown)[0]

    @staticmethod
    def _meeting(ids: list[int], last: list[int], start: int, end: int) -> int:
        """The latest boundary that the ways to ``start`` and to all boundaries reached behind it go through."""
        heads = {start, *(x for x in range(start + 1, end + 1) if ids[x] != NONE)}
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(top - last[top])
        return heads.pop()

    def _given(self, window: str, ids: list[int], last: list[int], end: int, unknown: bool) -> tuple[list[int], bool]:
        """Ids on the way to a boundary, and whether the last is an unknown character; neighbouring ones are one unknown piece."""
        out: list[int] = []
        while end:
            if (k := ids[end]) != NONE:
                out.append(k)
            elif self.model.bytes:
                out += self.model.fallback(window[end - 1])[::-1]
            else:
                out.append(NONE)
            end -= last[end]
        out.reverse()
        if NONE in out:
            ends = out[-1] == NONE
            out = [self.model.unknown if k == NONE else k for i, k in enumerate(out) if k != NONE or not (out[i - 1] == NONE if i else unknown)]
            return out, ends
        return out, unknown and not out

    def packed(self, text: str) -> bytes:
        """Ids of a text, as 32-bit numbers one after another."""
        return self.checked(text)[0]

    def checked(self, text: str) -> tuple[bytes, bool]:
        """The same, and whether they decode to the text; where words are searched alone, each tells its part of it when it is found."""
        model = self.model
        plain = model.by_word and model.by_line and model.bytes and model.prefix and not model.squeeze and text and SPACE not in text
        if not self.remember or not plain or not text.isascii() and _SURROGATE.search(text):
            normal = model.normal(text)
            ids = b"".join(array("i", part).tobytes() for part in self.stream(normal[i : i + BLOCK] for i in range(0, len(normal), BLOCK)))
            return ids, self.decode(np.frombuffer(ids, np.int32).tolist()) == text
        parts: list[bytes] = []
        for nth, line in enumerate(text.split("\n")):
            words = line.split(" ")  # each behind a space, but for the first of a later line
            if nth:
                parts.append(self._found("\n"))
                if words[0]:
                    parts.append(self._found(f"\n{words[0]}"))
                del words[0]
            if "" in words:
                words = _runs(words)
            found = list(map(self.known.get, words))
            if None in found:
                found = [self._found(w) if x is None else x for w, x in zip(words, found, strict=True)]
            parts += found
        ids = b"".join(parts)
        return ids, not self.lossy or self.decode(np.frombuffer(ids, np.int32).tolist()) == text

    def _found(self, key: str) -> bytes:
        """Ids of a word behind a space, or, if the key begins with a line's end, of that end alone or of the word behind it."""
        if (ids := self.known.get(key)) is not None:
            return ids
        if (ids := self.older.get(key)) is None:
            word = key if key == "\n" else key[1:] if key.startswith("\n") else SPACE + key.replace(" ", SPACE)
            ids = self._word(word)
            self.lossy |= b"".join(map(self.text_of.__getitem__, array("i", ids))) != word.replace(SPACE, " ").encode()
        if len(key) <= LONGEST_REMEMBERED:
            if self.held >= self.remember:
                self.older, self.known, self.held = self.known, {}, 0
            self.known[key] = ids
            self.held += ENTRY + len(key) + len(ids)
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word, at whose end all ways meet; a short one is a window of its own."""
        n = len(word)
        if n > BLOCK:
            return b"".join(array("i", part).tobytes() for part in self.stream(word[i : i + BLOCK] for i in range(0, n, BLOCK)))
        ids, last, score = [NONE] * (n + 1), [1] * (n + 1), [0.0, *[-np.inf] * n]
        self._extend(word, ids, last, score, 0, n)
        return array("i", self._given(word, ids, last, n, False)[0]).tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def _bytes(self, k: int) -> bytes:
        piece, kind = self.model.pieces[k], self.model.kinds[k]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " \u2047 ".encode()
        return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode("utf-8", "surrogatepass")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def _runs(words: list[str]) -> list[str]:
    """Words between single spaces, with the spaces of longer runs put before the word that follows; a run at the end is one more, without a word."""
    out, spaces = [], ""
    for word in words:
        if word:
            out.append(spaces + word)
            spaces = ""
        else:
            spaces += " "
    return [*out, spaces[1:]] if spaces else out


_encoders: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """One encoder a worker and model, so that what it remembers serves all its tasks."""
    if (key := hash(data)) not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read on the driver; it is some hundred kB whatever the data."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (null for a null text), n_ids, round_trip: whether decoding the ids gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS):  # few rows' texts and ids are held at a time
                part = batch.slice(at, ROWS)
                both = [(None, None) if t is None else encoder.checked(t) for t in (x.as_py() for x in part.column("text"))]
                sizes = [0 if ids is None else len(ids) // 4 for ids, _ in both]
                none = pa.array([ids is None for ids, _ in both])
                values = pa.array(np.frombuffer(b"".join(ids for ids, _ in both if ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values, mask=none)
                n = pa.array([None if ids is None else k for (ids, _), k in zip(both, sizes, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, n, pa.array([x for _, x in both], pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of the ids (null for null ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [None if x is None else encoder.decode(x) for x in pdf["ids"]]})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
