import os

import pytest

from tripleforge.llm import sentencepiece_viterbi as sv

spm = pytest.importorskip("sentencepiece")
HARD = ["", " ", "  x ", "Hello  world\n a", "é​☃ 中文字", "a\tb\r\n\n c", "▁", "x" * 3000, "    " * 9, "the" * 400, "<s> </s> <unk> <0x0A>", "🙂🙂 ñandú", "\x00a", "aaaa aaaaa aaaaaa", "ab" * 333 + " 1234567890 " + "!?" * 77]


@pytest.fixture(scope="module")
def model():
    if not os.path.exists(sv.MODEL):
        pytest.skip("no model file")
    return sv.model_bytes()


def as_unigram(data):
    """The same pieces as a unigram model: the trainer's model type is field 3 of field 2."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto.FromString(data)
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -1.0 - (i * 7919 % 1000) / 100
    return m.SerializeToString()


def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + HARD


def test_bpe_equals_library(spark, sf, model):
    theirs, ours = spm.SentencePieceProcessor(model_proto=model), sv.Encoder(model)
    for t in texts(spark, sf):
        want = theirs.encode(t)
        assert ours.encode(t) == want
        assert ours.decode(want) == theirs.decode(want)
        assert t == ours.decode(want) or sv.SPACE in t


def test_stream_without_memory_of_words(spark, sf, model):
    """The search over whole texts, in blocks of any size, gives the ids that it gives by words, and the library's."""
    theirs, ours = spm.SentencePieceProcessor(model_proto=model), sv.Encoder(model, remember=0)
    for i, t in enumerate(texts(spark, sf)):
        want = theirs.encode(t)
        assert ours.encode(t) == want
        text, n = ours.model.normal(t), (1, 7, 64, 1000)[i % 4]
        assert [k for part in ours.stream(text[j : j + n] for j in range(0, len(text), n)) for k in part] == want


def test_unigram_equals_library(spark, sf, model):
    try:
        data = as_unigram(model)
    except ImportError:
        pytest.skip("no protocol buffers")
    theirs, ours, whole = spm.SentencePieceProcessor(model_proto=data), sv.Encoder(data), sv.Encoder(data, remember=0)
    for t in texts(spark, sf)[:60] + HARD:
        a, b = ours.encode(t), theirs.encode(t)
        assert abs(sum(map(theirs.get_score, a)) - sum(map(theirs.get_score, whole.encode(t)))) < 1e-3
        assert a == b or abs(sum(map(theirs.get_score, a)) - sum(map(theirs.get_score, b))) < 1e-3 and theirs.decode(a) == theirs.decode(b)


def test_window_stays_bounded(model):
    ours, seen, longest = sv.Encoder(model), 0, 0

    def chars():
        nonlocal seen
        for c in (sv.SPACE + "abracadabra") * 5000:
            seen += 1
            yield c

    given = 0
    for part in ours.stream(chars()):
        given += sum(len(ours.model.pieces[k]) for k in part)
        longest = max(longest, seen - given)
    assert given == seen and longest < 10 * ours.model.longest


def test_rows(spark, model):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (2, "x y", None), (None, "x y", "b")], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_ids): (r.ids, r.round_trip) for r in sv.encode(rows, model).collect()}
    assert got[(1, None)] == (None, None) and got[(2, 0)] == ([], True) and got[(2, 2)] == got[(None, 2)]
    back = sv.decode(sv.encode(rows, model), model).collect()
    assert sorted(str(r.text) for r in back) == ["", "None", "x y", "x y"]
    assert sv.encode(rows.limit(0), model).count() == 0
