"""Nulls, empty tables, repeated rows, long texts and clashing columns in every stage and operator over documents."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripleforge.llm import exact_dedup, kneser_ney, language_id, mixing, sentencepiece_viterbi, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["keep_id", "kept", "fp", "rep", "component_id", "_kept", "raw", "k", "size", "rate", "copies", "score", "lang_pred", "ids", "bucket"]
WORDS = "the quick brown fox jumps over the lazy dog while nine grey cats look on and say nothing at all".split()


def prose(i):
    return " ".join(WORDS[(i * 7 + j * j) % len(WORDS)] + str(i % 3 * j % 5) for j in range(40))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, prose(i), "en" if i % 2 else "fr", "ab"[i % 2], 1) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (22, "   \n", "en", None, 4), (23, "12 34 !!", "fr", "b", 8), (24, prose(3), "en", "b", 1), (24, prose(3), "en", "b", 1)]
    rows += [(None, prose(5), None, "a", 1), (None, prose(99) + " alone", "en", "a", 1), (None, None, None, None, None), (25, "word " * 200_000, "en", "a", 1_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(12)] + [(None, None, None), (3, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage_takes_odd_rows(spark, odd, sf, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, sf)
    if at + 1 < len(corpus_pipeline.STAGES):
        assert out.columns == odd.columns
    assert out.count() > 0
    none = stage(spark, odd.where("false"), sf)
    assert none.count() == 0 and none.columns == out.columns


def test_all_stages_in_a_row(spark, odd, sf):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
    assert docs.count() > 0 and docs.where("not round_trip").count() == 0


def test_rows_without_an_id_stay_if_their_texts_are_alone(spark, odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.where(F.col("doc_id").isNull() & F.col("text").endswith("alone")).count() == 1
    near = simhash.keep_representatives(kept)
    assert near.where(F.col("doc_id").isNull() & F.col("text").endswith("alone")).count() == 1
    # This one's text is that of a row with an id, which stays.
    assert near.where(F.col("doc_id").isNull() & (F.col("text") == prose(5))).count() == 0 and near.where(F.col("doc_id") == 5).count() == 1


def test_one_row_for_each_row(odd, labels):
    n = odd.count()
    good = labels.where("quality = 1").select("doc_id")
    for out in (
        language_id.identify(odd), exact_dedup.exact_dedup(odd), simhash.near_dedup(odd), mixing.mix(odd), toxicity.score(odd, labels), kneser_ney.classify(odd, good),
        sentencepiece_viterbi.encode(odd, sentencepiece_viterbi.model_bytes()),
    ):
        assert out.count() == n, out.columns
