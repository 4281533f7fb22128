"""Forms of verbs, tags, synonyms and the passive."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripleforge.functions import inflection
from tripleforge.operators import perturb, tagging


def test_forms():
    want = {
        "stop": "stop stops stopped stopped stopping", "carry": "carry carries carried carried carrying", "tie": "tie ties tied tied tying", "see": "see sees saw seen seeing", "play": "play plays played played playing",
        "visit": "visit visits visited visited visiting", "submit": "submit submits submitted submitted submitting", "fix": "fix fixes fixed fixed fixing", "reach": "reach reaches reached reached reaching",
        "make": "make makes made made making", "go": "go goes went gone going", "agree": "agree agrees agreed agreed agreeing", "increase": "increase increases increased increased increasing", "have": "have has had had having",
    }
    assert {w: " ".join(inflection.forms(w).values()) for w in want} == want
    assert inflection.forms("give up")["past"] == "gave up" and inflection.forms("text", {"text": ("texted", "texted")})["past"] == "texted"
    table = inflection.inflected({"win": "lose", "accept": "reject", "rise": "fall", "put": "take"})
    assert [table[w] for w in ("wins", "won", "winning", "accepted", "rose", "risen", "puts", "put")] == ["loses", "lost", "losing", "rejected", "fell", "fallen", "takes", "take"]
    assert [inflection.participle(w) for w in ("shows", "inhibits", "studied", "catches", "rose", "uses", "reduce")] == ["shown", "inhibited", "studied", "caught", "risen", "used", "reduced"]


def test_first_replaceable_verb(spark):
    table = inflection.inflected(perturb.VERB_OPPOSITES)
    rows = {
        "Alice Smith Winning nothing. Peter Brown accepted the offer, and Anna Jones wins.": "Alice Smith Losing nothing. Peter Brown accepted the offer, and Anna Jones wins.",
        "They won. Maria Stone is here and Peter Brown increases taxes, joining Anna.": "They won. Maria Stone is here and Peter Brown decreases taxes, joining Anna.",
        "Maria Stone met Peter Brown; he is gaining weight.": "Maria Stone met Peter Brown; he is losing weight.",
        "nobody won": None, "": None, "Maria Stone was Peter Brown.": None, "Accepted by Maria Stone and Peter Brown!  Next.": "Rejected by Maria Stone and Peter Brown! Next.",
    }
    df = spark.createDataFrame([(k, v) for k, v in rows.items()] + [(None, None)], "text string, want string")
    got = df.select("want", perturb.replace_verb(F.col("text"), table).alias("made")).collect()
    assert all(r.made == r.want for r in got)
    assert df.select(perturb.replace_verb(F.col("text"), {}).alias("x")).where("x is not null").count() == 0


NOUNS, PLURALS, NAMES = "doctor drug cell study patient protein trial infection dose treatment".split(), "doctors drugs cells studies patients proteins trials".split(), "Aspirin Berlin Marie Novartis".split()
PAST, PRESENT, ADJECTIVES, ADVERBS = "inhibited reduced observed treated controlled caught showed".split(), "inhibits reduces observes treats controls shows".split(), "small chronic severe early novel".split(), "strongly quickly clearly often".split()


def sentence(rng):
    """A sentence with its tags; 'controls', 'study' and 'shows' are verbs or nouns by their place."""

    def phrase():
        if rng.random() < 0.2:
            return [(rng.choice(NAMES), "NNP")]
        adjective = [(rng.choice(ADJECTIVES), "JJ")] if rng.random() < 0.5 else []
        if rng.random() < 0.4:
            return adjective + [(rng.choice([*PLURALS, "controls", "shows"]), "NNS")]
        return [(rng.choice(["the", "a"]), "DT"), *adjective, (rng.choice(NOUNS), "NN")]

    adverb = [(rng.choice(ADVERBS), "RB")] if rng.random() < 0.4 else []
    verb = (rng.choice(PAST), "VBD") if rng.random() < 0.6 else (rng.choice(PRESENT), "VBZ")
    place = [("in", "IN"), *phrase()] if rng.random() < 0.3 else []
    words = [*phrase(), *adverb, verb, *phrase(), *place, (".", ".")]
    return [(w[0].upper() + w[1:] if i == 0 else w, t) for i, (w, t) in enumerate(words)]


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(1)
    rows = [(i, j, w, t) for i in range(800) for j, (w, t) in enumerate(sentence(rng))]
    return tagging.train(spark.createDataFrame([*rows, (900, 0, None, "NN"), (900, 1, "", "NN"), (901, 0, "x", None)], "sentence long, pos int, word string, tag string"))


def test_held_out_accuracy(spark, tagger):
    """Of new sentences at least 97 % of the words, of words that are verbs or nouns by their place 90 %; also unknown words by their ends."""
    rng, right, total, hard, n_hard = random.Random(2), 0, 0, 0, 0
    for _ in range(300):
        words, tags = zip(*sentence(rng))
        for w, want, got in zip(words, tags, tagger.tag(words)):
            right, total = right + (want == got), total + 1
            if w.lower() in ("controls", "shows"):
                hard, n_hard = hard + (want == got), n_hard + 1
    assert right / total >= 0.97 and n_hard > 20 and hard / n_hard >= 0.9
    assert tagger.tag("The patient slowly measured the reaction .".split()) == ["DT", "NN", "RB", "VBD", "DT", "NN", "."]
    df = spark.createDataFrame([("The drug reduced pain.",), (None,), ("",)], "text string").select(tagging.tagged(F.col("text"), tagger).alias("t"))
    got = [None if r.t is None else [x.tag for x in r.t] for r in df.collect()]
    assert got[0][:3] == ["DT", "NN", "VBD"] and got[1] is None and got[2] == []


def test_synonyms(spark, tagger):
    lexicon = {("drug", "noun"): "medicine", ("chronic", "adjective"): "lasting", ("severe", "adjective"): "grave", ("patients", "noun"): "sufferers", ("clearly", "adverb"): "plainly", ("controls", "noun"): "checks", ("cell", "noun"): "cell"}.get
    call = lambda word, kind: lexicon((word, kind))
    rows = {
        "The drug clearly reduced chronic infection.": "The medicine plainly reduced lasting infection.",
        "The drug often controls severe infection. Patients observed chronic controls.": "The medicine often controls grave infection. Patients observed lasting checks.",
        "The drug reduced the cell.": None, "": None,
    }
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows.items())] + [(None, None, 9)], "text string, want string, seed long")
    for r in df.select("want", tagging.synonyms(F.col("text"), F.col("seed"), tagger, call).alias("made")).collect():
        assert r.made == r.want
    one = df.select(tagging.synonyms(F.col("text"), F.col("seed"), tagger, call, most=1).alias("x")).first().x
    assert one is not None and one != next(iter(rows.values())) and sum(a != b for a, b in zip(one.split(), next(iter(rows)).split())) == 1
    stopped = df.select(tagging.synonyms(F.col("text"), F.col("seed"), tagger, call, stop=["drug"]).alias("x")).first().x
    assert stopped is None


def test_passive(spark, tagger):
    rows = {
        "Aspirin inhibits infection.": "Infection was inhibited by Aspirin.",
        "The drug strongly reduced chronic infections.": "Chronic infections were strongly reduced by the drug.",
        "In Berlin. Doctors treated the patient in the trial. The end.": "In Berlin. The patient in the trial was treated by doctors. The end.",
        "The doctor caught small cells.": "Small cells were caught by the doctor.",
        "The small cell.": None, "Doctors observed.": None, "": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in rows.items()] + [(None, None)], "text string, want string")
    for r in df.select("text", "want", tagging.passive(F.col("text"), F.lit(0), tagger).alias("made")).collect():
        assert r.made == r.want, r.text
    assert df.select(tagging.passive(F.col("text"), F.lit(0), tagger, least_words=50).alias("x")).where("x is not null").count() == 0


def test_words_keep_their_tags_beyond_the_vocabulary(spark):
    """Words that the model has no room for are told by ends that never mislead; those that ends don't tell are held first."""
    tag = lambda w: "NN" if w.endswith("tion") and w != "tion" and w[0].isascii() else "XX"
    words = [f"{a}{b}{end}" for a in "abcdeé" for b in "fghijklm" for end in ("tion", "ta")] + ["tion"]
    rows = [(i, 0, w, tag(w)) for i, w in enumerate(words)] + [(10_000 + i, 0, "ata", "XX") for i in range(500)]
    small = tagging.train(spark.createDataFrame(rows, "sentence long, pos int, word string, tag string"), vocabulary=12)
    assert [small.tag([w]) for w in words] == [[tag(w)] for w in words]
    assert small.tag(words) == [tag(w) for w in words] and len(small.words) <= 12
    more = [("20000", 0, "Le", "NNP"), *[(f"3{i}", 0, w, "NNP") for i, w in enumerate(["Za", "Zb", "Zc"] * 10)], ("40000", 0, "le", "XX")]
    large = tagging.train(spark.createDataFrame(more, "sentence string, pos int, word string, tag string"))
    assert large.tag(["Le", "le"]) == ["NNP", "XX"]


def test_synonyms_beyond_the_vocabulary(spark):
    """A word that only looks like a noun by its end is not replaced, also if the model has no room for all words."""
    words = [f"{a}{b}tion" for a in "abcdeé" for b in "fghijklm"]
    rows = spark.createDataFrame([(i, 0, w, "NN" if w[0].isascii() else "XX") for i, w in enumerate(words)], "sentence long, pos int, word string, tag string")
    df = spark.createDataFrame([("aftion éftion bgtion éhtion chtion",)], "text string")
    made = tagging.synonyms(F.col("text"), F.lit(0), tagging.train(rows, vocabulary=8), lambda w, _: f"{w}s")
    assert df.select(made.alias("x")).first().x == "aftions éftion bgtions éhtion chtions"


def test_numerals_are_no_letters_and_seeds_may_be_null(spark):
    """A word ends before ², ½ or Ⅷ, as letters alone make a word of the sample; a row without a seed is changed like others."""
    assert [w for *_, w in tagging.tokens("nation² ½ment aⅧb x_y 3.5 l'an")] == ["nation", "²", "½", "ment", "a", "Ⅷ", "b", "x", "_", "y", "3.5", "l'an"]
    words = [f"{a}{b}tion" for a in "abcde" for b in "fghijklm"]
    tagger = tagging.train(spark.createDataFrame([(i, 0, w, "NN") for i, w in enumerate(words)] + [(99, 0, "x", "XX")], "sentence long, pos int, word string, tag string"))
    df = spark.createDataFrame([("aftion² bgtion½ Ⅷchtion x²", None)], "text string, seed long")
    made = tagging.synonyms(F.col("text"), F.col("seed"), tagger, lambda w, _: f"{w}s")
    assert df.select(made.alias("x")).first().x == "aftions² bgtions½ Ⅷchtions x²"


def test_tags_are_given_out_in_parts(spark, tagger):
    """A batch's words are never held all at once, and counts need no words moved."""
    text = "The drug reduced pain. Ärzte kauften 3 x² drugs, quickly!"
    texts = [text, None, ""] * 300
    parts = list(tagging._in_parts(pd.Series([text] * 10_000, dtype=object), tagger))
    assert sum(map(len, parts)) == 10_000 and max(sum(map(len, p)) for p in parts) < tagging.TOGETHER + 30
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    words = df.select(F.explode(tagging.tagged(F.col("text"), tagger)).alias("t")).where(F.col("t.word").rlike(r"^\p{L}"))
    expected = {r["tag"]: r["n"] for r in words.groupBy("t.tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = tagging.tag_counts(df, "text", tagger)
    assert {r["tag"]: r["n"] for r in counted.collect()} == expected and sum(expected.values()) % 300 == 0
    assert "explode" not in counted._jdf.queryExecution().toString()
