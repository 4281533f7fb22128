import random

import pytest

from tripleforge.llm import toxicity as t


def test_grammar_readings():
    g = t.Grammar({"idiot": 2.0, "scum": 2.0}, threats={"kill": 1.0})
    order = t.READINGS
    read = lambda text: {order[i] for i, x in enumerate(g.features(text)) if x}
    assert read("you are an idiot") == {"aimed"} and read("idiot you are") == {"aimed"}
    assert read("what an idiot thing") == {"plain"} and read("this is not an idiot") == {"negated"}
    assert read("john said the word idiot") == {"reported"} and read("he will kill you") == {"threat"}
    assert read("you never kill anyone") == set() and read("they said you kill it") == set() and read("you kill the idiot") == {"threat", "aimed"}
    assert read("kill the lights") == set() and read("unidiotic words") == set() and read(None) == set()
    assert read("said so. idiots everywhere here") == {"plain"}


def test_learned_stems_ignore_words_of_copies():
    copied = {"aaaabbbb", "ccccdddd", "eeeeffff", "gggghhhh", "badwordx"}
    toxic = [copied | {f"salt{i}"} for i in range(30)] + [{f"w{i}x{j}zz" for j in range(5)} | {"badwordx"} for i in range(30)]
    clean = [{f"c{i}y{j}zz" for j in range(5)} for i in range(60)]
    assert set(t.learn_stems(toxic, clean, 1.0)) == {"badwordx"}


def corpus(n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        rows.append((i, f"word{i}a calm{i}b {'scumbag fools ' if bad else 'gentle '}text{i}c number{i}d more{i}e.", "x"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows + [(1000, None, "x"), (None, "scumbag", "x")], "doc_id long, text string, score string")
    out = t.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in want]
    assert held and all(r.predicted == want[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in out)
    assert len(out) == 402 and next(r for r in out if r.doc_id == 1000).predicted == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.score(docs, none).first().score == 0.0 and t.score(docs.limit(0), none).count() == 0


def test_reach_is_counted_in_words():
    g = t.Grammar({"idiot": 2.0, "scum": 2.0})
    read = lambda text: {t.READINGS[i]: round(float(x), 3) for i, x in enumerate(g.features(text)) if x}
    long = " ".join(["extraordinarily"] * 7)
    assert set(read(f"he said {long} idiot")) == {"reported"}
    for n in range(95, 115):  # an insult across any place behind the first one
        words = "idiot " + "x" * (n - 12) + " scum"
        assert read(words) == read("idiot x scum"), n
    assert set(read("idiot " + "x " * 50 + "never scum")) == {"plain", "negated"}
    assert read("a. idiot; b, scum! c") == read("idiot. scum") and read("scum") == read("scum " + "x " * 500)


def test_composition_equals_one_transducer_after_another():
    rng = random.Random(1)
    for _ in range(3000):
        symbols = rng.choices("NRTIHooo", k=rng.randint(0, 25))
        now, weight = symbols, 0.0
        for machine in t.transducers():
            now, more = machine.run(now)
            weight += more
        got = t.composed().run(symbols)
        assert got[0] == now and got[1] == pytest.approx(weight) and len(now) == len(symbols)
    assert t.PRIOR == pytest.approx([1.0, 1.3, 0.4, 0.4, 0.6])


def test_readings_by_definition():
    """The composed grammar against a direct statement of what each reading means."""
    rng = random.Random(2)
    for _ in range(3000):
        x = rng.choices("NRTIHooo", k=rng.randint(1, 20))
        want = list(x)
        for i, c in enumerate(x):
            before = lambda mark, n: mark in x[max(0, i - n) : i]  # noqa: E731, B023
            aimed = before("T", t.AIMED_WITHIN) or "T" in x[i + 1 : i + 1 + t.AIMED_WITHIN]
            if c in "IH":
                said = "n" if before("N", t.NEGATED_WITHIN) else "r" if before("R", t.REPORTED_WITHIN) else "a" if aimed else ""
                want[i] = "I" + said if c == "I" else "o" if said in ("n", "r") else "H" + said
        assert t.composed().run(x)[0] == want


def test_threats_are_learned(spark):
    rows = [(i, f"we will {'smashing' if i % 3 == 0 else 'greeting'} {'you' if i % 2 else 'lamps'} a{i}bcd e{i}fgh i{i}jkl m{i}nop q{i}rst") for i in range(600)]
    labels = [(i, int(i % 3 == 0 and i % 2 == 1)) for i in range(600)]
    grammar = t.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not grammar.stems and set(grammar.threats) == {"smashing"}
    score = lambda text: grammar.score(grammar.features(text))
    assert score("we will smashing you") > 0.7 > 0.3 > score("we will smashing lamps") and score("you are greeting") < 0.3
