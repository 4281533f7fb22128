import random

from tripleforge.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows, schema=SCHEMA):
    return {(r.conv_id, r.turn): r for r in quotes.reply_ordered(spark.createDataFrame(rows, schema)).collect()}


def test_nested_quotes(spark):
    rows = [
        (1, 0, "a", "The first message says this.\nAnd a second line of it."),
        (1, 1, "b", "> the first  message says THIS.\nI reply to that with my words."),
        (1, 2, "c", ">> The first message says this.\n> I reply to that with my words.\n\nMy own answer to both."),
        (1, 3, "a", "Nothing is quoted by this message."),
        (1, 4, "d", "> And a second line of it.\nLate answer.\n> never said by anybody here\nend"),
        (2, 0, "a", "> The first message says this.\nAnother conversation."),
        (2, 1, "a", None),
        (None, 1, "a", "> x"),
    ]
    got = run(spark, rows)
    assert (got[1, 1].reply_to, got[1, 1].thread, got[1, 1].depth, got[1, 1].text) == (0, 0, 1, "I reply to that with my words.")
    assert (got[1, 2].reply_to, got[1, 2].thread, got[1, 2].depth, got[1, 2].text) == (1, 0, 2, "My own answer to both.")
    assert (got[1, 2].n_quotes, got[1, 2].n_linked) == (2, 2)
    assert (got[1, 3].reply_to, got[1, 3].thread, got[1, 3].depth) == (None, 3, 0)
    assert (got[1, 4].reply_to, got[1, 4].n_quotes, got[1, 4].n_linked, got[1, 4].text) == (0, 2, 1, "Late answer.\nend")
    assert got[2, 0].reply_to is None and got[2, 1].text == "" and got[None, 1].reply_to is None
    assert len(got) == len(rows)


def test_long_chain_against_brute_force(spark):
    rng, rows, parent = random.Random(2), [], {}
    for c in range(3):
        for t in range(40):
            body = f"message number {t} of conversation {c}"
            if t and rng.random() < 0.8:
                parent[c, t] = rng.randrange(t)
                body = f"> message number {parent[c, t]} of conversation {c}\n{body}"
            rows.append((c, t, "u", body))

    def depth(c, t):
        return 0 if (c, t) not in parent else 1 + depth(c, parent[c, t])

    def root(c, t):
        return t if (c, t) not in parent else root(c, parent[c, t])

    got = run(spark, rows)
    for (c, t), r in got.items():
        assert (r.reply_to, r.depth, r.thread) == (parent.get((c, t)), depth(c, t), root(c, t))


def test_order_repeats_and_empty(spark):
    rows = [(1, 1, "a", "> hello there everyone\nyes"), (1, 0, "a", "hello there everyone"), (1, 0, "a", "hello there everyone"), (1, 1, "a", "> hello there everyone\nyes")]
    out = quotes.reply_ordered(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 4 and sorted(r.reply_to is None for r in out) == [False, False, True, True]
    assert quotes.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = quotes.reply_ordered(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_quotes(spark):
    rows = [
        (1, 0, "a", "Yes, at 9"),
        (1, 1, "b", "明天九点见。"),
        (1, 2, "c", "> Yes, at 9\nfine with me"),
        (1, 3, "a", "> 明天九点见。\nsee you then"),
        (1, 4, "b", "ok"),
        (1, 5, "c", "A longer message that is said once.\nok"),
        (1, 6, "a", "> ok\n>> A longer message that is said once.\nthis goes to the longer one"),
        (1, 7, "b", "> ok\n>\nonly the doubtful line"),
    ]
    got = run(spark, rows)
    assert [(got[1, t].reply_to, got[1, t].n_linked) for t in (2, 3, 6, 7)] == [(0, 1), (1, 1), (5, 2), (4, 1)]
