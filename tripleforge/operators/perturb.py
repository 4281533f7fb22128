"""Building labelled pairs: balanced samples, quality filters, and rule-based perturbations of texts and triples.

Choices that would be random are made by a hash of the row and a seed, so every run and every cluster makes the same.
Sentences end with full stops, question marks or exclamation marks.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once
from ..sources.storage import durable, ordinals, written
from . import shared_topics

#: Words and their opposites; any other table is a parameter.
OPPOSITES = {
    "increases": "decreases", "decreases": "increases", "causes": "prevents", "prevents": "causes", "includes": "excludes", "excludes": "includes", "won": "lost", "lost": "won",
    "accepted": "rejected", "rejected": "accepted", "joined": "left", "supports": "opposes", "opposes": "supports", "before": "after", "after": "before",
}
# Verbs and their opposites, for verbs that no larger lexicon has, and verbs that are never replaced.
VERB_OPPOSITES = {
    "increase": "decrease", "expand": "reduce", "support": "oppose", "win": "lose", "create": "destroy", "join": "leave", "lead": "follow", "founded": "dissolved", "help": "hinder",
    "accept": "reject", "approve": "disapprove", "gain": "lose", "build": "demolish", "grow": "decline", "rise": "fall", "improve": "worsen", "defend": "attack", "enter": "exit",
    "begin": "end", "open": "close", "include": "exclude", "allow": "prevent", "promote": "demote", "elect": "dismiss", "appoint": "remove", "produce": "consume", "sell": "buy",
    "send": "receive", "give": "take", "love": "hate", "born": "died", "married": "divorced", "hired": "fired", "passed": "failed", "won": "lost", "gained": "lost",
    "acquired": "sold", "joined": "left", "signed": "rejected",
}
KEPT_VERBS = ["is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did"]


def draw(seed: str, *columns: str) -> Column:
    """A hash that DuckDB computes as well: the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def balanced_sample(df: DataFrame, label: str, key: list[str], n: int | None = None, seed: str = "42") -> DataFrame:
    """As many rows of each label as the rarest has, and ``n`` at most; the first by hash, ties by key.

    Rows are ranked in hash ranges, so no task orders a whole label.
    """
    least = df.groupBy(label).count().agg(F.min("count").alias("c")).first()["c"] or 0
    n = min(n, least) if n is not None else least
    return numbered(df.withColumn("_draw", draw(seed, *key)), label, key).where(F.col("_nth") < n).drop("_draw", "_nth")


def binarize(df: DataFrame, score: str, threshold: float = 3.0) -> DataFrame:
    """``df`` with ``label``: scores of a scale to 1 are stretched to 5, then cut at ``threshold``."""
    top = df.agg(F.max(score).alias("top")).first()["top"]
    factor = 5.0 if top is not None and top <= 1 else 1.0
    return df.withColumn("label", (F.col(score) * factor >= threshold).cast("int"))


#: White space around sentences, as ``\s`` has it.
SPACES = " \t\n\x0b\f\r"


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def of_sentences(text: Column, parts: Column | None, f) -> Column:
    """f of the text's sentences: of ``parts``, where they are known."""
    return once(sentences(text), f) if parts is None else f(parts)


def phrases(text: Column, stop: list[str] = ()) -> Column:
    """Capitalised words of over three ASCII letters in order, each once, without those that begin a sentence's first word."""
    found = F.regexp_extract_all(text, F.lit(r"[a-z,;] ([A-Z][a-z]{3,})"), F.lit(1))
    out = F.array_distinct(found)
    return F.array_except(out, F.array(*[F.lit(w) for w in stop])) if stop else out


def is_prose(text: Column, least: int = 80, most: int = 400) -> Column:
    """No wiki markup, a number of words in range, two full stops."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    stops = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return ~text.rlike(r"\[\[|\{\{|==") & (words >= least) & (words <= most) & (stops >= 2)


def reorder(text: Column, parts: Column | None = None) -> Column:
    """First and last sentence stay, those between are reversed; null for fewer than four.  ``parts`` has the text's sentences, where they are known."""
    made = lambda s: F.when(F.size(s) >= 4, F.array_join(F.concat(F.slice(s, 1, 1), F.reverse(F.slice(s, 2, F.size(s) - 2)), F.slice(s, -1, 1)), " "))
    return of_sentences(text, parts, made)


def delete_sentence(text: Column, holding: Column) -> Column:
    """Without the sentences that hold the phrase; null if none or all do, or for a null phrase."""
    made = lambda s: once(F.filter(s, lambda x: ~F.contains(x, holding)), lambda k: F.when((F.size(k) > 0) & (F.size(k) < F.size(s)), F.array_join(k, " ")))
    return once(sentences(text), made)


def replace_relation(text: Column, opposites: dict[str, str] = OPPOSITES) -> Column:
    """The first word that has an opposite is replaced by it; null if there is none."""
    table = F.create_map(*[F.lit(x) for pair in opposites.items() for x in pair])

    def made(words: Column) -> Column:
        at = F.array_position(F.transform(words, lambda w: table[w].isNotNull()), True).cast("int")
        swapped = lambda n: F.concat(F.slice(words, 1, n - 1), F.array(table[F.get(words, n - 1)]), F.slice(words, n + 1, F.size(words)))
        return once(at, lambda n: F.when(n > 0, F.array_join(swapped(n), " ")))

    return once(F.split(text, " "), made)


def replace_verb(text: Column, table: dict[str, str], kept: list[str] = KEPT_VERBS, phrase: str = r"[A-Z][a-z]{3,}", at_least: int = 2, parts: Column | None = None) -> Column:
    """In the first sentence of so many phrases that has a word of the table, the first such word is replaced; null if there is none.

    ``table`` maps words to words, as ``inflection.inflected`` makes it of a lexicon; words in ``kept`` stay.  Words are
    compared in lower case, between characters that are no ASCII letters, digits or underscores; a capital stays.
    ``parts`` has the text's sentences, where they are known.
    """
    table = {k.lower(): v for k, v in table.items() if k.lower() not in kept}
    if not table:
        return F.lit(None).cast("string")
    words = "|".join(re.escape(w) for w in sorted(table, key=lambda w: (-len(w), w)))
    found = rf"(?is)^(|.*?[^a-z0-9_])({words})($|[^a-z0-9_].*)$"
    there = rf"(?i)(?:^|[^a-z0-9_])(?:{words})(?:$|[^a-z0-9_])"  # where ``found`` matches, without its groups
    by = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def changed(sentence: Column) -> Column:
        def put(word: Column) -> Column:
            other = by[F.lower(word)]
            other = F.when(F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1)), F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 1_000))).otherwise(other)
            return F.concat(F.regexp_extract(sentence, found, 1), other, F.regexp_extract(sentence, found, 3))

        return once(F.regexp_extract(sentence, found, 2), put)

    def made(s: Column) -> Column:
        fits = lambda x: (F.size(F.regexp_extract_all(x, F.lit(phrase), F.lit(0))) >= at_least) & x.rlike(there)
        joined = lambda n: F.array_join(F.transform(s, lambda x, i: F.when(i == n - 1, changed(x)).otherwise(x)), " ")
        # The first sentence that fits; those behind it aren't looked at.
        step = lambda now, x: F.struct((now["i"] + 1).alias("i"), F.when(now["at"] > 0, now["at"]).when(fits(x), now["i"] + 1).otherwise(F.lit(0)).alias("at"))
        first = F.aggregate(s, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), step, lambda now: now["at"])
        return once(first, lambda n: F.when(n > 0, joined(n)))

    return of_sentences(text, parts, made)


#: Numbers that may be changed: up to nine digits before the point.
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


# Per cent to which numbers are changed, for ranked answers and for compound changes.
RANKED_FACTORS, COMPOUND_FACTORS = ((40, 65), (135, 165)), ((40, 70), (130, 170))


def distort_numbers(text: Column, seed: Column, most: int = 3, years: bool = True, factors: tuple[tuple[int, int], tuple[int, int]] = RANKED_FACTORS) -> Column:
    """The first ``most`` numbers times a factor of one of the two ranges, ends included, by the seed and their place.

    Zeros, numbers of more than nine digits and, if ``years``, whole numbers from 1900 to 2024 stay.  Whole numbers stay
    whole, others keep one digit.  Null if no number can be changed.
    """

    def changed(x: Column, i: Column) -> Column:
        (low, end), (high, top) = factors
        step = F.pmod(seed + 7 * i, F.lit(end - low + top - high + 2)).cast("double")
        scaled = x.cast("double") * F.when(step <= end - low, low + step).otherwise(high - (end - low + 1) + step) / 100
        tenths = F.floor(scaled * 10 + 0.5).cast("string")
        parts = F.concat(F.substr(tenths, F.lit(1), F.length(tenths) - 1), F.lit("."), F.substring(tenths, -1, 1))
        one = F.when(F.length(tenths) == 1, F.concat(F.lit("0."), tenths)).otherwise(parts)
        return F.when(x.cast("double") == F.floor(x.cast("double")), F.floor(scaled + 0.5).cast("string")).otherwise(one)

    def eligible(x: Column) -> Column:
        year = x.rlike("^(19[0-9][0-9]|20[01][0-9]|202[0-4])$") if years else F.lit(False)
        return (x.cast("double") > 0) & (F.length(F.regexp_extract(x, "^[0-9]+", 0)) <= 9) & ~year

    def made(numbers: Column) -> Column:
        places = F.slice(F.filter(F.transform(numbers, lambda x, i: F.when(eligible(x), i)), lambda i: i.isNotNull()), 1, most)
        between = F.split(text, NUMBER)
        new = lambda at: F.transform(numbers, lambda x, i: F.when(F.array_contains(at, i), changed(x, i)).otherwise(x))
        joined = lambda at: F.array_join(F.transform(F.zip_with(between, new(at), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), lambda x: x), "")
        return once(places, lambda at: F.when(F.size(at) > 0, joined(at)))

    return once(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), made)


def invert_triples(triples: DataFrame) -> DataFrame:
    """Subject and object exchanged."""
    return triples.withColumns({"s": F.col("o"), "o": F.col("s")})


def swap_spans(text: Column, one: Column, two: Column) -> Column:
    """The two spans exchanged wherever they stand; null unless both are there and differ."""
    mark = F.lit("\ue000")
    there = F.contains(text, one) & F.contains(text, two) & (one != two) & (one != "") & (two != "")
    return F.when(there, F.replace(F.replace(F.replace(text, one, mark), two, one), mark, two))


def importance(sentence: Column, decision: Column | None = None) -> Column:
    """2 for each capitalised word, 1.5 for a digit, 3 if it names the decision, a thirtieth of its words."""
    words = F.size(F.filter(F.split(sentence, r"\s+"), lambda x: x != ""))
    named = F.lit(0.0) if decision is None else F.when((decision != "") & F.contains(F.lower(sentence), decision), 3.0).otherwise(0.0)
    return 2 * F.size(F.regexp_extract_all(sentence, F.lit("[A-Z][a-z]+"), F.lit(0))) + F.when(sentence.rlike("[0-9]"), 1.5).otherwise(0.0) + named + words / 30.0


def omit_facts(text: Column, decision: Column | None = None) -> Column:
    """Without the most important sentence, or the two most important of five and more, the first of equals; null for a single one."""

    def made(s: Column) -> Column:
        worth = F.transform(s, lambda x, i: F.struct(importance(x, decision).alias("v"), (-i).alias("i")))

        def without(w: Column) -> Column:
            first = F.array_max(w)
            second = F.when(F.size(w) >= 5, F.array_max(F.filter(w, lambda x: x != first))["i"]).otherwise(F.lit(1))
            keep = lambda d: F.array_join(F.filter(s, lambda x, i: (i != -d["a"]) & (i != -d["b"])), " ")
            return once(F.struct(first["i"].alias("a"), second.alias("b")), keep)

        return F.when(F.size(s) > 1, once(worth, without))

    return once(sentences(text), made)


def first_success(seed: Column, strategies: list[Column]) -> Column:
    """What the first strategy that isn't null makes of a row; the seed says which is tried first, the others follow in turn."""
    turn, out = F.pmod(seed, F.lit(len(strategies))), None
    for k in range(len(strategies)):
        own = F.coalesce(*strategies[k:], *strategies[:k])
        out = F.when(turn == k, own) if out is None else out.when(turn == k, own)
    return out


def replace_entities(text: Column, entities: Column, replacement: Column, most: int = 3) -> Column:
    """Each of the first ``most`` entities of the text replaced by the replacement, wherever it stands."""
    return F.aggregate(F.slice(entities, 1, most), text, lambda now, e: F.replace(now, e, replacement))


def hallucinate(text: Column, entities: Column, replacement: Column, seed: Column, most: int = 3) -> Column:
    """Up to ``most`` entities replaced and one number changed; null if neither can be."""
    swapped = replace_entities(text, entities, replacement, most)
    return once(swapped, lambda x: once(F.coalesce(distort_numbers(x, seed, 1, False, COMPOUND_FACTORS), x), lambda y: F.when(y != text, y)))


def pair_table(made: dict[str, DataFrame], key: str, text: str = "text", label: int = 0) -> DataFrame:
    """pair_id, key, response1, response2, label, perturbation_type: all generators' changed rows (key, text, made), numbered from 0."""
    out = None
    for name, df in made.items():
        own = df.where("made is not null").select(key, F.col(text).alias("response1"), F.col("made").alias("response2"), F.lit(label).alias("label"), F.lit(name).alias("perturbation_type"))
        out = own if out is None else out.unionByName(own)
    return ordinals(out, [key, "perturbation_type"], "pair_id")


#: Items that are tried as the partner of all others, in hash order, before topics are joined.
TRIED = 8
#: Items of a topic that are sent in one list, by their numbers.
HOLDERS = 16384
#: Pairs that a task counts, about, so that their counts fit its memory.
PAIRS = 4_000_000
#: Items whose numbers each machine gets as a whole, and rows of topics that a task turns to lists, about.
BROADCAST, DEALT = 1_000_000, 1_000_000


def overlap_partner(items: DataFrame, topics: DataFrame, seed: str = "7", most: bool = False, tried: int = TRIED) -> DataFrame:
    """id, other, shared: for each item (id) the one of all others that shares fewest (or ``most``) topics (id, topic).

    For fewest, the first few items in hash order are tried as the partner of all: who shares nothing with one of them is
    done.  Only the others meet those that share something through their topics; among them the first item that shares
    nothing is the first number missing, so no item is compared with all others.  For most, all meet in blocks
    (``shared_topics``).  Of equals, the first in hash order is taken; a single item has no partner.
    """
    order = numbered(items.select("id").distinct().withColumns({"_draw": draw(seed, "id"), "_one": F.lit(0)}), "_one", ["id"])
    order = durable(order.select("id", F.col("_nth").alias("nth")))
    n = order.count()
    if most:
        return _named(_most(order, topics, n), order)
    held = durable(topics.select("id", "topic").distinct().join(order, "id").select("nth", "topic"))
    left, done = order.select("nth"), None
    for b in range(min(tried, n)):
        theirs = held.where(F.col("nth") == b).select("topic")
        sharing = held.join(theirs, "topic", "left_semi").select("nth").distinct()
        free = left.join(sharing, "nth", "left_anti").where(F.col("nth") != b)
        own = free.select("nth", F.lit(b).cast("long").alias("b"), F.lit(0).cast("long").alias("shared"))
        done = own if done is None else done.unionByName(own)
        left = durable(left.join(free, "nth", "left_anti"))
        if left.isEmpty():
            break
    # A topic's items go to each item as lists, dealt by the item, so that pairs are made and counted where they stay.
    pairs = held.groupBy("topic").agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
    parts = max(int(order.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / PAIRS))
    holders = held.groupBy("topic", F.floor(F.col("nth") / HOLDERS).alias("_list")).agg(F.collect_list("nth").alias("others")).drop("_list")
    lists = held.join(left, "nth", "left_semi").join(holders, "topic").select("nth", "others").repartition(parts, "nth")
    met = lists.select("nth", F.explode("others").alias("b")).where("nth <> b").groupBy("nth", "b").agg(F.count(F.lit(1)).alias("shared"))
    pick = F.min(F.struct(F.col("shared").alias("by"), "b", "shared"))
    best = met.groupBy("nth").agg(pick.alias("p")).select("nth", "p.b", "p.shared")
    taken = met.select("nth", "b").unionByName(left.select("nth", F.col("nth").alias("b")))
    place = F.row_number().over(Window.partitionBy("nth").orderBy("b")) - 1
    missing = taken.withColumn("place", place).groupBy("nth").agg(F.count_if(F.col("b") == F.col("place")).alias("free"))
    known = F.col("free") >= n
    rows = missing.join(best, "nth", "left").select("nth", F.when(known, F.col("b")).otherwise(F.col("free")).alias("b"), F.when(known, F.col("shared")).otherwise(0).alias("shared"))
    return _named(rows if done is None else rows.unionByName(done), order)


def _named(rows: DataFrame, order: DataFrame) -> DataFrame:
    named = rows.join(order, "nth").join(order.select(F.col("nth").alias("b"), F.col("id").alias("other")), "b")
    return named.select("id", "other", "shared")


def _most(order: DataFrame, topics: DataFrame, n: int) -> DataFrame:
    """nth, b, shared of all ``n`` items; who shares nothing with any has the first of the others.

    Topics are dealt once, as lists of their items' numbers, which are stored; a topic's repeated rows fall out where they lie.
    """
    least = int(order.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = F.broadcast(order) if n <= BROADCAST else order
    held = topics.where("topic is not null").join(numbers, "id").select(F.col("nth").cast("int").alias("nth"), "topic")
    held = held.repartition(max(least, topics.count() // DEALT), "topic").dropDuplicates(["topic", "nth"])
    lists = held.groupBy("topic").agg(F.array_sort(F.collect_list("nth")).alias("others")).where(F.size("others") > 1)
    met = shared_topics.most_shared(written(lists.select("others")), n, least)
    best = met.groupBy("nth").agg(F.min(F.struct((-F.col("shared")).alias("by"), "b", "shared")).alias("p")).select("nth", "p.b", "p.shared")
    alone = F.when(F.col("nth") == 0, 1).otherwise(0)
    return order.select("nth").join(best, "nth", "left").select("nth", F.coalesce("b", alone).alias("b"), F.coalesce("shared", F.lit(0)).alias("shared"))


def quadruplets(levels: dict[int, DataFrame], key: str) -> DataFrame:
    """Rows key, level, text of the keys that have a text at every level; ``levels`` maps a level to (key, text)."""
    rows = None
    for level, df in levels.items():
        own = df.where("text is not null").select(key, F.lit(level).alias("level"), "text")
        rows = own if rows is None else rows.unionByName(own)
    whole = rows.groupBy(key).agg(F.count_distinct("level").alias("n")).where(F.col("n") == len(levels)).select(key)
    return rows.join(whole, key, "left_semi")


def text_kind(text: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """The kind most of whose keywords the text holds, the first of equals; ``default`` if it holds none."""
    words = F.split(F.lower(text), "[^a-z]+")
    held = [F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) for own in keywords.values()]
    most = F.greatest(*held) if len(held) > 1 else held[0]
    out = F.when(most == 0, default)
    for kind, n in zip(keywords, held, strict=True):
        out = out.when(n == most, kind)
    return out


def first_paragraph(text: Column, of: int = 4, least: int = 80, most: int = 400) -> Column:
    """The first of the text's first paragraphs that is prose; null if none is."""
    return F.get(F.filter(F.slice(F.split(text, "\n"), 1, of), lambda x: is_prose(x, least, most)), F.lit(0))


def numbered(rows: DataFrame, kind: str, ties: list[str], block: int = 1000) -> DataFrame:
    """``rows`` with ``_nth``: the number from 0 of each row in its kind, by ``_draw``; in two levels, by hash ranges.

    Ranges hold about ``block`` rows, and of large tables as many rows as there are ranges, so both levels are small.
    """
    n = rows.count()
    ranges = max(1, min(n // block, math.isqrt(n)))
    rows = rows.withColumn("_range", F.floor(F.col("_draw") * ranges / 2**32))
    before = F.sum("_n").over(Window.partitionBy(kind).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    held = rows.groupBy(kind, "_range").agg(F.count(F.lit(1)).alias("_n"))
    held = held.select(F.col(kind).alias("_k"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(kind, "_range").orderBy("_draw", *ties))
    rows = rows.withColumn("_place", nth).join(held, F.col(kind).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    return rows.withColumn("_nth", F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_k", "_r", "_before")


def consecutive(df: DataFrame, kind: str, title: str, key: str, seed: str = "11", block: int = 1000) -> DataFrame:
    """key, other: rows of one kind two by two in hash order, where their titles differ.

    A row's number in its kind is the count of the kind's earlier hash ranges and its place in its own range of about
    ``block`` rows, so no kind is ordered as a whole and yet at most one row of a kind is left over.
    """
    rows = df.select(F.col(kind).alias("_kind"), F.col(title).alias("_title"), F.col(key).alias("_key"), draw(seed, key).alias("_draw"))
    rows = numbered(rows, "_kind", ["_key", "_title"], block).withColumn("_pair", F.floor(F.col("_nth") / 2))
    row = F.struct("_nth", "_key", "_title")
    pairs = rows.groupBy("_kind", "_pair").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    whole = (F.col("a._nth") < F.col("b._nth")) & F.col("b._key").isNotNull() & (F.col("a._title") != F.col("b._title"))
    return pairs.where(whole).select(F.col("a._key").alias(key), F.col("b._key").alias("other"))


def delete_linked_sentence(text: Column, phrase: str = r"[A-Z][a-z]{3,}", at_least: int = 2) -> Column:
    """Without the first sentence that links so many phrases; null if there is none or it is all."""

    def made(s: Column) -> Column:
        at = F.array_position(F.transform(s, lambda x: F.size(F.regexp_extract_all(x, F.lit(phrase), F.lit(0))) >= at_least), True).cast("int")
        return once(at, lambda n: F.when((n > 0) & (F.size(s) > 1), F.array_join(F.concat(F.slice(s, 1, n - 1), F.slice(s, n + 1, F.size(s))), " ")))

    return once(sentences(text), made)


def swap_words(text: Column, vocabulary: dict[str, str], most: int = 2) -> Column:
    """The first whole-word occurrence of each entry of the vocabulary, in any case, replaced, for ``most`` entries in order; null if none occurs.

    A word ends where no ASCII letter, digit or underscore follows, so punctuation doesn't hide it.
    """
    def replacing(whole: str, by: str):
        def step(v: Column) -> Column:
            hit = (v["n"] < most) & v["x"].rlike(whole)
            return F.struct(F.when(hit, F.regexp_replace(v["x"], whole, f"$1{by}$2")).otherwise(v["x"]).alias("x"), (v["n"] + hit.cast("int")).alias("n"))

        return step

    now = F.struct(text.alias("x"), F.lit(0).alias("n"))
    for a, b in vocabulary.items():
        now = once(now, replacing(rf"(?is)^(|.*?[^a-z0-9_]){a}($|[^a-z0-9_])", b))
    return once(now, lambda v: F.when(v["n"] > 0, v["x"]))


def entity_pool(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """entity, n: what matches the pattern anywhere, and how often."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def corrupt(text: Column, seed: Column, vocabulary: dict[str, str]) -> Column:
    """struct<text, subtype>: changed numbers, or else changed words; null if neither is there."""
    number, words = distort_numbers(text, seed), swap_words(text, vocabulary, 1)
    made = F.struct(F.coalesce(number, words).alias("text"), F.when(number.isNotNull(), "number").otherwise("entity").alias("subtype"))
    return once(made, lambda x: F.when(x["text"].isNotNull(), x))


def until_enough(df: DataFrame, made: str, n: int, key: str, seed: str = "13") -> DataFrame:
    """``n`` of the rows for which something was made, the first in hash order."""
    return df.where(F.col(made).isNotNull()).withColumn("_draw", draw(seed, key)).orderBy("_draw", key).limit(n).drop("_draw")


def papers(df: DataFrame, text: str, words: int = 30, least_sentences: int = 2, most_words: int = 300) -> DataFrame:
    """Rows with so many words and sentences, with ``context``: the first words of the text, single-spaced."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    rows = df.where((F.size(w) >= words) & (F.size(sentences(F.col(text))) >= least_sentences))
    return rows.withColumn("context", F.array_join(F.slice(w, 1, most_words), " "))
