"""Quotation linking: conversations in reply order, without their quotes.  DataFrame functions only.

A line's quote level is the number of ``>`` that begin it.  A passage is a run of lines of one level.  Passages and
their lines are normalised (lower case, single spaces), hashed, and joined to the first message of the conversation
that says the same in its own words, that is at level 0.  A message replies to the earlier message that most characters
of its outermost linked passages come from; of equals, to the latest.  Short passages that several turns say come after
all others.  Following replies upwards gives each message its
thread (the turn at which it starts) and its depth.

A null text has no words and quotes nothing; a null conversation or turn is passed through without a link.  Rows that
repeat a turn are messages of their own, which share what replies to that turn.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

MARKERS = r"^\s*(?:>\s?)+"
QUOTES = r"(?m)^\s*>"
#: Shorter lines and passages, in characters, are doubtful where several turns say them: any other link goes before.
LEAST_CHARS = 12


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKERS, 0), r"[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, lines: each line with its level and its words, and quotes: whether any level is above 0."""
    line = lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKERS, "").alias("words"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    quotes = text.rlike(QUOTES)
    plain = F.array(F.struct(F.lit(0).alias("level"), text.alias("words")))  # a message without quotes is one piece
    return conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.when(quotes, F.transform(F.split(text, "\n"), line)).otherwise(plain).alias("lines"), quotes.alias("quotes"),
    )


def _own(lines: Column) -> Column:
    """The text without quotes."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["words"]), "\n")
    return F.regexp_replace(own, r"^\s+|\s+$", "")


def passages(said: DataFrame) -> DataFrame:
    """conv_id, turn, place, level, units: the passages of messages that quote, each with its normalised whole and lines."""
    rows = said.where("quotes").select("conv_id", "turn", "lines")
    first = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i)["level"] != F.get("lines", i - 1)["level"]))
    rows = rows.withColumn("first", first)
    end = lambda j: F.coalesce(F.get("first", j + 1), F.size("lines"))
    run = F.transform("first", lambda i, j: F.struct(F.get("lines", i)["level"].alias("level"), F.transform(F.slice("lines", i + 1, end(j) - i), lambda x: x["words"]).alias("words")))
    rows = rows.select("conv_id", "turn", F.posexplode(run).alias("place", "run"))
    return rows.select("conv_id", "turn", "place", F.col("run.level").alias("level"), _units(F.col("run.words")).alias("units"))


def _units(words: Column) -> Column:
    """What a passage is looked for by: its whole and its lines, normalised, as distinct strings."""
    whole = F.array(normal(F.array_join(words, "\n")))
    return F.array_distinct(F.filter(F.concat(whole, F.transform(words, normal)), lambda x: x != ""))


def links(said: DataFrame) -> DataFrame:
    """conv_id, turn, level, place, chars, sure, origin: for each quoted passage the turns it comes from, and how much of it.

    What a conversation says is reduced to one row for each (conversation, hash) before the join, so the join makes no
    pairs however often a line is repeated or quoted.
    """
    key = F.xxhash64("unit"), F.length("unit").alias("chars")
    asked = passages(said).where("level > 0").select("conv_id", "turn", "place", "level", F.explode("units").alias("unit"))
    asked = asked.select("conv_id", "turn", "place", "level", key[0].alias("hash"), key[1])
    own = F.split(_own(F.col("lines")), "\n")
    told = said.join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
    told = told.select("conv_id", "turn", F.explode(_units(own)).alias("unit")).groupBy("conv_id", F.xxhash64("unit").alias("hash")).agg(F.min("turn").alias("origin"), F.max("turn").alias("last"))
    sure = (F.col("chars") >= LEAST_CHARS) | (F.col("last") == F.col("origin"))
    return asked.join(told, ["conv_id", "hash"]).where("origin < turn").groupBy("conv_id", "turn", "level", "place", "origin").agg(F.max("chars").alias("chars"), F.max(sure).alias("sure"))


def parents(linked: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to."""
    by = linked.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("chars").alias("chars"), F.max("sure").alias("sure"))
    best = F.max_by("origin", F.struct("sure", -F.col("level"), F.col("chars"), F.col("origin")))
    return by.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def threads(parent: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread, depth of the messages that reply; found by doubling, in log(depth) joins."""
    now = durable(parent.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        joined = durable(now.join(up, ["conv_id", "thread"], "left"))
        now = joined.select("conv_id", "turn", "reply_to", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.where("higher is not null").isEmpty():
            return now


def reply_ordered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message, in the order (conv_id, thread, turn): conv_id, thread, turn, depth, reply_to, role, text, n_quotes, n_linked.

    ``text`` is what the message says itself.  Rows are ordered over ranges of that order, so a long conversation is
    several tasks' work and is never gathered in one.
    """
    said = messages(conversations, conv_col, turn_col, role_col, text_col)
    linked = durable(links(said))
    told = threads(parents(linked))
    known = linked.select("conv_id", "turn", "place").distinct().groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    quoted = passages(said).where("level > 0").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"))
    facts = quoted.join(told, ["conv_id", "turn"], "left").join(known, ["conv_id", "turn"], "left")
    out = said.select("conv_id", "turn", "role", _own(F.col("lines")).alias("text")).join(facts, ["conv_id", "turn"], "left")
    zero = F.lit(0)
    out = out.select(
        "conv_id", F.coalesce("thread", "turn").alias("thread"), "turn", F.coalesce("depth", zero).alias("depth"), "reply_to", "role", "text",
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"),
    )
    return out.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn")
