"""Triple extraction by a pluggable client, with prompts, recovery of its answers, and resuming."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.kg import PLACEHOLDERS

ANSWER = "map<string, array<array<string>>>"


def prompt(texts: list[Column], head: str = "Extract triples [subject, relation, object] from each text as JSON.") -> Column:
    """The instruction and the numbered texts; the answer has the keys kg_1 to kg_n."""
    return F.concat_ws("\n", F.lit(head), *[F.concat(F.lit(f"Text {i} (kg_{i}): "), F.coalesce(t, F.lit(""))) for i, t in enumerate(texts, 1)])


def recover(answer: Column) -> Column:
    """Triples by key from an answer: fences are stripped; if that is no JSON, the widest braces are tried."""
    bare = F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.from_json(bare, ANSWER), F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), ANSWER))


# The pattern of the message, and the seconds.
def wait_seconds(message: str, extra: float = 5.0, most: float = 120.0, unsaid: float = 60.0) -> float:
    """How long a rate-limit message asks to wait, and a little more; ``unsaid`` if it names no time."""
    found = re.search(r"try again in (?:(\d+)m)?(\d+\.?\d*)s", message)
    return min(most, extra + (60 * int(found[1] or 0) + float(found[2]) if found else unsaid))


@dataclass(frozen=True)
class Policy:
    """How a kind of client is called: tries, seconds between calls, words that tell a rate limit, and the waits after errors."""

    tries: int = 3
    spacing: float = 0.0
    limits: tuple[str, ...] = ("429", "rate_limit")
    after_limit: Callable[[str, int], float] = lambda message, attempt: wait_seconds(message)
    after_error: Callable[[int], float] = lambda attempt: 1.0

    def wait(self, message: str, attempt: int) -> float:
        limited = any(x.lower() in message.lower() for x in self.limits)
        return self.after_limit(message, attempt) if limited else self.after_error(attempt)


def _asked(message: str, attempt: int) -> float:
    found = re.search(r"retry in (\d+(?:\.\d+)?)s", message, re.I)
    return float(found[1]) + 1.0 if found else min(15.0 * 2**attempt, 60.0)


# Tries, spacings, waits and the words of the services' own messages, by family of clients.
POLICIES = {
    "gemini": Policy(5, 4.0, ("429", "RESOURCE_EXHAUSTED"), _asked, lambda attempt: 0.0),
    "openai": Policy(3),
    "groq": Policy(5, after_error=lambda attempt: min(2.0**attempt * 5, 60.0)),
    "local": Policy(3),
}


def family(model: str) -> str:
    """Which family a model's name belongs to; the first rule that holds."""
    name = model.lower()
    for kind, words in (("gemini", ("gemini",)), ("openai", ("gpt", "openai")), ("groq", ("groq", "llama", "mixtral"))):
        if any(w in name for w in words):
            return kind
    return "local"


class Clients:
    """Makes the client of a model by its family's maker, once for each model."""

    def __init__(self, makers: dict[str, Callable[[str], Callable[[str], str]]]):
        self.makers, self.made = makers, {}

    def get(self, model: str) -> Callable[[str], str]:
        if model not in self.made:
            if (kind := family(model)) not in self.makers:
                raise ValueError(f"no client for {kind} models")
            self.made[model] = self.makers[kind](model)
        return self.made[model]


def holds_graph(answer: str | None) -> bool:
    """Whether an answer holds a valid triple under any key: three texts, of which the first and the last are no token of the prompt."""
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", (answer or "").strip())
    for text in (bare, *re.findall(r"(?s)\{.*\}", bare)):
        try:
            value = json.loads(text)
        except ValueError:
            continue
        lists = [x for x in value.values() if isinstance(x, list)] if isinstance(value, dict) else []
        return any(_valid(t) for own in lists for t in own)
    return False


def _valid(triple: object) -> bool:
    whole = isinstance(triple, list) and len(triple) == 3 and all(isinstance(x, str) for x in triple)
    return whole and not any(triple[i].strip().lower() in PLACEHOLDERS for i in (0, 2))


class Turns:
    """When a task may call, so that the calls of all tasks together keep the spacing.

    Time is cut into slots of the spacing's length, which the tasks take in turn by the machines' clocks: nothing is
    agreed on while they run, and a task that is run again has the same slots.  A call begins at the start of a slot.
    """

    def __init__(self, spacing: float, task: int, tasks: int, pause: Callable[[float], None], now: Callable[[], float] = time.time):
        self.spacing, self.task, self.tasks, self.pause, self.now, self.last = spacing, task, tasks, pause, now, -1

    def wait(self) -> None:
        if self.spacing <= 0:
            return
        slot = int(self.now() // self.spacing) + 1
        slot = max(slot + (self.task - slot) % self.tasks, self.last + self.tasks if self.last >= 0 else 0)
        self.last = slot
        if (early := slot * self.spacing - self.now()) > 0:
            self.pause(early)


def extract(
    df: DataFrame, prompts: str, client: Callable[[], Callable[[str], str]], policy: Policy = Policy(), pause: Callable[[float], None] = time.sleep, good: Callable[[str | None], bool] = holds_graph, rounds: int = 3,
    tasks: int = 4, problem: str | None = None,
) -> DataFrame:
    """``df`` with ``answer``; one client for each partition, made there.

    A prompt is asked again, ``rounds`` times at most and a second apart, until its answer holds a graph; the last answer
    stays.  A call that fails is tried again as the policy says; rows whose calls all fail have a null answer and, if a
    column ``problem`` is named, the last error there.  A policy with a spacing is kept by all tasks together: the rows
    are dealt to ``tasks`` partitions, which take turns.
    """
    if policy.spacing > 0:
        df = df.repartition(tasks)
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, said = client(), [None]
        context = TaskContext.get()
        turns = Turns(policy.spacing, context.partitionId() % tasks if context else 0, tasks, pause)

        def call(text: str) -> str | None:
            for attempt in range(policy.tries):
                turns.wait()
                try:
                    return ask(text)
                except Exception as error:  # noqa: BLE001  a client's own errors
                    said[0] = str(error)
                    if attempt + 1 < policy.tries and (wait := policy.wait(said[0], attempt)) > 0:
                        pause(wait)
            return None

        for pdf in batches:
            out, wrong = [], []
            for text in pdf[prompts]:
                answer, said[0] = None, None
                for nth in range(rounds):
                    answer = call(text) or answer
                    if answer is None or good(answer):
                        break
                    if nth + 1 < rounds:
                        pause(1.0)
                out.append(answer)
                wrong.append(said[0] if answer is None else None)
            made = pdf[columns].assign(answer=out)
            yield made.assign(**{problem: wrong}) if problem else made

    fields = [T.StructField(c, T.StringType()) for c in ("answer", problem) if c]
    return df.mapInPandas(run, T.StructType([*df.schema.fields, *fields]))


def stored_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier runs have stored, or nothing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def extract_stored(df: DataFrame, key: str, prompts: str, path: str, client: Callable[[], Callable[[str], str]], most_runs: int = 5, **options) -> DataFrame:
    """``df`` with the answers stored at ``path``, where those of this run are added.

    Keys with an answer are not asked again, nor are those that ``most_runs`` runs have failed on; keys that failed are
    kept with their error and the number of the run.  Rows that repeat a key are asked once, for the smallest prompt.
    """
    spark = df.sparkSession
    before, nth = stored_answers(spark, path), 1
    asked = df.groupBy(F.col(key)).agg(F.min(prompts).alias("_prompt")).where(F.col(key).isNotNull())
    if before is not None:
        tried = before.groupBy(key).agg(F.max(F.col("answer").isNotNull()).alias("_told"), F.count_if(F.col("answer").isNull()).alias("_failed"))
        asked = asked.join(tried, key, "left").where(~F.coalesce("_told", F.lit(False)) & (F.coalesce("_failed", F.lit(0)) < most_runs)).drop("_told", "_failed")
        nth = (before.agg(F.max("run")).first()[0] or 0) + 1
    made = extract(asked, "_prompt", client, problem="problem", **options)
    made.select(key, "answer", "problem", F.lit(nth).alias("run")).write.mode("append").parquet(path)
    told = spark.read.parquet(path).where("answer is not null").groupBy(key).agg(F.max_by("answer", "run").alias("answer"))
    return df.join(told, key, "left")


def not_done(df: DataFrame, done: DataFrame, key: str, cells: list[str]) -> DataFrame:
    """Rows whose key has no finished graph yet."""
    finished = F.lit(False)
    for c in cells:
        finished = finished | (F.coalesce(F.trim(c), F.lit("[]")) != "[]")
    return df.join(done.where(finished).select(key), key, "left_anti")
