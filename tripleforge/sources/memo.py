"""What a slow function made of each distinct text, stored, so that it is asked once for each over all runs.

The function is a plug-in, as a translation model is.  Runs add to the store; a text that it holds is looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extraction import stored_answers
from .storage import written

#: Texts that the function gets at a time.
BATCH = 64


def mark(text: Column) -> Column:
    """Sixteen bytes of a text's SHA-256, by which texts are told apart where only that counts, so that fewer bytes are moved."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def looked_up(texts: DataFrame, text: str, path: str, make: Callable[[], Callable[[Sequence[str]], Sequence[str | None]]]) -> DataFrame:
    """text, made: what the function makes of each distinct text that isn't null, from the store at ``path`` or else asked now and stored.

    Texts for which the function gives null are stored so and not asked again.  Only texts that the store lacks reach the
    function, each of them once, ``BATCH`` at a time; ``make`` gives the function in each task.
    """
    wanted = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    return asked(wanted, path, make).join(wanted, "text", "left_semi")


def asked(wanted: DataFrame, path: str, make: Callable[[], Callable[[Sequence[str]], Sequence[str | None]]]) -> DataFrame:
    """text, made: the whole store at ``path``, once the distinct texts ``wanted`` that it lacks are asked and added to it."""
    spark = wanted.sparkSession
    known = stored_answers(spark, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                own = list(pdf["text"].iloc[i : i + BATCH])
                yield pd.DataFrame({"text": own, "made": list(ask(own))})

    new = wanted if known is None else wanted.join(known.select("text"), "text", "left_anti")
    new.mapInPandas(run, "text string, made string").write.mode("append").option("compression", "zstd").parquet(path)  # one job, which reads the store's files of before
    return spark.read.parquet(path)


def mapped_sentences(df: DataFrame, key: str, sentences: Column, path: str, make: Callable[[], Callable[[Sequence[str]], Sequence[str | None]]]) -> DataFrame:
    """key, made: each row's sentences as the function gives them, joined by spaces; null if it gives nothing for one of them, or for no sentence.

    Rows are told apart by ``key``.
    """
    rows = df.select(key, F.posexplode(sentences).alias("_nth", "text"))
    told = asked(rows.select("text").where("text is not null").distinct(), path, make).select(mark(F.col("text")).alias("_mark"), "made")
    joined = rows.select(key, "_nth", mark(F.col("text")).alias("_mark")).join(told, "_mark").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_nth", "made"))).alias("s"))
    whole = F.forall("s", lambda x: x["made"].isNotNull())
    out = joined.select(key, F.when(whole, F.array_join(F.transform("s", lambda x: x["made"]), " ")).alias("made"))
    return df.select(key).join(out, key, "left")


def there_and_back(df: DataFrame, key: str, sentences: Column, path: str, there: Callable, back: Callable, split: Callable[[Column], Column]) -> DataFrame:
    """key, made: a paraphrase by translating sentence by sentence and back, each way with a store of its own below ``path``; null if nothing changes."""
    first = written(mapped_sentences(df, key, sentences, f"{path}/there", there))
    second = mapped_sentences(first.where("made is not null"), key, split(F.col("made")), f"{path}/back", back)
    was = df.select(key, mark(F.array_join(sentences, " ")).alias("was"))
    return was.join(second, key, "left").select(key, F.when(mark(F.col("made")) != F.col("was"), F.col("made")).alias("made"))
