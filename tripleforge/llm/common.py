"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and words, as the operators' contracts state them.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: Used only where a session on one machine names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/tripleforge"
#: Keys that are looked up by broadcast because many rows have them: no more than so many, and rows of each.
MOST_HOT, LEAST_HOT = 100_000, 128


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  A local folder is set only where none is named and all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or LOCAL_CHECKPOINTS)
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder, with their lineage cut.  For narrow rows.

    Spark removes the files once nothing refers to them if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set;
    otherwise they stay until the folder is cleared.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``new_path`` named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows written to the shared folder as Parquet and read again.  For rows with texts; whoever names the path removes it."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_facts(rows: DataFrame, facts: DataFrame, on: str | list[str], times: str, total: int) -> DataFrame:
    """Rows joined to the one row of ``facts`` with their key; hot keys are spread over the tasks that hold their rows.

    ``times`` is the number of rows that have the key, ``total`` that of all rows.  Keys with more than total / MOST_HOT
    rows, of which there are fewer than MOST_HOT, are broadcast; rows of all other keys are joined by shuffling, so no task
    gets more than that many rows of one key.  Rows without facts are dropped.
    """
    on = [on] if isinstance(on, str) else on
    limit = max(LEAST_HOT, -(-total // MOST_HOT))
    mark = unused(rows.join(facts, on), "_hot")[0]
    hot = facts.where(F.col(times) > limit).withColumn(mark, F.lit(True))
    met = rows.join(F.broadcast(hot), on, "left")
    columns = [*rows.columns, *[c for c in facts.columns if c not in on]]
    others = met.where(F.col(mark).isNull()).select(*rows.columns)
    others = others.join(facts.where(F.col(times) <= limit), on)
    return met.where(F.col(mark)).select(*columns).unionByName(others.select(*columns))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the table's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def words_text(text: Column) -> Column:
    """The text with each run of white space made one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
