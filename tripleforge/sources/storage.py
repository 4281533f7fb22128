"""Intermediate tables in the folder that all machines of a session share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a session on one machine names no shared folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/tripleforge"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  A local folder is set only where none is named and all runs on one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or LOCAL_FOLDER)
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder, with their lineage cut, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder as columns, compressed, which takes less than ``durable`` where texts are long."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordinals(df: DataFrame, order: list[str], name: str, keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``df`` with the number from 0 of each row in the given order, which must tell rows apart.

    Rows are sorted in ranges; a row's number is the count of the earlier ranges and its place in its own, so no task
    orders the whole table and the driver sees one count a range.  ``keep`` stores the sorted rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), place.alias("_place"))
    rows = keep(rows)
    before, at = [], 0
    for r in rows.groupBy("_range").count().orderBy("_range").collect():
        before.append((r["_range"], at))
        at += r["count"]
    told = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))  # one row a range
    return rows.join(told, "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
