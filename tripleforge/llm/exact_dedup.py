"""Exact deduplication against immutable snapshots.

A snapshot is reduced once to a stored table of exact buckets (digest, smallest id, size) and a stored table of static
binary fuse filters, one for each bucket; neither changes later.  A batch is reduced to its own groups first; the loaded
filters of all snapshots screen the batch's digests; only the positives meet the exact buckets, and the rest stand as
groups of the batch alone.  The texts of groups of more than one row are then compared byte by byte.

Nulls: a null text counts as empty; a null id is never smaller than another, and a group of null ids keeps one row.
Rows that repeat an id and a text are rows of the group like any other; one of them stays.
An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import binary_fuse
from .common import durable, new_path, remove, unused, with_facts, words_text

#: Digests that one filter holds, about: a filter is built in one task and is some 60 kB.
KEYS_PER_FILTER = 50_000
#: Digests of groups to compare that are broadcast, some bytes each; more are met by shuffling.
MOST_BROADCAST = 1 << 20
#: Snapshots that a table without any is dealt into, beside the batch.
SNAPSHOTS = 2
FILTER = "bucket int, buckets int, seed long, segment long, starts long, slots binary"


def _bucket(sha: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(sha, 49, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _key(sha: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in sha], np.uint64)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, raw: the digest of the normalised text, and a hash of the text as it is that tells repeated ids apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        _sha(words_text(F.col(text_col))).alias("text_sha256"),
        F.xxhash64(text).alias("raw"),
    )


def exact_buckets(rows: DataFrame) -> DataFrame:
    """One row per digest: text_sha256, keep_id, group_size."""
    return rows.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


@dataclass
class Snapshot:
    """A snapshot's stored tables: ``digests`` (text_sha256, keep_id, group_size) and ``filters`` (one row a bucket)."""

    path: str
    buckets: int
    digests: DataFrame
    filters: DataFrame


def write_snapshot(groups: DataFrame, path: str) -> Snapshot:
    """Stores the exact buckets and filters of a snapshot's groups at a new path."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, starts, slots = binary_fuse.build(_key(pdf["text_sha256"]))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "buckets": [buckets], "seed": seed, "segment": segment, "starts": starts, "slots": [slots]})

    spark = groups.sparkSession
    groups.write.parquet(f"{path}/digests")
    stored = spark.read.parquet(f"{path}/digests")
    buckets = max(1, -(-stored.count() // KEYS_PER_FILTER))
    rows = stored.select("text_sha256", _bucket(F.col("text_sha256"), buckets).alias("bucket"))
    rows.groupBy("bucket").applyInPandas(build, FILTER).write.parquet(f"{path}/filters")
    return open_snapshot(spark, path)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A stored snapshot; its filters are read, not built again."""
    filters = spark.read.parquet(f"{path}/filters")
    buckets = filters.agg(F.max("buckets")).first()[0] or 1
    return Snapshot(path, buckets, spark.read.parquet(f"{path}/digests"), filters)


def screen(groups: DataFrame, snapshot: Snapshot, rows: int) -> DataFrame:
    """The batch's groups with ``maybe``: false if the snapshot surely lacks the digest.  ``rows``: how many groups there are, about.

    A filter is probed by several tasks if the batch is much larger than the snapshot.
    """
    columns = groups.columns

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(left), bool)
        if len(left) and len(right):
            f = right.iloc[0]
            hit = binary_fuse.contains(_key(left["text_sha256"]), int(f["seed"]), int(f["segment"]), int(f["starts"]), f["slots"])
        return left[columns].assign(maybe=hit)

    parts = max(1, -(-rows // (8 * KEYS_PER_FILTER * snapshot.buckets)))
    part = F.pmod(F.xxhash64("text_sha256"), F.lit(parts)).cast("int")
    left = groups.withColumn("bucket", _bucket(F.col("text_sha256"), snapshot.buckets)).withColumn("part", part).groupBy("bucket", "part")
    right = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("bucket", "part")
    kinds = ", ".join(f"{c} {t}" for c, t in groups.dtypes)
    return left.cogroup(right).applyInPandas(probe, f"{kinds}, maybe boolean")


def merge(batch: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """Groups over a batch's groups and all snapshots: text_sha256, keep_id, group_size.  A digest may be in several snapshots."""
    columns, rows = batch.columns, batch.count()
    sure = batch
    positives = []
    for s in snapshots:  # what one snapshot's filters let pass needn't ask the next
        screened = durable(screen(sure, s, rows))
        positives.append(screened.where("maybe").select(columns))
        sure = screened.where("not maybe").select(columns)
    exact = [s.digests.select(columns) for s in snapshots] + positives
    if not exact:
        return sure
    met = reduce(DataFrame.unionByName, exact).groupBy("text_sha256").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return met.unionByName(sure)


def verify(docs: DataFrame, groups: DataFrame, text_col: str = "text") -> None:
    """Compares the texts of each group of several rows byte by byte; raises if two texts share a digest.

    Only texts of such groups are shuffled, and of equal texts one for each task.
    """
    several = groups.where("group_size > 1")
    text = words_text(F.col(text_col))
    texts = docs.select(_sha(text).alias("text_sha256"), text.alias("bytes_of"))
    if (wanted := several.count()) <= MOST_BROADCAST:
        # Never null, so that no filter on it makes the digest again.
        short = F.coalesce(F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"), F.lit(0)).alias("short")
        texts = texts.withColumn("short", short).join(F.broadcast(several.select(short)), "short", "left_semi")
    else:
        texts = with_facts(texts, several.select("text_sha256", "group_size"), "text_sha256", "group_size", several.agg(F.sum("group_size")).first()[0])
    if wanted and not texts.groupBy("text_sha256", "bytes_of").agg(F.lit(1).alias("one")).groupBy("text_sha256").count().where("count > 1").isEmpty():
        raise ValueError("two texts share a SHA-256 digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: Column | None = None, snapshots: int = SNAPSHOTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, raw.

    Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` is made one space; of equal texts
    the row with the smallest id stays.  ``part`` is the number of the snapshot that holds a row, from 0; rows of no
    snapshot, nulls included, are the batch (default: by a hash of the id).  The result doesn't depend on it.
    """
    rows = durable(digests(docs, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(snapshots + 1)) if part is None else part))
    total = rows.count()
    within = F.coalesce((F.col("part") >= 0) & (F.col("part") < snapshots), F.lit(False))
    paths = [new_path(docs.sparkSession) for _ in range(snapshots)]
    stored = [write_snapshot(exact_buckets(rows.where(F.col("part") == i)), path) for i, path in enumerate(paths)]
    groups = durable(merge(durable(exact_buckets(rows.where(~within))), stored))
    for path in paths:
        remove(docs.sparkSession, path)
    verify(docs, groups, text_col)
    # Rows that repeat an id and a text are counted here and dealt out again, so that one of them is kept.
    counted = rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("raw").alias("raw"))
    out = with_facts(counted, groups, "text_sha256", "group_size", total).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    first = (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256", "raw")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept_id, kept_raw, raw, nth = unused(docs, "_kept_id", "_kept_raw", "_raw", "_nth")
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("raw").alias(kept_raw))
    out = docs.withColumn(raw, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = out.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)) & (F.col(raw) == F.col(kept_raw)), "left_semi")
    one = Window.partitionBy(id_col, raw).orderBy(F.lit(1))
    return out.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth, raw)
