"""A stored inner-product index: inverted lists over trained centres, searched across a whole table.

Vectors lie in the list of their nearest centre; a list is stored in parts of bounded size, with its centre and radius.
A search visits the lists whose centres have the largest inner product with a query; an exact search then visits every
list that could still hold something as good, since no vector of a list has more than query * centre + |query| * radius.
Queries meet the parts of lists in blocks, never a whole list or all queries in one task.  Lists that lie near each other
stand on one shelf of bounded size, and an exact search sends a query to a shelf once, whatever it holds for it.
Products are summed in the order of the components, so equal vectors have equal ones.

Vectors that are null, empty, of another length than most, or that hold null or non-finite numbers, are not indexed;
queries like that find nothing.  Of equal products the smaller id comes first; vectors that repeat an id are each found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import durable

#: Vectors that centres are trained on, about, and how many for each centre; all vectors are indexed.
SAMPLE_ROWS, SAMPLE_LIST = 100_000, 64
#: Bytes of the centres, which searching tasks hold.
CENTRE_BYTES = 1 << 26
#: Vectors of a part of a list, as stored, and of a shelf of several lists; queries that they meet in one block.
PART, SHELF, BLOCK = 4096, 8192, 8192


def _clean(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "v", lists: int | None = None, seed: int = 0, steps: int = 10) -> None:
    """Writes the index of a table: ``path``/vectors (list, part, id, v) and ``path``/lists (list, centre, radius, n).

    By default there are as many lists as the root of the number of vectors, as far as ``CENTRE_BYTES`` hold their
    centres.  Centres are the means of a k-means clustering of a hashed sample.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    rows = _clean(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()  # one row
    width, n = (sizes[0]["width"], sizes[0]["n"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == width)
    wanted = lists or max(1, int(n**0.5))
    wanted = max(1, min(wanted, CENTRE_BYTES // (8 * width), n))
    if n:
        one_in = max(1, n // min(SAMPLE_ROWS, max(SAMPLE_LIST * wanted, wanted + 1)))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(one_in)) == 0).select(array_to_vector("v").alias("features"))
        sample = sample if not sample.isEmpty() else rows.select(array_to_vector("v").alias("features"))
        centres = np.array(KMeans(k=wanted, seed=seed, maxIter=steps).fit(durable(sample)).clusterCenters()) if wanted > 1 else np.zeros((1, width))
    else:
        centres = np.zeros((1, width))
    half = (centres * centres).sum(axis=1) / 2

    def nearest(batches):
        for pdf in batches:
            v = _matrix(pdf["v"])
            at = (v @ centres.T - half).argmax(axis=1)
            yield pdf.assign(list=at.astype(np.int32), far=np.sqrt(((v - centres[at]) ** 2).sum(axis=1)))

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.mapInPandas(nearest, f"id {kind}, v array<double>, list int, far double")
    placed = durable(placed)
    held = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
    told = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").join(held, "list")
    told.write.mode("overwrite").parquet(f"{path}/lists")
    parts = F.ceil(F.col("n") / PART).cast("int")
    part = F.pmod(F.xxhash64("id", "v"), parts).cast("int")
    out = placed.join(F.broadcast(held.select("list", "n")), "list").withColumn("part", part)  # no more rows than lists
    out = out.repartitionByRange(max(1, -(-n // (16 * PART))), "list", "part").sortWithinPartitions("list", "part")
    out.select("list", "part", "id", "v").write.mode("overwrite").parquet(f"{path}/vectors")


def _shelves(centres: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """A shelf's number for each list: lists are halved between far centres until those of a shelf hold ``most`` vectors, or one is left."""
    out, left, shelf = np.zeros(len(n), np.int32), [np.arange(len(n))] if len(n) else [], 0
    while left:
        own = left.pop()
        if len(own) == 1 or n[own].sum() <= most:
            out[own] = shelf
            shelf += 1
            continue
        c = centres[own]
        one = c[((c - c.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        two = c[((c - one) ** 2).sum(axis=1).argmax()]
        own = own[np.argsort(c @ (two - one), kind="stable")]
        held = np.cumsum(n[own])
        at = min(max(1, int(np.searchsorted(held, held[-1] / 2, side="right"))), len(own) - 1)
        left += [own[:at], own[at:]]
    return out


def _chosen(asked: np.ndarray, v: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and vectors, and products: for each query the k largest, of equal ones the first, that are ``least`` or more."""
    near = asked @ v.T
    if v.shape[0] > k:
        few = ~np.isfinite(least)
        least = least.copy()
        least[few] = np.partition(near[few], -k, axis=1)[:, -k]
        slack = 1e-9 * (1 + np.linalg.norm(asked, axis=1) * np.linalg.norm(v, axis=1).max())  # for rounding, summed in any order
        low = least - slack
        low[~np.isfinite(low)] = -np.inf
        who, at = np.nonzero(~(near < low[:, None]))
    else:
        who, at = (x.ravel() for x in np.indices(near.shape))
    score = np.zeros(len(who))
    for c in range(v.shape[1]):
        score += asked[who, c] * v[at, c]
    order = np.lexsort((at, -score, who))
    who, at, score = who[order], at[order], score[order]
    first = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[first], at[first], score[first]


class Index:
    """An index that ``build`` wrote, opened for searching."""

    def __init__(self, spark: SparkSession, path: str):
        self.vectors = spark.read.parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # bounded by CENTRE_BYTES
        self.numbers = np.array([r["list"] for r in rows], np.int32)
        self.centres = np.array([r["centre"] for r in rows], float) if rows else np.zeros((0, 0))
        self.radius, self.n = np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows])

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, id_col: str = "id", vector_col: str = "v") -> DataFrame:
        """query_id, rank (from 1), id, score: the ``k`` largest inner products of each query; of all vectors if ``exact``, otherwise of ``probes`` lists."""
        asked = _clean(queries, id_col, vector_col).where(F.size("v") == self.centres.shape[1]).withColumnRenamed("id", "query_id")
        if not len(self.numbers):
            return asked.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(self.vectors.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score")).where("rank > 0")
        asked = durable(asked.withColumn("nth", F.monotonically_increasing_id()))
        found = self._visit(asked.withColumn("least", F.lit(None).cast("double")), self._lists(asked, probes), k, self.numbers)
        if exact:
            least = found.groupBy("nth").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("held"))
            least = least.select("nth", F.when(F.col("held") >= k, F.col("least")).alias("least"))
            shelves = _shelves(self.centres, self.n, SHELF)
            asked = durable(asked.join(least, "nth", "left"))
            found = self._visit(asked, self._open(asked, shelves), k, shelves)
        return found.join(asked.select("nth", "query_id"), "nth").select("query_id", F.row_number().over(_order()).alias("rank"), "id", "score")

    def _lists(self, asked: DataFrame, probes: int) -> DataFrame:
        """nth, shelf: the lists with the largest products of their centres, each a shelf of its own."""
        centres, numbers = self.centres, self.numbers

        def run(batches):
            for pdf in batches:
                far = -_matrix(pdf["v"]) @ centres.T
                first = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"nth": np.repeat(pdf["nth"].to_numpy(), first.shape[1]), "shelf": numbers[first.ravel()]})

        return asked.select("nth", "v").mapInPandas(run, "nth long, shelf int")

    def _open(self, asked: DataFrame, shelves: np.ndarray) -> DataFrame:
        """nth, shelf: the shelves with a list that could hold ``least`` or more; all of them where it is null."""
        order = np.argsort(shelves, kind="stable")
        centres, radius, starts = self.centres[order], self.radius[order], np.unique(shelves[order], return_index=True)[1]

        def run(batches):
            for pdf in batches:
                v = _matrix(pdf["v"])
                most = v @ centres.T + np.linalg.norm(v, axis=1)[:, None] * radius
                open_ = most + 1e-9 * (1 + np.abs(most)) >= pdf["least"].fillna(-np.inf).to_numpy(float)[:, None]
                who, at = np.nonzero(np.logical_or.reduceat(open_, starts, axis=1))
                yield pd.DataFrame({"nth": pdf["nth"].to_numpy()[who], "shelf": at.astype(np.int32)})

        return asked.select("nth", "v", "least").mapInPandas(run, "nth long, shelf int")

    def _visit(self, asked: DataFrame, visits: DataFrame, k: int, shelves: np.ndarray) -> DataFrame:
        """nth, id, score: the best of the visited shelves (nth, shelf), of which ``shelves`` has one for each list, that are ``least`` or more."""
        spark = asked.sparkSession
        visits = durable(visits)
        told = list(zip(self.numbers.tolist(), shelves.tolist(), (-(-self.n // PART) if len(self.n) else self.n).tolist(), strict=True))
        told = spark.createDataFrame(told, "list int, shelf int, parts int")
        blocks = visits.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        blocks = F.broadcast(durable(told.join(blocks, "shelf")))  # no more rows than lists
        parts = blocks.groupBy("shelf").agg(F.max("parts").alias("parts"), F.max("blocks").alias("blocks"))
        left = visits.join(F.broadcast(parts), "shelf").join(asked.select("nth", "v", "least"), "nth")
        left = left.withColumn("block", F.pmod(F.xxhash64("nth"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = self.vectors.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key, tasks = ["shelf", "part", "block"], int(spark.conf.get("spark.sql.shuffle.partitions"))

        def met(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"nth": pd.Series(dtype="int64"), "id": two["id"].iloc[:0], "score": pd.Series(dtype="float64")})]
            if len(one) and len(two):
                two = two.sort_values("id", kind="stable", na_position="first")
                v, ids = _matrix(two["v"]), two["id"].to_numpy()
                same = pd.Series([x.tobytes() for x in v])
                first = same.groupby(same).cumcount().to_numpy()
                v, ids = v[first < k], ids[first < k]  # of equal vectors no more can be found
                for at in range(0, len(one), 512):
                    own = one.iloc[at : at + 512]
                    who, which, score = _chosen(_matrix(own["v"]), v, own["least"].fillna(-np.inf).to_numpy(float), k)
                    out.append(pd.DataFrame({"nth": own["nth"].to_numpy()[who], "id": ids[which], "score": score}))
            return pd.concat(out[1:] or out)

        kind = self.vectors.schema["id"].dataType.simpleString()
        # Few bytes are much work, so the engine doesn't join these partitions.
        left, right = left.select(*key, "nth", "v", "least").repartition(tasks, *key), right.select(*key, "id", "v").repartition(tasks, *key)
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(met, f"nth long, id {kind}, score double")
        return _best(found, k)


def _order():
    return Window.partitionBy("nth").orderBy(F.col("score").desc(), "id")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= k).drop("rank")


def brute_force(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """query_id, rank, id, score by comparing the queries with all vectors in blocks; to measure recall by."""
    rows, asked = _clean(vectors, id_col, vector_col), _clean(queries, id_col, vector_col).withColumnRenamed("id", "query_id").withColumn("nth", F.monotonically_increasing_id())
    n, m = rows.count(), asked.count()
    parts, blocks = max(1, -(-n // PART)), max(1, -(-m // BLOCK))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = durable(asked).withColumn("block", deal("nth", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("part", deal("v", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def met(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": one["query_id"].iloc[:0], "nth": pd.Series(dtype="int64"), "id": two["id"].iloc[:0], "score": pd.Series(dtype="float64")})]
        two = two.sort_values("id", kind="stable")
        for q, nth, v in zip(one["query_id"], one["nth"], one["v"], strict=True):
            own = two[two["v"].map(len) == len(v)] if len(two) else two
            if len(own):
                score = _matrix(own["v"]) @ np.asarray(v, float)
                first = np.argsort(-score, kind="stable")[:k]
                out.append(pd.DataFrame({"query_id": q, "nth": nth, "id": own["id"].to_numpy()[first], "score": score[first]}))
        return pd.concat(out[1:] or out)

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, nth long, id {rows.schema['id'].dataType.simpleString()}, score double"
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(met, kinds)
    return _best(found, k).select("query_id", F.row_number().over(_order()).alias("rank"), "id", "score")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """The share of the true neighbours (query_id, id) that were found."""
    hit = true.select("query_id", "id").join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
