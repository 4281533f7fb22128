"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors of length one are projected onto a few Gaussian directions, made orthogonal to each other so that projected
lengths scatter less.  If x is at distance d of a query, its projected distance is about d * sqrt(chi2), chi2 having as
many degrees of freedom as there are directions.  A search takes projected neighbours in order of their distance and
verifies each against the original vectors; it stops when a neighbour as near as the worst found so far would, with
probability CONFIDENCE, have been projected nearer than what comes next.

The upper levels of the kd-tree cut the projected space into cells, each the rows of one task with a subtree of its own.
They are fitted on a bounded sample; where the table outgrows the cells of that sample, each cell is dealt into parts of
about the same size.  A query searches its nearest few cells; the stopping radius that this gives then selects the other
cells it must visit.  Equal vectors are one entry with the smallest few of their ids, and are searched for once, so that
copies crowd neither a cell nor a search.

Nearness is the cosine in double precision on the original vectors, ties to the smaller id.  Vectors that are null, zero,
or hold a null or a component that isn't finite take no part; vectors of each length are searched among themselves.  Null
ids take no part.  Repeated rows count once; of an id with several vectors, the query is the smallest by its bytes.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, with_facts

DIRECTIONS = 24
CONFIDENCE = 0.9
NEIGHBOURS = 5
#: Bytes of a cell's vectors, about, and rows of the sample that the upper levels are fitted on, so many to a cell at least.
CELL_BYTES, SAMPLE_ROWS, CELL_SAMPLE = 16 << 20, 20_000, 8
#: Cells that a query searches first.
NEAR = 3
LEAF = 128
SEED = 5


def chi_square_quantile(p: float, k: int) -> float:
    """x with P(chi2_k <= x) = p, for even k, by bisection on the closed form of the distribution."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * math.fsum((x / 2) ** j / math.factorial(j) for j in range(k // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return low


def directions(width: int) -> np.ndarray:
    """An even number of directions, no more than the vectors are long (2 at least)."""
    k = max(2, min(DIRECTIONS, width - width % 2))
    gaussian = np.random.default_rng(SEED).standard_normal((width, k))
    return np.linalg.qr(gaussian)[0] * math.sqrt(width) if width >= k else gaussian


def unit(vectors: np.ndarray) -> np.ndarray:
    largest = np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    vectors = vectors / largest
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Tree:
    """A kd-tree by medians.  Nodes are numbered from the root; a leaf is its own children."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.span, self.low, self.high, self.axis, self.cut, self.left, self.right = [], [], [], [], [], [], []
        todo = [(0, len(points), -1, False)]
        while todo:
            a, b, above, is_right = todo.pop()
            me, own = len(self.span), points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            axis = int((high - low).argmax())
            if above >= 0:
                (self.right if is_right else self.left)[above] = me
            for column, value in ((self.span, (a, b)), (self.low, low), (self.high, high), (self.axis, axis), (self.left, me), (self.right, me)):
                column.append(value)
            if b - a <= leaf or high[axis] == low[axis]:
                self.cut.append(0.0)
                continue
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
            self.cut.append(float(points[self.order[a + middle], axis]))
            todo += [(a, a + middle, me, False), (a + middle, b, me, True)]
        self.span, self.low, self.high = np.array(self.span), np.array(self.low), np.array(self.high)
        self.axis, self.cut, self.left, self.right = np.array(self.axis), np.array(self.cut), np.array(self.left), np.array(self.right)
        self.leaves = np.flatnonzero(self.left == np.arange(len(self.left)))

    def descend(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        node = np.zeros(len(points), np.int64)
        while True:
            further = np.where(points[np.arange(len(points)), self.axis[node]] < self.cut[node], self.left[node], self.right[node])
            if (further == node).all():
                return node
            node = further

    def within(self, point: np.ndarray, reach: float) -> np.ndarray:
        """Leaves that hold anything at most ``reach`` (squared) from the point, by going down the nodes that do."""
        out, node = [], np.zeros(1, np.int64)
        while len(node):
            gap = np.maximum(0, np.maximum(self.low[node] - point, point - self.high[node]))
            node = node[(gap * gap).sum(axis=1) <= reach]
            ends = self.left[node] == node
            out.append(node[ends])
            node = np.concatenate([self.left[node[~ends]], self.right[node[~ends]]])
        return np.sort(np.concatenate(out))


class Cell:
    """The vectors of one cell in the order of their tree, with their projections."""

    def __init__(self, vectors: np.ndarray, ids: list, onto: np.ndarray, ratio: float):
        u = unit(vectors)
        self.tree, self.onto, self.ratio, self.verified = Tree(u @ onto), onto, ratio, 0
        at = self.tree.order
        self.vectors, self.unit, self.ids = vectors[at], u[at], [ids[i] for i in at.tolist()]
        self.points = self.unit @ onto
        self.squares = (self.points * self.points).sum(axis=1)

    def search(self, query: np.ndarray, bound: float, keep: int) -> list[tuple[float, int]]:
        """The ``keep`` best as (-cosine, id), and fewer where they cannot be better than the cosine ``bound``."""
        u = unit(query[None])[0]
        p = u @ self.onto
        rows, cosine = np.zeros(0, np.int64), np.zeros(0)
        worst = bound  # cosine of the keep-th best known

        def reach() -> float:
            return self.ratio * max(0.0, 2 - 2 * worst) * (1 + 1e-9) + 1e-12 if worst > -np.inf else np.inf

        def verify(at: np.ndarray) -> None:
            nonlocal rows, cosine, worst
            self.verified += len(at)
            c = self.unit[at] @ u
            good = c >= worst - 1e-9
            rows, cosine = np.concatenate([rows, at[good]]), np.concatenate([cosine, c[good]])
            if len(rows) >= keep:
                worst = max(worst, float(np.partition(cosine, -keep)[-keep]))
                good = cosine >= worst - 1e-9
                rows, cosine = rows[good], cosine[good]

        tree = self.tree
        first = tree.span[tree.descend(p[None])[0]]
        verify(np.arange(*first))
        leaves = tree.within(p, reach())
        if 2 * len(leaves) > len(tree.leaves):  # most of the cell: its rows are gone through as they lie
            distance = self.squares - 2 * (self.points @ p) + p @ p
            near = distance <= reach()
            inside = np.zeros(len(near) + 1, np.int8)
            np.add.at(inside, tree.span[leaves, 0], 1)
            np.add.at(inside, tree.span[leaves, 1], -1)
            near &= np.cumsum(inside[:-1]) > 0
            near[first[0] : first[1]] = False
            at = np.flatnonzero(near)
            distance = distance[at]
        else:
            at = np.concatenate([np.arange(*tree.span[leaf]) for leaf in leaves.tolist() if tree.span[leaf, 0] != first[0]] or [np.zeros(0, np.int64)])
            distance = ((self.points[at] - p) ** 2).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        at, distance, done, many = at[order], distance[order], 0, 64
        while done < len(at) and distance[done] <= reach():
            verify(at[done : done + many])
            done, many = done + many, min(2 * many, 1024)
        v = self.vectors[rows]
        scale = np.sqrt((v * v).sum(axis=1)) * np.sqrt((query * query).sum())
        with np.errstate(all="ignore"):
            exact = (v * query).sum(axis=1) / scale
        exact = np.where(np.isfinite(exact) & (scale > 0), exact, cosine)  # squares out of range: the scaled vectors' cosine
        return sorted((-s, int(i)) for s, r in zip(exact.tolist(), rows.tolist(), strict=True) for i in self.ids[r])[:keep]


def valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column, kind: str, width: int) -> np.ndarray:
    """Rows of packed vectors as doubles."""
    return np.frombuffer(b"".join(column), kind).reshape(-1, width).astype(np.float64)


_BEST = "array<struct<neg: double, id: long>>"


def nearest(embeddings: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that ``is_query`` (over ``vec_id``) marks."""
    spark = embeddings.sparkSession
    own = dict(embeddings.dtypes)[vector_col]
    v = F.col(vector_col) if own == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    rows = rows.withColumn("asks", F.coalesce(is_query, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()  # one row a length of vectors
    parts = [_among(rows.where(F.size("v") == n), n, count, k, "<f4" if own == "array<float>" else "<f8", confidence) for n, count in sizes]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _among(rows: DataFrame, width: int, n: int, k: int, kind: str, confidence: float) -> DataFrame:
    """``nearest`` among n vectors of one length."""
    onto = directions(width)
    ratio, keep = chi_square_quantile(confidence, onto.shape[1]), k + 1  # a query's own id is among what it finds
    cell_rows = max(1000, CELL_BYTES // (8 * width))

    # The upper levels: cells fitted on a bounded sample of the distinct vectors, balanced by medians.
    draw = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE_ROWS / n)
    sample = rows.where(draw).select("v").distinct().collect() or rows.select("v").limit(1).collect()
    points = unit(np.array([r.v for r in sample], np.float64)) @ onto
    upper = Tree(points, max(CELL_SAMPLE, int(cell_rows * len(points) / n)))
    parts = max(1, -(-n // (2 * cell_rows * len(upper.leaves))))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's distinct vectors, packed, with the smallest few of their ids and how many rows ask for them."""
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)).tobytes()
            size, seen = len(packed) // batch.num_rows, {}
            for i, (vec_id, asks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                one = seen.setdefault(packed[i * size : (i + 1) * size], ([], [0]))
                one[0].append(vec_id)
                one[1][0] += asks
            yield pa.RecordBatch.from_arrays([
                pa.array(seen, pa.binary()), pa.array([sorted(set(ids))[:keep] for ids, _ in seen.values()], pa.list_(pa.int64())), pa.array([c for _, (c,) in seen.values()], pa.int64()),
            ], ["v", "ids", "asked"])

    entries = rows.mapInArrow(reduced, "v binary, ids array<long>, asked long").groupBy("v")
    entries = entries.agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.sum("asked").alias("asked"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=upper.descend(unit(_matrix(pdf["v"], kind, width)) @ onto))

    dealt = entries.mapInPandas(place, "v binary, ids array<long>, asked long, cell long")
    dealt = durable(dealt.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")))

    def boxes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            if len(pdf):
                p = unit(_matrix(pdf["v"], kind, width)) @ onto
                for cell, at in pdf.groupby("cell").indices.items():
                    low, high = held.get(cell, (np.inf, -np.inf))
                    held[cell] = np.minimum(low, p[at].min(axis=0)), np.maximum(high, p[at].max(axis=0))
        yield pd.DataFrame({"cell": list(held), "box": [np.concatenate(b) for b in held.values()]})

    # No more rows than tasks times the sample's cells; one box a cell reaches the driver.
    each = dealt.select("cell", "v").mapInPandas(boxes_of, "cell long, box array<double>").select("cell", F.posexplode("box").alias("at", "x"))
    ends = each.groupBy("cell", "at").agg(F.when(F.col("at") < onto.shape[1], F.min("x")).otherwise(F.max("x")).alias("x"))
    boxes = ends.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("b")).orderBy("cell").collect()
    cells, box = np.array([b.cell for b in boxes]), np.array([[x.x for x in b.b] for b in boxes])
    low, high = box[:, : onto.shape[1]], box[:, onto.shape[1] :]

    def gaps(p: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(low - p, p - high))
        return (gap * gap).sum(axis=1)

    def send(first: bool):
        """To its nearest cells each query that comes; or, with what it found there, to the others that it must visit."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                bounds = pdf["bound"] if not first else [-np.inf] * len(pdf)
                for v, p, bound in zip(pdf["v"], unit(_matrix(pdf["v"], kind, width)) @ onto if len(pdf) else [], bounds, strict=True):
                    gap = gaps(p)
                    order = gap.argsort(kind="stable")
                    reach = ratio * max(0.0, 2 - 2 * bound) * (1 + 1e-9) + 1e-12 if bound > -np.inf else np.inf
                    to = order[:NEAR] if first else [c for c in order[NEAR:] if gap[c] <= reach]
                    out += [(v, int(cells[c]), bound) for c in to]
                yield pd.DataFrame(out, columns=["v", "cell", "bound"])

        return run

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Searches one part of a cell for each of its queries."""
        out = []
        if len(left) and len(right):
            cell = Cell(_matrix(right["v"], kind, width), right["ids"].tolist(), onto, ratio)
            for packed, q, bound in zip(left["v"], _matrix(left["v"], kind, width), left["bound"], strict=True):
                out.append((packed, [{"neg": s, "id": i} for s, i in cell.search(q, bound, keep)]))
        return pd.DataFrame(out, columns=["v", "best"])

    def searched(sent: DataFrame) -> DataFrame:
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return sent.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInPandas(visit, f"v binary, best {_BEST}")

    def best(found: DataFrame) -> DataFrame:
        """A query's best over the cells it visited, a few of each."""
        return found.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, keep).alias("best"))

    sent = "v binary, cell long, bound double"
    asking = dealt.where("asked > 0").select("v")
    found = best(searched(asking.mapInPandas(send(True), sent)))
    if len(cells) > NEAR:
        found = durable(found)
        bound = F.coalesce(-F.get("best", F.lit(k))["neg"], F.lit(float("-inf")))
        onward = found.select("v", bound.alias("bound")).mapInPandas(send(False), sent)
        found = best(found.unionByName(searched(onward)))
    found = found.join(dealt.select("v", "asked"), "v")
    asked = rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(_packed(F.col("v"), kind)).alias("v"))
    told = with_facts(asked, durable(found), "v", "asked", n)
    theirs = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    told = told.select("query_id", F.posexplode(theirs).alias("at", "b"))
    return told.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.neg")).alias("score"))


def _packed(vector: Column, kind: str) -> Column:
    """The bytes of a vector, as the entries hold them."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([np.asarray(x, kind).tobytes() for x in part], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "binary")(vector)
