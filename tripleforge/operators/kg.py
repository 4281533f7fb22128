"""Knowledge graphs in cells and in long form: parsing, normalising, validating, graph tables, the relational kernel.

The long form has a row a triple: pair_id, side, pos, s, p, o.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import durable

TRIPLES = "array<array<string>>"
# Tokens of the prompt that an answer must not hold as subject or object.
PLACEHOLDERS = ["entity1", "entity2", "entity3", "entity4", "relation"]


def _literal(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Triples of cells that are Python literals but no JSON: tuples, None, escapes, one bare triple."""
    for batch in cells:
        out = []
        for cell in batch:
            try:
                value = ast.literal_eval(cell) if cell else []
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                value = []
            value = value if isinstance(value, list | tuple) else []
            if len(value) == 3 and all(isinstance(x, str) for x in value):
                value = [value]
            rows = [[("" if x is None else str(x)) for x in t] for t in value if isinstance(t, list | tuple) and len(t) == 3]
            out.append(rows)
        yield pd.Series(out)


_literal.__annotations__ = {"cells": Iterator[pd.Series], "return": Iterator[pd.Series]}


def parse_cells(df: DataFrame, cell: str, out: str = "kg") -> DataFrame:
    """``df`` with an array of [s, p, o]; cells that JSON can't read go through the literal parser, the rest stay in the JVM."""
    native = F.from_json(F.col(cell), TRIPLES)
    filled = F.trim(F.coalesce(F.col(cell), F.lit("")))
    easy = df.where(native.isNotNull() | (filled == "") | (F.lower(filled) == "nan")).withColumn(out, F.coalesce(native, F.array().cast(TRIPLES)))
    hard = df.where(native.isNull() & (filled != "") & (F.lower(filled) != "nan")).withColumn(out, F.pandas_udf(_literal, TRIPLES)(F.col(cell)))
    return easy.unionByName(hard).withColumn(out, F.filter(out, lambda t: F.size(t) == 3))


def normal_label(x: Column) -> Column:
    """Underscores to spaces, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(x, F.lit("_"), F.lit(" "))), " {2,}", " "))


def canonical(s: Column, p: Column, o: Column) -> Column:
    """``s|p|o`` with each part lower-cased and its white space collapsed."""
    part = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return F.concat_ws("|", part(s), part(p), part(o))


def valid(s: Column, p: Column, o: Column) -> Column:
    """Whether all three are there and neither subject nor object is a placeholder; false for nulls."""
    good = lambda x: ~F.lower(F.trim(x)).isin(PLACEHOLDERS)
    return F.coalesce(good(s) & good(o) & p.isNotNull(), F.lit(False))


def until_blank(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Wide paragraphs as rows key, place, text, up to the first blank one."""
    filled = F.array(*[F.coalesce(F.trim(c), F.lit("")) for c in columns])
    first = F.array_position(F.transform(filled, lambda x: x == ""), True)
    kept = F.slice(F.array(*columns), 1, F.when(first > 0, first - 1).otherwise(len(columns)).cast("int"))
    return df.select(*key, F.posexplode(kept).alias("place", "text"))


def edges(triples: DataFrame) -> DataFrame:
    """pair_id, side, u, v, relation: undirected, lower-cased, u <= v; the last relation stays.

    A triple without a subject or an object is no edge; the relation may be null.  Repeated triples are one edge.
    """
    s, o = F.lower("s"), F.lower("o")
    rows = triples.where("s is not null and o is not null").select("pair_id", "side", "pos", F.least(s, o).alias("u"), F.greatest(s, o).alias("v"), F.lower("p").alias("p"))
    return rows.groupBy("pair_id", "side", "u", "v").agg(F.max_by("p", "pos").alias("relation"))


def node_counts(triples: DataFrame) -> DataFrame:
    """pair_id, side, nodes, edges, relations: the sizes of each graph.

    The triples are dealt once by graph; edges, and then nodes and relations, are counted where they lie.
    """
    # A stated number of partitions, which the engine doesn't join, so that a task's tables stay small.
    parts = int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges(triples.where("s is not null and o is not null").repartition(parts, "pair_id", "side"))
    part = lambda kind, name, edge: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.lit(edge).alias("edge"))
    ends = e.select("pair_id", "side", F.explode(F.array(part(0, "u", 0), part(0, "v", 0), part(1, "relation", 1))).alias("x")).select("pair_id", "side", "x.*")
    named = ends.groupBy("pair_id", "side", "kind", "name").agg(F.sum("edge").alias("edge"))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, F.col("name")))
    return named.groupBy("pair_id", "side").agg(count(0).alias("nodes"), F.sum("edge").alias("edges"), count(1).alias("relations"))


def vocabulary(triples: DataFrame) -> DataFrame:
    """pair_id, kind (entity or relation), label, id: numbers by label over both graphs of a pair."""
    from pyspark.sql import Window

    entity = triples.select("pair_id", F.lit("entity").alias("kind"), F.explode(F.array(F.lower("s"), F.lower("o"))).alias("label"))
    relation = triples.select("pair_id", F.lit("relation").alias("kind"), F.lower("p").alias("label"))
    rows = entity.union(relation).distinct()
    return rows.withColumn("id", (F.row_number().over(Window.partitionBy("pair_id", "kind").orderBy("label")) - 1).cast("long"))


def light(triple: Column) -> Column:
    """A triple's parts without white space around them; null parts are empty."""
    return F.transform(triple, lambda x: F.trim(F.coalesce(x, F.lit(""))))


def filled(s: Column, p: Column, o: Column) -> list[Column]:
    """Parts of a triple for a network: a blank subject or object is one space, a blank relation ``related``."""
    part = lambda x, name: F.when(F.trim(F.coalesce(x, F.lit(""))) == "", name).otherwise(x)
    return [part(s, " ").alias("s"), part(p, "related").alias("p"), part(o, " ").alias("o")]


def wl_relational(triples: DataFrame, pairs: DataFrame, iterations: int = 5) -> DataFrame:
    """pair_id, wl: the normalised kernel over levels 0 to ``iterations`` by joins on nodes; null where a graph has no edge.

    The edges and each level's labels are written once, so the plan of a level doesn't hold the levels before it.  One
    join and one aggregation a level, keyed by the pair and a node: a large graph is spread over tasks.  Labels are
    64-bit hashes, which meet only labels of the same pair.
    """
    e = edges(triples).select("pair_id", "side", "u", "v")
    both = durable(e.union(e.select("pair_id", "side", F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = both.select("pair_id", "side", "u").distinct().withColumn("label", F.xxhash64("u"))
    levels = []
    for level in range(iterations + 1):
        labels = durable(labels)
        levels.append(labels.select("pair_id", "side", F.lit(level).alias("level"), "label"))
        if level < iterations:
            near = both.join(labels.select("pair_id", "side", F.col("u").alias("v"), F.col("label").alias("near")), ["pair_id", "side", "v"])
            near = near.groupBy("pair_id", "side", "u").agg(F.array_sort(F.collect_list("near")).alias("near"))
            labels = labels.join(near, ["pair_id", "side", "u"]).select("pair_id", "side", "u", F.xxhash64("label", "near").alias("label"))
    c = [F.sum((F.col("side") == k).cast("long")).alias(f"c{k}") for k in (0, 1)]
    own = reduce(DataFrame.unionByName, levels).groupBy("pair_id", "level", "label").agg(*c)
    total = own.groupBy("pair_id").agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"k{i}{j}") for i, j in ((0, 1), (0, 0), (1, 1))])
    return _normalised(total, pairs)


#: Edges of whole pairs that a task labels together, at least one pair.
TOGETHER = 1 << 18


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit numbers spread over all 64-bit numbers, one to one."""
    x = x ^ np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Places in sorted columns where another row begins."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def wl_sums(pair: np.ndarray, side: np.ndarray, u: np.ndarray, v: np.ndarray, iterations: int) -> np.ndarray:
    """Sums k01, k00 and k11 over levels 0 to ``iterations`` for pairs 0, 1, .. of edges between nodes named by 64-bit numbers.

    A label of the next level is a hash of a node's label and of the sum of its neighbours' mixed labels, which tells
    multisets apart as their sorted labels do; labels meet only those of the same pair.
    """
    graph, name = np.tile(2 * pair + side, 2), np.concatenate([u, v])
    order = np.lexsort((name, graph))
    graph, name = graph[order], name[order]
    first = _firsts(graph, name)
    node = np.empty(len(order), np.int64)
    node[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    graph, label, n = graph[first], name[first].view(np.uint64), len(first)
    one, two = node[: len(u)], node[len(u) :]
    both = np.unique(np.concatenate([one * n + two, two * n + one]))  # repeated edges once, by node
    start, near = _firsts(both // n), both % n
    group, right, out = graph // 2, graph % 2, np.zeros((3, int(pair[-1]) + 1))
    for level in range(iterations + 1):
        order = np.lexsort((label, group))
        first = _firsts(group[order], label[order])
        c1 = np.add.reduceat(right[order], first)
        c0 = np.diff(np.append(first, n)) - c1
        for k, product in enumerate((c0 * c1, c0 * c0, c1 * c1)):
            out[k] += np.bincount(group[order][first], product, out.shape[1])
        if level < iterations:
            label = _mixed(_mixed(label, 1) + np.add.reduceat(_mixed(label, 2)[near], start), 3)
    return out.astype(np.int64)


def wl_grouped(triples: DataFrame, pairs: DataFrame, iterations: int = 5) -> DataFrame:
    """As ``wl_relational``, with the edges of a pair in one task: they are shuffled once, as hashes of their nodes, whatever the levels."""
    s, o = F.xxhash64(F.lower("s")).alias("u"), F.xxhash64(F.lower("o")).alias("v")
    e = triples.where("s is not null and o is not null and pair_id is not null").select("pair_id", F.col("side").cast("long").alias("side"), s, o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges come by pair; whole pairs gather until they are ``TOGETHER`` edges."""
        held: list[pa.RecordBatch] = []
        rows, enough = 0, TOGETHER
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= enough:
                t = pa.Table.from_batches(held).combine_chunks()
                codes = t["pair_id"].combine_chunks().dictionary_encode().indices.to_numpy()
                whole = int(np.searchsorted(codes, codes[-1]))  # the last pair may go on
                if whole:
                    yield sums(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                rows = t.num_rows - whole
                enough = max(TOGETHER, 2 * rows)
        if rows:
            yield sums(pa.Table.from_batches(held).combine_chunks())

    def sums(t: pa.Table) -> pa.RecordBatch:
        pair = t["pair_id"].combine_chunks().dictionary_encode()
        k = wl_sums(pair.indices.to_numpy().astype(np.int64), *(t[c].to_numpy() for c in ("side", "u", "v")), iterations)
        return pa.RecordBatch.from_arrays([pair.dictionary, *(pa.array(x) for x in k)], ["pair_id", "k01", "k00", "k11"])

    kind = dict(triples.dtypes)["pair_id"]
    own = e.repartition("pair_id").sortWithinPartitions("pair_id").mapInArrow(run, f"pair_id {kind}, k01 long, k00 long, k11 long")
    return _normalised(own, pairs)


def _normalised(total: DataFrame, pairs: DataFrame) -> DataFrame:
    wl = F.when((F.col("k00") > 0) & (F.col("k11") > 0), F.col("k01") / F.sqrt(F.col("k00").cast("double") * F.col("k11")))
    return pairs.select("pair_id").distinct().join(total.select("pair_id", wl.alias("wl")), "pair_id", "left")


def relabel(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triples whose subjects and objects are replaced as ``mapping`` (pair_id, label, anchor) says; others and relations stay."""
    out = triples
    for c in ("s", "o"):
        own = mapping.select("pair_id", F.col("label").alias(c), F.col("anchor").alias("_anchor"))
        out = out.join(own, ["pair_id", c], "left").withColumn(c, F.coalesce("_anchor", c)).drop("_anchor")
    return out.select(*triples.columns)


def contract(triples: DataFrame, clusters: DataFrame) -> DataFrame:
    """pair_id, side, u, v, relation: the graph with each cluster (pair_id, label, anchor) as one node; the first relation stays."""
    rows = relabel(triples, clusters)
    u, v = F.least("s", "o").alias("u"), F.greatest("s", "o").alias("v")
    return rows.groupBy("pair_id", "side", u, v).agg(F.min_by("p", "pos").alias("relation"))


def first_seen(triples: DataFrame) -> DataFrame:
    """pair_id, side, label, id: nodes numbered as they first appear, a subject before its object."""
    from pyspark.sql import Window

    ends = F.array(F.struct((2 * F.col("pos")).alias("at"), F.col("s").alias("label")), F.struct((2 * F.col("pos") + 1).alias("at"), F.col("o").alias("label")))
    rows = triples.select("pair_id", "side", F.explode(ends).alias("e")).groupBy("pair_id", "side", "e.label").agg(F.min("e.at").alias("at"))
    return rows.select("pair_id", "side", "label", (F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("at")) - 1).cast("long").alias("id"))


def triple_ids(triples: DataFrame, words: DataFrame) -> DataFrame:
    """pair_id, side, pos, h, r, t: numbers of a vocabulary (pair_id, kind, label, id); 0 for what it lacks."""
    out = triples.select("pair_id", "side", "pos", *[F.lower(c).alias(c) for c in ("s", "p", "o")])
    for c, kind, name in (("s", "entity", "h"), ("p", "relation", "r"), ("o", "entity", "t")):
        own = words.where(F.col("kind") == kind).select("pair_id", F.col("label").alias(c), F.col("id").alias(name))
        out = out.join(own, ["pair_id", c], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out.select("pair_id", "side", "pos", "h", "r", "t")
