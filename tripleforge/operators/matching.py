"""Best-match joins of vectors inside pairs, and the scores that follow from them.

Both sides are tables (pair_id, pos, v, ...).  The join is always on the pair, so its size is that of two small sides;
the best match is an aggregation (``max_by``), not a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + floor)


def pair_cosines(one: DataFrame, two: DataFrame) -> DataFrame:
    """pair_id, pos1, pos2, cos for all couples of a pair's two sides."""
    n1, n2 = F.sqrt(dot(F.col("v"), F.col("v"))), F.sqrt(dot(F.col("v"), F.col("v")))
    a = one.select("pair_id", F.col("pos").alias("pos1"), F.col("v").alias("v1"), n1.alias("n1"))
    b = two.select("pair_id", F.col("pos").alias("pos2"), F.col("v").alias("v2"), n2.alias("n2"))
    return a.join(b, "pair_id").select("pair_id", "pos1", "pos2", (dot(F.col("v1"), F.col("v2")) / (F.col("n1") * F.col("n2") + 1e-8)).alias("cos"))


def best_match(cosines: DataFrame, digits: int = 6) -> DataFrame:
    """pair_id, pos1, pos2, cos: the best couple of each pos1; of equals (to ``digits``) the first pos2."""
    by = F.struct(F.round("cos", digits), -F.col("pos2"))
    return cosines.groupBy("pair_id", "pos1").agg(F.max_by(F.struct("pos2", "cos"), by).alias("b")).select("pair_id", "pos1", "b.pos2", "b.cos")


def soft_mapping(best: DataFrame, threshold: float = 0.65) -> DataFrame:
    """``best`` with ``anchor``: pos2 where the match is near enough, else null."""
    return best.withColumn("anchor", F.when(F.col("cos") >= threshold, F.col("pos2")))


def match_f1(cosines: DataFrame) -> DataFrame:
    """pair_id, p, r, f1 of mean best matches: p over pos2, r over pos1."""
    p = cosines.groupBy("pair_id", "pos2").agg(F.max("cos").alias("c")).groupBy("pair_id").agg(F.avg("c").alias("p"))
    r = cosines.groupBy("pair_id", "pos1").agg(F.max("cos").alias("c")).groupBy("pair_id").agg(F.avg("c").alias("r"))
    return p.join(r, "pair_id").withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def gaussian_similarity(cosines: DataFrame, sigma: float = 1.0) -> DataFrame:
    """pair_id, similarity: mean over pos1 of the largest exp(-d^2 / 2 sigma^2), d between unit vectors."""
    near = F.exp(-(2 - 2 * F.col("cos")) / (2 * sigma**2))
    return cosines.groupBy("pair_id", "pos1").agg(F.max(near).alias("c")).groupBy("pair_id").agg(F.avg("c").alias("similarity"))


def pooled_cosine(one: DataFrame, two: DataFrame) -> DataFrame:
    """pair_id, cos of the two sides' mean vectors."""

    def mean(df: DataFrame, name: str) -> DataFrame:
        per = df.select("pair_id", F.posexplode("v").alias("i", "x")).groupBy("pair_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        return per.withColumnRenamed("x", name)

    both = mean(one, "x").join(mean(two, "y"), ["pair_id", "i"])
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    return both.groupBy("pair_id").agg((s("x", "y") / (F.sqrt(s("x", "x")) * F.sqrt(s("y", "y")) + 1e-8)).alias("cos"))


def partwise_classes(parts: DataFrame, t: float = 0.7) -> DataFrame:
    """pair_id, pos1, pos2, overall, class, from couples with the cosines of heads, relations and tails.

    The best couple by the mean of the three; a match below 0.5 is missing; all three near: aligned; entities near but
    not the relation: relation_substitution; the relation and one entity near: entity_substitution; else unclassified.
    """
    overall = F.round((F.col("head") + F.col("rel") + F.col("tail")) / 3, 6)
    rows = parts.withColumn("overall", overall)
    best = rows.groupBy("pair_id", "pos1").agg(F.max_by(F.struct("pos2", "overall", "head", "rel", "tail"), F.struct("overall", -F.col("pos2"))).alias("b")).select("pair_id", "pos1", "b.*")
    h, r, x = F.col("head") >= t, F.col("rel") >= t, F.col("tail") >= t
    kind = F.when(F.col("overall") < 0.5, "missing").when(h & r & x, "aligned").when(h & x, "relation_substitution").when(r & (h | x), "entity_substitution").otherwise("unclassified")
    return best.withColumn("class", kind)


def three_classes(couples: DataFrame, aligned: float = 0.76, entity: float = 0.8, relation: float = 0.7) -> DataFrame:
    """pair_id, pos1, pos2, score, class, from couples with the score of the whole triples and the cosines of their parts.

    The best couple by score, the first of equals: near enough as a whole: aligned; else by its parts, both entities but
    not the relation: relation_different; the relation and an entity: entity_different; else unclassified.
    """
    rows = couples.withColumn("score", F.round("score", 6))
    best = rows.groupBy("pair_id", "pos1").agg(F.max_by(F.struct("pos2", "score", "head", "rel", "tail"), F.struct("score", -F.col("pos2"))).alias("b")).select("pair_id", "pos1", "b.*")
    h, r, t = F.col("head") >= entity, F.col("rel") >= relation, F.col("tail") >= entity
    kind = F.when(F.col("score") >= aligned, "aligned").when(h & t & ~r, "relation_different").when(r & (h | t), "entity_different").otherwise("unclassified")
    return best.withColumn("class", kind)


def class_columns(classes: DataFrame, kinds: list[str]) -> DataFrame:
    """pair_id and a column a class: the couples [pos1, pos2] of the class in order, as JSON."""
    each = [F.to_json(F.array_sort(F.collect_list(F.when(F.col("class") == k, F.array("pos1", "pos2"))))).alias(k) for k in kinds]
    return classes.groupBy("pair_id").agg(*each)


def extras(two: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the second side that no classified match uses."""
    used = classes.where(~F.col("class").isin("missing", "unclassified")).select("pair_id", F.col("pos2").alias("pos")).distinct()
    return two.join(used, ["pair_id", "pos"], "left_anti")


def label_clusters(vectors: DataFrame, key: str, vector: str = "v", seed: int = 0, steps: int = 10) -> DataFrame:
    """key, cluster by k-means with k = max(3, sqrt of the number of rows), distributed; for tables of labels."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    k = max(3, int(rows.count() ** 0.5))
    return KMeans(k=k, seed=seed, maxIter=steps).fit(rows).transform(rows).select(key, F.col("prediction").alias("cluster"))
