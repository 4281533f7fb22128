"""Readers and writers: text-only CSV, scored files with metadata in their path, tables for papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import durable, ordinals


def read_csv(spark: SparkSession, path: str, schema: str | None = None, recursive: bool = False, line_breaks: bool = False, keep_empty: bool = False) -> DataFrame:
    """A CSV file or folder with a header; all columns are strings unless a schema is given.

    ``line_breaks``: cells may hold them, in which case a file is one task.  ``keep_empty``: an empty cell is an empty
    text, otherwise null.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("recursiveFileLookup", recursive)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return df.na.fill("") if keep_empty else df


def path_metadata(path: Column) -> list[Column]:
    """dataset, model and temperature of ``.../<temperature>/<dataset>_<model>.csv``; a folder that is no number counts as 0."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^/.]+)*$", 1)
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return [
        F.regexp_extract(name, r"^([^_]+)", 1).alias("dataset"), F.regexp_extract(name, r"^[^_]+_(.+)$", 1).alias("model"),
        F.coalesce(F.when(folder.rlike(r"^\d+(\.\d+)?$"), folder.cast("double")), F.lit(0.0)).alias("temperature"),
    ]


def read_scored(spark: SparkSession, root: str, columns: list[str], line_breaks: bool = True) -> DataFrame:
    """All scored CSV files below a folder with their metadata; score columns as doubles, null if unreadable."""
    df = read_csv(spark, root, recursive=True, line_breaks=line_breaks).withColumn("_path", F.input_file_name())
    scores = {c: F.expr(f"try_cast(`{c}` as double)") for c in columns if c in df.columns}
    return df.withColumns(scores).select("*", *path_metadata(F.col("_path"))).drop("_path")


#: Different headers that one tree may have, and columns of one file.
MOST_HEADERS, MOST_COLUMNS = 1000, 4096


def headers(spark: SparkSession, root: str, suffix: str = ".csv", skip: tuple[str, ...] = ()) -> DataFrame:
    """path, names: the header of every CSV file below a folder, read by tasks that take the files' first lines.

    Files whose name doesn't end with ``suffix`` and those below a folder named in ``skip`` are left out, and so are
    files without a line.  Names are trimmed.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("start")).where("start = 0")
    for folder in skip:
        lines = lines.where(~F.contains("path", F.lit(f"/{folder}/")))
    first = lines.withColumn("nth", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "nth").alias("line"))
    cells = F.regexp_extract_all(F.regexp_replace("line", "^\ufeff|\r$", ""), F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = lambda x: F.trim(F.when(F.startswith(x, F.lit('"')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return first.select("path", F.transform(cells, bare).alias("names"))


def read_tree(spark: SparkSession, root: str, scores: list[str], skip: tuple[str, ...] = ("Analysis_plot_temps",), line_breaks: bool = False) -> DataFrame:
    """All CSV files below a folder that have every one of the score columns, united by the names of their own headers.

    Files may have their columns in any order and columns that others lack, which are null there.  Files without a score
    column and the folders of results in ``skip`` are left out.  Scores become doubles, null if unreadable; dataset, model,
    temperature and source_file come from the path.  The files are read once, by place of column; a table of their headers
    says which name each place has.  Of a name that a header repeats, the first place counts.
    """
    found = headers(spark, root, skip=skip)
    for c in scores:
        found = found.where(F.array_contains("names", c))
    found = durable(found)
    kinds = [r["names"] for r in found.select("names").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(kinds) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    names = list(dict.fromkeys(n for kind in kinds for n in kind if n))
    width = max((len(kind) for kind in kinds), default=1)
    if width > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns in a file")
    if clash := {"dataset", "model", "temperature", "source_file"} & set(names):
        raise ValueError(f"columns named like those from the path: {sorted(clash)}")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True).option("enforceSchema", True)
    reader = reader.option("multiLine", line_breaks).option("escape", '"').schema(", ".join(f"c{i} string" for i in range(width)))
    rows = reader.csv(root).select(F.col("_metadata.file_path").alias("path"), F.array(*[f"c{i}" for i in range(width)]).alias("cells"))
    kind_of = spark.createDataFrame([(i, kind) for i, kind in enumerate(kinds)], "kind int, names array<string>")  # the different headers
    told = found.join(F.broadcast(kind_of), "names").select("path", "kind")
    few = told.count() <= MOST_COLUMNS * MOST_HEADERS // 16
    met = rows.join(F.broadcast(told) if few else told, "path")
    places = F.array(*[F.array(*[F.lit(kind.index(n) if n in kind else -1) for n in names] or [F.lit(-1)]) for kind in kinds] or [F.array(F.lit(-1))])
    cell = lambda k: F.get(F.col("cells"), F.nullif(F.get(F.get(places, F.col("kind")), F.lit(k)), F.lit(-1)))
    value = lambda n, k: cell(k).try_cast("double") if n in scores else cell(k)
    return met.select(*[value(n, k).alias(n) for k, n in enumerate(names)], *path_metadata(F.col("path")), F.col("path").alias("source_file"))


def resolve(df: DataFrame, candidates: list[str]) -> str | None:
    """The first of the candidate column names that the table has."""
    return next((c for c in candidates if c in df.columns), None)


def first_source(attempts: list[Callable[[], DataFrame]]) -> DataFrame:
    """The first of several sources that can be read; the last one's error if none can."""
    problem: Exception = ValueError("no source given")
    for attempt in attempts:
        try:
            return attempt()
        except (AnalysisException, FileNotFoundError, ValueError) as error:
            problem = error
    raise problem


def join_scores(
    pairs: DataFrame, scores: DataFrame, score: str, keys: tuple[str, ...] = ("pair_id", "row_id", "id"), order: list[str] | None = None, pair_order: list[str] | None = None
) -> DataFrame:
    """Pairs with their score, null if there is none.

    The scores' key is the first of ``keys`` that they have; it meets the pairs' column of that name, or ``id`` their
    ``pair_id``.  Of repeated keys the first by ``order`` stays (by default the smallest score).  Without such a key rows
    meet by their place, scores by ``order`` and pairs by ``pair_order``, which must then be given.
    """
    key = next((k for k in keys if k in scores.columns), None)
    theirs = key if key in pairs.columns else "pair_id" if key == "id" and "pair_id" in pairs.columns else None
    if theirs is not None:
        kept = F.min_by(score, F.struct(*order)) if order else F.min(score)
        rows = scores.groupBy(F.col(key).alias(theirs)).agg(kept.alias(score))
        return pairs.join(rows, theirs, "left")
    if not order or not pair_order:
        raise ValueError(f"none of {keys} in both tables, and no order to join by")
    left, right = ordinals(pairs, pair_order, "_ordinal"), ordinals(scores, order, "_ordinal").select("_ordinal", score)
    return left.join(right, "_ordinal", "left").drop("_ordinal")


def standardize(df: DataFrame, columns: dict[str, list[str]], kinds: dict[int, str], dataset: str, n: int | None = None, order: list[str] | None = None) -> DataFrame:
    """pair_id, response1, response2, label, perturbation_type, dataset_name from a table whose columns have one of several names.

    ``columns`` gives the candidates for each of response1, response2 and label; ``kinds`` names the labels' kinds.  Rows
    without a text are dropped; the first ``n`` by ``order`` stay and are numbered from 0 in that order.
    """
    names = {k: resolve(df, own) for k, own in columns.items()}
    if missing := [k for k, v in names.items() if v is None]:
        raise ValueError(f"no column for {missing}")
    label = F.expr(f"try_cast(`{names['label']}` as int)")
    kind = F.coalesce(*[F.when(label == k, F.lit(v)) for k, v in kinds.items()], F.lit("unknown"))
    rows = df.withColumns({"_a": F.col(names["response1"]), "_b": F.col(names["response2"]), "_l": label, "_k": kind}).where("_a is not null and _b is not null and _l is not null")
    order = order or ["_a", "_b", "_l"]
    rows = ordinals(rows.orderBy(*order).limit(n) if n is not None else rows, order, "pair_id")
    return rows.select("pair_id", F.col("_a").alias("response1"), F.col("_b").alias("response2"), F.col("_l").alias("label"), F.col("_k").alias("perturbation_type"), F.lit(dataset).alias("dataset_name"))


def split_by(df: DataFrame, key: list[str], columns: dict[str, float], name: str = "alpha", value: str = "score") -> DataFrame:
    """key, alpha, score: one row for each of the wide columns that isn't null; ``columns`` maps a column to its alpha."""
    each = F.array(*[F.struct(F.lit(a).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c, a in columns.items()])
    return df.select(*key, F.explode(each).alias("e")).select(*key, f"e.{name}", f"e.{value}").where(F.col(value).isNotNull())


def write_split(df: DataFrame, path: str, by: str = "alpha") -> None:
    """A folder of CSV files for each value of a column."""
    df.write.mode("overwrite").partitionBy(by).option("header", True).csv(path)


def base_name(path: Column) -> Column:
    """A file's name without its folder, its extension and the ends that name a method or an alpha."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^/.]+)?$", 1), r"_(?:results|scores|alpha_[0-9]p[0-9]+(?:_results)?)$", "")


def pivot_reindexed(df: DataFrame, row: str, column: str, value: str, rows: list[str], columns: list[str]) -> DataFrame:
    """A row for each of ``rows`` in their order, a column for each of ``columns``; null where the table has nothing."""
    spark = df.sparkSession
    wide = df.where(F.col(row).isin(rows)).groupBy(row).pivot(column, columns).agg(F.first(value, True))
    order = F.broadcast(spark.createDataFrame(list(enumerate(rows)), f"_nth long, `{row}` string"))  # the given rows
    return order.join(wide, row, "left").orderBy("_nth").select(row, *columns)


def ordered_by(df: DataFrame, orders: dict[str, list[str]], drop_others: bool = True) -> DataFrame:
    """Rows sorted by columns whose values have a stated order; other values are dropped, or come last."""
    place = {c: F.array_position(F.array(*map(F.lit, own)), F.col(c)) for c, own in orders.items()}
    if drop_others:
        for c, p in place.items():
            df = df.where(F.col(c).isNotNull() & (p > 0))
    return df.orderBy(*[F.when(p > 0, p).asc_nulls_last() for p in place.values()], *orders)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """label, n."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def split_low(df: DataFrame, scores: list[str], limits: Column, path: str) -> None:
    """Three CSV folders with the table's columns: all rows, the low ones, and those with no low score."""
    low = limits
    for name, rows in (("all", df), ("low", df.where(low)), ("filtered", df.where(~low))):
        write_csv(rows.select(*df.columns), f"{path}/{name}")


def copy_to(df: DataFrame, paths: list[str]) -> None:
    """The same CSV at several places; the rows are computed for each."""
    for path in paths:
        write_csv(df, path)


def to_console(df: DataFrame, most: int = 1000) -> str:
    """A fixed-width table of a small result; an error beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cells = [df.columns, *[["-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip() for r in cells)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def to_latex(df: DataFrame, most: int = 1000) -> str:
    """A booktabs table of a small result; an error beyond ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "--" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("_", r"\_").replace("%", r"\%")
    lines = [" & ".join(cell(x) for x in r) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", lines[0], r"\midrule", *lines[1:], r"\bottomrule", r"\end{tabular}"])
