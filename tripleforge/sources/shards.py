"""Sharded data sets of JSON lines as a data source of their own, for tables and for streams.

``spark.dataSource.register(Shards)`` makes the format ``shards`` known; ``Hub`` maps names of data sets to folders.  The
files may lie in any file system that Arrow opens, compressed or not.  Each file is a partition, read in blocks, and only
the asked columns are parsed.  As a stream, files come in the order in which they were written, each once.

Lines that lack a column have null there; columns that aren't in the schema are passed over.  Empty files and folders
give no rows.  A line that is no JSON object is an error that names its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pajson
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

ENDS = (".json", ".jsonl", ".json.gz", ".jsonl.gz", ".json.zst", ".jsonl.zst", ".json.bz2", ".jsonl.bz2")
#: Bytes of a file that are parsed at a time; a line may not be longer.
BLOCK_BYTES = 1 << 24


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match("file:/(?!/)", path):
        path = f"file://{path[5:]}"
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def listed(path: str, ends: Sequence[str] = ENDS) -> list[tuple[int, str, int]]:
    """Time, path and bytes of the data files below a folder, in the order in which they were written."""
    where, root = opened(path)
    infos = [where.get_file_info(root)]
    if infos[0].type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if infos[0].type == pafs.FileType.Directory:
        infos = where.get_file_info(pafs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].split("/"))
    return sorted((x.mtime_ns or 0, x.path, x.size or 0) for x in infos if x.type == pafs.FileType.File and x.path.endswith(tuple(ends)) and not hidden(x.path))


class Shard(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def parsed(root: str, path: str, schema: pa.Schema | None) -> Iterator[pa.RecordBatch]:
    """A file's rows; columns that the schema doesn't have are passed over."""
    where, _ = opened(root)
    options = pajson.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore" if schema is not None else "infer")
    with where.open_input_stream(path, compression="detect") as stream:
        head = stream.read(1)
        if not head:
            return
    with where.open_input_stream(path, compression="detect") as stream:
        try:
            reader = pajson.open_json(stream, pajson.ReadOptions(block_size=BLOCK_BYTES), options)
            for batch in reader:
                yield batch if schema is None else batch.select(schema.names)
        except pa.ArrowInvalid as problem:
            raise ValueError(f"{path}: {problem}") from problem


class _Reading:
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, to_arrow_schema(schema)

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        yield from parsed(self.path, partition.value, self.schema)


class _Tables(_Reading, DataSourceReader):
    def partitions(self) -> list[Shard]:
        return [Shard(path) for _, path, size in sorted(listed(self.path), key=lambda x: -x[2])] or [Shard("")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.value else iter(())


class _Streams(_Reading, DataSourceStreamReader):
    """An offset is the time and the name of the last file taken."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return [Shard(path) for time, path, _ in listed(self.path) if after < (time, path) <= upto]


class Shards(DataSource):
    """``path`` is the folder; ``columns`` (names, with commas) leaves only these.  Without a schema the first file's first block tells it."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> StructType:
        if not (files := listed(self.options["path"])):
            raise ValueError("an empty folder needs a schema")
        batch = next((b for _, path, _ in files for b in parsed(self.options["path"], path, None)), None)
        if batch is None:
            raise ValueError("empty files need a schema")
        return self._asked(from_arrow_schema(batch.schema))

    def _asked(self, schema: StructType) -> StructType:
        names = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([schema[c] for c in names]) if names else schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Tables(self.options["path"], self._asked(schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Streams(self.options["path"], self._asked(schema))


class Hub:
    """Data sets by name: ``name`` or ``name/config`` stands for a folder below the root, with a folder of files for each split."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.dataSource.register(Shards)

    def load(self, name: str, split: str = "train", schema: str | None = None, columns: Sequence[str] = (), stream: bool = False) -> DataFrame:
        """A split as a table, or as a stream that its new files go on; ``columns`` are all that is read."""
        reader = (self.spark.readStream if stream else self.spark.read).format("shards")
        if schema is not None:
            kept = StructType.fromDDL(schema)
            reader = reader.schema(StructType([kept[c] for c in columns]) if columns else kept)
        return reader.option("columns", ",".join(columns)).load(f"{self.root}/{name}/{split}")
