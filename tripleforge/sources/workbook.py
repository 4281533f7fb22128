"""Workbooks of the open spreadsheet format (a zip of XML parts), read and written as a data source, without added packages.

Reading: a partition for each workbook below a path and each sheet asked for; the first row names the columns.  Cells are
strings unless the schema says otherwise; an empty cell is null.  Writing: one workbook whose sheets are tables; a
sheet has at most as many rows as the format allows, more are an error.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from .shards import listed, opened

# The format's names, and its most rows and columns.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML can't hold.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def column_name(k: int) -> str:
    """A, B, ..., Z, AA, ... of columns from 0."""
    out, k = "", k + 1
    while k:
        k, digit = divmod(k - 1, 26)
        out = chr(65 + digit) + out
    return out


def column_number(cell: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", cell)[0]:
        out = 26 * out + ord(c) - 64
    return out - 1


class Book:
    """A workbook that is open for reading."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {x.get("Id"): x.get("Target") for x in links}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        at = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {x.get("name"): at(target[x.get(f"{{{LINKS}}}id")]) for x in book.iter(f"{{{MAIN}}}sheet")}
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            with self.zip.open("xl/sharedStrings.xml") as part:
                for _, node in ElementTree.iterparse(part):
                    if node.tag == f"{{{MAIN}}}si":
                        self.shared.append("".join(t.text or "" for run in node for t in ([run] if run.tag == f"{{{MAIN}}}t" else run.findall(f"{{{MAIN}}}t") if run.tag == f"{{{MAIN}}}r" else [])))
                        node.clear()

    def rows(self, sheet: str) -> Iterator[list[str | float | bool | None]]:
        """The cells of each row of a sheet; rows that are left out in the file are left out here."""
        with self.zip.open(self.sheets[sheet]) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag == f"{{{MAIN}}}row":
                    out: list = []
                    for cell in node.findall(f"{{{MAIN}}}c"):
                        at = column_number(cell.get("r")) if cell.get("r") else len(out)
                        out += [None] * (at + 1 - len(out))
                        out[at] = self._value(cell)
                    node.clear()
                    yield out

    def _value(self, cell: ElementTree.Element) -> str | float | bool | None:
        kind, v = cell.get("t", "n"), cell.find(f"{{{MAIN}}}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        return v.text == "1" if kind == "b" else v.text if kind in ("str", "e") else float(v.text)


def _as(value: str | float | bool | None, kind) -> object:
    """A cell as a column's type has it; null where it can't be."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(int(value)) if value == int(value) else repr(value)
    try:
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
        number = float(value)
        return number if isinstance(kind, (DoubleType, FloatType)) else int(number) if number == int(number) else None
    except (ValueError, OverflowError):
        return None


class Sheet(InputPartition):
    def __init__(self, path: str, name: str | None):
        super().__init__((path, name))


def _book(root: str, path: str) -> Book:
    with opened(root)[0].open_input_file(path) as f:
        return Book(f.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: StructType):
        self.path, self.sheet, self.schema = path, sheet, schema

    def partitions(self) -> list[Sheet]:
        return [Sheet(path, self.sheet) for _, path, _ in listed(self.path, (".xlsx",))]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        path, sheet = partition.value
        book = _book(self.path, path)
        rows = book.rows(sheet if sheet is not None else next(iter(book.sheets)))
        names = [None if x is None else str(x).strip() for x in next(rows, [])]
        at = [names.index(f.name) if f.name in names else -1 for f in self.schema]
        for row in rows:
            yield tuple(_as(row[i] if 0 <= i < len(row) else None, f.dataType) for i, f in zip(at, self.schema, strict=True))


class _Done(WriterCommitMessage):
    def __init__(self, temporary: str | None):
        self.temporary = temporary


class _Writer(DataSourceWriter):
    """Rows are (sheet, nth, cells as JSON); one task writes the book under another name, which the commit changes."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Done:
        where, path = opened(self.path)
        temporary = f"{path}.{uuid.uuid4().hex}"
        sheets: list[str] = []
        out = None
        for row in iterator:
            if out is None:
                where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                book = zipfile.ZipFile(where.open_output_stream(temporary), "w", zipfile.ZIP_DEFLATED)
                out = True
            if not sheets or sheets[-1] != row.sheet:
                if sheets:
                    part.write(b"</sheetData></worksheet>")
                    part.close()
                sheets.append(row.sheet)
                part, n = book.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True), 0
                part.write(f'{_XML}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            n += 1
            if n > MOST_ROWS:
                raise ValueError(f"more than {MOST_ROWS} rows in sheet {row.sheet}")
            part.write(f'<row r="{n}">{"".join(self._cell(v, i, n) for i, v in enumerate(json.loads(row.cells)))}</row>'.encode())
        if out is None:
            return _Done(None)
        part.write(b"</sheetData></worksheet>")
        part.close()
        self._rest(book, sheets)
        book.close()
        book.fp and book.fp.close()
        return _Done(temporary)

    @staticmethod
    def _cell(value: object, i: int, n: int) -> str:
        at = f"{column_name(i)}{n}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(_UNFIT.sub("", value))}</t></is></c>'

    @staticmethod
    def _rest(book: zipfile.ZipFile, sheets: list[str]) -> None:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')

    def commit(self, messages) -> None:
        where, path = opened(self.path)
        for message in messages:
            if message is not None and message.temporary:
                where.move(message.temporary, path)

    def abort(self, messages) -> None:
        where, _ = opened(self.path)
        for message in messages:
            if message is not None and message.temporary:
                where.delete_file(message.temporary)


class Workbooks(DataSource):
    """``path`` is a workbook or a folder of them, ``sheet`` a sheet's name (by default the first)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        files = listed(self.options["path"], (".xlsx",))
        if not files:
            raise ValueError("no workbook")
        book = _book(self.options["path"], files[0][1])
        names = next(book.rows(self.options.get("sheet") or next(iter(book.sheets))), [])
        return StructType([StructField(str(x).strip(), StringType()) for x in names if x is not None])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("sheet"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    """A sheet of a workbook, or of each workbook of a folder; strings unless a schema is given."""
    spark.dataSource.register(Workbooks)
    reader = spark.read.format("workbook")
    reader = reader.schema(schema) if schema else reader
    return (reader.option("sheet", sheet) if sheet is not None else reader).load(path)


def write_workbook(sheets: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """One workbook; each sheet is a table and the columns its rows are ordered by.  Nested values are written as JSON, other types as text.

    A single task writes it, row by row.
    """
    spark = next(iter(sheets.values()))[0].sparkSession
    spark.dataSource.register(Workbooks)
    rows = None
    plain = (StringType, BooleanType, IntegerType, LongType, DoubleType, FloatType)
    for nth, (name, (df, order)) in enumerate(sheets.items()):
        if len(df.columns) > MOST_COLUMNS or re.search(r"[\[\]:*?/\\]", name) or not 0 < len(name) <= 31:
            raise ValueError(f"sheet {name!r}")
        nested = lambda f: f.dataType.simpleString().startswith(("array", "map", "struct"))
        cells = [F.to_json(f"`{f.name}`").alias(f.name) if nested(f) else F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.col(f"`{f.name}`").cast("string") for f in df.schema]
        finite = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c) if isinstance(f.dataType, (DoubleType, FloatType)) else c for c, f in zip(cells, df.schema, strict=True)]
        inside = lambda x: F.substr(x, F.lit(6), F.length(x) - 6)  # noqa: E731  of {"x":...}
        each = F.concat(F.lit("["), F.concat_ws(",", *[F.when(c.isNull(), "null").otherwise(inside(F.to_json(F.struct(c.alias("x"))))) for c in finite]), F.lit("]"))
        own = df.select(F.lit(nth).alias("at"), F.lit(name).alias("sheet"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("by"), each.alias("cells"))
        own = own.orderBy("by").select("at", "sheet", F.monotonically_increasing_id().alias("nth"), "cells")
        head = spark.createDataFrame([(nth, name, -1, json.dumps(df.columns))], "at int, sheet string, nth long, cells string")
        own = head.unionByName(own)
        rows = own if rows is None else rows.unionByName(own)
    rows.repartition(1).sortWithinPartitions("at", "nth").select("sheet", "nth", "cells").write.format("workbook").mode("overwrite").save(path)
