"""SQLite files as a Spark source (SRC-11): a GeoPackage's feature tables, read in ranges of rows by executors.

SQLite opens files, so the path has to be one that the driver and all executors mount.  Geometry columns come as bytes.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[Rows]:
        with _open(self.path) as con:
            low, high = con.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {_quoted(self.table)}").fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] or [Rows(0, -1)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(map(_quoted, self.columns))
        with _open(self.path) as con:
            yield from con.execute(f"select {names} from {_quoted(self.table)} where rowid between ? and ?", (partition.first, partition.last))


class Sqlite(DataSource):
    """Options: path, table, parts (default 8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def _columns(self) -> list[tuple[str, str]]:
        with _open(self.options["path"]) as con:
            return [(r[1], (r[2] or "").upper()) for r in con.execute(f"pragma table_info({_quoted(self.options['table'])})")]

    def schema(self) -> StructType:
        def kind(t: str):
            return LongType() if "INT" in t else StringType() if any(x in t for x in ("CHAR", "TEXT", "CLOB")) else DoubleType() if any(x in t for x in ("REAL", "FLOA", "DOUB")) else BinaryType()

        return StructType([StructField(n, kind(t)) for n, t in self._columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], [f.name for f in schema], int(self.options.get("parts", 8)))


def tables_of(path: str) -> dict[str, list[str]]:
    """Table -> columns of a file."""
    with _open(path) as con:
        names = [r[0] for r in con.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' and name not like 'gpkg_%' order by name")]
        return {n: [r[1] for r in con.execute(f"pragma table_info({_quoted(n)})")] for n in names}


def feature_table(path: str, level: int) -> str:
    """The first table with GID_n and NAME_n of a level."""
    for name, columns in tables_of(path).items():
        if {f"GID_{level}", f"NAME_{level}"} <= set(columns):
            return name
    raise LookupError(f"no table of {path} has GID_{level} and NAME_{level}")


def boundaries(spark: SparkSession, path: str, level: int, parts: int = 8) -> DataFrame:
    """The rows of a level's table with GID_n and NAME_n; `catalog.features` makes them distinct."""
    spark.dataSource.register(Sqlite)
    rows = spark.read.format("sqlite_rows").option("path", path).option("table", feature_table(path, level)).option("parts", parts).load()
    return rows.select(F.col(f"GID_{level}"), F.col(f"NAME_{level}"))
