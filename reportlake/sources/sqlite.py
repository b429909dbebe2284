"""SQLite tables as a Spark data source over the standard library, opened read-only and read in ranges of rowid."""

from __future__ import annotations

import sqlite3
from contextlib import closing

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SqliteSource(DataSource):
    """format("sqlite") with options path, table, columns (comma-separated, all by default), parts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        kinds = {"INTEGER": LongType(), "REAL": DoubleType()}
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        with closing(_open(self.options["path"])) as db:
            found = {r[1]: kinds.get((r[2] or "").upper(), StringType()) for r in db.execute(f'PRAGMA table_info("{self.options["table"]}")')}
        if not found:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(c, found[c]) for c in wanted or found])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("parts", "4"))
        self.columns = [f.name for f in schema.fields]
        self.text = [isinstance(f.dataType, StringType) for f in schema.fields]

    def partitions(self):
        with closing(_open(self.path)) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with closing(_open(self.path)) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (part.first, part.last)):
                yield tuple(str(v) if t and v is not None else v for v, t in zip(row, self.text, strict=True))


def sqlite_table(spark, path: str, table: str, columns: list[str] | None = None):
    """A table as a DataFrame."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", str(path)).option("table", table)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()
