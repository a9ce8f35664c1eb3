"""One-off import of a SQLite reviews file through the Python Data Source API.

Each input partition reads one rowid range with its own connection, so the
import is parallel; save the result as Parquet and work from that.  The file
must be readable at the same path by every executor (a shared folder).
Raw values keep the reference's loose typing: every column arrives as text
unless a schema says otherwise; cleaning happens later (C2-C4).
"""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEFAULT_SCHEMA = ("id long, name string, brewery string, subgenre string, abv string, location string, "
                  "rating string, average_rating double, reviewer string, review_date string, review_text string, "
                  "algorithm_rating double, total_reviews int")


class RowRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReviewsSource(DataSource):
    """``spark.read.format("sqlite_reviews").option("path", f).option("table", "beers").load()``"""

    @classmethod
    def name(cls):
        return "sqlite_reviews"

    def schema(self):
        return self.options.get("schema", DEFAULT_SCHEMA)

    def reader(self, schema):
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path = options["path"]
        self.table = options.get("table", "beers")
        self.parts = int(options.get("numPartitions", "8"))
        self.schema = schema

    def partitions(self):
        with sqlite3.connect(self.path) as con:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if lo is None:
            return [RowRange(1, 0)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [RowRange(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: RowRange):
        fields = self.schema.fields
        cols = ", ".join(f'"{f.name}"' for f in fields)
        kinds = [f.dataType.typeName() for f in fields]
        con = sqlite3.connect(self.path)
        try:
            cur = con.execute(f"SELECT {cols} FROM {self.table} WHERE rowid BETWEEN ? AND ?", (partition.lo, partition.hi))
            for row in cur:
                yield tuple(_coerce(v, k) for v, k in zip(row, kinds))
        finally:
            con.close()


def _coerce(v, kind: str):
    if v is None:
        return None
    if kind == "string":
        return str(v)
    if kind in ("long", "integer"):
        try:
            return int(v)
        except (TypeError, ValueError):
            return None
    if kind == "double":
        try:
            return float(v)
        except (TypeError, ValueError):
            return None
    return v


def register(spark) -> None:
    spark.dataSource.register(SqliteReviewsSource)


def read_sqlite_reviews(spark, path: str, table: str = "beers", partitions: int = 8, schema: str | None = None):
    register(spark)
    r = spark.read.format("sqlite_reviews").option("path", path).option("table", table).option("numPartitions", partitions)
    if schema:
        r = r.option("schema", schema)
    return r.load()
