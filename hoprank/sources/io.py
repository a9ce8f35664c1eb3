"""Sources and sinks.

Tables are Parquet (pruning and pushdown reach the scan); derived tables are
written under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import logging
import os
import uuid
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..session import CODEC, table_path

log = logging.getLogger(__name__)

# reviews_raw: text columns stay text until cleaning
REVIEWS_RAW = StructType([
    StructField("id", StringType()), StructField("name", StringType()), StructField("brewery", StringType()),
    StructField("subgenre", StringType()), StructField("abv", StringType()), StructField("location", StringType()),
    StructField("rating", StringType()), StructField("average_rating", DoubleType()),
    StructField("reviewer", StringType()), StructField("review_date", StringType()),
    StructField("review_text", StringType()), StructField("algorithm_rating", DoubleType()),
    StructField("total_reviews", IntegerType()),
])


#: One way of quoting for reading and writing: a quote inside a quoted field is doubled.
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
       "ignoreTrailingWhiteSpace": False, "encoding": "UTF-8"}


def write_reviews_csv(df: DataFrame, path: str) -> None:
    """S3, the other way: every text field quoted, so that ``read_reviews`` gives the same rows back; compressed files."""
    df.write.options(**CSV).option("quoteAll", True).option("compression", "gzip").option("lineSep", "\n").csv(path)


def read_reviews(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """Whole reviews table; CSV with a header row, permissive, fixed schema.

    Quoted CSV fields may hold line breaks, commas and doubled quotes; white space at their ends is kept.
    """
    reader = spark.read
    if fmt == "csv":
        return reader.options(**CSV).option("mode", "PERMISSIVE").schema(schema or REVIEWS_RAW).csv(path)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


#: The partition column of tables whose batches can be appended again.
BATCH = "batch"


def ensure_table(spark: SparkSession, name: str, schema: StructType = REVIEWS_RAW, path: str | None = None, batches: bool = False) -> None:
    """Declare the table if it does not exist (Parquet); with ``batches`` it has a partition per batch label."""
    if spark.catalog.tableExists(name):
        return
    if batches:
        schema = StructType([*schema.fields, StructField(BATCH, StringType())])
    w = spark.createDataFrame([], schema).write.format("parquet")
    if batches:
        w = w.partitionBy(BATCH)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def with_batch_labels(df: DataFrame, **labels) -> DataFrame:
    """Stamp constant columns on a batch."""
    return df.withColumns({k: F.lit(v) for k, v in labels.items()})


def append_reviews(df: DataFrame, table: str, field_map: dict | None = None, batch_id: str | None = None, **labels) -> int:
    """Rename fields to columns, stamp labels, append; an empty batch is skipped.

    With ``batch_id`` (a table declared with ``batches``) the append can be repeated: the rows are staged and moved
    into the partition of their batch when the whole job has succeeded, in place of what an earlier call with
    the same label wrote.  A failed job leaves the table as it was.  Without it every call adds rows.

    Returns the number of rows written (0 for an empty batch, which is logged).
    """
    if field_map:
        df = df.select(*[F.col(src).alias(dst) for src, dst in field_map.items()])
    df = with_batch_labels(df, **labels)
    target = df.sparkSession.table(table)
    cols = [c for c in target.columns]
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c) for c in cols])
    seen = Observation()
    counted = out.observe(seen, F.count(F.lit(1)).alias("n"))                                   # one pass: write and count
    if batch_id is None:
        counted.write.mode("append").insertInto(table)
    else:
        conf, key = df.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")                     # staged, then only the written partition is replaced
        try:
            counted.withColumn(BATCH, F.lit(str(batch_id))).write.insertInto(table, overwrite=True)
        finally:
            conf.set(key, before)
    n = seen.get["n"]
    if not n:
        log.info("append_reviews: empty batch for %s; nothing written", table)
    return n


def with_surrogate_key(df: DataFrame, name: str = "id", start: int = 0) -> DataFrame:
    """Dense 0-based row numbers without a single-partition window.

    The rows are written once with their partition and place in it, so that the job
    which counts the partitions and the one which numbers the rows see the same layout
    whatever adaptive execution does.  Partitions of a sorted table are in its order, so
    the numbers are as well.  ``start`` continues an existing table (its stored max + 1).
    """
    spark = df.sparkSession
    path = table_path(spark, f"keyed-{uuid.uuid4().hex[:12]}")
    df.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}).write.parquet(path)
    rows = spark.read.schema(_keyed_schema(df.schema)).parquet(path)
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)     # one row per partition
    offsets = counts.select("_pid", "_first", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.lit(start)).alias("_off"))
    return (rows.join(offsets, "_pid").withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_off", "_first"))


def _keyed_schema(schema: StructType) -> StructType:
    return StructType(schema.fields + [StructField("_pid", IntegerType()), StructField("_mid", LongType())])


def content_key(df: DataFrame, cols, name: str = "id") -> DataFrame:
    """S8 alternative: a key from the content (stable across re-runs)."""
    return df.withColumn(name, F.md5(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols])))


def materialize(spark: SparkSession, name: str, builder: Callable[[], DataFrame], path: str | None = None) -> DataFrame:
    """Load-or-compute a derived table (Parquet under the shared folder)."""
    path = path or table_path(spark, name)
    if not _exists(spark, path):
        builder().write.mode("overwrite").option("compression", CODEC).parquet(path)
    return spark.read.parquet(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Save computed vectors."""
    df.write.mode(mode).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS")))
