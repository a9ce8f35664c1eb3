"""Stream forms (R1-R3), re-aimed from the reference's batch appends.

R1 ``stream_reviews``: new review files -> C2/C3 cleaning -> Parquet sink
   (file sink: exactly once through its own log; checkpoint in the shared folder).
R2 ``stream_dedupe``: keep the first copy (smallest id) of every (name, reviewer, text hash).
   exact mode = a keyed aggregate in update mode: the state (RocksDB, changelog checkpoints)
   holds the smallest copy of each key, a micro-batch reads and writes the state of its
   own keys only, and hands on the new first copy of each.  Each batch writes its
   own folder (``batch=<id>``) in overwrite mode, so a retried batch replaces
   its output instead of doubling it; ``deduped`` reads the smallest copy of each key, which is the
   batch clean-up's row in whatever order the copies came.  Bounded mode =
   dropDuplicatesWithinWatermark (state is dropped behind the watermark; first come, first kept).
R3 ``stream_index``: foreachBatch appends the LSH keys of each batch's rows to
   an index folder partitioned by batch and table (planes fixed up front).
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..operators.lsh import build_index
from ..plans.sizing import broadcast_if_small
from ..session import CODEC, ensure_checkpoint_dir, write_once


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def read_review_stream(spark: SparkSession, path: str, schema, max_files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def cleaned(stream: DataFrame) -> DataFrame:
    """C2 + C3 per row (no state)."""
    return clean.parse_percent(clean.coerce_numeric(stream, "rating"), "abv")


def stream_reviews(spark: SparkSession, in_path: str, out_path: str, schema, name: str = "reviews",
                   available_now: bool = True):
    """Run the cleaning stream into a Parquet folder; returns the (finished or running) query."""
    q = (cleaned(read_review_stream(spark, in_path, schema)).writeStream.format("parquet")
         .option("path", out_path).option("checkpointLocation", _ckpt(spark, name)).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


#: State of the exact de-duplication: on disk, keys of a batch only, small checkpoints of the last batches.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.minBatchesToRetain": "2"}


def first_copies(stream: DataFrame, keys=clean.DEDUPE_KEYS) -> DataFrame:
    """The smallest copy (by id) of every key, as one struct; on a stream the state is one row per key.

    A text is in the state by its hash only; plans that need it join it by id or hash."""
    hashed = clean.with_text_hash(stream)
    rest = [c for c in hashed.columns if c not in (*keys, "id", "review_text")]
    return hashed.groupBy(*keys).agg(F.min(F.struct("id", *rest)).alias("first"))


def _write_batch(out_path: str):
    def run(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").option("compression", CODEC).parquet(os.path.join(out_path, f"batch={batch_id}"))
    return run


def deduped(spark: SparkSession, out_path: str, keys=clean.DEDUPE_KEYS) -> DataFrame:
    """The smallest copy of each key over all batches, then the rating and abv filters, as the batch
    clean-up does (a first copy with a bad rating hides the others)."""
    copies = spark.read.option("basePath", out_path).parquet(out_path).select(*keys, "first.*")
    return cleaned(clean.dedupe_written(copies, keys))


def stream_dedupe(spark: SparkSession, in_path: str, out_path: str, schema, mode: str = "exact",
                  name: str = "dedupe", watermark: str = "30 days", available_now: bool = True):
    """R2: ``exact`` (keyed state; read with ``deduped``) or ``bounded`` (cleaned rows, watermark state)."""
    s = read_review_stream(spark, in_path, schema)
    if mode == "exact":
        for k, v in STATE.items():                   # read when the query starts, and kept with its checkpoint
            spark.conf.set(k, v)
        w = (first_copies(s).writeStream.outputMode("update").foreachBatch(_write_batch(out_path))
             .option("checkpointLocation", _ckpt(spark, name)))
    else:
        ts = clean.with_text_hash(s).withColumn("_ts", F.to_timestamp("review_date"))
        once = cleaned(ts.withWatermark("_ts", watermark).dropDuplicatesWithinWatermark(list(clean.DEDUPE_KEYS)).drop("_ts"))
        w = (once.writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", _ckpt(spark, name)).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def seen_keys(spark: SparkSession, out_path: str, keys=clean.DEDUPE_KEYS) -> DataFrame:
    """The keys that an exact de-duplication stream has taken in, each once."""
    alone, copies = clean.split_copies(spark.read.option("basePath", out_path).parquet(out_path).select(*keys), list(keys))
    return copies.distinct() if alone is None else alone.unionByName(copies.distinct())


def _named_index(rows: DataFrame, vectors: DataFrame, planes: np.ndarray, key: str, vec: str) -> DataFrame:
    """``build_index`` of rows that name their vector by ``key``: a vector is hashed once, its keys go to the rows."""
    used = vectors.join(broadcast_if_small(write_once(rows.select(key).distinct(), "used"), "used vectors"), key, "left_semi")
    keys = write_once(build_index(used, planes, key, vec).withColumnRenamed("id", key), "vector-keys")
    return rows.select("id", key).join(broadcast_if_small(keys, "vector keys"), key).select("table_id", "bucket", "id")


def stream_index(spark: SparkSession, rows_path: str, index_path: str, schema, planes: np.ndarray,
                 name: str = "index", vec: str = "embedding", available_now: bool = True,
                 vectors: DataFrame | None = None, key: str = "vec_id"):
    """Extend the LSH index with every batch (fixed planes); the rows hold their vector or name one of ``vectors`` by ``key``."""
    def run(batch: DataFrame, batch_id: int):
        index = build_index(batch, planes, "id", vec) if vectors is None else _named_index(batch, vectors, planes, key, vec)
        (index.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("compression", CODEC)
         .partitionBy("table_id").parquet(os.path.join(index_path, f"batch={batch_id}")))

    w = (read_review_stream(spark, rows_path, schema).writeStream.foreachBatch(run)
         .option("checkpointLocation", _ckpt(spark, name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.option("basePath", index_path).parquet(index_path).select("table_id", "bucket", "id")
