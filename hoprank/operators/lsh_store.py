"""The LSH index as stored tables that a query reads only in part.

Two tables lie side by side:

* ``keys``  (cell, bucket, id): one row per row and hash table.  ``cell`` is the hash
  table's number and the leading bits of the bucket; it is the partition
  column.  Inside a cell the rows are sorted by bucket, in small row groups.
* ``rows``  (id, kept columns, vector as packed bytes): bucketed and sorted by id, so that
  a join on id reads it without a shuffle of vectors.

A query touches: the cells of its own keys (partition pruning), in them the row groups and pages
whose bucket range holds one of its keys (pushed filter), and then the rows of its
candidates.  Few keys become literals in the scan.  More of them than MAX_KEYS are joined,
and the cells are pruned when the join runs (dynamic partition pruning).  The fetch joins
by id: the wanted ids are shuffled, the vectors are not; Spark builds a Bloom filter of the wanted ids
while the query runs and drops other rows of ``rows`` right after their scan.  Each candidate row's vector is read once, whatever the number of queries that want it.

Reading in part pays while the queries want a small share of the rows; for many queries at once a
pass over all rows (``lsh.probe_candidates``) is the better plan.  ``share`` tells which case it is.

Appending a batch writes more files into the same cells and a new generation of
``rows``; a batch that is appended again under its label replaces itself.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrowvec import QueryBlock, matrix, pack, positions, query_blocks
from ..plans.sizing import broadcast_if_small
from ..session import cut_lineage, table_path
from .lsh import lsh_signature

#: Leading bits of a bucket that go into the partition column.
CELL_BITS = 4
#: Distinct query keys that become literals of the scan; more are joined.
MAX_KEYS = 8192
#: Bytes of a row group of ``keys``, and buckets (files a generation) of ``rows``.
ROW_GROUP, BUCKETS = 1 << 20, 16
#: Spark's run-time filters are meant for sides of gigabytes; here they pay off at any size.
RUNTIME_FILTER = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
                  "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
                  "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(256 << 20)}


@dataclass
class LshStore:
    spark: SparkSession
    path: str
    planes: np.ndarray
    keep: tuple[str, ...]
    vec: str = "embedding"

    # ------------------------------------------------------------ writing

    @property
    def _cell_bits(self) -> int:
        return min(CELL_BITS, self.planes.shape[1])

    def _cell(self):
        """The partition of a key: hash table, then the bucket's leading bits."""
        k, s = self.planes.shape[1], self._cell_bits
        return (F.col("table_id") * (1 << s) + F.shiftright("bucket", k - s)).cast("int")

    def append(self, rows: DataFrame, batch: str = "0") -> "LshStore":
        """L3: add the keys and vectors of ``rows``; the same ``batch`` label again replaces that batch."""
        rows = rows.select("id", *[c for c in self.keep if c != "id"], self.vec)
        signed = lsh_signature(rows.select("id", self.vec), self.planes, self.vec)
        keys = (signed.select("id", F.posexplode("buckets").alias("table_id", "bucket")).withColumn("cell", self._cell())
                .drop("table_id"))
        (keys.repartitionByRange("cell", "bucket").sortWithinPartitions("cell", "bucket").write.mode("overwrite")
         .option("parquet.block.size", ROW_GROUP).partitionBy("cell").parquet(os.path.join(self.path, "keys", f"batch={batch}")))
        small = packed(rows, self.vec, self.planes.shape[2])
        (small.repartition(BUCKETS, "id").write.mode("overwrite").format("parquet").bucketBy(BUCKETS, "id").sortBy("id")
         .option("path", os.path.join(self.path, "rows", f"batch={batch}")).saveAsTable(self._table(batch)))
        return self

    def _table(self, batch: str) -> str:
        return "lsh_rows_" + "".join(c if c.isalnum() else "_" for c in f"{os.path.basename(self.path)}_{batch}").lower()

    def _batches(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, "keys"))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p)) if fs.exists(p) else []

    # ------------------------------------------------------------ reading

    def keys(self) -> DataFrame:
        base = os.path.join(self.path, "keys")
        return self.spark.read.option("basePath", base).parquet(base)

    def query_keys(self, queries: DataFrame) -> DataFrame:
        """(query_id, cell, bucket) of every query and hash table."""
        signed = lsh_signature(queries.select("query_id", self.vec), self.planes, self.vec)
        return (signed.select("query_id", F.posexplode("buckets").alias("table_id", "bucket"))
                .select("query_id", self._cell().alias("cell"), "bucket"))

    def _meet(self, queries: DataFrame, max_keys: int) -> DataFrame:
        """(query_id, id) for every hash table in which their keys meet."""
        wanted = self.query_keys(queries).persist()
        distinct = wanted.select("cell", "bucket").distinct().limit(max_keys + 1).collect()
        keys = self.keys()
        if len(distinct) <= max_keys:
            keys = keys.filter(F.col("cell").isin(sorted({r["cell"] for r in distinct}))
                               & F.col("bucket").isin(sorted({r["bucket"] for r in distinct})))
            found = keys.join(F.broadcast(wanted), ["cell", "bucket"])
        else:
            # a filter on the small side is what lets the planner prune the cells when the join runs
            found = keys.join(broadcast_if_small(wanted.filter("cell >= 0"), "query keys"), ["cell", "bucket"])
        return found.select("query_id", "id")

    def candidates(self, queries: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
        """L4: distinct (query_id, id) whose keys meet in any hash table."""
        return self._meet(queries, max_keys).distinct()

    def wants(self, queries: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
        """The same by row: id and the queries that want it (at most those of a block), written."""
        path = table_path(self.spark, f"lsh-wants-{uuid.uuid4().hex[:12]}")
        found = self._meet(queries, max_keys).groupBy("id").agg(F.collect_set("query_id").alias("wants"))
        found.write.parquet(path)
        return self.spark.read.schema(found.schema).parquet(path)

    def share(self, queries: DataFrame) -> float:
        """Keys that the queries meet, per stored row: a bound on the share of the rows that they want (a pruned count)."""
        met = self._meet(queries.select("query_id", self.vec), MAX_KEYS).select("id")
        stored = self.rows().count()                 # from file footers
        return met.count() / stored if stored else 0.0

    def _rows(self, batch: str) -> DataFrame:
        """The bucketed table of a batch; a session that didn't write it declares it over the files."""
        name, path = self._table(batch), os.path.join(self.path, "rows", f"batch={batch}")
        if not self.spark.catalog.tableExists(name):
            fields = ", ".join(f"`{c}` {t}" for c, t in self.spark.read.parquet(path).dtypes)
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def rows(self) -> DataFrame:
        """The stored rows of all batches."""
        parts = [self._rows(b) for b in self._batches()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def fetch(self, wants: DataFrame) -> DataFrame:
        """The stored rows of the wanted ids, once each, with ``wants``."""
        least = "id > ''" if dict(wants.dtypes)["id"] == "string" else f"id > {-2 ** 63}"
        some = wants.filter(f"{least} and size(wants) > 0")      # a filter makes it a creation side of run-time filters
        out = None
        for batch in self._batches():
            part = self._rows(batch).join(some, "id")
            out = part if out is None else out.unionByName(part)
        return out

    def similarity(self, queries: DataFrame, with_vectors: bool = False) -> DataFrame:
        """(query_id, kept columns, similarity[, vector]) of every candidate; checkpointed, so that the filters hold when it runs."""
        out = None
        for block in query_blocks(queries.select("query_id", self.vec), self.vec):
            qb = QueryBlock.collect(block, self.vec)
            with runtime_filters(self.spark):
                part = cut_lineage(_scored(self.fetch(self.wants(block)), qb, self.keep, self.vec, with_vectors))
            out = part if out is None else out.union(part)
        return out


@contextlib.contextmanager
def runtime_filters(spark: SparkSession):
    """Run-time filters for the plans that are run inside."""
    before = {k: spark.conf.get(k) for k in RUNTIME_FILTER}
    for k, v in RUNTIME_FILTER.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def packed(rows: DataFrame, vec: str, d: int) -> DataFrame:
    """The vector column as packed float32 bytes."""
    other = [c for c in rows.columns if c != vec]
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in other)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in other), pack(matrix(b.column(vec), d))], names=[*other, vec])
    return rows.select(*other, vec).mapInArrow(run, f"{fields}, {vec} binary")


def _scored(fetched: DataFrame, qb: QueryBlock, keep, vec: str, with_vectors: bool) -> DataFrame:
    """Cosine of every fetched row to each query that wants it; a row's vector is unpacked once."""
    keep, d = list(keep), qb.unit.shape[1]
    qtype = fetched.schema["wants"].dataType.elementType.simpleString()
    fields = ", ".join([f"query_id {qtype}"] + [f"{c} {fetched.schema[c].dataType.simpleString()}" for c in keep])
    bc = fetched.sparkSession.sparkContext.broadcast(qb)

    def run(batches):
        block = bc.value
        known = block.key_array()
        for b in batches:
            if not b.num_rows:
                continue
            wants = b.column("wants")
            ids = wants.flatten()
            row = np.repeat(np.arange(b.num_rows), np.asarray(wants.value_lengths()))
            x = matrix(b.column(vec), d)
            n = np.linalg.norm(x, axis=1)[row]
            dots = np.einsum("ij,ij->i", x[row], block.unit[positions(ids, known)])
            sim = np.divide(dots, n, out=np.zeros(len(row)), where=n > 0)
            take = pa.array(row)
            cols = [ids, *(b.column(c).take(take) for c in keep), pa.array(sim)]
            names = ["query_id", *keep, "similarity"]
            if with_vectors:
                cols.append(b.column(vec).take(take))
                names.append(vec)
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return fetched.select(*keep, vec, "wants").mapInArrow(run, f"{fields}, similarity double" + (f", {vec} binary" if with_vectors else ""))
