"""Alternative paths: index join = probe through a whole set-up; stream modes; batch replay."""
import os
import re
import tempfile

from pyspark.sql import functions as F

from hoprank.operators import clean
from hoprank.operators import lsh as LSH
from hoprank.operators.lsh_store import LshStore, runtime_filters
from hoprank.plans.recommend import recommend
from hoprank.streaming import streams as ST


def test_join_probe_and_store_give_the_same_rows(ws):
    q = ws.queries(True)
    cols, got = ["query_id", "beer", "rank"], {}
    for how in ("probe", "join", "store"):
        model = ws.model(store=True)
        model.candidates = how
        got[how] = sorted(tuple(r) for r in recommend(model, q, "lsh_cf").select(*cols, F.round("score", 9)).collect())
    assert got["probe"] == got["join"] == got["store"] and got["probe"]


def pairs(df):
    return sorted((r["query_id"], r["id"]) for r in df.select("query_id", "id").collect())


def test_store_reads_in_part(spark, ws):
    """One query: its cells, its buckets and the Bloom filter of its ids stand in the scans; vectors are not shuffled."""
    model = ws.model(store=True)
    store, one = model.store, ws.queries().orderBy("query_id").limit(1)
    want = pairs(LSH.query_index(model.index, one, model.planes))
    cands = store.candidates(one)
    assert pairs(cands) == want and want
    keys = [r["cell"] for r in store.query_keys(one).collect()]
    plan = cands._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "PushedFilters: [In(bucket" in plan
    cells = re.search(r"PartitionFilters: \[cell#\d+ IN(?:SET)? \(?([0-9,() ]*)", plan).group(1)
    assert {int(c) for c in re.findall(r"\d+", cells)} == set(keys) and len(set(keys)) <= model.planes.shape[0]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")         # as with tables that can't be broadcast
    try:
        with runtime_filters(spark):
            fetched = store.fetch(store.wants(one))
            plan = fetched._jdf.queryExecution().executedPlan().toString()
            assert sorted(r["id"] for r in fetched.select("id").collect()) == sorted(i for _, i in want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "might_contain" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") == 1                  # of the wanted ids only
    assert store.share(one) < 0.2 < store.share(ws.queries())


def test_store_with_many_keys_batches_and_repeats(spark, ws):
    model, q = ws.model(), ws.queries()
    want = pairs(LSH.query_index(model.index, q, model.planes))
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    store = LshStore(spark, os.path.join(d, "lsh"), model.planes, ("id", "name"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    store.append(ws.train.filter(half), "a").append(ws.train.filter(~half), "b").append(ws.train.filter(~half), "b")
    assert store.rows().count() == ws.train.count()
    assert pairs(store.candidates(q)) == want == pairs(store.candidates(q, max_keys=0))        # literals, then a join
    assert pairs(store.similarity(q)) == want
    again = LshStore(spark, store.path, model.planes, ("id", "name"))    # opened by another session: tables are declared anew
    for b in "ab":
        spark.sql(f"DROP TABLE {store._table(b)}")
    assert pairs(again.similarity(q)) == want


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


def test_dedupe_stream_equals_the_batch_in_any_order_and_touches_its_own_keys(spark, ws):
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    want = rows_of(clean.preprocess(ws.raw))
    for turn, order in enumerate((F.col("id").asc(), F.col("id").desc())):
        src, out, name = os.path.join(d, f"in{turn}"), os.path.join(d, f"out{turn}"), f"{os.path.basename(d)}-{turn}"
        parts = ws.raw.repartitionByRange(4, order)                      # copies of a key meet in different batches
        parts.write.parquet(src)
        schema = spark.read.parquet(src).schema
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        try:
            ST.stream_dedupe(spark, src, out, schema, name=name).awaitTermination()
            assert rows_of(ST.deduped(spark, out)) == want
            assert ST.seen_keys(spark, out).count() == clean.dedupe_first(clean.with_text_hash(ws.raw)).count()
            # ten rows more: the state is asked for their keys, not for all
            ws.raw.orderBy("id").limit(10).coalesce(1).write.mode("append").parquet(src)
            q = ST.stream_dedupe(spark, src, out, schema, name=name)
            q.awaitTermination()
            state = [p for p in q.recentProgress if p["numInputRows"]][-1]["stateOperators"][0]
            assert state["numRowsUpdated"] <= 10 and state["numRowsTotal"] > 100
            assert state["customMetrics"]["rocksdbGetCount"] <= 20 and state["customMetrics"]["rocksdbPutCount"] <= 20
            assert rows_of(ST.deduped(spark, out)) == want               # the same rows again change nothing
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_replayed_batch_does_not_double(spark, ws):
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    run, batch = ST._write_batch(d), ST.first_copies(ws.raw)
    run(batch, 0)
    run(batch, 0)                     # a retried micro-batch rewrites its own folder
    assert spark.read.parquet(d).count() == batch.count()
    assert rows_of(ST.deduped(spark, d)) == rows_of(clean.preprocess(ws.raw))


def test_bounded_dedupe_stream_runs(spark, ws):
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    ws.raw.write.parquet(src)
    schema = spark.read.parquet(src).schema
    ST.stream_dedupe(spark, src, out, schema, mode="bounded", name=os.path.basename(d) + "-b").awaitTermination()
    got = spark.read.parquet(out)
    assert 0 < got.count() <= ws.raw.count()
    assert got.groupBy("name", "reviewer", "text_hash").count().filter(F.col("count") > 1).count() == 0
