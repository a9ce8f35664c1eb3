"""Benchmark: headline stages at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

join, CF for the held-out users, each recommendation set-up for all held-out
rows at once, the evaluation summary, and hashing throughput at the final
reference setting (k=13, L=30).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from hoprank.operators import cf as CF  # noqa: E402
from hoprank.operators import lsh as LSH  # noqa: E402
from hoprank.plans.recommend import recommend  # noqa: E402
from hoprank.plans.workspace import Workspace  # noqa: E402
from hoprank.session import get_spark, table_path  # noqa: E402


def run(df) -> int:
    """Execute fully without collecting (noop sink), return nothing."""
    df.write.mode("overwrite").format("noop").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("bench", cpus)
    times: dict[str, float] = {}
    extra: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    ws = timed("prepare_tables", lambda: Workspace.load(spark, sf_dir))
    model = ws.model()
    queries = ws.queries()

    def build_index():
        path = table_path(spark, f"bench-index-{spark.sparkContext.applicationId}")
        LSH.build_index(ws.train, model.planes).write.mode("overwrite").partitionBy("table_id").parquet(path)
        return spark.read.parquet(path)

    model.index = timed("index_build", build_index)
    n_cands = timed("lsh_candidates", lambda: LSH.query_index(model.index, queries, model.planes).count())
    users = queries.select("reviewer").distinct()
    timed("cf_predictions", lambda: run(CF.cf_scores(ws.train, users)[0]))
    n_q = queries.count()
    for plan in ("lsh_cf", "lsh_kmeans_cf", "cosine", "cf"):
        timed(f"recommend_{plan}", lambda p=plan: run(recommend(model, queries, p, n=20)))
        extra[f"sec_per_query_{plan}"] = round(times[f"recommend_{plan}"] / max(n_q, 1), 4)

    # hashing throughput at the final reference setting (k=13, L=30)
    planes = LSH.make_hyperplanes(ws.dim, 13, 30, 7)
    n_rows = ws.train.count()
    t = time.perf_counter()
    run(LSH.lsh_signature(ws.train.select("id", "embedding"), planes))
    dt = time.perf_counter() - t
    times["hash_k13_L30"] = round(dt, 3)
    extra["rows_hashed_per_sec_k13_L30"] = round(n_rows / dt, 1)
    extra["n_queries"] = n_q
    extra["candidates_per_query"] = round(n_cands / max(n_q, 1), 1)
    extra["train_rows"] = n_rows

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_stage_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus, "extra": extra}))


if __name__ == "__main__":
    main()
