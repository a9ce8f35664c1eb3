"""Registered queries against their DuckDB statements on sf0.001 (the driver's check, small)."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from hoprank.fixtures import TABLES

SF_SMALL = "/root/testdata/sf0.001"

FAST = ["clean_stage_counts", "item_info", "split_summary", "test_rows", "cf_user_similarity", "cf_predictions",
        "cf_user_betas", "cf_neighbours", "cf_jaccard_neighbours", "lsh_candidate_stats", "recommend_cosine",
        "recommend_cf", "recommend_lsh_cf", "recommend_lsh_cf_info", "recommend_bucket_score",
        "mining_frequent_pairs", "mining_pair_recommender", "item_top_terms", "page_links", "page_taxonomy",
        "page_paragraphs", "crawl_frontier", "review_page_plan", "reviews_location_split", "language_profile",
        "review_languages_en"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_every_query_has_a_runner():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    d = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    pd.testing.assert_frame_equal(_norm(s), _norm(d), check_dtype=False, check_exact=False, rtol=0, atol=1e-9)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns
