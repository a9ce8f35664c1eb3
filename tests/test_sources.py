"""Sources and sinks: SQLite import, CSV, table declare/append, surrogate keys, materialize."""
import os
import sqlite3
import tempfile

from pyspark.sql import functions as F

from hoprank.sources import io as IO
from hoprank.sources.sqlite_source import read_sqlite_reviews


def test_sqlite_import_in_ranges(spark, ws):
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    path = os.path.join(d, "beers.db")
    rows = ws.raw.select("name", "abv", "rating", "reviewer").collect()
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE beers (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT, abv REAL, rating REAL, reviewer TEXT)")
        con.executemany("INSERT INTO beers (name, abv, rating, reviewer) VALUES (?, ?, ?, ?)",
                        [(r.name, r.abv, r.rating, r.reviewer) for r in rows])
    df = read_sqlite_reviews(spark, path, partitions=4, schema="id long, name string, abv string, rating string, reviewer string")
    assert df.count() == len(rows)
    assert df.select("id").distinct().count() == len(rows)
    assert df.filter(F.col("abv") == "-").count() == sum(1 for r in rows if r.abv == "-")


def test_csv_declare_append_and_keys(spark):
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    csv = os.path.join(d, "sample.csv")
    with open(csv, "w") as f:
        f.write("id,name,brewery,subgenre,abv,location,rating,average_rating,reviewer,review_date,review_text,algorithm_rating,total_reviews\n")
        f.write("1,A,B,IPA,5%,DK,4.0,3.5,u1,2020-01-01,nice,,3\n2,A,B,IPA,-,DK,Unknown,3.5,u2,2020-01-02,meh,,3\n")
    df = IO.read_reviews(spark, csv, "csv")
    assert df.count() == 2 and df.schema["rating"].dataType.typeName() == "string"
    name = "t_reviews_" + os.path.basename(d).replace("-", "_")
    IO.ensure_table(spark, name, path=os.path.join(d, "tbl"))
    assert IO.append_reviews(df.limit(0), name) == 0
    assert IO.append_reviews(df, name, subgenre="Stout") == 2
    assert spark.table(name).filter(F.col("subgenre") == "Stout").count() == 2
    keyed = IO.with_surrogate_key(spark.range(0, 1000).repartition(7), "k", start=10)
    ks = sorted(r.k for r in keyed.collect())
    assert ks == list(range(10, 1010))
    built = []
    m1 = IO.materialize(spark, "mat-" + os.path.basename(d), lambda: built.append(1) or spark.range(5))
    m2 = IO.materialize(spark, "mat-" + os.path.basename(d), lambda: built.append(1) or spark.range(5))
    assert m1.count() == m2.count() == 5 and built == [1]


def test_csv_keeps_breaks_quotes_and_white_space(spark):
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    texts = ['first line\nsecond, line', 'say ""hi"", ok', '"', '""', ',', ' both ends ', 'tab\tand \\ slash', 'a\r\nb', 'é\n\n"x"\n', None,
             'long ' * 50_000, '\\"', "it's"]
    cols = [f.name for f in IO.REVIEWS_RAW.fields]
    rows = [(str(i), "n", "b", "s", "5%", None, "4.0", 3.5, "u", "2020-01-01", t, None, 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, IO.REVIEWS_RAW)
    IO.write_reviews_csv(df.repartition(3), os.path.join(d, "out"))
    back = {r["id"]: tuple(r) for r in IO.read_reviews(spark, os.path.join(d, "out"), "csv").select(cols).collect()}
    want = {str(i): tuple(r) for i, r in enumerate(rows)}
    assert back == want
    with open(os.path.join(d, "in.csv"), "w", newline="") as f:          # as other programs write it
        f.write(",".join(cols) + "\n" + '1,n,b,s,5%,DK,4.0,3.5,u,2020,"first line\nsecond, line",,3\n2,n,b,s,5%,DK,4.0,3.5,u,2020,"say ""hi"", ok",,3\n')
    got = IO.read_reviews(spark, os.path.join(d, "in.csv"), "csv").select("id", "review_text", "total_reviews").collect()
    assert [tuple(r) for r in got] == [("1", "first line\nsecond, line", 3), ("2", 'say "hi", ok', 3)]


def test_a_batch_appended_again_counts_once(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="hoprank-test-", dir="/tmp")
    name = "t_batches_" + os.path.basename(d).replace("-", "_")
    cols = [f.name for f in IO.REVIEWS_RAW.fields]
    rows = spark.createDataFrame([(str(i), "n", "b", "s", "5%", "DK", "4.0", 3.5, "u", "2020", "t", None, 3) for i in range(50)], IO.REVIEWS_RAW)
    IO.ensure_table(spark, name, path=os.path.join(d, "tbl"), batches=True)

    def held():
        return sorted((r["batch"], r["n"]) for r in spark.table(name).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect())
    assert IO.append_reviews(rows, name, batch_id="one") == 50
    assert IO.append_reviews(rows.limit(20), name, batch_id="two") == 20
    assert IO.append_reviews(rows, name, batch_id="one") == 50
    assert held() == [("one", 50), ("two", 20)]

    @F.udf("string")
    def fails(x):
        raise ValueError("a task fails")
    with pytest.raises(Exception):
        IO.append_reviews(rows.withColumn("brewery", F.when(F.col("id") > "3", fails("id")).otherwise("b")).repartition(4), name, batch_id="two")
    assert held() == [("one", 50), ("two", 20)]          # a failed append leaves the earlier rows
    assert IO.append_reviews(rows.limit(0), name, batch_id="three") == 0 and held() == [("one", 50), ("two", 20)]
    assert spark.table(name).columns[:len(cols)] == cols
