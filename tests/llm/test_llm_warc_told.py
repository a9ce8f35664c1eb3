"""Payloads stay where they are read: only the digests of repeated ones are told to the rows."""

from hoprank.llm import warc as W


def test_payloads_are_not_shuffled(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", "a" * 2000 if i % 3 else "b" * (900 + i)) for i in range(60)] + [(None, None, "a" * 2000), (3, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    told = W.told(pages)
    text = told._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text and "Sort" not in text
    key = lambda df: sorted(map(str, df.select("page_id", "digest", "refers_to").collect()))
    got = key(told)
    monkeypatch.setattr(W, "REPEATED_ROWS", -1)
    assert got == key(W.told(pages)) and sum("refers_to=59" in r for r in got) == 40
