"""Page extraction on an in-line table page; stream = batch."""
from pyspark.sql import functions as F

from hoprank.sources import pages as PG

PAGE = ('<table class="table"><tbody><tr><td>#</td><td>Name</td><td>Count</td><td>ABV</td><td>Score</td></tr>'
        '<tr><td>1</td><td><a href="/beer/a/1">Alpha &amp; Co</a></td><td>25</td><td>6.5%</td><td>3.9</td></tr>'
        '<tr><td>2</td><td><a href="/beer/b/2">Beta</a></td><td>7</td><td>5%</td><td>3.1</td></tr>'
        '<tr><td>3</td><td><a href="https://x.org/c">Gamma</a></td><td>n/a</td><td>-</td><td>2.0</td></tr>'
        '</tbody></table>')


def test_table_rows_popular_and_links(spark):
    pages = spark.createDataFrame([(1, "https://site.example/top/ipa/us", PAGE)], "page_id long, url string, html string")
    rows = PG.extract_table_rows(pages, {"name": 1, "count": 2, "abv": 3, "score": 4})
    assert [r.name for r in rows.orderBy("pos").collect()] == ["Alpha & Co", "Beta", "Gamma"]
    assert [r.name for r in PG.filter_popular(rows, "count").collect()] == ["Alpha & Co"]
    links = PG.extract_blocks(pages, r'<a href="[^"]*">', {"href": (r'href="([^"]*)"', 1)})
    got = [r[0] for r in links.select(PG.absolute_url("href", "url")).collect()]
    assert got == ["https://site.example/beer/a/1", "https://site.example/beer/b/2", "https://x.org/c"]


def test_frontier_resume(spark):
    styles = spark.createDataFrame([("style", 0, "all", "All Styles"), ("style", 1, "ipa", "IPA"),
                                    ("style", 2, "sake", "Saké"), ("style", 3, "stout", "Stout")],
                                   "menu string, pos int, name string, text string")
    countries = spark.createDataFrame([("country", 0, "x", "---"), ("country", 1, "be", "Belgium"),
                                       ("country", 2, "213", "United States")], "menu string, pos int, name string, text string")
    f = PG.crawl_frontier(PG.clean_options(styles), PG.clean_options(countries))
    assert f.count() == 4 and f.filter(F.col("country_name") == "us").count() == 2
    r = PG.resume_frontier(f, "Belgium", "Stout").orderBy("country_pos", "style_pos")
    assert [(x.country_text, x.style_text) for x in r.collect()] == [("Belgium", "Stout"), ("United States", "IPA"),
                                                                     ("United States", "Stout")]
    assert PG.resume_frontier(f, "Belgium", "Lager").count() == 4      # unknown style: all styles


def test_stream_clean_equals_batch(spark):
    import __spark_entry__ as E
    SF_SMALL = "/root/testdata/sf0.001"
    from hoprank.operators import clean
    from hoprank.plans.workspace import Workspace
    got = E.queries()["stream_clean"](spark, SF_SMALL)
    raw = Workspace.load(spark, SF_SMALL).raw
    want = clean.parse_percent(clean.coerce_numeric(raw, "rating"), "abv")
    assert got.count() == want.count()
    assert got.select("id").subtract(want.select("id")).count() == 0
