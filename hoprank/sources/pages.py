"""Data steps over collected web pages (P1-P13).  Fetching is not built.

Pages are rows (page_id, url, html).  Extraction uses regular expressions
in Spark SQL functions (``regexp_extract_all`` + ``explode``), so it runs in
the JVM, partition by partition, and each page is handled where it lies.
Tables and review records, whose elements nest, are read by structure (``html``).
Patterns avoid lazy quantifiers and repeated groups: they mean the same in Java
and RE2, and long blocks can't exhaust the matcher's stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import table_cells

# Fixed values that must equal the reference's
PLACEHOLDERS_PREFIX = "All "          # "All Styles", "All Countries"
PLACEHOLDER_DASHES = "---"
RECODE = {"United States": "us"}
SKIP_STYLE_WORD = "Saké"
MIN_REVIEWS = 10                      # listing rows need strictly more reviews
PAGE_SIZE = 100                       # reviews per page
DEFAULT_TEXT = "Unknown"
DEFAULT_SHORT = "Un"

# default rules for the stored pages
LINK = r'<li><a href="([^"]*)">([^<]*)</a></li>'
HEADING = r"<h1>([^<]*)</h1>"
#: A paragraph runs from its tag to its close, the next paragraph, or the next block element.
PARAGRAPH = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_END = (r"(?is)</?(?:p|div|article|section|table|ul|ol|dl|pre|blockquote|form|nav|header|footer|aside|main|"
                 r"h[1-6]|body|html)[\s>].*$")
TITLE = r"<title>([^<]*)</title>"
LANG = r'<html lang="([^"]*)"'


def unescape(c) -> Column:
    """The five XML entities (JVM string functions)."""
    col = F.col(c) if isinstance(c, str) else c
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        col = F.replace(col, F.lit(ent), F.lit(ch))
    return col


def strip_tags(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(unescape(F.regexp_replace(col, r"<[^>]*>", " ")))


# ------------------------------------------------------------------ P1-P5

def clean_options(options: DataFrame) -> DataFrame:
    """Drop placeholder options ("All ...", "---"); recode United States -> "us".

    options: (menu, pos, name, text)."""
    keep = ~F.col("text").startswith(PLACEHOLDERS_PREFIX) & (F.col("text") != PLACEHOLDER_DASHES)
    name = F.col("name")
    for text, code in RECODE.items():
        name = F.when(F.col("text") == text, F.lit(code)).otherwise(name)
    return options.filter(keep).withColumn("name", name)


def crawl_frontier(styles: DataFrame, countries: DataFrame, template: str = "https://example.org/top/%s/%s") -> DataFrame:
    """Every country x every style (styles containing "Saké" dropped), URL from a template.

    Every pair of the two menus is the feature: each country takes each style once."""
    s = styles.filter(~F.col("text").contains(SKIP_STYLE_WORD)).select(
        F.lit(1).alias("_menu"), F.col("pos").alias("style_pos"), F.col("name").alias("style_name"),
        F.col("text").alias("style_text"))
    c = countries.select(F.lit(1).alias("_menu"), F.col("pos").alias("country_pos"),
                         F.col("name").alias("country_name"), F.col("text").alias("country_text"))
    return (c.join(s, "_menu").select("country_pos", "country_name", "country_text", "style_pos", "style_name", "style_text")
            .withColumn("url", F.format_string(template, F.col("style_name"), F.col("country_name"))))


def resume_frontier(frontier: DataFrame, last_country: str, last_style: str) -> DataFrame:
    """Start at ``last_country``; for that first country start at ``last_style``
    (all styles when the style is unknown); all styles for the countries after it.
    An unknown country keeps the whole frontier."""
    marks = frontier.agg(F.min(F.when(F.col("country_text") == last_country, F.col("country_pos"))).alias("c0"),
                         F.min(F.when(F.col("style_text") == last_style, F.col("style_pos"))).alias("s0")).first()
    c0, s0 = marks["c0"], marks["s0"]
    if c0 is None:
        return frontier
    first = F.col("country_pos") == c0
    if s0 is not None:
        first = first & (F.col("style_pos") >= s0)
    return frontier.filter((F.col("country_pos") > c0) | first)


def filter_popular(listing: DataFrame, col: str = "count", minimum: int = MIN_REVIEWS) -> DataFrame:
    """Rows whose count parses and is strictly above ``minimum``."""
    return listing.filter(F.col(col).cast("string").try_cast("int") > minimum)


def page_plan(items: DataFrame, col: str = "count", page_size: int = PAGE_SIZE) -> DataFrame:
    """P5: review pages 0 .. count // page_size per item."""
    n = F.col(col).cast("string").try_cast("long")
    return items.filter(n.isNotNull()).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / page_size))))


def first_pages(items: DataFrame, limit: int) -> DataFrame:
    """P5, the form with a fixed number of pages: 1 .. limit per item."""
    return items.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(limit)))) if limit > 0 else items.withColumn(
        "page", F.lit(1)).limit(0)


# ------------------------------------------------------------------ P6-P13

def extract_blocks(pages: DataFrame, block: str, fields: dict[str, tuple[str, int]], keep=("page_id", "url")) -> DataFrame:
    """Every match of ``block`` in a page, one row each with its position;
    fields are (pattern, group) applied to the block text."""
    blocks = pages.select(*keep, F.posexplode(F.regexp_extract_all("html", F.lit(block), 0)).alias("pos", "_b"))
    return blocks.select(*keep, "pos", *[F.regexp_extract("_b", pat, grp).alias(name)
                                         for name, (pat, grp) in fields.items()])


def between(text: Column, begin: str, end: str) -> Column:
    """The pieces that follow each match of ``begin``, cut where ``end`` matches."""
    pieces = F.split(text, begin, -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.regexp_replace(p, end, ""))


def extract_table_rows(pages: DataFrame, columns: dict[str, int], skip_header: bool = True, keep=("page_id", "url")) -> DataFrame:
    """``columns`` maps a name to a cell index (null where a row is shorter).
    The first row of a table is a header (skipped), as in the reference's listing tables."""
    rows = table_cells(pages, keep)
    if skip_header:
        rows = rows.filter(F.col("pos") > 0)
    return rows.select(*keep, "table_no", "pos", *[F.get("cells", F.lit(i)).alias(n) for n, i in columns.items()])


def extract_table_by_header(pages: DataFrame, columns: dict[str, str], keep=("page_id", "url")) -> DataFrame:
    """P6 by header names: ``columns`` maps a name to the heading of its column in the table's first row
    (null where the table has no such heading)."""
    rows = table_cells(pages, keep)
    heads = rows.filter("pos = 0").select(*[F.col(c).alias(f"_{c}") for c in keep], F.col("table_no").alias("_t"), F.col("cells").alias("_head"))
    same = F.col("table_no") == F.col("_t")
    for c in keep:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = rows.filter("pos > 0").join(heads, same)
    at = {n: F.array_position("_head", F.lit(h)).cast("int") for n, h in columns.items()}
    return out.select(*keep, "table_no", "pos", *[F.when(i > 0, F.get("cells", i - 1)).alias(n) for n, i in at.items()])


def extract_records(pages: DataFrame, block: str, block_end: str, fields: dict[str, tuple[str, int]],
                    constants: dict[str, tuple[str, int]] | None = None, keep=("page_id", "url")) -> DataFrame:
    """Review records: blocks from ``block`` to ``block_end``, their fields (pattern, group; null when
    missing), and constants that the whole page carries."""
    def field(text, pattern, group):
        return F.nullif(strip_tags(F.regexp_extract(text, pattern, group)), F.lit(""))
    const = [field("html", p, g).alias(n) for n, (p, g) in (constants or {}).items()]
    rows = pages.select(*keep, *const, F.posexplode(between(F.col("html"), block, block_end)).alias("pos", "_b"))
    return rows.select(*keep, *(constants or {}), "pos", *[field("_b", p, g).alias(n) for n, (p, g) in fields.items()])


def coalesce_default(c, default: str = DEFAULT_TEXT) -> Column:
    """The value, or a default when missing (an empty string is kept, as in the reference)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit(default))


def coalesce_text(expanded, collapsed) -> Column:
    """P10: expanded text when present (non-empty), else the collapsed text."""
    a = F.col(expanded) if isinstance(expanded, str) else expanded
    b = F.col(collapsed) if isinstance(collapsed, str) else collapsed
    return F.coalesce(F.nullif(a, F.lit("")), b)


def absolute_url(href, page_url) -> Column:
    """Absolute links stay; '/x' joins the page's scheme and host; 'x' joins the page's folder."""
    h = F.col(href) if isinstance(href, str) else href
    u = F.col(page_url) if isinstance(page_url, str) else page_url
    host = F.regexp_extract(u, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(u, r"^(https?://[^?#]*/)", 1)
    return (F.when(h.rlike(r"^https?://"), h)
            .when(h.startswith("//"), F.concat(F.regexp_extract(u, r"^(https?:)", 1), h))
            .when(h.startswith("/"), F.concat(host, h))
            .otherwise(F.concat(F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder), h)))


def split_location(c) -> tuple[Column, Column]:
    """(first two characters, the rest); ("Un", "Unknown") when missing."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.coalesce(F.substring(col, 1, 2), F.lit(DEFAULT_SHORT)),
            F.coalesce(F.expr(f"substring({c}, 3)") if isinstance(c, str) else F.substring(col, 3, 1 << 30),
                       F.lit(DEFAULT_TEXT)))


def require(df: DataFrame, col: str) -> DataFrame:
    """Keep rows that carry the field."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def page_links(pages: DataFrame, keep=()) -> DataFrame:
    """Navigation links of every page with absolute URLs (P6 + P11 + P13); ``keep``: further columns of the page."""
    links = extract_blocks(pages, LINK, {"href": (LINK, 1), "name": (LINK, 2)}, keep=("page_id", "url", *keep))
    out = links.select("page_id", *keep, "pos", unescape(F.trim("name")).alias("name"),
                       absolute_url(unescape("href"), "url").alias("link"))
    return require(out, "name")


def extract_taxonomy(pages: DataFrame, heading: str = HEADING) -> DataFrame:
    """Heading -> its links; pages without a heading or without links give nothing."""
    h = pages.select("page_id", "url", "html", unescape(F.trim(F.regexp_extract("html", heading, 1))).alias("heading"))
    return page_links(h.filter(F.col("heading") != ""), ("heading",)).select("page_id", "heading", "pos", "name", "link")


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """P7 + P10: whole paragraphs with page constants attached (language, title), in one pass over the pages;
    an empty paragraph falls back to the page title."""
    consts = pages.select("page_id", F.regexp_extract("html", LANG, 1).alias("lang"),
                          unescape(F.trim(F.regexp_extract("html", TITLE, 1))).alias("title"), "html")
    paras = consts.select("page_id", "lang", "title", F.posexplode(between(F.col("html"), PARAGRAPH, PARAGRAPH_END)).alias("pos", "raw"))
    return paras.select("page_id", "pos", "lang", "title", coalesce_text(strip_tags("raw"), "title").alias("text"))
