"""URL filters: explicit rules, and an empirical-Bayes reputation of hosts.

Labelled pages (bad: low quality or toxic) are counted per host, registered domain and
suffix.  The bad rate of each level is shrunk towards the next wider one by a
beta-binomial prior: all pages -> suffix -> domain -> host.  A suffix is the last label of a
name, or its last two where SUFFIXES lists them (``co.uk``); the registered domain has one
label more.  An address of numbers is a domain of its own, under the suffix ``ip``, and a
name of one label or a suffix alone is its own domain.  The strength of each prior
comes from the spread of the rates between the groups of its level (method of moments);
the rate of all pages starts from one bad page in four.
A host without rule is blocked when the lower bound of its posterior bad rate (mean less
Z standard deviations) is above MAX_BAD; hosts without labels have the prior of their
domain.

Only page_id and url are read, and the pages meet the verdicts of their hosts in one
join on host, which adaptive execution splits for a hot host.

Defined results: a null url or one without ``://`` has an empty host and path, no rule
fits it, and it is judged like any host; pages with equal ids or urls are judged each on
its own; several labels of a page count as one, bad if one of them is; labels that are
null in both columns don't count; other columns are not looked at; without labels every
page without a rule is allowed; no pages give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
#: The longest rule that fits a url wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of two labels under which names are registered.
SUFFIXES = tuple(f"{second}.{country}" for country, seconds in (
    ("uk", "ac co gov ltd me net nhs org plc sch"), ("au", "asn com edu gov id net org"), ("jp", "ac ad co ed go gr lg ne or"),
    ("br", "com edu gov net org"), ("cn", "ac com edu gov net org"), ("in", "ac co edu firm gov ind net org"),
    ("kr", "ac co go ne or re"), ("nz", "ac co geek govt net org school"), ("za", "ac co gov net org web"),
    ("tr", "com edu gov net org"), ("mx", "com edu gob net org"), ("tw", "com edu gov net org")) for second in seconds.split())
#: Blocked above this bad rate; standard deviations below the mean; range of a prior's strength in pages.
MAX_BAD, Z, WEAKEST, STRONGEST = 0.4, 1.645, 2.0, 200.0


def split_url(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, PARTS, 1), UPPER, LOWER), F.regexp_extract(text, PARTS, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):      # the last `when` is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


#: User, port and last dots are no part of a name; an address is four numbers, or stands in brackets.
AROUND, ADDRESS = r"^.*@|:[0-9]*$|\.+$", r"^([0-9]+\.){3}[0-9]+$|^\["


def name_of(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, AROUND, ""), r"\.+$", "")


def suffix_of(name: Column, suffixes=SUFFIXES) -> Column:
    """``ip`` for an address; the last two labels if they are a suffix, else the last."""
    two = F.substring_index(name, ".", -2)
    return (F.when(F.regexp_like(name, F.lit(ADDRESS)), "ip").when(two.isin(*suffixes), two)
            .otherwise(F.substring_index(name, ".", -1)))


def registered_domain(name: Column, suffixes=SUFFIXES) -> Column:
    """The suffix and the label before it."""
    return (F.when(F.regexp_like(name, F.lit(ADDRESS)), name)
            .when(F.substring_index(name, ".", -2).isin(*suffixes), F.substring_index(name, ".", -3))
            .otherwise(F.substring_index(name, ".", -2)))


def _level(counts: DataFrame, group: list[str]) -> DataFrame:
    return counts.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the pages that a prior of this level is worth, from the spread of the groups' rates.

    With N pages, mean rate m and weights n_i, the spread S = sum n_i (p_i - m)^2 is about
    (k - 1) m (1 - m) for equal rates; what it has more comes from the groups.
    """
    t = groups.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count(F.lit(1)).alias("k"),
                   F.sum(F.col("n") * F.col("n")).alias("nn"),
                   F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("pp"))
    m = F.col("B") / F.col("N")
    spread = F.col("pp") - F.col("B") * m
    between = (spread - (F.col("k") - 1) * m * (1 - m)) / (F.col("N") - F.col("nn") / F.col("N"))
    strength = F.when((F.col("k") > 1) & (F.col("N") > F.col("nn") / F.col("N")) & (between > 0), m * (1 - m) / between - 1)
    return t.select(F.greatest(F.least(F.coalesce(strength, F.lit(STRONGEST)), F.lit(STRONGEST)), F.lit(WEAKEST))
                    .alias("strength"))


def host_verdicts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, verdict for every host of ``pages``."""
    label = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.expr("int(coalesce(quality = 0, false) or coalesce(toxic = 1, false))")).alias("bad"))
    # pages without a label count for no one, but their hosts take part
    counts = (pages.join(label, F.col("page_id") == F.col("_id"), "left").groupBy("host")
              .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
              .withColumn("name", name_of(F.col("host")))
              .withColumn("domain", registered_domain(F.col("name"))).withColumn("suffix", suffix_of(F.col("name"))))
    counts = C.written(counts.drop("name"), "hosts")
    domains, suffixes = _level(counts, ["domain", "suffix"]), _level(counts, ["suffix"])
    every = counts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 4)).alias("m0"))
    known = [x.filter("n > 0") for x in (suffixes, domains, counts)]
    # the mean over all pages and a strength for each level: four numbers
    numbers = every.select(F.lit("m0").alias("name"), F.col("m0").alias("value"))
    for name, level in zip(("ks", "kd", "kh"), known):
        numbers = numbers.union(_strength(level).select(F.lit(name), "strength"))
    k = {r["name"]: r["value"] for r in numbers.collect()}
    m0, ks, kd, kh = (F.lit(float(k[c])) for c in ("m0", "ks", "kd", "kh"))
    s = suffixes.select(F.col("suffix").alias("_s"), ((F.col("bad") + ks * m0) / (F.col("n") + ks)).alias("ms"))
    d = domains.join(s, F.col("suffix") == F.col("_s")).select(
        F.col("domain").alias("_d"), ((F.col("bad") + kd * F.col("ms")) / (F.col("n") + kd)).alias("md"))
    a, n = F.col("bad") + kh * F.col("md"), F.col("n") + kh
    mean = a / n
    low = mean - Z * F.sqrt(mean * (1 - mean) / (n + 1))
    return counts.join(d, F.col("domain") == F.col("_d")).select(
        F.col("host").alias("_host"), F.when(low > MAX_BAD, "block").otherwise("allow").alias("reputation"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).join(
        host_verdicts(parts, labels), F.col("host") == F.col("_host"))
    told = F.col("reputation")
    for verdict, rule in rules:
        told = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(told)
    return judged.select("page_id", "host", "path", "rule", told.alias("verdict"))


def url_query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(C.table(spark, sf_dir, "pages"), C.table(spark, sf_dir, "labels"))


def _sql() -> str:
    fits = "(p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(p.path, '{q}')"
    when = " ".join(f"WHEN {fits.format(h=r.split('/', 1)[0], q='/' + r.split('/', 1)[1])} THEN '{r}'"
                    for _, r in sorted(RULES, key=lambda x: -len(x[1])))
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES)
    k = ("(SELECT greatest(least(coalesce(CASE WHEN k > 1 AND n > nn / n AND b > 0 THEN m * (1 - m) / b - 1 END, {hi}), {hi}),"
         " {lo}) FROM (SELECT *, (pp - bad * m - (k - 1) * m * (1 - m)) / (n - nn / n) b FROM (SELECT sum(n) n, sum(bad) bad,"
         " count(*) k, sum(n * n) nn, sum(CAST(bad AS DOUBLE) * bad / n) pp, sum(bad) / sum(n) m FROM {t} WHERE n > 0)))")
    k = {c: k.format(t=t, hi=f"CAST({STRONGEST} AS DOUBLE)", lo=f"CAST({WEAKEST} AS DOUBLE)")
         for c, t in (("ks", "s"), ("kd", "d"), ("kh", "h"))}
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') host,
   regexp_extract(coalesce(url, ''), '{PARTS}', 2) path FROM pages),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS INT)) bad FROM labels
   WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) n, coalesce(sum(bad), 0) bad,
   regexp_replace(regexp_replace(host, '{AROUND}', '', 'g'), '\.+$', '') AS name, string_split(name, '.') labels,
   array_to_string(list_slice(labels, -2, -1), '.') two, regexp_matches(name, '{ADDRESS}') ip
   FROM u LEFT JOIN l ON page_id = doc_id GROUP BY host),
h AS (SELECT host, n, bad, CASE WHEN ip THEN name WHEN two IN {SUFFIXES} THEN array_to_string(list_slice(labels, -3, -1), '.')
   ELSE two END AS domain, CASE WHEN ip THEN 'ip' WHEN two IN {SUFFIXES} THEN two ELSE labels[-1] END suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) n, sum(bad) bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) n, sum(bad) bad FROM d GROUP BY suffix),
c AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 4) m0, {k['ks']} ks, {k['kd']} kd, {k['kh']} kh FROM h),
ms AS (SELECT suffix, (bad + ks * m0) / (n + ks) ms FROM s, c),
md AS (SELECT domain, (bad + kd * ms) / (n + kd) md FROM d JOIN ms USING (suffix), c),
mh AS (SELECT host, (bad + kh * md) / (n + kh) m, n + kh n FROM h JOIN md USING (domain), c),
r AS (SELECT host, CASE WHEN m - {Z} * sqrt(m * (1 - m) / (n + 1)) > {MAX_BAD} THEN 'block' ELSE 'allow' END v FROM mh),
p AS (SELECT * FROM u JOIN r USING (host)),
q AS (SELECT page_id, host, path, v, CASE {when} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {verdict} ELSE v END verdict FROM q
"""


SQL = _sql()
