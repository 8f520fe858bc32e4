"""URL block lists with redirect equivalence (DataFrame functions only).

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's; the longest rule wins (of equally long ones, allow). Hosts
are matched once each: the suffixes of every distinct host meet the rules' hosts. Pages
meet their host's rules in parts (by address and numbers of their rows), so a frequent host doesn't load a task.

Pages name other addresses of themselves by canonical links and redirects (meta refresh);
more edges may be given. Connected components over these edges are the aliases. A URL
with a rule keeps the rule's verdict. Any other takes its component's: allow if a rule
allows an alias, else block if a rule blocks one, else allow.

Aliases compare host, path and query, without scheme, case of the host, or fragment.
Defined cases: null URLs and those without "://" have empty host and path, fit no rule,
are in no component and are allowed; null html has no edges; edges of unknown or relative
targets count (a relative one starts at the page's host); repeated rows are judged each; an
empty table gives an empty result. Extra columns pass through, whatever their names; added
columns (host, path, rule, verdict) replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected

#: The rules to apply, as (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Parts that the pages of one host are dealt over at most when they meet its rules.
PARTS = 512
ADDED = ("host", "path", "rule", "verdict")
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL = r"""(?is)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
GOTO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Host, path and query; null for URLs without "://" ."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def decoded(text: Column) -> Column:
    """Text with &amp; and numeric character references decoded, each once."""
    parts = F.regexp_extract_all(text, F.lit(r"(?is)&amp;|&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});|[^&]+|&"), F.lit(0))

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, r"(?i)^&#x?([0-9a-f]+);$", 1)
        code = F.when(F.lower(x).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        good = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(F.lower(x) == "&amp;", "&").when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def _named(body: Column, tag: str, mark: str, value: str) -> Column:
    """The values of all tags that carry the mark."""
    tags = F.filter(F.regexp_extract_all(body, F.lit(tag), F.lit(0)), lambda x: F.rlike(x, F.lit(mark)))
    return F.transform(tags, lambda x: decoded(F.regexp_extract(x, value, 1)))


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): addresses that a page's canonical links and redirects join."""
    body, own = F.col(common.quoted(html)), F.col(common.quoted(url))
    named = F.concat(_named(body, LINK, CANONICAL, HREF), _named(body, META, REFRESH, GOTO))
    hinted = pages.where(own.contains("://")).where(F.lower(body).contains("canonical") | F.lower(body).contains("refresh"))
    found = hinted.select(own.alias("u"), F.explode(named).alias("t")).where("t <> ''")
    t = F.col("t")
    full = F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(F.lit("http://"), host(F.col("u")), t)).otherwise(
        F.concat(F.lit("http://"), host(F.col("u")), F.regexp_extract(path(F.col("u")), "(?s)^(.*/)?", 0), t)
    )
    return found.select(address(F.col("u")).alias("a"), address(full).alias("b"))


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "r_host string, r_path string, r_verdict string")


def _spread(rows: DataFrame, *first: str) -> Column:
    """A hash of a row's plain columns."""
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.xxhash64(*first, *(f.name for f in rows.schema.fields if isinstance(f.dataType, plain) and f.name not in first))


def matched(rows: DataFrame, rules: DataFrame, labels: int) -> DataFrame:
    """rows (with host, path and node) plus `hit`: the longest rule that fits, as (size, allow, rule).

    labels: how many labels the longest host of the rules has; a host's longer tails can't meet one.
    """
    n = F.size("labels")
    tails = F.transform(F.sequence(F.greatest(n - (labels - 1), F.lit(1)), n), lambda i: F.array_join(F.slice("labels", i, labels), "."))
    # The pages of a host are dealt over parts, and its rules go to those parts that it has, so
    # a frequent host is many tasks' work and a rare one costs one row.
    dealt = rows.withColumn("part", F.pmod(_spread(rows, "node"), F.lit(PARTS)).cast("int"))
    hosts = dealt.select("host", "part").where("host <> ''").distinct().withColumn("labels", F.slice(F.reverse(F.split("host", "[.]")), 1, labels)).withColumn("labels", F.reverse("labels"))
    one = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), (F.col("r_verdict") == "allow").alias("allow"), F.concat("r_host", "r_path").alias("rule"), F.col("r_path").alias("start"))
    own = hosts.select("host", "part", F.explode(tails).alias("r_host")).join(rules, "r_host").groupBy("host", "part").agg(F.collect_set(one).alias("rules"))
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    return dealt.join(own, ["host", "part"], "left").withColumn("hit", F.array_max(fits)).drop("rules", "part")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str | None = "html", more: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict; more: further edges as URLs (a, b)."""
    spark = pages.sparkSession
    listed, labels = rules_of(spark, rules), max((h.count(".") + 1 for h, _, _ in rules), default=1)
    own = F.col(common.quoted(url))
    kept = [c for c in pages.columns if c.lower() not in ADDED]
    named = [f"k{n}" for n in range(len(kept))]  # free of any name used below
    columns = [F.col(common.quoted(c)).alias(n) for c, n in zip(kept, named, strict=True)]
    rows = pages.select(*columns, host(own).alias("host"), path(own).alias("path"), address(own).alias("node"))
    links = spark.createDataFrame([], "a string, b string") if html is None else edges(pages, url, html)
    if more is not None:
        links = links.unionByName(more.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    groups = connected(links)
    as_url = F.concat(F.lit("http://"), F.col("node"))
    known = matched(groups.select("node", "component", host(as_url).alias("host"), path(as_url).alias("path")), listed, labels)
    verdicts = known.groupBy("component").agg(F.bool_or("hit.allow").alias("some_allow"), F.bool_or(~F.col("hit.allow")).alias("some_block"))
    aliases = groups.join(verdicts, "component").select("node", F.when(~F.coalesce("some_allow", F.lit(False)) & F.coalesce("some_block", F.lit(False)), "block").otherwise("allow").alias("other"))
    # A row without an address has a key of its own, so that many of them don't meet in one task.
    met = matched(rows, listed, labels)
    met = met.withColumn("key", F.coalesce("node", F.concat(F.lit("?"), _spread(met, "node").cast("string"))))
    found = met.join(aliases.withColumnRenamed("node", "key"), "key", "left")
    verdict = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.allow"), "allow").otherwise("block")).otherwise(F.coalesce("other", F.lit("allow")))
    return found.select(*(F.col(n).alias(c) for c, n in zip(kept, named, strict=True)), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
