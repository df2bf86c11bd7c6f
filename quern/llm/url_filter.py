"""URL filters: rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a host, a path prefix and a verdict. Its literal tokens are its host's labels and the path segments that it
holds whole; the one that the fewest distinct urls have is its key in the index. The tokens of a url fetch its candidate
rules, and only those run their regular expression. The longest rule that fits wins; ties go to block, then by name.

Each distinct url is judged once, so a url that many pages share costs no more. A null url, or one without "://", has an
empty host and path and fits no rule; the default verdict holds. Repeated pages are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as c

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), F.lit("")), AZ, az)


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: Column, path: Column, whole: bool) -> Column:
    """Labels of the host and segments of the path; whole: the last segment counts though no slash ends it."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("."), x))
    segments = F.split(path, "/")
    if not whole:
        segments = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    segments = F.transform(segments, lambda x: F.concat(F.lit("/"), x))
    return F.array_distinct(F.filter(F.concat(labels, segments), lambda x: F.length(x) > 1))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of pages with host, path, rule and verdict (replacing columns of these names).

    rules: (verdict, host, path). A rule without any literal token, as with an empty host and path, fits every url with
    a host; it stands in the index under a token that every url has.
    """
    rules = rules.select("verdict", F.col("host").alias("rhost"), F.col("path").alias("rpath")).dropDuplicates()
    rules = rules.withColumn("rule", F.concat("rhost", "rpath"))
    quoted = lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.when(F.col("rhost") == "", F.lit(r"(?s)^[^/]*")).otherwise(F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(F.col("rhost")))), F.when(F.col("rpath") == "", F.lit("(?:/.*)?$")).otherwise(quoted(F.col("rpath"))))
    rules = rules.withColumn("pattern", pattern)
    urls = pages.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("u")).agg(F.count("*").alias("n")).select("u", host(F.col("u")).alias("h"), path(F.col("u")).alias("p")).where("h <> '' or p <> ''")
    fetch = urls.select("u", F.concat("h", "p").alias("site"), F.explode(F.concat(tokens(F.col("h"), F.col("p"), True), F.array(F.lit("")))).alias("token"))
    literal = rules.withColumn("token", F.explode(F.concat(tokens(F.col("rhost"), F.col("rpath"), False), F.array(F.lit("")))))
    rarity = fetch.join(literal.select("token"), "token", "left_semi").groupBy("token").agg(F.count("*").alias("seen"))
    index = literal.join(rarity, "token", "left").groupBy("rule", "verdict", "pattern").agg(F.min_by("token", F.struct(F.coalesce("seen", F.lit(0)), F.when(F.col("token") == "", 1).otherwise(0), "token")).alias("token"))
    index = c.cut(index, "url-index")
    fits = fetch.join(index, "token").where(F.expr("site rlike pattern"))
    best = fits.groupBy("u").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), (F.col("verdict") == "block").cast("int"), "rule")).alias("best"))
    kept = [x for x in pages.columns if x.lower() not in ("host", "path", "rule", "verdict")]
    left = pages.select(*[F.col(f"`{x}`") for x in kept], host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    out = left.join(best.withColumnRenamed("u", "_judged"), F.col(url) == F.col("_judged"), "left")
    return out.select(*[F.col(f"`{x}`") for x in kept], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(c.read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, rest FROM u),
p AS (SELECT row_number() OVER () AS r, page_id, coalesce(host, '') AS host, coalesce(regexp_extract(substr(rest, length(host) + 1), '^[^?#]*'), '') AS path FROM h),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT r, verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, verdict DESC) AS n
      FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.r = f.r AND f.n = 1
"""
