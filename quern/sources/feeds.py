"""Feeds and site maps from stored bodies: items, dates and links as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import urls as u
from quern.operators import extract

ITEMS_PER_FEED = 40


def tag(body: Column, name: str) -> Column:
    """The first element's text, out of CDATA, trimmed; null if empty."""
    own = F.regexp_extract(body, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(F.trim(F.regexp_replace(own, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")), F.lit(""))


def items(feeds: DataFrame) -> DataFrame:
    """(feed, lang, pos, title, url, snippet, published_at) of RSS and Atom bodies; feeds: (feed, lang, status, body). Only good answers count."""
    raw = feeds.where("status between 200 and 299").select("feed", "lang", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>(.*?)</\1>"), F.lit(2))).alias("pos", "x")).where(F.col("pos") < ITEMS_PER_FEED)
    x = F.col("x")
    href = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    link = F.coalesce(href(r"""(?is)<link[^>]*rel=["']alternate["'][^>]*href=["']([^"']+)["']"""), href(r"""(?is)<link[^>]*href=["']([^"']+)["']"""), tag(x, "link"), tag(x, "guid"))
    url = u.url_key(extract.all_entities(link))
    when = F.coalesce(*[extract.date(tag(x, n)) for n in ("pubDate", "published", "updated", "dc:date")])
    text = F.left(extract.plain(extract.all_entities(F.coalesce(tag(x, "description"), tag(x, "summary"), tag(x, "content"), F.lit("")))), F.lit(400))
    return raw.select("feed", "lang", "pos", extract.plain(extract.all_entities(tag(x, "title"))).alias("title"), url.alias("url"), text.alias("snippet"), when.alias("published_at")).where("title is not null and url is not null")


def corpus(found: DataFrame) -> DataFrame:
    """One item an address, the first by feed and place."""
    return found.withColumn("n", F.row_number().over(W.partitionBy("url").orderBy("feed", "pos"))).where("n = 1").drop("n")


def refreshed(previous: DataFrame, pulled: DataFrame, answers: DataFrame, now: Column, most_hours: float = 1.0) -> DataFrame:
    """Items of feeds after a pull: new ones where the answer was good, else the previous ones: unchanged (304) or, if it failed, up to an hour old.

    previous: items with fetched_at; answers: (feed, status).
    """
    good = answers.where("status between 200 and 299").select("feed")
    kept = previous.join(good, "feed", "left_anti").join(answers, "feed", "left")
    fresh = (F.col("status") == 304) | (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp")) <= most_hours * 3.6e9)
    return pulled.withColumn("fetched_at", now).unionByName(kept.where(fresh).drop("status"))


def sitemap(bodies: DataFrame) -> DataFrame:
    """(url, kind, pos, loc, last_modified) of url sets, indexes of site maps and plain lists. bodies: (url, body)."""
    nodes = bodies.select("url", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<((?:url|sitemap)(?:\s[^>]*)?>.*?)</(?:url|sitemap)>"), F.lit(1))).alias("pos", "x"))
    xml = nodes.select("url", "pos", F.when(F.col("x").rlike("(?is)^sitemap"), "index").otherwise("page").alias("kind"), extract.entities(tag(F.col("x"), "loc")).alias("loc"), extract.date(tag(F.col("x"), "lastmod")).alias("last_modified"))
    text = bodies.where(~F.col("body").rlike("(?is)<(?:urlset|sitemapindex)")).select("url", F.lit("page").alias("kind"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*(https?://\S+)\s*$"), F.lit(1))).alias("pos", "loc"), F.lit(None).cast("timestamp").alias("last_modified"))
    return xml.unionByName(text).where("loc is not null").select("url", "kind", "pos", "loc", "last_modified")


def robots(bodies: DataFrame) -> DataFrame:
    """(url, sitemap) named by robots files."""
    return bodies.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)[ \t]*$"), F.lit(1))).alias("sitemap"))
