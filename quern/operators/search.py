"""Search as one program: ranked lists of many sources become scored, diverse results of many queries at once.

lists: as in fuse; pages: (url, content[, published_at, updated_at]) that have been read; planned: (query_id, query, intent),
the cleaned query. Addresses are compared by canonical key. Nulls: a result without address, title or snippet is left out, an
unknown date is kept and counts as neutral, a page that wasn't read is served from its snippet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import urls as u
from quern.operators import fuse

# ---- fixed values: least useful relevance, results read beyond those asked for, least number of candidates ----
LEAST_RELEVANCE, HEADROOM, LEAST_CANDIDATES = 0.15, 1, 10
# Depths of search: sources asked first, wait before others, time for web and other sources, for recovery and for reading, pages read.
PROFILES = [
    ("fast", 3.0, 80, 450, 350, 700, 1000, 3),
    ("balanced", 4.0, 120, 700, 600, 1200, 1400, 5),
    ("deep", float("inf"), 0, 1800, 1600, 2500, 3500, 8),
]
# -----------------------------------------------------------------------------------------------------------------


def accepted(results: DataFrame, now: Column, freshness_hours: float | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Whole results at public, safe addresses of the domains asked for, not older than asked for where a date is known."""
    own = results.where("url is not null and title is not null and snippet is not null")
    own = own.where(u.is_url_allowed(F.col("url"), exclude, include) & ~u.is_unsafe(F.col("url"), F.concat_ws(" ", "title", "snippet")))
    return fresh(own, now, freshness_hours)


def fresh(results: DataFrame, now: Column, hours: float | None) -> DataFrame:
    if hours is None:
        return results
    since = F.unix_micros(now.cast("timestamp")) - int(hours * 3.6e9)
    return results.where(F.col("published_at").isNull() | (F.unix_micros(F.col("published_at").cast("timestamp")) >= since))


def chosen(results: DataFrame, planned: DataFrame, most: int) -> DataFrame:
    """The best results of each query by their cheap score; equal ones in the order of their rank."""
    own = results.join(planned.select("query_id", "query"), "query_id").withColumns({"_t": F.lower("title"), "_s": F.lower("snippet")})
    own = own.withColumn("_score", F.round(fuse.pre_score(F.col("query"), F.col("_t"), F.col("_s")), 9))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_score"), "rank"))
    return own.withColumn("position", place).where(F.col("position") <= most).drop("_t", "_s", "_score", "query")


def read(results: DataFrame, pages: DataFrame) -> DataFrame:
    """results with the content and dates of pages of the same address; without content the snippet stands. The first of several pages by address counts."""
    dates = [x for x in ("published_at", "updated_at") if x in pages.columns]
    own = pages.select(u.url_key(F.col("url")).alias("_key"), F.struct("url", "content", *dates).alias("_p")).groupBy("_key").agg(F.min("_p").alias("_p"))
    out = results.join(own, F.col("url_key") == F.col("_key"), "left")
    own_date = lambda x: F.col(f"_p.{x}") if x in dates else F.lit(None).cast("timestamp")
    return out.withColumns({"content": F.coalesce(F.nullif(F.col("_p.content"), F.lit("")), F.col("snippet")), "published_at": F.coalesce(own_date("published_at"), F.col("published_at")), "updated_at": own_date("updated_at")}).drop("_key", "_p")


def scored(results: DataFrame, planned: DataFrame, now: Column) -> DataFrame:
    """results with relevance, credibility (raised where a host gives several results), freshness and overall."""
    kinds = results.sparkSession.createDataFrame(fuse.INTENTS, "_kind string, _half double, _r double, _c double, _f double, _ttl int")
    own = fuse.with_relevance(results, planned, "title", "snippet", "content", on=F.col("query_id") == F.col("_q"))
    own = own.join(planned.select(F.col("query_id").alias("_i"), F.col("intent").alias("_kind")), F.col("query_id") == F.col("_i")).join(F.broadcast(kinds), "_kind")  # six rows
    same = F.count("*").over(W.partitionBy("query_id", F.coalesce(u.host(F.col("url")), F.lit(""))))
    own = own.withColumn("_n", same).withColumn("credibility", F.round(fuse.corroborated(fuse.credibility(F.col("url"), F.length("content")), F.col("_n")), 3))
    own = own.withColumns({"relevance": F.round("relevance", 3), "freshness": fuse.freshness(F.col("published_at"), now, F.col("_half"))})
    own = own.withColumn("overall", fuse.overall(F.col("relevance"), F.col("credibility"), F.col("freshness"), F.col("_r"), F.col("_c"), F.col("_f")))
    return own.drop("_q", "_query", "_i", "_kind", "_half", "_r", "_c", "_f", "_ttl", "_n")


def search(lists: DataFrame, pages: DataFrame, planned: DataFrame, now: Column, max_results: int = 10, freshness_hours: float | None = None, include: list[str] | None = None, exclude: list[str] | None = None, requested: DataFrame | None = None) -> DataFrame:
    """(query_id, place, url, title, snippet, content, published_at, updated_at, relevance, credibility, freshness, overall).

    Lists are fused, filtered and cut by a cheap score before any page is joined; pages asked for by address (requested:
    query_id, url, title, snippet, published_at) come before what was found and take places from it. Results off the topic
    go unless a query has no others; the best by `overall` stay, few a host.
    """
    fused = fuse.fuse(lists, max(LEAST_CANDIDATES, 2 * max_results))
    found = accepted(fused, now, freshness_hours, include, exclude).select("query_id", "url_key", "url", "title", "snippet", "published_at", "rank")
    if requested is None:
        best = chosen(found, planned, max_results + HEADROOM)
    else:
        first = requested.select("query_id", u.url_key(F.col("url")).alias("url_key"), "url", "title", "snippet", "published_at", F.lit(0).alias("rank"))
        first = first.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("url_key")) - 1000)
        best = chosen(found.join(first.select("query_id", "url_key"), ["query_id", "url_key"], "left_anti"), planned, max_results + HEADROOM)
        n = first.groupBy("query_id").agg(F.count("*").alias("_n"))
        best = best.join(n, "query_id", "left").where(F.col("position") <= max_results + HEADROOM - F.coalesce("_n", F.lit(0))).drop("_n").unionByName(first)
    own = fresh(scored(read(best, pages), planned, now), now, freshness_hours)
    own = fuse.filter_or_all(own, F.col("relevance") >= LEAST_RELEVANCE, ["query_id"])
    own = own.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("overall"), "position")))
    return fuse.cap_hosts(own, max_results).select("query_id", "place", "url", "title", "snippet", "content", "published_at", "updated_at", "relevance", "credibility", "freshness", "overall")
