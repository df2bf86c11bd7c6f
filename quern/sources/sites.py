"""Site maps of many sites at once from stored bodies: robots files, indexes one level deep, page links where a site tells nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import urls as u
from quern.operators import extract
from quern.sources import feeds

# Addresses of a site by default, site maps of an index that are followed, links of a page.
LIMIT, MOST_CHILDREN, MOST_LINKS = 200, 8, 300


def site_map(sites: DataFrame, bodies: DataFrame, limit: int = LIMIT, path_part: str | None = None) -> DataFrame:
    """(site, place, url, last_modified, via): the addresses of each site, last changed first, then those without a date by length.

    sites: (site), as https://host; bodies: (url, body) of what has been fetched. Robots files name the site maps, else
    /sitemap.xml is taken; the last MOST_CHILDREN maps of an index are followed, not theirs. Sites without any get the
    links of their front page to the same host. path_part: keeps addresses whose path holds it, unless none does.
    """
    body = bodies.select(F.col("url").alias("_u"), "body")
    declared = sites.join(body, F.concat("site", F.lit("/robots.txt")) == F.col("_u")).select("site", F.col("_u").alias("url"), "body")
    declared = feeds.robots(declared.select(F.col("site").alias("url"), "body")).select(F.col("url").alias("site"), F.col("sitemap").alias("map"))
    usual = sites.join(declared.select("site").distinct(), "site", "left_anti").select("site", F.concat("site", F.lit("/sitemap.xml")).alias("map"))
    roots = declared.unionByName(usual).distinct()

    def parsed(maps: DataFrame) -> DataFrame:
        own = maps.join(body, F.col("map") == F.col("_u")).select(F.struct("site", "map").alias("url"), "body")
        return feeds.sitemap(own).select("url.site", "url.map", "kind", "pos", "loc", "last_modified")

    first = parsed(roots)
    children = first.where("kind = 'index'").groupBy("site", "loc").agg(F.max(F.struct("map", "pos")).alias("at"))
    children = children.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy(F.desc("at")))).where(F.col("n") <= MOST_CHILDREN)
    second = parsed(children.select("site", F.col("loc").alias("map")))
    pages = first.unionByName(second).where("kind = 'page'").groupBy("site", F.col("loc").alias("url")).agg(F.max("last_modified").alias("last_modified")).withColumn("via", F.lit("sitemap"))
    silent = sites.join(pages.select("site").distinct(), "site", "left_anti")
    front = silent.join(body, F.concat("site", F.lit("/")) == F.col("_u"))
    hrefs = F.array_distinct(F.regexp_extract_all("body", F.lit(r"""(?i)<a\b[^>]*href=["']([^"'#]+)["']"""), F.lit(1)))
    links = front.select("site", F.explode(hrefs).alias("h")).select("site", extract.resolved(F.col("h"), F.concat("site", F.lit("/"))).alias("url")).where(F.col("url").rlike("^https?:"))
    links = links.where(u.host_matches(u.host(F.col("url")), u.host(F.col("site")))).select("site", "url", F.lit(None).cast("timestamp").alias("last_modified"), F.lit("links").alias("via")).distinct()
    links = links.withColumn("n", F.row_number().over(W.partitionBy("site").orderBy(F.length("url"), "url"))).where(F.col("n") <= MOST_LINKS).drop("n")
    every = pages.unionByName(links)
    if path_part:
        holds = F.contains(F.lower(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))), F.lit(path_part.lower()))
        every = every.withColumn("_ok", holds).withColumn("_any", F.max("_ok").over(W.partitionBy("site"))).where("_ok or not _any").drop("_ok", "_any")
    order = [F.desc_nulls_last("last_modified"), F.when(F.col("last_modified").isNull(), F.length("url")), F.col("url")]
    return every.withColumn("place", F.row_number().over(W.partitionBy("site").orderBy(*order))).where(F.col("place") <= limit).select("site", "place", "url", "last_modified", "via")
