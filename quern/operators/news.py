"""Headlines: matching a corpus of items to queries, newest first, and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import substrings

# ---- fixed values ----
SUFFIXES = ["lar", "ler", "ları", "leri", "ında", "inde", "dan", "den", "tan", "ten", "nın", "nin", "nun", "nün", "ya", "ye", "da", "de", "ta", "te", "ı", "i", "u", "ü"]
# ----------------------


def turkish_lower(x: Column) -> Column:
    return F.lower(F.translate(x, "Iİ", "ıi"))


def terms(query: Column) -> Column:
    """T5: words in Turkish lower case, longer ones less one suffix, of three letters or more."""
    own = F.transform(F.split(query, r"\s+"), turkish_lower)
    cut = F.transform(own, lambda x: F.when(F.length(x) <= 4, x).otherwise(F.regexp_replace(x, "(?:" + "|".join(SUFFIXES) + ")$", "")))
    return F.filter(cut, lambda x: F.length(x) >= 3)


def match(items: DataFrame, queries: DataFrame, limit: int, now: Column, freshness_hours: float | None = None) -> DataFrame:
    """(query_id, id, rank, score): a term counts 1 in the title, else .4 in the snippet; most terms must be there; recent items gain up to .5.

    items: (id, title, snippet, published_at). All queries' terms go over each item once; only hits meet the queries. A query without terms takes all items.
    """
    own = items.withColumn("t", turkish_lower(F.col("title"))).withColumn("b", turkish_lower(F.col("snippet")))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / F.lit(3.6e9)
    if freshness_hours is not None:
        own = own.where(F.col("published_at").isNull() | (hours <= freshness_hours))
    asked = substrings.asked_terms(queries, terms(F.col("query")))
    found = substrings.hits(own, ["id"], ["t", "b"], asked).join(asked, "term")
    per = found.groupBy("query_id", "id", "n", "term").agg(F.max(F.when(F.col("field") == "t", 1.0).otherwise(0.4)).alias("part"), F.first("times").alias("times"))
    need = F.least(F.col("n"), F.greatest(F.lit(2), F.ceil(F.col("n") * 0.6)))
    matched = per.groupBy("query_id", "id", "n").agg(F.sum("times").alias("held"), F.sum(F.col("part") * F.col("times")).alias("score")).where(F.col("held") >= need).select("query_id", "id", "score")
    without = queries.where(F.size(terms(F.col("query"))) == 0).select("query_id").crossJoin(own.select("id")).withColumn("score", F.lit(0.0))
    fresh = own.select("id", (F.greatest(F.lit(0.0), 1 - F.coalesce(hours, F.lit(72.0)) / 168) * 0.5).alias("fresh"))
    both = matched.unionByName(without).join(fresh, "id").withColumn("score", F.col("score") + F.col("fresh"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))).where(F.col("rank") <= limit).select("query_id", "id", "rank", "score")


def headlines(items: DataFrame, limit: int) -> DataFrame:
    """The newest items; those without a date last, as of 2000."""
    when = F.coalesce(F.col("published_at").cast("timestamp"), F.to_timestamp(F.lit("2000-01-01 00:00:00")))
    return items.orderBy(when.desc(), "id").limit(limit)


def with_topics(items: DataFrame, feeds: DataFrame, wanted: list[str]) -> DataFrame:
    """Items of feeds that have one of the topics. feeds: (source, topics)."""
    own = feeds.where(F.arrays_overlap("topics", F.array(*map(F.lit, wanted)))).select(F.col("source").alias("_s"))
    return items.join(own, F.col("source") == F.col("_s"), "left_semi")
