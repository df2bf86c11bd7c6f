"""Ranked lists: reciprocal rank fusion, gates, caps by host, interleaving, cheap pre-ranking and final scores.

A ranked list is (query_id, provider, list_ord, rank, title, url, snippet, published_at), ranks from 0 in each list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.functions import urls as u
from quern.operators import substrings
from quern.operators.durable import kept

RRF_K, HOST_CAP = 60, 2
#: Queries up to which they are sent to all tasks.
SENT_QUERIES = 10_000
# ---- fixed values: intent, half-life in hours, weights of relevance, credibility and freshness, result life in seconds ----
INTENTS = [
    ("news", 24.0, 0.35, 0.25, 0.4, 300),
    ("finance", 12.0, 0.3, 0.3, 0.4, 300),
    ("product", 720.0, 0.45, 0.3, 0.25, 1800),
    ("technical", 4320.0, 0.45, 0.4, 0.15, 86400),
    ("academic", 8760.0, 0.35, 0.55, 0.1, 86400),
    ("general", 2160.0, 0.45, 0.4, 0.15, 3600),
]
# What an assessment of an address says, in the order of urls.HOST_CLASSES, and which of these classes are primary; then the other signals.
CLASS_SIGNALS, PRIMARY = ["birincil-kaynak", "akademik", "referans", "kurumsal-haber", "resmi-dokümantasyon", "topluluk"], [0.95, 0.9, 0.85]
NO_ADDRESS, LOW_TRUST, PLAIN_HTTP, FULL, EMPTY = "geçersiz-url", "düşük-editoryal-denetim", "şifresiz-bağlantı", "dolu-içerik", "içerik-çıkarılamadı"
# --------------------------------------------------------------------------------------------------------------------------


def fuse(lists: DataFrame, limit: int | None = None, key: Column | None = None) -> DataFrame:
    """(query_id, url_key, score, providers, url, title, snippet, published_at, rank): the sum of 1 / (60 + rank) over lists.

    A list counts an address once, at its best rank. The first seen copy stays, with the longest snippet (the first of equals) and the first known date.
    """
    own = lists.withColumn("url_key", u.url_key(F.col("url")) if key is None else key)
    once = own.withColumn("n", F.row_number().over(W.partitionBy("query_id", "list_ord", "url_key").orderBy("rank"))).where("n = 1").drop("n")
    seen = F.struct("list_ord", "rank")
    out = once.groupBy("query_id", "url_key").agg(
        F.sum(1 / (F.lit(RRF_K) + F.col("rank") + 1)).alias("score"),
        F.countDistinct("provider").alias("providers"),
        F.min_by("url", seen).alias("url"),
        F.min_by("title", seen).alias("title"),
        F.max_by("snippet", F.struct(F.length("snippet"), -F.col("list_ord"), -F.col("rank"))).alias("snippet"),
        F.min_by("published_at", F.when(F.col("published_at").isNotNull(), seen)).alias("published_at"),
        F.min(seen).alias("first"),
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.desc("providers"), "first"))
    out = out.withColumn("rank", place).drop("first")
    return out if limit is None else out.where(F.col("rank") <= limit)


def provider_names(lists: DataFrame) -> DataFrame:
    """(query_id, provider, providers): the names of the lists that have results, in the lists' order, joined by plus signs, and their number."""
    own = lists.groupBy("query_id", "provider").agg(F.min("list_ord").alias("list_ord")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("list_ord", "provider"))).alias("p"))
    return own.select("query_id", F.array_join(F.transform("p", lambda x: x["provider"]), "+").alias("provider"), F.size("p").cast("long").alias("providers"))


def cap_hosts(results: DataFrame, limit: int, cap: int = HOST_CAP, host: Column | None = None) -> DataFrame:
    """At most `cap` results of a host, in order; those held back follow if there is room. results: (query_id, pos, url, ...)."""
    own = results.withColumn("_host", F.coalesce(u.host(F.col("url")) if host is None else host, F.lit("")))
    own = own.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "_host").orderBy("pos")))
    held = (F.col("_n") > cap) & (F.col("_host") != "")
    return own.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(held.cast("int"), "pos"))).where(F.col("place") <= limit).drop("_host", "_n")


def interleave(lists: DataFrame, limit: int, group: list[str], list_ord: str, rank: str) -> DataFrame:
    """Round robin over lists: first ones in the lists' order, then second ones, up to limit."""
    return lists.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(rank, list_ord))).where(F.col("place") <= limit)


def gate(terms: Column, hay: Column) -> Column:
    """Whether any gate token of the query is part of the text; without tokens everything passes. hay: in lower case, a plain column (a test a token reads it)."""
    return (F.size(terms) == 0) | F.exists(terms, lambda x: F.contains(hay, x))


def filter_or_all(df: DataFrame, cond: Column, keys: list[str]) -> DataFrame:
    """Rows that pass; all rows of a group in which none does."""
    own = df.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    return own.withColumn("_any", F.max("_ok").over(W.partitionBy(*keys))).where("_ok or not _any").drop("_ok", "_any")


def pre_score(query: Column, title: Column, snippet: Column) -> Column:
    """A cheap score before any page is read: .6 a term in the title, else .4 in the snippet, over the number of terms; .3 for the phrase in the title.

    title, snippet: in lower case, plain columns that are not null.
    """
    terms = t.short_tokens(query)
    n = F.size(terms)
    part = F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.when(F.contains(title, x), 0.6 / n).when(F.contains(snippet, x), 0.4 / n).otherwise(0.0))
    return F.when(n == 0, F.lit(0.5)).otherwise(part + F.when(F.contains(title, F.lower(query)), 0.3).otherwise(0.0))


def gated(docs: DataFrame, queries: DataFrame, id_col: str, hay: str) -> DataFrame:
    """(query_id, id) of all documents whose text (in lower case) holds a gate token of the query; a query without tokens lets all pass. One pass over the texts for all queries."""
    terms = substrings.asked_terms(queries, t.gate_tokens(F.col("query")))
    found = substrings.hits(docs, [id_col], [hay], terms)
    open_to_all = queries.where(F.size(t.gate_tokens(F.col("query"))) == 0).select("query_id")
    return found.join(terms.select("query_id", "term"), "term").select("query_id", id_col).distinct().unionByName(open_to_all.crossJoin(docs.select(id_col)))


def pre_scored(docs: DataFrame, queries: DataFrame, id_col: str, title: str, snippet: str, limit: int) -> DataFrame:
    """(query_id, id, rank, score): the best by a cheap score before any page is read: .6 a term in the title, else .4 in the snippet, over the number of terms; .3 for the phrase in the title.

    title, snippet: in lower case. A query without terms gives all .5. Ties by id; documents that hold no term have score 0. One pass over the texts for all queries.
    """
    terms = substrings.asked_terms(queries, t.short_tokens(F.col("query")))
    phrase = queries.where(F.size(t.short_tokens(F.col("query"))) > 0).select("query_id", F.lower("query").alias("term"))
    found = substrings.hits(docs, [id_col], [title, snippet], terms.select("term").union(phrase.select("term")))
    # A term counts where it counts most: a title's hit sorts before a snippet's.
    own = found.join(terms, "term").groupBy("query_id", id_col, "term").agg((F.max(F.when(F.col("field") == title, 0.6).otherwise(0.4)) * F.first("times") / F.first("n")).alias("part"))
    bonus = found.where(F.col("field") == title).join(phrase, "term").select("query_id", id_col, F.lit(None).cast("string").alias("term"), F.lit(0.3).alias("part"))
    scored = own.unionByName(bonus).groupBy("query_id", id_col).agg(F.sum("part").alias("score"))
    without = queries.where(F.size(t.short_tokens(F.col("query"))) == 0)
    some = substrings.best_of_all(scored, docs, queries.where(F.size(t.short_tokens(F.col("query"))) > 0), id_col, limit)
    return some.unionByName(substrings.best_of_all(scored.limit(0), docs, without, id_col, limit, 0.5))


def with_relevance(docs: DataFrame, queries: DataFrame, title: str, snippet: str, content: str, on: Column | None = None) -> DataFrame:
    """docs joined with queries (query_id, query), and relevance: coverage of the query's terms by title (.5), snippet (.3) and the first 4000 characters of the content (.2), and .15 for the phrase.

    Texts and queries are normalized once each, before they meet. Without a condition every document meets every query: a product of partitions would read each document again for
    each partition of queries, so queries are sent to all tasks up to a checked number, and beyond it the normalized documents are kept.
    """
    whole = lambda x: t.normalize(F.coalesce(F.col(x), F.lit("")))
    own = docs.withColumns({"_a": whole(title), "_b": whole(snippet), "_d": t.normalize(F.substring(F.coalesce(F.col(content), F.lit("")), 1, 4000))})
    ask = queries.select(F.col("query_id").alias("_q"), F.col("query").alias("_query"), t.plain_tokens(F.col("query")).alias("_terms"), t.normalize(F.col("query")).alias("_p"))
    if on is not None:
        both = own.join(ask, on)
    elif queries.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES:
        both = own.crossJoin(F.broadcast(ask))
    else:
        both = kept(own).crossJoin(ask)
    share = lambda x: F.size(F.filter("_terms", lambda y: F.contains(F.col(x), y))) / F.size("_terms")
    bonus = F.when((F.length("_p") > 8) & (F.contains(F.col("_a"), F.col("_p")) | F.contains(F.col("_d"), F.col("_p"))), 0.15).otherwise(0.0)
    score = F.when(F.size("_terms") == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), share("_a") * 0.5 + share("_b") * 0.3 + share("_d") * 0.2 + bonus))
    return both.withColumn("relevance", score).drop("_a", "_b", "_d", "_terms", "_p")


def credibility(url: Column, n_chars: Column) -> Column:
    """A host's class, lowered for little reviewed hosts, plain http and empty pages, raised for full ones; .2 for what isn't an address."""
    name = u.host(url)
    base = None
    for _, score, patterns in u.HOST_CLASSES:
        hit = name.rlike("|".join(patterns))
        base = F.when(hit, score) if base is None else base.when(hit, score)
    base = base.otherwise(0.45)
    base = F.when(name.rlike("|".join(u.LOW_TRUST)), F.least(base, F.lit(0.35))).otherwise(base)
    base = base - F.when(F.startswith(url, F.lit("http://")), 0.08).otherwise(0.0) + F.when(n_chars > 1200, 0.05).when(n_chars < 200, -0.08).otherwise(0.0)
    return F.when(name.isNull(), F.lit(0.2)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))


def assessment(url: Column, n_chars: Column) -> Column:
    """(signals, is_primary) of an address beside its credibility: the host's class, little review, plain http, a full or an empty page. Primary are official, academic and documentation hosts."""
    name = u.host(url)
    kind = primary = None
    for (_, score, patterns), signal in zip(u.HOST_CLASSES, CLASS_SIGNALS, strict=True):
        hit = name.rlike("|".join(patterns))
        kind = F.when(hit, signal) if kind is None else kind.when(hit, signal)
        primary = F.when(hit, score in PRIMARY) if primary is None else primary.when(hit, score in PRIMARY)
    told = F.array_compact(F.array(kind, F.when(name.rlike("|".join(u.LOW_TRUST)), LOW_TRUST), F.when(F.startswith(url, F.lit("http://")), PLAIN_HTTP), F.when(n_chars > 1200, FULL).when(n_chars < 200, EMPTY)))
    return F.when(name.isNull(), F.struct(F.array(F.lit(NO_ADDRESS)).alias("signals"), F.lit(False).alias("is_primary"))).otherwise(F.struct(told.alias("signals"), F.coalesce(primary, F.lit(False)).alias("is_primary")))


def freshness(published: Column, now: Column, half_life: Column) -> Column:
    """Half of it every half-life; .5 where no date is known."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(3.6e9)
    return F.when(published.isNull(), F.lit(0.5)).otherwise(F.round(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours) / half_life), 3))


def corroborated(score: Column, n: Column) -> Column:
    return F.when(n > 1, F.least(F.lit(1.0), score + F.least(F.lit(0.1), 0.03 * n))).otherwise(score)


def overall(rel: Column, cred: Column, fresh: Column, r: Column, c: Column, f: Column, digits: int = 3) -> Column:
    """Weighted by intent, and scaled down below a relevance of one half."""
    return F.round((rel * r + cred * c + fresh * f) * F.least(F.lit(1.0), rel / 0.5), digits)
