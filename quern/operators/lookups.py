"""Lookups whose plain form is a nested loop, as equality joins: domain lists, prefixes, chains of redirects; and checks of inline documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.durable import kept

# ---- fixed values: redirects followed at most, and their statuses; documents of a request, characters of one and of all ----
HOPS = 3
REDIRECTS = [301, 302, 303, 307, 308]
MOST_DOCUMENTS, MOST_CHARS, MOST_TOTAL = 200, 40_000, 1_500_000
# ----------------------------------------------------------------------------------------------------------------------------


def suffixes(host: Column) -> Column:
    """A host and all domains it is part of, the longest first: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def plain_domain(pattern: Column) -> Column:
    """A pattern of a list as a domain: small letters, without *., a leading and a trailing dot."""
    return F.regexp_replace(F.lower(F.trim(pattern)), r"^\*?\.|\.$", "")


def allow_lists(lists: DataFrame) -> DataFrame:
    """(list_id, domain) that a list lets through; a null domain alone: nothing. lists: (list_id, kind, domain), kind allowed or include, of any number.

    Where a list has both kinds, the narrower of each two domains of which one holds the other; if none does, nothing may pass. A list without either kind has no row: it lets all pass.
    """
    own = lists.where(F.col("kind").isin("allowed", "include")).select("list_id", "kind", plain_domain(F.col("domain")).alias("domain")).distinct()
    parts = own.withColumn("part", F.explode(suffixes(F.col("domain"))))
    other = own.select(F.col("list_id").alias("l2"), F.col("kind").alias("k2"), F.col("domain").alias("d2"))
    # A domain stays if it is, or is part of, a domain of the other kind.
    both = parts.join(other, F.expr("list_id <=> l2 and part = d2 and kind <> k2")).select("list_id", "domain").distinct()
    kinds = own.groupBy("list_id").agg(F.countDistinct("kind").alias("kinds"))
    named = kinds.withColumnRenamed("list_id", "_l")
    single = own.join(named.where("kinds = 1"), F.expr("list_id <=> _l")).select("list_id", "domain")
    denied = kinds.where("kinds = 2").join(both.withColumnRenamed("list_id", "_l"), F.expr("list_id <=> _l"), "left_anti").select("list_id", F.lit(None).cast("string").alias("domain"))
    return single.unionByName(both).unionByName(denied)


def pass_lists(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """asked (list_id, host, ...) with rule (the longest domain that let it through, or blocked it) and passes.

    lists: (list_id, kind, domain), kind allowed, include, blocked or exclude. A host meets the few domains that it is part of, not the rules of its list. Null hosts pass nothing.
    """
    rows = asked.withColumn("_row", F.struct(*asked.columns))
    allow = allow_lists(lists)
    block = lists.where(F.col("kind").isin("blocked", "exclude")).select("list_id", plain_domain(F.col("domain")).alias("domain")).distinct()
    rules = allow.withColumn("blocks", F.lit(False)).unionByName(block.withColumn("blocks", F.lit(True))).withColumnRenamed("list_id", "_l")
    hosts = asked.select("list_id", "host").where("host is not null").distinct()
    parts = hosts.withColumn("_part", F.explode(suffixes(F.lower("host"))))
    met = parts.join(rules.where("domain is not null"), F.expr("list_id <=> _l and _part = domain"))
    longest = lambda flag: F.max_by("domain", F.when(F.col("blocks") == F.lit(flag), F.length("domain")))
    met = met.groupBy("list_id", "host").agg(longest(False).alias("_allow"), longest(True).alias("_block")).withColumnsRenamed({"list_id": "_l1", "host": "_h1"})
    limited = allow.select(F.col("list_id").alias("_l2")).distinct().withColumn("_limited", F.lit(True))
    out = rows.join(met, F.expr("list_id <=> _l1 and host = _h1"), "left").join(limited, F.expr("list_id <=> _l2"), "left")
    passes = F.col("host").isNotNull() & F.col("_block").isNull() & (F.col("_limited").isNull() | F.col("_allow").isNotNull())
    return out.select(*asked.columns, F.coalesce("_block", "_allow").alias("rule"), passes.alias("passes"))


def first_prefix(texts: DataFrame, prefixes: DataFrame, keys: list[str], text: str, prefix: str, order: str) -> DataFrame:
    """texts with `found`: the first prefix, by order, of the same keys that the text begins with; null if none does.

    prefixes: (keys, prefix, order). Only the lengths that some prefix has are cut from a text, so the join is by equality; an empty prefix begins every text.
    Of equal prefixes of the same keys the first stands for all, and texts meet them as distinct heads as long as the longest prefix: neither whole texts nor repeated prefixes are joined.
    """
    groups = [F.col(x).alias(f"_k{i}") for i, x in enumerate(keys)]
    known = prefixes.where(F.col(prefix).isNotNull()).groupBy(*groups, F.col(prefix).alias("_p")).agg(F.min(order).alias("_o"))
    lengths = known.agg(F.array_sort(F.collect_set(F.length("_p"))).alias("_lengths"))  # as many as lengths differ
    texts_ = texts.crossJoin(F.broadcast(lengths)).withColumn("_head", F.substring(F.col(text), F.lit(1), F.coalesce(F.array_max("_lengths"), F.lit(0)))).drop("_lengths")
    heads = texts_.select(*keys, "_head").distinct().crossJoin(F.broadcast(lengths))
    heads = heads.withColumn("_cut", F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length("_head")), lambda n: F.substring(F.col("_head"), F.lit(1), n))))
    same = " and ".join([*[f"`{x}` <=> _k{i}" for i, x in enumerate(keys)], "_cut = _p"])
    met = heads.join(known, F.expr(same)).groupBy(*[F.col(x).alias(f"_r{i}") for i, x in enumerate(keys)], F.col("_head").alias("_t")).agg(F.min_by("_p", "_o").alias("found"))
    back = " and ".join([*[f"`{x}` <=> _r{i}" for i, x in enumerate(keys)], "_head = _t"])
    return texts_.join(met, F.expr(back), "left").select(*texts.columns, "found")


def origin(url: Column) -> Column:
    """Scheme, host and port of an address, small letters, the scheme's own port left out."""
    bare = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0))
    return F.regexp_replace(F.regexp_replace(bare, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")


def follow(asked: DataFrame, crawl: DataFrame, hops: int = HOPS) -> DataFrame:
    """asked (url, ...) with final_url, hops, status, error and keeps_credentials, along the redirects of a crawl table (url, status, location), each url once.

    At most `hops` redirects are followed, all rows a step at a time. error: missing (an address that the crawl does not hold), no_target (a redirect without a location),
    too_many (a redirect after the last hop; a circle ends so). Locations are absolute, or a path on the same origin. Credentials are dropped at the first change of origin.
    """
    known = crawl.select(F.col("url").alias("_u"), F.col("status").alias("_s"), F.col("location").alias("_l"))
    known = kept(known.withColumn("_l", F.when(F.startswith("_l", F.lit("/")), F.concat(origin(F.col("_u")), F.col("_l"))).otherwise(F.col("_l"))))
    own = asked.withColumns({"final_url": F.col("url"), "hops": F.lit(0), "status": F.lit(None).cast("int"), "error": F.lit(None).cast("string"), "keeps_credentials": F.lit(True), "_open": F.lit(True)})
    for hop in range(hops + 1):
        met = own.join(known, F.expr("_open and final_url = _u"), "left")
        moved = F.col("_open") & F.col("_s").isin(REDIRECTS)
        goes = F.coalesce(moved & F.col("_l").isNotNull() & F.lit(hop < hops), F.lit(False))
        error = F.when(F.col("_open") & F.col("_u").isNull(), "missing").when(moved & F.col("_l").isNull(), "no_target").when(moved & F.lit(hop == hops), "too_many")
        own = met.select(
            *asked.columns, F.when(goes, F.col("_l")).otherwise(F.col("final_url")).alias("final_url"), (F.col("hops") + goes.cast("int")).alias("hops"),
            F.coalesce(F.when(F.col("_open"), F.col("_s").cast("int")), F.col("status")).alias("status"), F.coalesce("error", error).alias("error"),
            (F.col("keeps_credentials") & ~(goes & (origin(F.col("_l")) != origin(F.col("final_url"))))).alias("keeps_credentials"), goes.alias("_open"),
        )
    return own.drop("_open")


def inline_documents(rows: DataFrame) -> DataFrame:
    """(request_id, documents, error_place, reason) of requests that bring their documents: rows (request_id, place from 0, id, text).

    The first fault by place counts: too_many (more than 200 documents, at place 200), no_text, too_long, too_much (all texts so far), repeated_id. A missing or empty id is the place.
    Requests with too many documents are told by a count; only the others' rows are put in order, at most 200 each.
    """
    counts = rows.groupBy("request_id").agg(F.count("*").alias("documents"))
    fit = counts.where(F.col("documents") <= MOST_DOCUMENTS).withColumnsRenamed({"request_id": "_r", "documents": "_n"})
    own = rows.join(fit, F.expr("request_id <=> _r"), "left_semi").select("request_id", "place", F.coalesce(F.nullif("id", F.lit("")), F.col("place").cast("string")).alias("id"), F.length("text").alias("n"), F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("filled"))
    w = W.partitionBy("request_id").orderBy("place")
    own = own.withColumns({"upto": F.sum("n").over(w), "nth": F.row_number().over(W.partitionBy("request_id", "id").orderBy("place"))})
    reason = F.when(~F.col("filled"), "no_text").when(F.col("n") > MOST_CHARS, "too_long").when(F.col("upto") > MOST_TOTAL, "too_much").when(F.col("nth") > 1, "repeated_id")
    faults = own.withColumn("reason", reason).where("reason is not null").groupBy("request_id").agg(F.min("place").alias("error_place"), F.min_by("reason", "place").alias("reason")).withColumnRenamed("request_id", "_r")
    out = counts.join(faults, F.expr("request_id <=> _r"), "left")
    many = F.col("documents") > MOST_DOCUMENTS
    return out.select("request_id", "documents", F.when(many, F.lit(MOST_DOCUMENTS)).otherwise(F.col("error_place")).cast("long").alias("error_place"), F.when(many, "too_many").otherwise(F.col("reason")).alias("reason"))
