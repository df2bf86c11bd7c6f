"""Search sources as tables: stored answers of each kind parsed into ranked lists, and the outcome of their attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import extract

#: Of each kind of JSON answer: its schema, the path of its rows, and expressions for title, url, snippet and date of a row x.
KINDS: dict[str, tuple[str, str, str, str, str, str]] = {
    "plain": ("results array<struct<title:string,url:string,description:string>>", "results", "x.title", "x.url", "x.description", "null"),
    "runs": ("results array<struct<title:array<struct<value:string>>,url:string,extract:array<struct<value:string>>>>", "results", "array_join(transform(x.title, y -> y.value), '')", "regexp_replace(x.url, '^http://', 'https://')", "array_join(transform(x.extract, y -> y.value), '')", "null"),
    "questions": ("items array<struct<title:string,question_id:bigint,excerpt:string,creation_date:bigint,site:string>>", "items", "x.title", "concat('https://', x.site, '/questions/', x.question_id)", "x.excerpt", "timestamp_seconds(x.creation_date)"),
    "repositories": ("items array<struct<full_name:string,html_url:string,description:string,pushed_at:string>>", "items", "x.full_name", "x.html_url", "x.description", "try_to_timestamp(x.pushed_at)"),
    "stories": ("hits array<struct<title:string,url:string,objectID:string,story_text:string,created_at:string>>", "hits", "x.title", "coalesce(nullif(x.url, ''), concat('https://news.ycombinator.com/item?id=', x.objectID))", "left(x.story_text, 300)", "try_to_timestamp(x.created_at)"),
    "works": ("results array<struct<title:string,doi:string,publication_date:string,abstract_inverted_index:map<string,array<int>>>>", "results", "x.title", "x.doi", "array_join(transform(array_sort(flatten(transform(map_entries(x.abstract_inverted_index), e -> transform(e.value, p -> named_struct('p', p, 'w', e.key))))), y -> y.w), ' ')", "try_to_timestamp(x.publication_date)"),
    "articles": ("query struct<search:array<struct<title:string,snippet:string,timestamp:string>>>, lang string", "query.search", "x.title", "concat('https://', lang, '.wikipedia.org/wiki/', replace(url_encode(replace(x.title, ' ', '_')), '+', '%20'))", "x.snippet", "try_to_timestamp(x.timestamp)"),
    "manuals": ("documents array<struct<title:string,mdn_url:string,summary:string>>", "documents", "x.title", "concat('https://developer.mozilla.org', x.mdn_url)", "x.summary", "null"),
    "packages": ("objects array<struct<package:struct<name:string,description:string,date:string>>>", "objects", "x.package.name", "concat('https://www.npmjs.com/package/', x.package.name)", "x.package.description", "try_to_timestamp(x.package.date)"),
    "filings": ("hits struct<hits:array<struct<_id:string,_source:struct<display_names:array<string>,file_type:string,file_date:string,ciks:array<string>>>>>", "hits.hits", "concat(coalesce(get(x._source.display_names, 0), 'SEC filing'), ' — ', coalesce(x._source.file_type, 'filing'))", "coalesce(concat('https://www.sec.gov/Archives/edgar/data/', regexp_replace(get(x._source.ciks, 0), '^0+', ''), '/', replace(split_part(x._id, ':', 1), '-', ''), '/', split_part(x._id, ':', 2)), 'https://www.sec.gov/edgar/search/')", "concat_ws(' ', x._source.file_type, x._source.file_date)", "try_to_timestamp(x._source.file_date)"),
    "entities": ("search array<struct<label:string,concepturi:string,description:string>>", "search", "x.label", "x.concepturi", "x.description", "null"),
}

# ---- fixed values: which sources are asked for an intent, in order; others take the last row ----
ROUTES = [
    ("news", ["newsroom", "marginalia", "mwmbl", "google-news", "wikipedia", "wikidata"]),
    ("finance", ["newsroom", "marginalia", "mwmbl", "google-news", "sec-filings", "wikidata"]),
    ("academic", ["marginalia", "mwmbl", "openalex", "scholar", "wikipedia", "wikidata"]),
    ("technical", ["marginalia", "mwmbl", "stackexchange", "github", "hackernews", "packages", "mdn"]),
    ("product", ["newsroom", "marginalia", "mwmbl", "google-news", "hackernews", "packages", "wikipedia"]),
    ("general", ["marginalia", "mwmbl", "wikipedia", "wikidata", "newsroom", "stackexchange", "github", "hackernews", "google-news"]),
]
# --------------------------------------------------------------------------------------------------


def routed(planned: DataFrame, first: list[str] | None = None) -> DataFrame:
    """(query_id, list_ord, provider): the sources of each query by its intent; first: sources asked before them. planned: (query_id, intent)."""
    routes = F.create_map(*[F.lit(x) for x in sum(([k, "|".join(v)] for k, v in ROUTES), [])])
    own = F.coalesce(F.try_element_at(routes, F.col("intent")), F.lit("|".join(ROUTES[-1][1])))
    return planned.select("query_id", F.posexplode(F.concat(F.array(*map(F.lit, first or [])), F.split(own, r"\|"))).alias("list_ord", "provider"))


def ranked(answers: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, provider, list_ord, rank, title, url, snippet, published_at) from answers (query_id, provider, list_ord, kind, status, body).

    Answers that aren't good and rows without title or url bring nothing.
    """
    parts = []
    for kind, (schema, rows, title, url, snippet, when) in KINDS.items():
        own = answers.where((F.col("kind") == kind) & F.col("status").between(200, 299)).withColumn("_b", F.from_json("body", schema))
        own = own.select("query_id", "provider", "list_ord", *([F.coalesce(F.col("_b.lang"), F.lit("en")).alias("lang")] if "lang string" in schema else []), F.posexplode(F.col(f"_b.{rows}")).alias("pos", "x"))
        parts.append(own.select("query_id", "provider", "list_ord", "pos", F.expr(title).alias("title"), F.expr(url).alias("url"), F.coalesce(F.expr(f"cast({snippet} as string)"), F.lit("")).alias("snippet"), F.expr(f"cast({when} as timestamp)").alias("published_at")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.where("nullif(title, '') is not null and nullif(url, '') is not null").withColumn("snippet", extract.plain(F.col("snippet")))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "list_ord").orderBy("pos")) - 1).where(F.col("rank") < limit).drop("pos")


def outcomes(attempts: DataFrame) -> DataFrame:
    """(query_id, provider, ok, rows): a source fails only if all its attempts failed; a good empty answer is a success."""
    return attempts.groupBy("query_id", "provider").agg(F.max(F.col("status").between(200, 299)).alias("ok"), F.sum("rows").alias("rows"))


def on_time(lists: DataFrame, deadline: Column) -> tuple[DataFrame, DataFrame]:
    """Lists that arrived in time, and late ones, which don't change the answer but may be stored for the next."""
    return lists.where(F.col("arrival_ms") <= deadline), lists.where(F.col("arrival_ms") > deadline)


def waves(lists: DataFrame, enough: int) -> DataFrame:
    """Rows of the first wave of sources, and of the second for queries that the first leaves short. lists: (query_id, wave, url, ...)."""
    short = lists.groupBy("query_id").agg(F.countDistinct(F.when(F.col("wave") == 1, F.col("url"))).alias("n")).where(F.col("n") >= enough).select("query_id")
    return lists.where("wave = 1").unionByName(lists.where("wave > 1").join(short, "query_id", "left_anti"))
