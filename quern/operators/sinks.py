"""What leaves the engine: envelopes, projections by mode, text blocks; and checks and summaries of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the modes that name them; results has all columns, and sources all but the content.
MODES = {"claims": ["query_id", "claim", "text", "sources", "confidence"], "report": ["query_id", "question_id", "query", "summary", "findings", "urls", "is_gap", "used_for", "gaps", "searches", "rounds", "sources_examined"]}


def envelope(df: DataFrame, keys: list[str], name: str = "results", order: str = "rank") -> DataFrame:
    """One JSON text a key: the key's columns, the number of rows and the rows in order. Rows of a key are a request's, so few."""
    rest = [x for x in df.columns if x not in keys]
    rows = F.array_sort(F.collect_list(F.struct(order, *[x for x in rest if x != order])))
    return df.groupBy(*keys).agg(rows.alias(name)).select(*keys, F.to_json(F.struct(*keys, F.size(name).alias("count"), name)).alias("body"))


def shape(df: DataFrame, mode: str) -> DataFrame:
    """The columns of a mode that the table has: links for those who only follow them keep snippet, dates, source and scores."""
    return df if mode == "results" else df.drop("content") if mode == "sources" else df.select(*[x for x in MODES[mode] if x in df.columns])


def render(df: DataFrame, most: int = 700) -> DataFrame:
    """(query_id, text): numbered blocks of title, address and text, white space collapsed, each text up to `most` characters."""
    flat = F.left(F.trim(F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\s+", " ")), F.lit(most))
    block = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit("\n"), F.col("url"), F.lit("\n"), flat)
    return df.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def batch_summary(answers: DataFrame) -> DataFrame:
    """(batch, queries, succeeded, providers, all_cached). answers: (batch, query_id, ok, providers, cached)."""
    return answers.groupBy("batch").agg(F.count("*").alias("queries"), F.sum(F.col("ok").cast("long")).alias("succeeded"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("providers")))).alias("providers"), F.bool_and("cached").alias("all_cached"))


def repeated_ids(df: DataFrame, key: str | Column) -> DataFrame:
    """Ids that occur more than once, with their number."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def identical_once(queries: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Requests that mean the same run once: (the first of each key, each request's first)."""
    own = queries.withColumn("_key", key)
    first = own.groupBy("_key").agg(F.min("query_id").alias("runs_as"))
    mapped = own.join(first, "_key").select("query_id", "runs_as")
    return queries.join(first.select(F.col("runs_as").alias("query_id")), "query_id", "left_semi"), mapped
