"""Research over several rounds, for many questions at once: a search an angle, claims of each, further searches where support is thin.

A round is a fixed program over tables: all questions' searches of a round run together. `lookup` takes (query_id, query, intent)
and gives (query_id, ord, url, title, host, credibility, text); here query_id is a section's key, question * 100 + place.
Rounds are few (three at most), so plans stay small; what several steps read is cut by `keep`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import claims, planner
from quern.operators.durable import kept

# ---- fixed values: rounds, angles and sources of each depth; searches a later round; claims of a section and of the whole ----
DEPTHS = {"quick": (1, 3, 10), "standard": (2, 5, 20), "deep": (3, 8, 40)}
FOLLOW_UPS, SECTION_CLAIMS, ALL_CLAIMS, WHOLE_OVERLAP = 2, 4, 15, 0.12
# --------------------------------------------------------------------------------------------------------------------------
SECTIONS = 100


def summary(found: DataFrame, key: str, most: int) -> DataFrame:
    """(key, summary): the first claims' sentences, joined."""
    own = found.where(F.col("claim") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("claim", "text"))).alias("c"))
    return own.select(key, F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("summary"))


def follow_ups(sections: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, query, intent): for the first sections whose best claim has fewer than two sources, the angle with the question's first words, or asking for a source."""
    best = found.where("claim = 1").select(F.col("query_id").alias("_k"), "sources")
    weak = sections.join(best, F.col("query_id") == F.col("_k"), "left").where("sources is null or sources < 2")
    weak = weak.withColumn("n", F.row_number().over(W.partitionBy("question_id").orderBy("query_id"))).where(F.col("n") <= FOLLOW_UPS)
    words = F.array_join(F.slice(t.plain_tokens(F.col("question")), 1, 4), " ")
    more = F.when((words != "") & ~F.contains(F.col("query"), words), words).otherwise(F.lit("kaynak"))
    return weak.select("query_id", F.concat_ws(" ", "query", more).alias("query"), "intent")


def started(wave: DataFrame, results: DataFrame, most: int, before: DataFrame | None = None) -> DataFrame:
    """(query_id) of the searches of a wave that start at all: while fewer than `most` sources have been gathered for their question, in the wave's order. before: results of earlier rounds."""
    question = F.floor(F.col("query_id") / SECTIONS).alias("question_id")
    counts = wave.select("query_id").join(results.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", question, F.coalesce("n", F.lit(0)).alias("n"))
    earlier = F.sum("n").over(W.partitionBy("question_id").orderBy("query_id").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.withColumn("had", F.coalesce(earlier, F.lit(0)))
    if before is not None:
        old = before.groupBy(question).agg(F.count("*").alias("old")).withColumnRenamed("question_id", "_q")
        counts = counts.join(old, F.col("question_id") == F.col("_q"), "left").withColumn("had", F.col("had") + F.coalesce("old", F.lit(0)))
    return counts.where(F.col("had") < most).select("query_id")


def merged(results: DataFrame, order: list[Column]) -> DataFrame:
    """Each address of a section once, the first by order, numbered anew."""
    once = results.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "url").orderBy(*order))).where("_n = 1").drop("_n")
    return once.withColumn("ord", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def research(questions: DataFrame, lookup: Callable[[DataFrame], DataFrame], depth: str = "standard", keep: Callable[[DataFrame], DataFrame] = kept) -> dict[str, DataFrame]:
    """Reports of questions (query_id, query), as tables; once a question has its sources, nothing more is searched for it:

    sections (question_id, query_id, query, summary, findings, urls, is_gap); findings (query_id, claim, text, sources, ...) over all
    sources; sources (query_id, place, url, title, credibility, used_for); stats (query_id, searches, sources_examined, gaps, summary).
    """
    rounds, angles, most = DEPTHS[depth]
    asked = questions.select(F.col("query_id").alias("question_id"), F.col("query").alias("question"), planner.intent(F.col("query")).alias("intent"))
    subs = planner.decompose(F.col("question"), F.col("intent"), angles)
    sections = keep(asked.select("*", F.posexplode(subs).alias("pos", "query")).withColumn("query_id", F.col("question_id").cast("long") * SECTIONS + F.col("pos")).drop("pos"))
    texts = sections.select("query_id", "query")
    wave = sections.select("query_id", "query", "intent")
    results, searches, found = None, None, None
    for turn in range(rounds):
        got = keep(lookup(wave))
        done = keep(started(wave, got, most, results).withColumn("turn", F.lit(turn)))
        new = got.join(done, "query_id")
        if not turn:
            # An angle that the bound leaves out is no section, and so no gap.
            sections = keep(sections.join(done.select("query_id"), "query_id", "left_semi"))
        searches = done if searches is None else searches.unionByName(done)
        results = keep(new if results is None else results.unionByName(new))
        # A later round's results stand before those that a section had.
        own = merged(results, [F.desc("turn"), F.col("ord")]).join(texts, "query_id")
        found = keep(claims.verify(own.select("query_id", "query", "ord", "host", "text", "credibility"), SECTION_CLAIMS))
        wave = follow_ups(sections, found)
    question = F.floor(F.col("query_id") / SECTIONS)
    gathered = merged(results.withColumn("section", F.col("query_id")).withColumn("query_id", question), [F.col("turn"), F.col("section"), F.col("ord")]).where(F.col("ord") <= most)
    names = questions.select("query_id", "query")
    whole = claims.verify(gathered.join(names, "query_id").select("query_id", "query", "ord", "host", "text", "credibility"), ALL_CLAIMS, WHOLE_OVERLAP)
    used = results.join(texts, "query_id").select(question.alias("_q"), F.col("url").alias("_u"), "query_id", "query").distinct()
    used = used.groupBy("_q", "_u").agg(F.array_sort(F.collect_list(F.struct("query_id", "query"))).alias("s")).select("_q", "_u", F.transform("s", lambda x: x["query"]).alias("used_for"))
    sources = gathered.join(used, (F.col("query_id") == F.col("_q")) & (F.col("url") == F.col("_u")), "left").select("query_id", F.col("ord").alias("place"), "url", "title", "credibility", "used_for")
    urls = results.groupBy("query_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    listed = found.groupBy("query_id").agg(F.count("*").alias("findings")).join(summary(found, "query_id", 2), "query_id")
    out = sections.join(listed, "query_id", "left").join(urls, "query_id", "left").withColumns({"findings": F.coalesce("findings", F.lit(0)), "urls": F.coalesce("urls", F.array().cast("array<string>"))}).withColumn("is_gap", F.col("findings") == 0)
    stats = out.groupBy(F.col("question_id").alias("query_id")).agg(F.count_if("is_gap").alias("gaps"))
    ran = searches.groupBy(question.alias("_q")).agg(F.count("*").alias("searches"), (F.max("turn") + 1).alias("rounds"))
    stats = stats.join(ran, F.col("query_id") == F.col("_q"), "left").drop("_q").join(sources.groupBy("query_id").agg(F.count("*").alias("sources_examined")), "query_id", "left").join(summary(whole, "query_id", 5), "query_id", "left")
    return {"sections": out.select("question_id", "query_id", "query", "summary", "findings", "urls", "is_gap"), "findings": whole, "sources": sources, "stats": stats}
