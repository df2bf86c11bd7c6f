"""Facts from series and registers: changes, latest values, top events, and lookups in order of trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(series: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """series with the change against the previous value, also in percent; null without one or from zero."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    own = series.withColumn("previous", before)
    return own.withColumn("change", F.round(F.col(value) - F.col("previous"), 4)).withColumn("change_pct", F.when(F.col("previous") != 0, F.round((F.col(value) - F.col("previous")) / F.col("previous") * 100, 3)))


def latest(series: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, latest) of the last known value."""
    return series.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("latest"))


def strongest(events: DataFrame, least: float, since: Column, most: int = 50) -> DataFrame:
    """Events of a magnitude and a time at least, newest first."""
    return events.where((F.coalesce("value", F.lit(0.0)) >= least) & (F.col("ts") >= since)).orderBy(F.desc("ts"), "event_id").limit(most)


def lookup(asked: DataFrame, register: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ask, code, tier): an alias, a code, the exact name, or a name that holds the words (of four letters or more) decides, in this order.

    asked: (ask); register: (code, short, name, ord), of any size; aliases: (alias, code).
    """
    want = asked.withColumn("k", F.lower(F.trim("ask")))
    names = register.select(F.lower("name").alias("n"), "code", "ord")
    # A name that holds the words holds their first four letters: only such names are looked at.
    grams = names.where("length(n) >= 4").select("*", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(n) - 3), i -> substring(n, i, 4))"))).alias("g"))
    parts = want.where("length(k) >= 4").withColumn("g", F.substring("k", 1, 4))
    tiers = [
        want.join(aliases.select(F.lower("alias").alias("k"), F.col("code")), "k").select("ask", "code", F.lit(1).alias("tier"), F.lit(0).alias("ord")),
        want.join(register.select(F.lower("short").alias("k"), "code", "ord"), "k").select("ask", "code", F.lit(2).alias("tier"), "ord"),
        want.join(names.withColumnRenamed("n", "k"), "k").select("ask", "code", F.lit(3).alias("tier"), "ord"),
        parts.join(grams, "g").where(F.contains(F.col("n"), F.col("k"))).select("ask", "code", F.lit(4).alias("tier"), "ord"),
    ]
    every = tiers[0]
    for x in tiers[1:]:
        every = every.unionByName(x)
    best = every.groupBy("ask").agg(F.min(F.struct("tier", "ord", "code")).alias("b"))
    return asked.select("ask").distinct().join(best, "ask", "left").select("ask", "b.code", "b.tier")
