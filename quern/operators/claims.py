"""Claims: checkable sentences, groups of alike ones, independent support, conflicts and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators.durable import kept

SAME, CONFLICT, OPPOSED = 0.62, 0.45, 0.6
# ---- fixed values: what a confidence rests on ----
BASIS = ["bağımsız kaynak", "ortalama güvenilirlik", "çelişen kaynak"]
# --------------------------------------------------


def candidates(results: DataFrame, min_overlap: float | None = 0.2) -> DataFrame:
    """(query_id, ord, pos, sentence, host, credibility): factual sentences near enough to the query, in the order of results."""
    own = results.select("query_id", "query", "ord", "host", "credibility", F.posexplode(t.told_sentences(F.col("text"))).alias("pos", "x")).where("x.factual")
    own = own.select("query_id", "query", "ord", "host", "credibility", "pos", F.col("x.s").alias("sentence"))
    if min_overlap is not None:
        own = own.where(t.overlap(t.plain_tokens(F.col("sentence")), t.plain_tokens(F.col("query"))) >= min_overlap)
    return own.drop("query")


def alike(sets: DataFrame, least: float = SAME) -> DataFrame:
    """(query_id, a, b), a < b: all pairs of token sets (query_id, n, tokens) that share at least `least` of the smaller one.

    A smaller set has few tokens to spare: one of its rarest ones is in every set it is alike to. So those rare tokens of each set meet all
    tokens of sets that are no smaller, and a pair is tested once, at the first of them that it shares. Empty sets are alike to nothing.
    """
    size = F.size("tokens")
    own = sets.where(size > 0).select(F.col("query_id").alias("q"), "n", "tokens", size.alias("size"))
    every = own.select("q", "n", "size", F.explode("tokens").alias("token"))
    often = every.groupBy("q", "token").agg(F.count("*").alias("df"))
    ranked = every.join(often.withColumnsRenamed({"q": "_q", "token": "_t"}), F.expr("q <=> _q and token = _t")).groupBy("q", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
    ranked = ranked.withColumn("size", F.size("tokens"))
    spare = F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1
    small = ranked.select("q", F.col("n").alias("a"), F.col("tokens").alias("ta"), F.col("size").alias("sa"), F.slice("tokens", F.lit(1), spare).alias("rare"))
    small = small.withColumn("token", F.explode("rare"))
    large = ranked.select(F.col("q").alias("q2"), F.col("n").alias("b"), F.col("tokens").alias("tb"), F.col("size").alias("sb"), F.explode("tokens").alias("t2"))
    met = small.join(large, F.expr("q <=> q2 and token = t2 and (sa < sb or (sa = sb and a < b))"))
    near = met.where((F.get(F.array_intersect("rare", "tb"), F.lit(0)) == F.col("token")) & (F.size(F.array_intersect("ta", "tb")) / F.col("sa") >= least))
    return near.select(F.col("q").alias("query_id"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def first_independent(pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(query_id, b, a): each b that has an earlier neighbour among the leaders, with the first of these. pairs: (query_id, a, b), a < b.

    Going through all numbers in order, a number leads if no earlier leader is its neighbour. In a round all those lead that wait for no earlier
    number; their neighbours are settled; the pairs among the rest remain. Rounds are as many as the longest chain of waiting, not as the numbers.
    """
    pairs = left = kept(pairs)
    settled = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        waiting = left.select("query_id", F.col("b").alias("x")).distinct()
        leads = left.select("query_id", F.col("a").alias("x")).distinct().join(waiting.withColumnRenamed("query_id", "_q").withColumnRenamed("x", "_x"), F.expr("query_id <=> _q and x = _x"), "left_anti")
        leads = kept(leads)
        named = leads.withColumnsRenamed({"query_id": "_q", "x": "_x"})
        covered = left.join(named, F.expr("query_id <=> _q and a = _x"), "left_semi").select("query_id", F.col("b").alias("x")).distinct()
        # A leader's pairs go with their later ends.
        gone = kept(covered).withColumnsRenamed({"query_id": "_q", "x": "_x"})
        settled = gone if settled is None else settled.unionByName(gone)
        left = left.join(gone, F.expr("query_id <=> _q and b = _x"), "left_anti").join(gone, F.expr("query_id <=> _q and a = _x"), "left_anti")
        left = kept(left)
    else:
        raise RuntimeError(f"leaders were not settled in {rounds} rounds")
    if settled is None:
        return pairs
    # Whoever was settled is no leader; all others are.
    return pairs.join(settled, F.expr("query_id <=> _q and a = _x"), "left_anti").groupBy("query_id", "b").agg(F.min("a").alias("a"))


def group_sentences(found: DataFrame) -> DataFrame:
    """(query_id, group, ord, pos, sentence, host, credibility): each sentence joins the first group whose first sentence is alike; group is that one's number.

    Sentences are numbered by ord, pos and text. Those with the same tokens stand together, as they meet the same leaders. Sentences without a token are groups of their own. A query may be of any size.
    """
    place = F.row_number().over(W.partitionBy("query_id").orderBy("ord", "pos", "sentence"))
    columns = ["query_id", "ord", "pos", "sentence", "host", "credibility"]
    own = kept(found.select(*columns, place.alias("n"), F.array_sort(F.array_distinct(t.plain_tokens(F.col("sentence")))).alias("tokens")))
    sets = own.where(F.size("tokens") > 0).groupBy("query_id", "tokens").agg(F.min("n").alias("n"))
    led = first_independent(alike(sets)).withColumnsRenamed({"query_id": "_q", "b": "_b", "a": "_a"})
    of_set = sets.join(led, F.expr("query_id <=> _q and n = _b"), "left").select(F.col("query_id").alias("_q"), F.col("tokens").alias("_t"), F.coalesce("_a", "n").alias("_g"))
    out = own.join(of_set, F.expr("query_id <=> _q and tokens = _t"), "left")
    return out.select("query_id", F.coalesce("_g", "n").alias("group"), *columns[1:])


def confidence(sources: Column, credibility: Column, conflicts: Column) -> Column:
    """Saturating support, weighted by credibility, lowered by conflicts."""
    own = (1 - F.pow(F.lit(0.55), sources)) * (0.55 + 0.45 * credibility)
    own = F.when(conflicts > 0, own * F.greatest(F.lit(0.35), 1 - 0.25 * conflicts)).otherwise(own)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), own)), 3)


def basis(sources: Column, credibility: Column, conflicts: Column) -> Column:
    """What a confidence rests on, as texts: independent sources, their mean credibility to two digits, and conflicting sources if there are any."""
    told = F.array(F.concat(sources.cast("string"), F.lit(f" {BASIS[0]}")), F.concat(F.lit(f"{BASIS[1]} "), F.format_string("%.2f", credibility.cast("double"))))
    return F.when(conflicts > 0, F.array_append(told, F.concat(conflicts.cast("string"), F.lit(f" {BASIS[2]}")))).otherwise(told)


def contradicts(a: Column, b: Column) -> Column:
    """Alike sentences without a common figure, or of which one denies."""
    return _against(_sides(a), _sides(b))


def _sides(x: Column) -> dict[str, Column]:
    """What a contradiction looks at."""
    return {"tokens": F.array_distinct(t.plain_tokens(x)), "figures": t.numbers(x), "denies": t.negates(x)}


def _against(a: dict[str, Column], b: dict[str, Column]) -> Column:
    near = t.overlap(a["tokens"], b["tokens"])
    x, y = a["figures"], b["figures"]
    figures = (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    return (near >= CONFLICT) & (figures | ((a["denies"] != b["denies"]) & (near > OPPOSED)))


def verify(results: DataFrame, max_claims: int = 12, min_overlap: float = 0.2) -> DataFrame:
    """(query_id, claim, text, sources, members, credibility, conflicts, confidence), best supported first.

    results: (query_id, query, ord, host, text, credibility).
    """
    found = candidates(results, min_overlap)
    groups = group_sentences(found)
    head = groups.where("true").groupBy("query_id", "group").agg(F.min_by("sentence", F.struct("ord", "pos")).alias("text"), F.min(F.struct("ord", "pos")).alias("first"), F.count("*").alias("members"), F.countDistinct("host").alias("sources"))
    best = F.row_number().over(W.partitionBy("query_id", "group", "host").orderBy(F.desc("credibility"), "ord", "pos"))
    cited = groups.withColumn("n", best).where("n = 1").groupBy("query_id", "group").agg(F.avg("credibility").alias("credibility"), F.collect_set("host").alias("hosts"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sources"), F.desc("members"), "first"))
    claims = head.join(cited, ["query_id", "group"]).withColumn("claim", place).where(F.col("claim") <= max_claims)
    other = groups.select(F.col("query_id").alias("q2"), F.col("host").alias("other_host"), *[v.alias(f"o_{k}") for k, v in _sides(F.col("sentence")).items()])
    told = claims.select("query_id", "claim", "hosts", *[v.alias(f"c_{k}") for k, v in _sides(F.col("text")).items()])
    fields = lambda prefix: {k: F.col(f"{prefix}_{k}") for k in ("tokens", "figures", "denies")}
    against = told.join(other, (F.col("query_id") == F.col("q2")) & ~F.array_contains("hosts", F.col("other_host")) & _against(fields("c"), fields("o"))).groupBy("query_id", "claim").agg(F.countDistinct("other_host").alias("conflicts"))
    out = claims.join(against, ["query_id", "claim"], "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    return out.select("query_id", "claim", "text", "sources", "members", "credibility", "conflicts", confidence(F.col("sources"), F.col("credibility"), F.col("conflicts")).alias("confidence"))


def overview(results: DataFrame, claims: DataFrame) -> DataFrame:
    """(query_id, sources_used, claims, contested): distinct hosts of a query's results, its claims, and how many of these some source contradicts. results: (query_id, host, ...)."""
    used = results.groupBy("query_id").agg(F.countDistinct("host").alias("sources_used"))
    told = claims.groupBy("query_id").agg(F.count("*").alias("claims"), F.count_if(F.col("conflicts") > 0).alias("contested")).withColumnRenamed("query_id", "_q")
    return used.join(told, F.expr("query_id <=> _q"), "left").select("query_id", "sources_used", *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("claims", "contested")])


def answer(claims: DataFrame, sentences: int = 4, floor: float = 0.35) -> DataFrame:
    """The most confident claims above the floor."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("confidence"), "claim"))
    return claims.where(F.col("confidence") >= floor).withColumn("place", place).where(F.col("place") <= sentences)
