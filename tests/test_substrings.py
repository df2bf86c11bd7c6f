"""Many substring queries at once against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import fuse, news, substrings


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))), rng.choice([None, "", "ab cab ı ş", "x" * 3000 + "abcabc"])) for i in range(120)]
    return spark.createDataFrame(rows, "id long, a string, b string").repartition(3), rows


@pytest.mark.parametrize("bound", [1 << 20, 60])
def test_hits(spark, docs, bound):
    df, rows = docs
    terms = ["ab", "abc", "cab", "bca b", "zz", "ı ş", "", None, "ab", "c", "aaaaaa"]
    got = sorted(map(tuple, substrings.hits(df, ["id"], ["a", "b"], spark.createDataFrame([(x,) for x in terms], "term string"), bound).collect()))
    want = sorted((i, f, x) for i, a, b in rows for f, text in (("a", a), ("b", b)) for x in {x for x in terms if x} if text and x in text)
    assert got == want and len(got) > 200
    assert substrings.hits(df, ["id"], ["a"], spark.createDataFrame([], "term string")).count() == 0
    assert substrings.hits(df.limit(0), ["id"], ["a"], spark.createDataFrame([("a",)], "term string")).count() == 0


def test_scores_equal_those_of_all_pairs(spark, docs):
    df, rows = docs
    own = df.select("id", "a", F.coalesce("b", F.lit("")).alias("b"))
    queries = spark.createDataFrame([(1, "abc cab"), (2, "abc abc bca"), (3, "a b"), (4, "qqq www"), (5, "cabc ab")], "query_id int, query string")
    pairs = own.crossJoin(queries).withColumn("score", F.round(fuse.pre_score(F.col("query"), F.col("a"), F.col("b")), 9))
    every = {}
    for r in pairs.collect():
        every.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    for limit in (5, 100):
        got = {}
        for r in fuse.pre_scored(own, queries, "id", "a", "b", limit).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-round(r["score"], 9) or 0.0, r["id"]))
        assert got == {q: [(x or 0.0, i) for x, i in sorted(v)[:limit]] for q, v in every.items()}
    gate = {(r["query_id"], r["id"]) for r in fuse.gated(own, queries, "id", "a").collect()}
    assert {i for q, i in gate if q == 3} == {r[0] for r in rows} and {i for q, i in gate if q == 5} == {i for i, a, _ in rows if "cabc" in a}


def test_news_needs_most_terms(spark):
    items = spark.createDataFrame([(1, "alfa beta", "gama", None), (2, "alfa", "delta", None), (3, "nothing", "", None)], "id long, title string, snippet string, published_at timestamp")
    queries = spark.createDataFrame([(1, "alfa beta gama"), (2, "a"), (3, "alfa alfa alfa beta")], "query_id int, query string")
    got = {(r["query_id"], r["id"]) for r in news.match(items, queries, 10, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)}
