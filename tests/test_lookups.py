"""Equality joins in place of nested loops: edges; and the data source."""

import pytest
from pyspark.sql import functions as F

from quern.operators import lookups
from quern.sources import stored


def test_lists_that_exclude_each_other_let_nothing_pass(spark):
    lists = spark.createDataFrame([(1, "allowed", "a.example"), (1, "include", "b.example"), (2, "allowed", "*.Docs.a.example."), (2, "include", "a.example"), (3, "blocked", "x.a.example"), (4, "include", "a.example"), (4, "exclude", "bad.a.example")], "list_id int, kind string, domain string")
    hosts = ["a.example", "docs.a.example", "x.docs.a.example", "b.example", "bad.a.example", "x.a.example", "aa.example", None]
    asked = spark.createDataFrame([(i, h) for i in (1, 2, 3, 4, 5) for h in hosts], "list_id int, host string").withColumn("rule2", F.lit("clash"))
    got = {}
    for r in lookups.pass_lists(asked, lists).collect():
        if r["passes"]:
            got.setdefault(r["list_id"], set()).add(r["host"])
    every = set(hosts) - {None}
    assert got == {2: {"docs.a.example", "x.docs.a.example"}, 3: every - {"x.a.example"}, 4: {"a.example", "docs.a.example", "x.docs.a.example", "x.a.example"}, 5: every}
    assert lookups.pass_lists(asked.limit(0), lists).count() == 0 and lookups.pass_lists(asked, lists.limit(0)).where("passes").count() == 5 * 7


def test_first_prefix_wins(spark):
    texts = spark.createDataFrame([(1, "alpha engine kaynak"), (1, "alpha engine kaynak"), (1, "beta"), (1, None), (2, "alpha engine"), (None, "x")], "q int, t string")
    prefixes = spark.createDataFrame([(1, "alpha engine", 2), (1, "alpha", 1), (1, "alphabet", 0), (2, "alpha engine and more", 0), (None, "", 5), (1, None, 0)], "q int, p string, o int")
    out = sorted(((r["q"], r["t"], r["found"]) for r in lookups.first_prefix(texts, prefixes, ["q"], "t", "p", "o").collect()), key=repr)
    assert out == sorted([(1, "alpha engine kaynak", "alpha")] * 2 + [(1, "beta", None), (1, None, None), (2, "alpha engine", None), (None, "x", "")], key=repr)


def test_redirects(spark):
    crawl = [("https://a.example/0", 301, "/1"), ("https://a.example/1", 302, "https://b.example/2"), ("https://b.example/2", 307, "https://a.example/3"), ("https://a.example/3", 200, None), ("http://c.example/x", 308, "http://c.example/y"), ("http://c.example/y", 301, "http://c.example/x"), ("https://d.example/", 301, None), ("https://e.example/", 301, "https://gone.example/"), ("http://p.example:80/", 301, "http://p.example/ok"), ("http://p.example/ok", 200, None), ("https://a.example/far", 301, "https://a.example/0")]
    own = spark.createDataFrame([(u,) for u, _, _ in crawl] + [("https://none.example/",), (None,)], "url string")
    out = {r["url"]: tuple(r)[1:] for r in lookups.follow(own, spark.createDataFrame(crawl, "url string, status int, location string")).collect()}
    assert out["https://a.example/0"] == ("https://a.example/3", 3, 200, None, False) and out["https://a.example/3"] == ("https://a.example/3", 0, 200, None, True)
    assert out["https://a.example/far"][1:] == (3, 307, "too_many", False) and out["http://c.example/x"][1:] == (3, 301, "too_many", True)
    assert out["https://d.example/"][1:] == (0, 301, "no_target", True) and out["https://e.example/"] == ("https://gone.example/", 1, 301, "missing", False)
    assert out["http://p.example:80/"] == ("http://p.example/ok", 1, 200, None, True) and out["https://none.example/"][2:] == (None, "missing", True) and out[None][2] is None


def test_inline_documents(spark):
    rows = [(1, 0, None, "a"), (1, 1, "", "b"), (2, 0, "x", "a"), (2, 1, "x", "b"), (3, 0, "x", "a"), (3, 1, "y", " \n"), (4, 0, "1", "a"), (4, 1, None, "b"), (5, 0, "a", "c" * 40_001), (None, 0, "a", None)]
    rows += [(6, i, str(i), "t") for i in range(201)] + [(7, i, str(i), "t" * 40_000) for i in range(39)]
    out = {r["request_id"]: tuple(r)[1:] for r in lookups.inline_documents(spark.createDataFrame(rows, "request_id int, place long, id string, text string")).collect()}
    assert out == {1: (2, None, None), 2: (2, 1, "repeated_id"), 3: (2, 1, "no_text"), 4: (2, 1, "repeated_id"), 5: (1, 0, "too_long"), None: (1, 0, "no_text"), 6: (201, 200, "too_many"), 7: (39, 37, "too_much")}


def test_stored_answers_are_pruned(spark, tmp_path):
    path = str(tmp_path / "answers")
    own = spark.range(240).selectExpr("concat('p', id % 3) as provider", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) as fetched_at", "cast(id as int) as place", "concat('u', id) as url", "'' as title", "'' as snippet")
    stored.store(own, path)
    where = "provider = 'p1' and fetched_at >= timestamp'2024-01-04 06:00:00' and fetched_at < timestamp'2024-01-06 00:00:00' and place % 2 = 0"
    got = stored.answers(spark, path).where(where)
    assert "PushedFilters: [EqualTo(provider,p1), GreaterThanOrEqual(fetched_at" in got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    want = sorted(map(tuple, own.where(where).collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 7
    reader = stored.AnswerReader({"path": path})
    assert len(reader.files()) == 30
    assert list(reader.pushFilters([stored.EqualTo(("provider",), "p1"), stored.EqualTo(("url",), "u1")])) == [stored.EqualTo(("url",), "u1")] and len(reader.files()) == 10
    assert stored.answers(spark, path).where("provider = 'nobody'").count() == 0 and stored.answers(spark, path).count() == 240
    with pytest.raises(Exception, match="needs its provider"):
        stored.store(own.withColumn("provider", F.lit(None).cast("string")), path)
