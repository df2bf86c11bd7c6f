"""Operators on small hand-made tables: the behaviour that SQL checks don't pin down."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import chunk, claims, extract, facts, fuse, graph, ops, planner, rank, research
from quern.sources import feeds, providers

DOCS = [
    ("a", "Index bloat builds up when dead tuples stay. Rebuild the index concurrently to fix bloat in postgres."),
    ("b", "Boil the pasta for ten minutes. Add salt and stir the sauce."),
    ("c", "Vacuum removes dead tuples from tables. It keeps the planner honest."),
    ("d", "Index bloat builds up when dead tuples stay. Rebuild the index concurrently to fix bloat in postgres."),
]


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("stopped", "stop"), ("addresses", "address"), ("status", "status"), ("queries", "query"), ("library", "library"), ("libraries", "library"), ("database", "databas"), ("indekslerinden", "indeks")])
def test_stems(spark, word, stem):
    assert spark.range(1).select(t.stem(F.lit(word)).alias("x")).first()["x"] == stem


def ranked(spark, query, **how):
    docs = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(DOCS)], "id long, text string")
    return docs, spark.createDataFrame([(1, query)], "query_id int, query string")


def test_rank_puts_the_topic_first(spark):
    docs, queries = ranked(spark, "how do I fix index bloat")
    rows = rank.bm25(docs, queries).orderBy("rank").collect()
    assert {rows[0]["id"], rows[1]["id"]} == {0, 3} and rows[0]["relative"] == 1.0 and 1 not in [r["id"] for r in rows]
    assert "bloat" in rank.passages(rank.bm25(docs, queries, 1), docs, queries).first()["best_passage"]


def test_diversity_prefers_another_document_to_a_copy(spark):
    docs, queries = ranked(spark, "index bloat dead tuples")
    assert [r["id"] for r in rank.mmr(docs, queries, 2, 0.0).orderBy("rank").collect()] == [0, 3]
    assert [r["id"] for r in rank.mmr(docs, queries, 2, 0.8).orderBy("rank").collect()] == [0, 2]


def test_rank_of_nothing(spark):
    docs, queries = ranked(spark, "zzzz qqqq")
    assert rank.bm25(docs, queries).count() == 0
    assert rank.bm25(docs.limit(0), queries).count() == 0


@pytest.mark.parametrize("size", [200, 500])
def test_chunks(size):
    text = "# Title\n\nIntro line one. It has words.\n\n## Part\n\n" + "Sentence about padding goes here. " * 60 + "\n\n## Other\n\nShort tail."
    out = chunk.chunks(pd.Series([text, "", None, "One sentence.", "x" * 3000]), size, 60)
    assert out["doc"].value_counts().to_dict()[3] == 1 and not {1, 2} & set(out["doc"]) and sum(out["doc"] == 4) >= 5
    out = out[out["doc"] == 0].to_dict("records")
    assert len(out) >= 3 and [c["index"] for c in out] == list(range(len(out)))
    assert all(c["chars"] <= size + 180 for c in out) and [c["start"] for c in out] == sorted(c["start"] for c in out)
    assert any("Part" in c["headings"] for c in out)


def test_chunk_trails():
    """A heading ends those of its depth and below; a lone line without a stop is one of depth 1; small blocks are packed, overlaps stay within a trail."""
    text = "# A\n\n## B\n\none.\n\n### C\n\ntwo.\n\n## D\nthree.\n\nLone line\n\nfour.\nfive"
    out = chunk.chunks(pd.Series([text]))
    assert out[["headings", "text"]].to_numpy().tolist() == [[["A", "B"], "one."], [["A", "B", "C"], "two."], [["A", "D"], "three."], [["Lone line"], "four.\nfive"]]
    long = "\n\n".join(f"Paragraph {i} " + "word " * 30 + "end." for i in range(4))
    out = chunk.chunks(pd.Series([long]), 200, 20).to_dict("records")
    assert len(out) == 4 and all(b["text"].startswith(a["text"][-20:] + " ") for a, b in zip(out, out[1:], strict=False))
    assert long[out[2]["start"] :].startswith("Paragraph 2")


def test_chunk_rows(spark):
    rows = chunk.chunk(spark.createDataFrame([(1, "One. Two."), (2, None)], "doc_id int, text string")).collect()
    assert [(r["doc_id"], r["text"]) for r in rows] == [(1, "One. Two.")]


def test_fusion_counts_each_list_once(spark):
    rows = [(1, "p", 0, 0, "A", "http://a.example/x?utm_source=1", "s", None), (1, "p", 0, 1, "B", "http://b.example/", "", None), (1, "q", 1, 0, "B", "http://www.b.example", "longer", datetime(2024, 1, 1)), (1, "q", 1, 1, "B", "http://b.example/#x", "", None)]
    own = spark.createDataFrame(rows, "query_id int, provider string, list_ord int, rank int, title string, url string, snippet string, published_at timestamp")
    out = fuse.fuse(own).orderBy("rank").collect()
    assert [r["title"] for r in out] == ["B", "A"] and abs(out[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12 and out[0]["snippet"] == "longer" and out[0]["published_at"] is not None


def test_filter_or_all(spark):
    own = spark.createDataFrame([(1, 5), (1, 6), (2, 1)], "k int, v int")
    assert {(r["k"], r["v"]) for r in fuse.filter_or_all(own, F.col("v") > 5, ["k"]).collect()} == {(1, 6), (2, 1)}


@pytest.mark.parametrize(("query", "urls", "rest"), [("https://example.com/a, compare with example.org", ["https://example.com/a", "https://example.org/"], "compare with"), ("see https://en.wikipedia.org/wiki/Ruby_(language).", ["https://en.wikipedia.org/wiki/Ruby_(language)"], "see ."), ("read main.py now", [], "read main.py now"), ("https://u:p@example.com/x", [], "")])
def test_addresses(spark, query, urls, rest):
    got = spark.range(1).select(planner.addresses(F.lit(query)).alias("x")).first()["x"]
    assert got["urls"] == urls
    assert got["remainder"].strip(" ,.") == rest.strip(" ,.")


def test_breaker(spark):
    rows = [("s", i * 1000, False) for i in range(4)] + [("s", 10_000, True), ("s", 33_500, True), ("s", 34_000, True)]
    out = ops.breaker(spark.createDataFrame(rows, "source string, ts long, ok boolean")).orderBy("ts").collect()
    assert [r["state"] for r in out] == ["closed"] * 4 + ["open", "half-open", "closed"] and not out[4]["asked"]


def test_fixed_window(spark):
    out = ops.fixed_window(spark.createDataFrame([("k", x) for x in (0, 10, 20, 1000, 1010)], "key string, ts long"), "key", 2, 1000).orderBy("ts").collect()
    assert [r["allowed"] for r in out] == [True, True, False, True, True] and out[2]["retry_ms"] == 980


def test_smoothing(spark):
    own = spark.createDataFrame([("s", 1, 100.0), ("s", 2, 200.0), ("s", 3, 50.0)], "k string, ts int, v double")
    assert ops.smoothed(own, "k", ["ts"], "v").first()["ema"] == 106


def test_contradiction(spark):
    row = spark.range(1).select(claims.contradicts(F.lit("The tower is 300 metres tall today"), F.lit("The tower is 324 metres tall today")).alias("a"), claims.contradicts(F.lit("The tower is 300 metres tall"), F.lit("The tower is 300 metres tall")).alias("b")).first()
    assert row["a"] and not row["b"]


def test_groups_hold_all_sentences(spark):
    """Brute force over more sentences than the 200 that once were the most."""
    import random

    draw = random.Random(3)
    words = [a + b for a in ("kan", "lor", "mis", "nut", "per", "rit") for b in ("tel", "mor", "vas", "zin", "dup")]
    rows = [(q, i, 0, " ".join(draw.choice(words) for _ in range(draw.randint(1, 6))) if i % 50 else "a of", f"h{i % 7}", 0.5) for q in (1, None) for i in range(450)]
    found = spark.createDataFrame(rows, "query_id int, ord long, pos int, sentence string, host string, credibility double").repartition(3)
    got = {(r["query_id"], r["ord"]): r["group"] for r in claims.group_sentences(found).collect()}
    want = {}
    for q in (1, None):
        heads = []
        for n, (_, i, _, x, _, _) in enumerate((r for r in rows if r[0] == q), 1):
            own = {w for w in x.split() if len(w) >= 3}
            own_head = next((k for k, h in heads if own and h and len(own & h) / min(len(own), len(h)) >= claims.SAME), None)
            if own_head is None:
                heads.append((n, own))
            want[q, i] = own_head or n
    assert got == want and len({g for g in got.values() if g > 200}) > 0


def test_feed_items(spark):
    body = "<rss><item><title>A &amp; B</title><link>https://x.example/a?utm_source=f&amp;id=1</link><pubDate>Sun, 06 Sep 2026 00:00:00 GMT</pubDate><description><![CDATA[<p>Text</p>]]></description></item><item><title>C</title><link>https://x.example/c</link></item></rss>"
    own = spark.createDataFrame([("f", "en", 200, body), ("g", "en", 503, body)], "feed string, lang string, status int, body string")
    out = feeds.items(own).orderBy("pos").collect()
    assert [r["title"] for r in out] == ["A & B", "C"] and out[0]["url"] == "https://x.example/a?id=1" and out[0]["published_at"] == datetime(2026, 9, 6) and out[0]["snippet"] == "Text"


def test_sitemap(spark):
    body = "<urlset><url><loc>https://x.example/a</loc><lastmod>2024-01-02</lastmod></url><url><loc>https://x.example/b</loc></url></urlset>"
    out = feeds.sitemap(spark.createDataFrame([("u", body), ("v", "https://x.example/c\n")], "url string, body string")).orderBy("loc").collect()
    assert [r["loc"][-1] for r in out] == ["a", "b", "c"] and out[0]["last_modified"] == datetime(2024, 1, 2)


def test_answers_of_sources(spark):
    rows = [(1, "p", 0, "plain", 200, '{"results":[{"title":"T","url":"https://a.example","description":"<b>x</b>"},{"title":"","url":"u"}]}'), (1, "w", 1, "works", 200, '{"results":[{"title":"W","doi":"https://doi.org/1","abstract_inverted_index":{"b":[1],"a":[0,2]}}]}'), (1, "x", 2, "plain", 503, "")]
    out = providers.ranked(spark.createDataFrame(rows, "query_id int, provider string, list_ord int, kind string, status int, body string")).orderBy("list_ord").collect()
    assert [(r["title"], r["snippet"]) for r in out] == [("T", "x"), ("W", "a b a")]


def test_links_and_blocks(spark):
    html = "<html><head><title>T</title></head><body><nav><a href='/n'>Nav</a></nav><article><p>" + "word " * 20 + "</p><p>short</p></article><a href='b.html'>B</a></body></html>"
    row = spark.range(1).select(extract.readable(F.lit(html)).alias("r"), extract.links(F.lit(html), F.lit("https://x.example/d/a.html")).alias("l")).first()
    assert row["r"] == ("word " * 20).strip() and [x["url"] for x in row["l"]] == ["https://x.example/n", "https://x.example/d/b.html"]


def test_walk(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {(r["node"], r["depth"]) for r in graph.walk(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_changes_without_a_previous_value(spark):
    out = facts.changes(spark.createDataFrame([("k", 1, 0.0), ("k", 2, 5.0)], "k string, t int, v double"), "k", ["t"], "v").orderBy("t").collect()
    assert out[0]["change"] is None and out[1]["change"] == 5.0 and out[1]["change_pct"] is None


def test_research_rounds(spark):
    """Angles that one source supports are searched again, a later round's results stand first, sources are gathered up to a bound, angles without findings are gaps."""
    fact = "The Alpha engine reached 340 kilometres in 1998 according to the official measured records"
    answers = {"alpha engine": [("https://a.example/1", "a", fact + "."), ("https://b.example/1", "b", fact + ".")], "beta engine": [("https://c.example/1", "c", "The Beta engine weighs 20 tonnes and was built in 1977 by the works")]}
    asked = []

    def lookup(planned):
        rows = [(r["query_id"], k, u, u, h, 0.5, x) for r in planned.collect() for k, (u, h, x) in enumerate(answers.get(r["query"], [("https://d.example/2", "d", "The Beta engine weighs 20 tonnes and was built in 1977 by the works")] if r["query"].startswith("beta engine ") else []))]
        asked.append(sorted(r["query"] for r in planned.collect()))
        return spark.createDataFrame(rows, "query_id long, ord int, url string, title string, host string, credibility double, text string")

    out = research.research(spark.createDataFrame([(7, "alpha engine, beta engine")], "query_id int, query string"), lookup, "standard")
    sections = {r["query"]: r for r in out["sections"].collect()}
    assert len(asked) == 2 and {"alpha engine", "beta engine"} <= set(asked[0]) and len(asked[1]) <= 2 and any(x.startswith("beta engine ") for x in asked[1])
    assert sections["alpha engine"]["findings"] >= 1 and not sections["alpha engine"]["is_gap"] and fact in sections["alpha engine"]["summary"]
    assert sections["beta engine"]["urls"] == ["https://c.example/1", "https://d.example/2"]
    sources = {r["url"]: r["used_for"] for r in out["sources"].collect()}
    assert sources["https://a.example/1"] == ["alpha engine"] and len(sources) <= 20
    stats = out["stats"].collect()[0]
    assert stats["rounds"] == 2 and stats["searches"] == len(asked[0]) + len(asked[1]) and stats["sources_examined"] == len(sources) and stats["gaps"] == sum(r["is_gap"] for r in sections.values())


def test_rerank_appends_what_does_not_match(spark):
    docs, queries = ranked(spark, "zzzz qqqq")
    assert [r["score"] for r in rank.rerank(docs, queries, 2).collect()] == [0.0, 0.0]
    docs, queries = ranked(spark, "alpha")
    for diversity in (0.0, 0.5):
        out = rank.rerank(docs, queries, 50, diversity).orderBy("rank").collect()
        assert [r["rank"] for r in out] == list(range(1, len(out) + 1)) and len({r["id"] for r in out}) == len(out) == docs.count()


def test_lookup_of_a_large_register(spark):
    register = spark.range(20_000).select(F.col("id").cast("string").alias("code"), F.lit("").alias("short"), F.concat(F.lit("name "), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" end")).alias("name"), F.col("id").alias("ord"))
    asked = spark.createDataFrame([("019999",), ("nothing here",), ("000",)], "ask string")
    out = {r["ask"]: r["code"] for r in facts.lookup(asked, register, spark.createDataFrame([], "alias string, code string")).collect()}
    assert out == {"019999": "19999", "nothing here": None, "000": None}


def test_research_stops_at_its_sources(spark):
    """Twelve results a search: the second search brings the bound of 20, so no third one, no second round and no gap."""
    fact = "The {} engine reached 340 kilometres in 1998 according to the official measured records."
    ask = "alpha engine, beta engine, gamma engine, delta engine, omega engine"

    def lookup(planned):
        rows = [(r["query_id"], k, f"https://h{k}.example/{abs(hash(r['query'])) % 10**6}", "t", f"h{k}", 0.5, fact.format(r["query"].split(" ")[0].title())) for r in planned.collect() for k in range(12)]
        return spark.createDataFrame(rows, "query_id long, ord int, url string, title string, host string, credibility double, text string")

    out = research.research(spark.createDataFrame([(30_000_000, ask)], "query_id int, query string"), lookup, "standard")
    stats = out["stats"].collect()[0]
    assert (stats["searches"], stats["rounds"], stats["gaps"], stats["sources_examined"]) == (2, 1, 0, 20) and out["sections"].count() == 2


def test_invalid_parameters_are_errors(spark):
    from quern.operators import params

    df = spark.createDataFrame([(1, None, None), (2, "day", "tr-TR"), (3, "never", "tr-TR"), (4, "-3", "EN"), (5, "12", "EN")], "id int, fresh string, locale string")
    out = {r["id"]: (r["fresh"], r["locale"], r["error"], r["error_field"]) for r in params.parsed(df, {"fresh": params.freshness(F.col("fresh")), "locale": params.locale(F.col("locale"))}).collect()}
    assert out == {1: (None, None, None, None), 2: (24.0, "tr-TR", None, None), 3: (None, "tr-TR", "invalid_request", "fresh"), 4: (None, None, "invalid_request", "fresh"), 5: (12.0, None, "invalid_request", "locale")}


def test_sources_keep_all_but_the_content(spark):
    from quern.operators import sinks

    df = spark.range(1).selectExpr("id as query_id", "'u' as url", "'s' as snippet", "'c' as content", "'p' as published_at", "0.5 as relevance")
    assert sinks.shape(df, "sources").columns == ["query_id", "url", "snippet", "published_at", "relevance"] and sinks.shape(df, "results").columns == df.columns


def test_overview_counts_contested_claims(spark):
    results = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d")], "query_id int, host string")
    told = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (None, 1, 1)], "query_id int, claim int, conflicts long")
    assert {r["query_id"]: tuple(r)[1:] for r in claims.overview(results, told).collect()} == {1: (2, 2, 1), 2: (1, 0, 0), None: (1, 1, 1)}
    row = spark.range(1).select(claims.basis(F.lit(2), F.lit(0.8), F.lit(0)).alias("a"), claims.basis(F.lit(1), F.lit(0.456), F.lit(3)).alias("b")).first()
    assert row["a"] == ["2 bağımsız kaynak", "ortalama güvenilirlik 0.80"] and row["b"] == ["1 bağımsız kaynak", "ortalama güvenilirlik 0.46", "3 çelişen kaynak"]
