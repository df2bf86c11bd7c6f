"""What keeps time and shuffles in step with the input: each step's plan or bound, beside its results."""

import io
from contextlib import redirect_stdout

import pandas as pd
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import chunk, extract, fuse, lookups


def plan_of(df, mode="extended"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def physical(df):
    return plan_of(df).split("== Physical Plan ==")[1]


def test_relevance_reads_each_document_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Alpha", "alpha beta, gamma delta"), (2, None, None)], "doc_id int, source string, text string")
    asked = spark.createDataFrame([(1, "alpha gamma"), (2, "beta delta")], "query_id int, query string")
    own = fuse.with_relevance(docs, asked, "source", "text", "text")
    assert "CartesianProduct" not in physical(own) and "BroadcastNestedLoopJoin" in physical(own)
    want = sorted(map(tuple, own.select("_q", "doc_id", "relevance").collect()))
    monkeypatch.setattr(fuse, "SENT_QUERIES", 1)
    assert sorted(map(tuple, fuse.with_relevance(docs, asked, "source", "text", "text").select("_q", "doc_id", "relevance").collect())) == want


def test_normalize_is_the_same_in_one_pass(spark):
    x = "Çok  İYİ,\t_a-b\x0b9 é\x1c §§ z\n"
    plain = F.translate(F.lower(F.col("x")), "çğıöşüâîû", "cgiosuaiu")
    old = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))
    row = spark.createDataFrame([(x,)], "x string").select(t.normalize(F.col("x")).alias("a"), old.alias("b")).first()
    assert row["a"] == row["b"] != ""


def test_prefixes_meet_heads_once(spark):
    """No whole text is shuffled, and equal prefixes are joined as one: the rows of the join don't grow with their product."""
    texts = spark.createDataFrame([(i, "en", "abcdef" + "x" * 500 + str(i)) for i in range(300)] + [(900, "en", None), (901, None, "abcd")], "doc_id long, lang string, text string")
    prefixes = spark.createDataFrame([("en", "abc", i) for i in range(200)] + [("en", "abcd", -1), (None, "a", 7)], "lang string, p string, o long")
    out = lookups.first_prefix(texts, prefixes, ["lang"], "text", "p", "o").select("doc_id", "found")
    got = dict(map(tuple, out.collect()))
    assert got == {**dict.fromkeys(range(300), "abcd"), 900: None, 901: "a"}
    assert not [x for x in physical(out).splitlines() if "Exchange hashpartitioning" in x and " text#" in x]
    none = lookups.first_prefix(texts, prefixes.limit(0), ["lang"], "text", "p", "o")
    assert none.where("found is null").count() == 302


def test_pages_are_stripped_once(spark):
    page = "<html><script>x</script><body><nav>n</nav><p>" + "a" * 50 + "</p><p>" + "b" * 50 + "</p><p>" + "a" * 90 + "</p><p>" + "a" * 95 + "</p></body>"
    df = spark.createDataFrame([(1, page), (2, "<main>short</main>"), (3, None)], "page_id int, html string")
    for x in (extract.blocks(F.col("html")), extract.readable(F.col("html"))):
        assert physical(df.select(x.alias("x"))).count("noscript") == 1
    got = {r["page_id"]: r["b"] for r in df.select("page_id", extract.blocks(F.col("html")).alias("b")).collect()}
    assert got == {1: ["a" * 50, "b" * 50, "a" * 90], 2: [], 3: None}
    text = {r["page_id"]: r["b"] for r in df.select("page_id", extract.readable(F.col("html")).alias("b")).collect()}
    assert text == {1: "\n".join(got[1]), 2: "short", 3: None}


def test_titles_decode_every_named_entity(spark):
    """As the reference does, whose parser decodes a title's text; the SQL of html_title knows three entities only."""
    row = spark.createDataFrame([("<title>a = &quot;b&quot; &amp; c</title>", "https://x.example/")], "html string, url string").select(extract.title(F.col("html"), F.col("url")).alias("x")).first()
    assert row["x"] == 'a = "b" & c'


def test_terms_by_lookup_are_those_of_the_stemmer(spark):
    words = ["İNDEKSLERİNDEN", "indexes", "running", "stopped", "addresses", "queries", "Straße", "ΣΟΦΟΣ", "école", "classes", "bus", "the", "a", "ız", "ﬁnding", "٣٤٥", "naïve--", "a.b.c_", "x" * 40 + "ies"]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "the of a")], "id int, x string")
    got = {r["id"]: r["w"] for r in rows.select("id", t.rank_tokens(F.col("x")).alias("w")).collect()}
    cut = F.transform(F.regexp_extract_all("x", F.lit(r"[\p{L}\p{N}][\p{L}\p{N}_.-]*"), F.lit(0)), lambda x: F.regexp_replace(x, r"^[.\-_]+|[.\-_]+$", ""))
    stop = F.array(*map(F.lit, t.RANK_STOP))
    native = F.filter(t.stems(F.filter(cut, lambda x: F.length(x) >= 2)), lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x))
    assert got == {r["id"]: r["w"] for r in rows.select("id", native.alias("w")).collect()}
    assert got[2] is None and got[3] == got[4] == []
    assert "regexp_replace" not in physical(rows.select(t.rank_tokens(F.col("x"))))


def test_sentences_are_told_once_with_their_facts(spark):
    a, b = "It rose by 12 percent in the year, as was written here.", "According to nobody at all the thing is the one we know."
    plain = "Words without any figure stand here, and there are many of them."
    text = f"{a} {b}\n{plain}\nPlease subscribe to the newsletter of this very long page, 12 times. How many of these are there in all of the world? Short. {'x' * 401}"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, x string")
    got = {r["id"]: r["s"] for r in rows.select("id", t.told_sentences(F.col("x")).alias("s")).collect()}
    assert [tuple(x) for x in got[1]] == [(a, True), (b, True), (plain, False)] and got[2] is None and got[3] == []
    native = spark.createDataFrame([(x["s"], x["factual"]) for x in got[1]], "s string, f boolean")
    assert native.where(t.is_factual(F.col("s")) != F.col("f")).count() == 0


def test_chunks_are_made_slab_by_slab(spark):
    batch = pd.DataFrame({"id": range(6), "body": ["a" * 10, None, "b" * 35, "", "c" * 10, "d" * 10]})
    parts = list(chunk.slabs(batch, 20))
    assert [list(p["id"]) for p in parts] == [[0, 1], [2, 3], [4, 5]] or [list(p["id"]) for p in parts] == [[0, 1], [2], [3, 4, 5]]
    assert all(len(p) and (p["body"].fillna("").str.len().sum() <= 20 or p["body"].fillna("").str.len().gt(0).sum() == 1) for p in parts)
    assert list(chunk.slabs(batch.iloc[:0], 20)) == []
    docs = spark.createDataFrame([(i, f"line {i} of a text that is long enough.\n\n" * 40) for i in range(20)], "doc_id long, text string").coalesce(1)
    whole = chunk.chunks(docs.toPandas()["text"])
    got = chunk.chunk(docs)
    assert got.count() == len(whole) and sorted(r["text"] for r in got.collect()) == sorted(whole["text"])


def test_picks_hold_few_rows_a_task(spark):
    """However many documents match and however far picks must look, one task holds the best rows of a query and no more; results don't depend on how many."""
    import random

    from quern.operators import rank

    rng = random.Random(5)
    bag = [f"w{i}" for i in range(30)]
    texts = [" ".join(["alpha"] * rng.randint(1, 4) + ["beta"] * rng.randint(0, 2) + rng.sample(bag, rng.randint(2, 6))) for _ in range(60)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 3)], "id long, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta alpha"), (3, "zzzz")], "query_id int, query string")
    scored = [(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in rank.bm25(docs, asked, None).collect()]
    terms = {r["id"]: set(r["w"]) for r in docs.select("id", t.rank_tokens(F.col("text")).alias("w")).collect()}
    want = []
    for q in (1, 2):
        left = [x for x in sorted(scored) if x[0] == q]
        top, seen = max(x[3] for x in left), []
        for place in range(1, 9):
            best = max(left, key=lambda x: (0.5 * x[3] / top - 0.5 * max([len(terms[x[2]] & s) / min(len(terms[x[2]]), len(s)) for s in seen], default=0), -x[1]))
            left.remove(best)
            seen.append(terms[best[2]])
            want.append((q, best[2], place, best[3]))
    for front in (1, 5, 1000):
        assert sorted(map(tuple, rank.mmr(docs, asked, 8, 0.5, first=front).collect())) == sorted(want)
    rows = [(1, i, i + 1, 1.0 / (i + 1), [i % 3], 1.0, 0.0, 0, 100) for i in range(4)]
    assert 1 <= len(list(rank._picked(rows, 8, 0.5))) < 8
