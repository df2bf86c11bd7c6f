"""Every registered query over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.functions import urls as u
from quern.operators import chunk, claims, extract, facts, fuse, graph, news, ops, planner, rank, search, sinks
from quern.plans import sql as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"
ASKED = [(1, "the thon of and this thing"), (2, "der einst ungen kommen"), (3, "que los ciones de la"), (4, "tionhe stand reading queries"), (5, "zzzz qqqq")]


def query(oracle: str | None = None):
    """Register a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id int, query string")


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else q.lit(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


# ---- text ----


@query(f"SELECT doc_id, md5({q.normalize('text')}) AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.normalize(F.col("text")).cast("binary")).alias("normal"))


@query(f"SELECT doc_id, len({q.plain_tokens('text')}) AS n, md5(array_to_string({q.plain_tokens('text')}, ' ')) AS tokens FROM documents")
def tokenize_counts(spark, sf_dir):
    own = t.plain_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(own).cast("long").alias("n"), F.md5(F.array_join(own, " ").cast("binary")).alias("tokens"))


@query(f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS tokens FROM (SELECT doc_id, {q.rank_tokens('text')} AS w FROM documents)")
def rank_token_counts(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", t.rank_tokens(F.col("text")).alias("w"))
    return own.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("tokens"))


WORDS = ["indekslerinden", "index", "indexes", "run", "running", "stop", "stopped", "address", "addresses", "status", "query", "queries", "queried", "library", "libraries", "database", "concurrently", "tuples"]


_WORDS = "SELECT DISTINCT lower(word) AS word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE regexp_matches(word, '^\\p{L}+$')"


@query(f"SELECT word, {q.stem('f')} AS stem FROM (SELECT word, {q.fold('word')} AS f FROM ({_WORDS}))")
def stem_table(spark, sf_dir):
    """Every word of the documents with its stem; the words of the reference's own cases are unit tests."""
    own = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).where(F.col("word").rlike(r"^\p{L}+$")).select(F.lower("word").alias("word")).distinct()
    return own.select("word", t.stem(F.col("word")).alias("stem"))


@query(f"SELECT doc_id, len(s) AS n, len(list_filter(s, lambda x: {q.any_of('x', t.FACTUAL)})) AS factual FROM (SELECT doc_id, {q.sentences('text')} AS s FROM documents)")
def factual_sentences(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", t.told_sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.filter("s", lambda x: x["factual"])).cast("long").alias("factual"))


QUESTIONS = ["How do I fix index bloat?", "Question: what is it", "Index bloat grows.", "Any idea why it fails", "neden böyle oldu?", "It is done. Is it?", "The answer is 42"]


@query(f"SELECT doc_id, s, {q.any_of('s', t.QUESTION)} AS question FROM (SELECT doc_id, {q.q(QUESTIONS)}[doc_id % {len(QUESTIONS)} + 1] || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' ' || source END || CASE WHEN doc_id % 11 = 3 THEN '?' ELSE '' END AS s FROM documents)")
def question_cases(spark, sf_dir):
    s = F.concat(F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("doc_id") % len(QUESTIONS)).cast("int")), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit(" "), "source")), F.when(F.col("doc_id") % 11 == 3, "?").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", "s", t.is_question(F.col("s")).alias("question"))


# ---- ranking ----

_TOK = f"d AS (SELECT doc_id AS id, {q.rank_tokens('text')} AS w FROM documents), q AS (SELECT query_id, {q.rank_tokens('query')} AS w FROM {values(ASKED)} v(query_id, query)), qt AS (SELECT query_id, term, count(*) AS times, min(pos) AS first FROM (SELECT query_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM q) GROUP BY ALL), tf AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL)"
_BM25 = f"""WITH {_TOK}, st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, tf.id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(d.w) / a))) AS score, array_to_string(list(term ORDER BY first), ',') AS matched
      FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN d ON d.id = tf.id, st GROUP BY query_id, tf.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score / max(score) OVER (PARTITION BY query_id), 4) AS relative FROM s)"""


def _ranked(spark, sf_dir, k=10):
    return rank.bm25(documents(spark, sf_dir), asked(spark), k)


@query(_BM25 + " SELECT query_id, id, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_BM25 + " SELECT query_id, id, relative, matched FROM r WHERE rank <= 25")
def bm25_matched_terms(spark, sf_dir):
    return _ranked(spark, sf_dir, 25).select("query_id", "id", "relative", F.array_join("matched_terms", ",").alias("matched"))


@query(f"WITH {_TOK} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_frequency(spark, sf_dir):
    return rank.term_frequencies(documents(spark, sf_dir), rank.query_terms(asked(spark))).groupBy("term").agg(F.count("*").alias("df"))


@query(f"SELECT doc_id AS id, len({q.rank_tokens('text')})::DOUBLE + 2.5::DOUBLE * len({q.rank_tokens('source')}) AS length FROM documents")
def weighted_doc_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return rank.weighted_length(docs, "source")


@query(
    _BM25
    + rf""", top AS (SELECT query_id, id FROM r WHERE rank <= 5),
sp AS (SELECT top.query_id, top.id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s, q.w AS terms
       FROM top JOIN documents ON doc_id = id JOIN q ON q.query_id = top.query_id),
one AS (SELECT query_id, id, s, terms, unnest(range(1, len(s) + 1)) AS i FROM sp),
st2 AS (SELECT query_id, id, i, s[i] AS x, terms FROM one),
hit AS (SELECT query_id, id, i, x, length(x) + 1 AS n, list_intersect(list_distinct({q.rank_tokens('x')}), terms) AS h FROM st2),
win AS (SELECT a.query_id, a.id, a.i AS i, b.i AS j, (SELECT sum(n) FROM hit c WHERE c.query_id = a.query_id AND c.id = a.id AND c.i BETWEEN a.i AND b.i) AS n,
        len(list_distinct(flatten((SELECT list(h) FROM hit c WHERE c.query_id = a.query_id AND c.id = a.id AND c.i BETWEEN a.i AND b.i)))) AS hits
        FROM hit a JOIN hit b ON a.query_id = b.query_id AND a.id = b.id AND b.i >= a.i AND b.i - a.i < 200),
best AS (SELECT query_id, id, arg_max(struct_pack(i := i, j := j, hits := hits), struct_pack(a := hits, b := -n, c := -i)) AS b FROM win WHERE n <= 320 OR i = j GROUP BY query_id, id)
SELECT sp.query_id, sp.id, nullif(left(CASE WHEN coalesce(b.hits, 0) <= 0 THEN array_to_string(s[1:2], ' ') ELSE array_to_string(s[b.i:b.j], ' ') END, 320), '') AS best_passage FROM sp LEFT JOIN best USING (query_id, id)"""
)
def best_passage(spark, sf_dir):
    return rank.passages(_ranked(spark, sf_dir, 5), documents(spark, sf_dir), asked(spark)).select("query_id", "id", "best_passage")


_MMR = _BM25 + """, c AS (SELECT r.query_id, r.id, r.rank, round(score, 9) AS score, round(score, 9) / max(round(score, 9)) OVER (PARTITION BY r.query_id) AS rel, list_distinct(d.w) AS w FROM r JOIN d ON d.id = r.id),
p AS (SELECT DISTINCT query_id, 0 AS k, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[][]) AS seen, 0::DOUBLE AS score FROM c
      UNION ALL SELECT query_id, k + 1, list_append(ids, best.id), list_append(seen, best.w), best.score
      FROM (SELECT p.query_id, k, ids, seen, arg_max({'id': c.id, 'w': c.w, 'score': c.score}, {'v': (1 - 0.5::DOUBLE) * rel - 0.5::DOUBLE * coalesce(list_max(list_transform(seen, lambda x: len(list_intersect(x, c.w)) / greatest(least(len(x), len(c.w)), 1))), 0), 'r': -c.rank}) AS best
            FROM p JOIN c ON c.query_id = p.query_id AND NOT list_contains(ids, c.id) WHERE k < 10 GROUP BY p.query_id, k, ids, seen))"""
_MMR = _MMR.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_MMR + " SELECT query_id, ids[k] AS id, k AS rank, round(score, 6) AS score FROM p WHERE k > 0")
def mmr_topk(spark, sf_dir):
    return rank.mmr(documents(spark, sf_dir), asked(spark), 10, 0.5).withColumn("score", F.round("score", 6))


@query(_MMR + f""", m AS (SELECT query_id, ids[k] AS id, k AS rank, round(score, 6) AS score FROM p WHERE k > 0), n AS (SELECT v.query_id, count(r.id) AS n FROM {values(ASKED)} v(query_id, query) LEFT JOIN r ON r.query_id = v.query_id GROUP BY v.query_id)
SELECT * FROM m UNION ALL SELECT query_id, id, n + place, 0 FROM (SELECT n.query_id, n, d.id, row_number() OVER (PARTITION BY n.query_id ORDER BY d.id) AS place FROM n, d WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = n.query_id AND r.id = d.id)) WHERE n + place <= 10""")
def rerank_diverse(spark, sf_dir):
    return rank.rerank(documents(spark, sf_dir), asked(spark), 10, 0.5).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


# ---- addresses ----


@query(f"SELECT page_id, {q.url_key('url')} AS url_key, {q.host('url')} AS host FROM pages")
def url_canonicalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.url_key(F.col("url")).alias("url_key"), u.host(F.col("url")).alias("host"))


@query(f"SELECT {q.url_key('url')} AS url_key, min(page_id) AS page_id FROM pages GROUP BY 1")
def url_dedupe_keep_first(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(u.url_key(F.col("url")).alias("url_key")).agg(F.min("page_id").alias("page_id"))


@query(f"SELECT {q.host('url')} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(u.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT page_id FROM pages WHERE ends_with({q.host('url')}, '.example.com') OR {q.host('url')} = 'example.com' OR ends_with({q.host('url')}, '.example.org')")
def domain_filter_include(spark, sf_dir):
    wanted = F.array(F.lit("example.com"), F.lit("*.example.org"))
    return table(spark, sf_dir, "pages").where(F.exists(wanted, lambda p: u.host_matches(u.host(F.col("url")), p))).select("page_id")


@query(f"SELECT page_id FROM pages WHERE NOT (ends_with({q.host('url')}, '.example.net') OR {q.host('url')} = 'example.net')")
def domain_filter_exclude(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~u.host_matches(u.host(F.col("url")), F.lit("example.net"))).select("page_id")


POLICY = [
    ("https://[::ffff:127.0.0.1]/", False), ("https://[::ffff:7f00:1]/", False), ("http://localhost./x", False), ("https://[fe90::1]/", False), ("https://[ff02::1]/", False), ("http://2130706433/", False), ("https://example.com./", True),
    ("ftp://example.com/", False), ("https://user:pw@example.com/", False), ("http://10.1.2.3/", False), ("http://172.20.0.1/", False), ("http://172.32.0.1/", True), ("http://169.254.1.1/", False), ("http://100.64.0.1/", False), ("http://8.8.8.8/", True), ("http://a.internal/", False), ("https://bad.example.org/", False),
]


@query("SELECT * FROM " + values([(a, "TRUE" if b else "FALSE") for a, b in POLICY]).replace("'TRUE'", "TRUE").replace("'FALSE'", "FALSE") + " v(url, allowed)")
def url_policy_check(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in POLICY], "url string").select("url", u.is_url_allowed(F.col("url"), blocked=["bad.example.org"]).alias("allowed"))


# ---- plans ----

PLANS = [
    (1, "please what is postgres index bloat?"), (2, "breaking news about nepal floods today"), (3, "bitcoin price 2024"), (4, "best laptop vs. tablet and cheapest phone"), (5, "arxiv paper on graph neural networks"),
    (6, "python install error"), (7, "son dakika"), (8, "vektör veritabanı nedir"), (9, "can you explain the moon landing"), (10, "haberler bu hafta"), (11, "envoy proxy circuit breaking"), (12, "stock market latest headlines inflation"),
]


_PLANNED = f"SELECT doc_id AS query_id, {q.q([x for _, x in PLANS])}[doc_id % {len(PLANS)} + 1] || ' ' || source || ' ' || n_chars AS query FROM documents"


@query(f"SELECT query_id, i AS intent, {q.freshness('query', 'i')} AS freshness_hours FROM (SELECT query_id, query, {q.intent('query')} AS i FROM ({_PLANNED}))")
def query_plan_intent_freshness(spark, sf_dir):
    """A query for each document: one of a list, with the document's source and length behind it."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.concat_ws(" ", F.get(F.array(*[F.lit(x) for _, x in PLANS]), (F.col("doc_id") % len(PLANS)).cast("int")), "source", F.col("n_chars").cast("string")).alias("query"))
    return planner.plan(own).select("query_id", "intent", "freshness_hours")


@query()
def query_plan_full(spark, sf_dir):
    return planner.plan(spark.createDataFrame(PLANS, "query_id int, query string"), 4).select("query_id", "optimized", "language", "urls", "urls_only", "sub_queries")


# ---- ranked lists ----

_LISTS = f"""l AS (SELECT (page_id % 7)::INT AS query_id, 'p' || (page_id % 3) AS provider, (page_id % 3)::INT AS list_ord, row_number() OVER (PARTITION BY page_id % 7, page_id % 3 ORDER BY page_id) - 1 AS rank, {q.url_key('url')} AS k, url, page_id FROM pages
UNION ALL SELECT ((page_id // 2) % 7)::INT, 'q', 3, row_number() OVER (PARTITION BY (page_id // 2) % 7 ORDER BY page_id DESC) - 1, {q.url_key('url')}, url, page_id FROM pages)"""


def lists(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", "url", extract.title(F.col("html"), F.col("url")).alias("title"), F.lit("").alias("snippet"), F.lit(None).cast("timestamp").alias("published_at"))
    a = own.withColumn("query_id", (F.col("page_id") % 7).cast("int")).withColumn("list_ord", (F.col("page_id") % 3).cast("int")).withColumn("provider", F.concat(F.lit("p"), F.col("list_ord")))
    a = a.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "list_ord").orderBy("page_id")) - 1)
    b = own.withColumn("query_id", (F.floor(F.col("page_id") / 2) % 7).cast("int")).withColumn("list_ord", F.lit(3)).withColumn("provider", F.lit("q"))
    b = b.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("page_id"))) - 1)
    return a.unionByName(b)


@query(
    f"""WITH {_LISTS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_ord, k ORDER BY rank) AS n FROM l),
g AS (SELECT query_id, k AS url_key, sum(1.0::DOUBLE / (61 + rank)) AS score, count(DISTINCT provider) AS providers, min(list_ord * 1000000 + rank) AS first FROM o WHERE n = 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, providers DESC, first) AS rank FROM g)
SELECT query_id, url_key, round(score, 9) AS score, providers FROM r WHERE rank <= 20"""
)
def rrf_fusion(spark, sf_dir):
    own = fuse.fuse(lists(spark, sf_dir), 20)
    return own.select("query_id", "url_key", F.round("score", 9).alias("score"), "providers")


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), p AS (SELECT source, doc_id, row_number() OVER (ORDER BY n, source) AS place FROM r) SELECT place, source, doc_id FROM p WHERE place <= 200")
def interleave_sources(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("source", "doc_id")
    own = own.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("n <= 200")
    return fuse.interleave(own.withColumn("g", F.lit(1)), 200, ["g"], "source", "n").select(F.col("place").cast("long").alias("place"), "source", "doc_id")


@query(
    f"""WITH r AS (SELECT (page_id % 5)::INT AS query_id, page_id, coalesce({q.host('url')}, '') AS h FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY page_id) AS n FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (n > 2 AND h <> '')::INT, page_id) AS place FROM n) SELECT query_id, page_id, place FROM p WHERE place <= 30"""
)
def host_diversify(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).cast("int").alias("query_id"), "page_id", F.col("page_id").alias("pos"), "url")
    return fuse.cap_hosts(own, 30).select("query_id", "page_id", F.col("place").cast("long").alias("place"))


_GATE = "list_transform(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: length(x) >= 4), lambda x: left(x, greatest(4, length(x) - 2)))"


@query(f"SELECT query_id, doc_id FROM documents, (SELECT query_id, {_GATE} AS t FROM {values(ASKED[:4])} v(query_id, query)) WHERE len(t) = 0 OR len(list_filter(t, lambda x: contains(lower(text), x))) > 0")
def relevance_gate(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("hay"))
    return fuse.gated(own, spark.createDataFrame(ASKED[:4], "query_id int, query string"), "doc_id", "hay")


_PRE = "list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: length(x) >= 3)"


@query(
    f"""WITH s AS (SELECT query_id, page_id, CASE WHEN len(t) = 0 THEN 0.5::DOUBLE ELSE coalesce(list_sum(list_transform(t, lambda x: CASE WHEN contains(ti, x) THEN 0.6::DOUBLE / len(t) WHEN contains(sn, x) THEN 0.4::DOUBLE / len(t) ELSE 0 END)), 0) + CASE WHEN contains(ti, lower(query)) THEN 0.3 ELSE 0 END END AS score
FROM (SELECT query_id, query, {_PRE} AS t FROM {values(ASKED[:4])} v(query_id, query)), (SELECT page_id, lower(url) AS ti, lower(html) AS sn FROM pages)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, page_id) AS rank FROM s) SELECT query_id, page_id, rank, round(score, 9) AS score FROM r WHERE rank <= 11"""
)
def prescore_topn(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("title"), F.lower("html").alias("snippet"))
    out = fuse.pre_scored(own, spark.createDataFrame(ASKED[:4], "query_id int, query string"), "page_id", "title", "snippet", 11)
    return out.select("query_id", "page_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


# ---- scores ----

_REL_NORM = {k: q.normalize(v) for k, v in (("ti", "source"), ("sn", "text"), ("bo", "substr(text, 1, 4000)"))}


@query(
    f"""SELECT query_id, doc_id, round(CASE WHEN len(t) = 0 THEN 0.5 ELSE least(1.0, len(list_filter(t, lambda x: contains(ti, x))) / len(t)::DOUBLE * 0.5 + len(list_filter(t, lambda x: contains(sn, x))) / len(t)::DOUBLE * 0.3 + len(list_filter(t, lambda x: contains(bo, x))) / len(t)::DOUBLE * 0.2
+ CASE WHEN length(p) > 8 AND (contains(ti, p) OR contains(bo, p)) THEN 0.15 ELSE 0 END) END, 6) AS relevance
FROM (SELECT query_id, {q.plain_tokens('query')} AS t, {q.normalize('query')} AS p FROM {values(ASKED[:3])} v(query_id, query)), (SELECT doc_id, {_REL_NORM['ti']} AS ti, {_REL_NORM['sn']} AS sn, {_REL_NORM['bo']} AS bo FROM documents)"""
)
def relevance_score(spark, sf_dir):
    own = fuse.with_relevance(table(spark, sf_dir, "documents"), spark.createDataFrame(ASKED[:3], "query_id int, query string"), "source", "text", "text")
    return own.select(F.col("_q").alias("query_id"), "doc_id", F.round("relevance", 6).alias("relevance"))


HOSTS = ["https://www.gov.uk/x", "https://arxiv.org/abs/1", "http://en.wikipedia.org/wiki/X", "https://www.bbc.co.uk/news", "https://docs.rust-lang.org/", "https://github.com/a/b", "https://me.blogspot.com/", "not an address", "https://pubmed.ncbi.nlm.nih.gov/1", "https://example.com/"]
_CRED = "CASE " + " ".join(f"WHEN regexp_matches(h, {q.lit('|'.join(p))}) THEN {s}" for _, s, p in u.HOST_CLASSES) + " ELSE 0.45 END"
_CRED = f"CASE WHEN h IS NULL THEN 0.2 ELSE greatest(0, least(1, CASE WHEN regexp_matches(h, {q.lit('|'.join(u.LOW_TRUST))}) THEN least(0.35, {_CRED}) ELSE {_CRED} END - CASE WHEN starts_with(url, 'http://') THEN 0.08 ELSE 0 END + CASE WHEN n > 1200 THEN 0.05 WHEN n < 200 THEN -0.08 ELSE 0 END)) END"


@query(f"SELECT url, round(({_CRED})::DOUBLE, 6) AS credibility FROM (SELECT url, {q.host('url')} AS h, length(html) AS n FROM pages UNION ALL SELECT url, {q.host('url')}, 100 FROM {values([(x,) for x in HOSTS])} v(url))")
def credibility_class(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("url", F.length("html").alias("n")).unionByName(spark.createDataFrame([(x, 100) for x in HOSTS], "url string, n int"))
    return own.select("url", F.round(fuse.credibility(F.col("url"), F.col("n")), 6).alias("credibility"))


_KINDS = ["news", "finance", "product", "technical", "academic", "general"]


@query(
    f"""SELECT event_id, kind, CASE WHEN ts IS NULL THEN 0.5 ELSE round(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9::DOUBLE) / hl), 3) END::DOUBLE AS freshness
FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts, ({q.q(_KINDS)})[event_id % 6 + 1] AS kind FROM events) JOIN {values([(a, b) for a, b, *_ in fuse.INTENTS])} v(k, hl) ON k = kind"""
)
def freshness_decay(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("ts"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 6 + 1).cast("int")).alias("kind"))
    dim = spark.createDataFrame(fuse.INTENTS, "k string, hl double, r double, c double, f double, ttl int")
    own = own.join(F.broadcast(dim), F.col("kind") == F.col("k"))
    return own.select("event_id", "kind", fuse.freshness(F.col("ts"), F.lit(NOW).cast("timestamp_ntz"), F.col("hl")).alias("freshness"))


@query(
    f"""SELECT doc_id, round((rel * 0.45::DOUBLE + cred * 0.4::DOUBLE + fresh * 0.15::DOUBLE) * least(1, rel / 0.5::DOUBLE), 6) AS overall FROM (SELECT doc_id, (doc_id % 101) / 100.0::DOUBLE AS rel, least(1, c + CASE WHEN n > 1 THEN least(0.1, 0.03 * n) ELSE 0 END)::DOUBLE AS cred, 0.5::DOUBLE AS fresh
FROM (SELECT doc_id, 0.45::DOUBLE AS c, doc_id % 5 AS n FROM documents))"""
)
def overall_score(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") % 101) / 100.0).alias("rel"), fuse.corroborated(F.lit(0.45), F.col("doc_id") % 5).alias("cred"))
    return own.select("doc_id", fuse.overall(F.col("rel"), F.col("cred"), F.lit(0.5), F.lit(0.45), F.lit(0.4), F.lit(0.15), digits=6).alias("overall"))


# ---- pages ----


@query(r"SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.title(F.col("html"), F.col("url")).alias("title"))


@query()
def html_blocks(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(extract.blocks(F.col("html"))).alias("pos", "block"))


@query()
def html_readable(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.readable(F.col("html")).alias("content"))


@query()
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(extract.links(F.col("html"), F.col("url"))).alias("x")).select("page_id", "x.text", "x.url")


# ---- search and rerank ----

SEARCHES = [(0, "the thon of this thing", "general"), (1, "reading queries about language", "technical"), (2, "der einst ungen kommen", "news"), (3, "que los ciones de la", "academic"), (4, "example page about things", "product"), (5, "zzzz qqqq", "finance"), (6, "copyright home about contact", "general")]
_SHARE = lambda x: f"len(list_filter(t, lambda y: contains({x}, y))) / len(t)::DOUBLE"
_PAGE_TITLE = ORACLES["html_title"].removeprefix("SELECT page_id, ").removesuffix(" FROM pages")


@query(
    f"""WITH {_LISTS}, ti AS (SELECT page_id, {_PAGE_TITLE} FROM pages),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_ord, k ORDER BY rank) AS n, list_ord * 1000000 + rank AS seen FROM l),
g AS (SELECT query_id, k, sum(1.0::DOUBLE / (61 + rank)) AS score, count(DISTINCT provider) AS providers, min(seen) AS first, arg_min(url, seen) AS url, arg_min(page_id, seen) AS page_id FROM o WHERE n = 1 GROUP BY query_id, k),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, providers DESC, first) AS rank FROM g),
c AS (SELECT f.query_id, k, url, rank, title, query, intent, {_PRE} AS short FROM f JOIN ti USING (page_id) JOIN {values(SEARCHES)} v(query_id, query, intent) USING (query_id) WHERE rank <= 20),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN len(short) = 0 THEN 0.5::DOUBLE ELSE coalesce(list_sum(list_transform(short, lambda x: CASE WHEN contains(lower(title), x) THEN 0.6::DOUBLE / len(short) ELSE 0 END)), 0) + CASE WHEN contains(lower(title), lower(query)) THEN 0.3 ELSE 0 END END, 9) DESC, rank) AS position FROM c),
pg AS (SELECT DISTINCT ON (k) k, html AS content, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR * (page_id % 500) AS published FROM (SELECT *, {q.url_key('url')} AS k FROM pages) ORDER BY k, url, html, published),
e AS (SELECT p.*, content, published, {q.plain_tokens('query')} AS t, {q.normalize('query')} AS ph, {q.normalize('title')} AS a, {q.normalize('substr(content, 1, 4000)')} AS d, coalesce({q.host('url')}, '') AS h, length(content) AS n, hl, wr, wc, wf
  FROM p JOIN pg USING (k) JOIN {values([x[:5] for x in fuse.INTENTS])} i(kind, hl, wr, wc, wf) ON kind = intent WHERE position <= 11),
s AS (SELECT *, round(CASE WHEN len(t) = 0 THEN 0.5 ELSE least(1.0, {_SHARE('a')} * 0.5 + {_SHARE('d')} * 0.2 + CASE WHEN length(ph) > 8 AND (contains(a, ph) OR contains(d, ph)) THEN 0.15 ELSE 0 END) END, 3) AS rel, ({_CRED})::DOUBLE AS c0, count(*) OVER (PARTITION BY query_id, h) AS same,
  round(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(published)) / 3.6e9::DOUBLE) / hl), 3) AS fresh FROM e),
w AS (SELECT *, round(CASE WHEN same > 1 THEN least(1, c0 + least(0.1, 0.03 * same)) ELSE c0 END::DOUBLE, 3) AS cred FROM s),
x AS (SELECT *, round((rel * wr::DOUBLE + cred * wc::DOUBLE + fresh * wf::DOUBLE) * least(1, rel / 0.5::DOUBLE), 3) AS overall, max((rel >= 0.15)::INT) OVER (PARTITION BY query_id) AS useful FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overall DESC, position) AS pos FROM x WHERE rel >= 0.15 OR useful = 0), z AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY pos) AS nth FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (nth > 2 AND h <> '')::INT, pos) AS place FROM z) SELECT query_id, place, url, title, rel AS relevance, cred AS credibility, fresh AS freshness, overall FROM r WHERE place <= 10"""
)
def search_results(spark, sf_dir):
    """Fuse, filter, choose, read, score, drop what is off the topic, cap hosts."""
    hours = F.expr("make_dt_interval(0, cast(page_id % 500 as int))")
    pages = table(spark, sf_dir, "pages").select("url", F.col("html").alias("content"), (F.lit("2024-01-31 00:00:00").cast("timestamp") - hours).alias("published_at"))
    out = search.search(lists(spark, sf_dir), pages, spark.createDataFrame(SEARCHES, "query_id int, query string, intent string"), F.lit(NOW).cast("timestamp"))
    return out.select("query_id", F.col("place").cast("long").alias("place"), "url", "title", "relevance", "credibility", "freshness", "overall")


@query(
    _BM25 + f""", m AS (SELECT query_id, id, rank, score FROM r WHERE rank <= 10), n AS (SELECT v.query_id, count(m.id) AS n FROM {values(ASKED)} v(query_id, query) LEFT JOIN m ON m.query_id = v.query_id GROUP BY v.query_id),
x AS (SELECT query_id, doc_id AS id, n + row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM n, documents WHERE (query_id, doc_id) NOT IN (SELECT (query_id, id) FROM m))
SELECT query_id, id, rank, round(score, 6) AS score FROM m UNION ALL SELECT query_id, id, rank, 0 FROM x WHERE rank <= 10"""
)
def rerank_results(spark, sf_dir):
    """The best ten of each query, filled up with documents that don't match."""
    own = rank.rerank(documents(spark, sf_dir), asked(spark))
    return own.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# ---- claims, chunks, news ----


def _results(spark, sf_dir):
    # Twenty documents a query: their number grows with the input, not what one query holds.
    own = table(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("query_id"), F.lit("the thon and that").alias("query"), F.col("doc_id").alias("ord"), F.col("source").alias("host"), "text", ((F.col("doc_id") % 10) / 10.0).alias("credibility"))
    return own


# A fold in SQL: sentence by sentence, with the list of the groups' first sentences.
_CLAIMS = f"""WITH RECURSIVE x AS (SELECT doc_id // 20 AS query_id, doc_id AS ord, source AS host, s, unnest(range(len(s))) AS pos FROM (SELECT doc_id, source, {q.sentences('text')} AS s FROM documents)),
f AS (SELECT query_id, ord, pos, host, s[pos + 1] AS sentence FROM x WHERE {q.any_of('s[pos + 1]', t.FACTUAL)}),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord, pos, sentence) AS n, list_distinct({q.plain_tokens('sentence')}) AS w FROM f),
r AS (SELECT DISTINCT query_id, 0::BIGINT AS n, 0::BIGINT AS g, [{{'n': 0::BIGINT, 'w': ['']}}] AS lead FROM n
      UNION ALL SELECT query_id, n, g, CASE WHEN g = n THEN list_append(lead, {{'n': n, 'w': w}}) ELSE lead END
      FROM (SELECT n.query_id, n.n, n.w, lead, coalesce(list_filter(lead, lambda l: len(w) > 0 AND len(l.w) > 0 AND len(list_intersect(l.w, w)) / least(len(l.w), len(w)) >= {claims.SAME}::DOUBLE)[1].n, n.n) AS g FROM r JOIN n ON n.query_id = r.query_id AND n.n = r.n + 1)),
cg AS (SELECT query_id, n, g FROM r WHERE n > 0)"""


@query(_CLAIMS + ' SELECT n.query_id, g AS "group", ord, pos, host FROM n JOIN cg USING (query_id, n)')
def claim_groups(spark, sf_dir):
    return claims.group_sentences(claims.candidates(_results(spark, sf_dir), None)).select("query_id", "group", "ord", "pos", "host")


@query()
def claim_confidence(spark, sf_dir):
    return claims.verify(_results(spark, sf_dir), min_overlap=0.0)


@query()
def answers(spark, sf_dir):
    return claims.answer(claims.verify(_results(spark, sf_dir), min_overlap=0.0))


@query("SELECT doc_id, n, c, round(least(1, greatest(0, (1 - pow(0.55, n)) * (0.55 + 0.45 * c) * CASE WHEN k > 0 THEN greatest(0.35, 1 - 0.25 * k) ELSE 1 END)), 3)::DOUBLE AS confidence FROM (SELECT doc_id, doc_id % 7 + 1 AS n, (n_chars % 101)::DOUBLE / 100 AS c, n_chars % 5 AS k FROM documents)")
def confidence_table(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 7 + 1).alias("n"), ((F.col("n_chars") % 101).cast("double") / 100).alias("c"), (F.col("n_chars") % 5).alias("k"))
    return own.select("doc_id", "n", "c", claims.confidence(F.col("n"), F.col("c"), F.col("k")).alias("confidence"))


@query()
def chunk_documents(spark, sf_dir):
    return chunk.chunk(table(spark, sf_dir, "documents")).drop("headings")


@query()
def chunk_totals(spark, sf_dir):
    return chunk.chunk(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("estimated_tokens").alias("tokens"))


_NEWS = f"SELECT doc_id AS id, source AS title, text AS snippet, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 HOUR * (doc_id % 500) AS p FROM documents"
_TERMS = f"list_filter(list_transform(list_transform(regexp_split_to_array(query, '\\s+'), lambda x: lower(translate(x, 'Iİ', 'ıi'))), lambda x: CASE WHEN length(x) <= 4 THEN x ELSE regexp_replace(x, '(?:{'|'.join(news.SUFFIXES)})$', '') END), lambda x: length(x) >= 3)"


def items(spark, sf_dir):
    hours = F.expr("make_dt_interval(0, cast(doc_id % 500 as int))")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("snippet"), (F.lit("2024-01-31 00:00:00").cast("timestamp") - hours).alias("published_at"))


@query(
    f"""WITH i AS (SELECT id, lower(translate(title, 'Iİ', 'ıi')) AS t, lower(translate(snippet, 'Iİ', 'ıi')) AS b, p FROM ({_NEWS})), q AS (SELECT query_id, {_TERMS} AS w FROM {values(ASKED)} v(query_id, query)),
s AS (SELECT query_id, id, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN contains(t, x) THEN 1.0::DOUBLE WHEN contains(b, x) THEN 0.4::DOUBLE ELSE 0 END)), 0) + greatest(0, 1 - ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(p)) / 3.6e9::DOUBLE) / 168) * 0.5 AS score FROM i, q
      WHERE len(w) = 0 OR len(list_filter(w, lambda x: contains(t, x) OR contains(b, x))) >= least(len(w), greatest(2, ceil(len(w) * 0.6)))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank <= 20"""
)
def news_match(spark, sf_dir):
    return news.match(items(spark, sf_dir), asked(spark), 20, F.lit(NOW).cast("timestamp")).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"SELECT id FROM ({_NEWS}) ORDER BY p DESC, id LIMIT 50")
def news_headlines(spark, sf_dir):
    return news.headlines(items(spark, sf_dir), 50).select("id")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3')")
def news_topic_join(spark, sf_dir):
    feeds = spark.createDataFrame([("src1", ["world", "tech"]), ("src2", ["sport"]), ("src3", ["tech"])], "source string, topics array<string>")
    return news.with_topics(table(spark, sf_dir, "documents"), feeds, ["tech", "science"]).select("doc_id")


# ---- facts ----


@query("SELECT o_orderkey, o_custkey, CASE WHEN p IS NULL THEN NULL ELSE round(round(o_totalprice - p, 6), 2) END AS change FROM (SELECT o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)")
def price_change_lag(spark, sf_dir):
    own = facts.changes(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return own.select("o_orderkey", "o_custkey", F.round(F.round(F.col("o_totalprice") - F.col("previous"), 6), 2).alias("change"))


@query("SELECT o_custkey, arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_custkey")
def latest_observation(spark, sf_dir):
    return facts.latest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@query("SELECT event_id, ts, value FROM events WHERE coalesce(value, 0) >= 50 AND ts >= TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id LIMIT 50")
def quakes_topk(spark, sf_dir):
    return facts.strongest(table(spark, sf_dir, "events"), 50.0, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id", "ts", "value")


ASKS = ["turkiye", "FR", "germany", "unit", "nowhere"]


@query(
    f"""WITH a AS (SELECT ask, lower(trim(ask)) AS k FROM {values([(x,) for x in ASKS])} v(ask)), r AS (SELECT CAST(n_nationkey AS VARCHAR) AS code, lower(left(n_name, 2)) AS short, lower(n_name) AS name, n_nationkey AS ord FROM nation),
m AS (SELECT ask, '99' AS code, 1 AS tier, 0 AS ord FROM a WHERE k = 'turkiye' UNION ALL SELECT ask, code, 2, ord FROM a JOIN r ON k = short UNION ALL SELECT ask, code, 3, ord FROM a JOIN r ON k = name UNION ALL SELECT ask, code, 4, ord FROM a JOIN r ON length(k) >= 4 AND contains(name, k)),
b AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY tier, ord, code) AS n FROM m) SELECT a.ask, code, tier FROM a LEFT JOIN b ON a.ask = b.ask AND n = 1"""
)
def lookup_priority(spark, sf_dir):
    register = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.left("n_name", F.lit(2)).alias("short"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))
    aliases = spark.createDataFrame([("turkiye", "99")], "alias string, code string")
    register = register.withColumn("ord", F.col("ord").cast("int"))
    return facts.lookup(spark.createDataFrame([(x,) for x in ASKS], "ask string"), register, aliases)


# ---- operations ----

_USE = "SELECT event_type AS op, value AS ms, event_type <> 'error' AND event_id % 17 <> 0 AS ok, event_id % 3 = 0 AS cached, event_id, user_id, ts FROM events"


def calls(spark, sf_dir):
    ok = (F.col("event_type") != "error") & (F.col("event_id") % 17 != 0)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.col("value").alias("ms"), ok.alias("ok"), (F.col("event_id") % 3 == 0).alias("cached"), "event_id", "user_id", "ts")


@query(f"SELECT op, count(*) AS requests, round(avg(ms), 6) AS avg_ms, round(avg((NOT ok)::INT), 9) AS error_rate, round(avg(cached::INT), 9) AS cache_rate FROM ({_USE}) GROUP BY op")
def usage_summary(spark, sf_dir):
    return ops.usage(calls(spark, sf_dir)).select("op", "requests", F.round("avg_ms", 6).alias("avg_ms"), F.round("error_rate", 9).alias("error_rate"), F.round("cache_rate", 9).alias("cache_rate"))


@query(f"SELECT op, l[least(len(l), floor(0.5 * len(l))::INT + 1)] AS p50, l[least(len(l), floor(0.95 * len(l))::INT + 1)] AS p95 FROM (SELECT op, list(ms ORDER BY ms) AS l FROM ({_USE}) WHERE ms IS NOT NULL GROUP BY op)")
def usage_percentiles(spark, sf_dir):
    return ops.nearest_rank(calls(spark, sf_dir).where("ms is not null"), ["op"], "ms", {"p50": 0.5, "p95": 0.95})


@query(f"SELECT op, event_id FROM (SELECT op, event_id, row_number() OVER (PARTITION BY op ORDER BY ts DESC, event_id DESC) AS n FROM ({_USE})) WHERE n <= 500")
def last_500_samples(spark, sf_dir):
    return ops.last_samples(calls(spark, sf_dir), ["op"], [F.desc("ts"), F.desc("event_id")]).select("op", "event_id")


@query(f"SELECT provider, count(*) AS calls, round(avg(ok::INT), 9) AS success_rate FROM (SELECT unnest(string_split(op || '+u' || (user_id % 3), '+')) AS provider, ok FROM ({_USE})) GROUP BY provider")
def provider_success_rate(spark, sf_dir):
    own = calls(spark, sf_dir).withColumn("provider", F.concat("op", F.lit("+u"), (F.col("user_id") % 3).cast("string")))
    return ops.provider_success(own).select("provider", "calls", F.round("success_rate", 9).alias("success_rate"))


@query(f"SELECT event_id, CAST(sum((NOT ok)::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS streak FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM ({_USE}))")
def failure_streaks(spark, sf_dir):
    return ops.failure_streaks(calls(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "streak")


# Folds in SQL: one row of each key a round.
_EMA = f"""WITH RECURSIVE e AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({_USE}) WHERE ms IS NOT NULL),
s AS (SELECT user_id, rn, floor(ms + 0.5::DOUBLE)::DOUBLE AS ema FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.rn, CASE WHEN ema = 0 THEN floor(ms + 0.5::DOUBLE) ELSE floor(ema * (1 - {ops.ALPHA}::DOUBLE) + ms * {ops.ALPHA}::DOUBLE + 0.5::DOUBLE) END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, ema FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1"""
_BREAKER = f"""WITH RECURSIVE e AS (SELECT op AS source, epoch_us(ts) // 1000 AS ts, event_id, ok, row_number() OVER (PARTITION BY op ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM ({_USE})),
s AS (SELECT source, rn, ts, event_id, ok, true AS asked, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS f, 0::BIGINT AS until FROM e WHERE rn = 1
      UNION ALL SELECT source, rn, ts, event_id, ok, asked, CASE WHEN NOT asked THEN 'open' WHEN f >= {ops.THRESHOLD} THEN 'half-open' ELSE 'closed' END, CASE WHEN NOT asked THEN f WHEN ok THEN 0 ELSE f + 1 END,
             CASE WHEN NOT asked THEN until WHEN NOT ok AND f + 1 >= {ops.THRESHOLD} THEN ts + least({ops.MAX_MS}, {ops.BASE_MS} * pow(2, least(20, f + 1 - {ops.THRESHOLD})))::BIGINT ELSE 0 END
             FROM (SELECT e.*, f, until, NOT (f >= {ops.THRESHOLD} AND e.ts < until) AS asked FROM s JOIN e ON e.source = s.source AND e.rn = s.rn + 1))
SELECT source, ts, event_id, ok, asked, state FROM s"""
_WINDOW = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
s AS (SELECT user_id, rn, ts, event_id, 1::BIGINT AS count, ts + 3600000 AS reset FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.rn, e.ts, e.event_id, CASE WHEN e.ts >= reset THEN 1 ELSE count + 1 END, CASE WHEN e.ts >= reset THEN e.ts + 3600000 ELSE reset END FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT user_id, ts, event_id, count, count <= 2 AS allowed, CASE WHEN count <= 2 THEN 0 ELSE reset - ts END AS retry_ms FROM s"""


@query(_EMA)
def ema_latency(spark, sf_dir):
    return ops.smoothed(calls(spark, sf_dir), "user_id", ["ts", "event_id"], "ms")


@query(_BREAKER)
def breaker_state(spark, sf_dir):
    own = calls(spark, sf_dir).select(F.col("op").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts"), "event_id", "ok")
    return ops.breaker(own, tie=["event_id"])


@query(_WINDOW)
def rate_limit_fixed_window(spark, sf_dir):
    own = calls(spark, sf_dir).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("ts"), "event_id")
    return ops.fixed_window(own, "user_id", 2, 3_600_000, tie=["event_id"])


@query(f"SELECT op, f, CAST(least(600000, 30000 * pow(2, greatest(0, f - 4))) AS BIGINT) AS pause FROM (SELECT op, event_id % 14 AS f FROM ({_USE}) WHERE NOT ok GROUP BY ALL)")
def cooldown_table(spark, sf_dir):
    """The pause after each number of failures that an operation is counted with."""
    own = calls(spark, sf_dir).where("not ok").select("op", (F.col("event_id") % 14).alias("f")).distinct()
    return own.select("op", "f", ops.cooldown_ms(F.col("f")).alias("pause"))


@query("SELECT event_id, sha256(length(event_type) || ':' || event_type || length(CAST(user_id AS VARCHAR)) || ':' || user_id || '1:-') AS key FROM events")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ops.cache_key(F.col("event_type"), F.col("user_id").cast("string"), F.lit("-")).alias("key"))


_TTL = values([(x[0], x[-1]) for x in fuse.INTENTS])


@query(f"SELECT page_id, k AS intent, fh, CASE WHEN fh IS NULL THEN ttl ELSE least(ttl, fh * 3600, 21600) END::DOUBLE AS ttl FROM (SELECT page_id, {q.q([x[0] for x in fuse.INTENTS])}[page_id % {len(fuse.INTENTS)} + 1] AS i, CASE WHEN page_id % 4 > 0 THEN (page_id % 97)::DOUBLE / 8 END AS fh FROM pages) JOIN {_TTL} v(k, ttl) ON k = i")
def ttl_table(spark, sf_dir):
    dim = F.broadcast(spark.createDataFrame([(x[0], x[-1]) for x in fuse.INTENTS], "intent string, t int"))  # six intents
    kind = F.get(F.array(*[F.lit(x[0]) for x in fuse.INTENTS]), (F.col("page_id") % len(fuse.INTENTS)).cast("int"))
    own = table(spark, sf_dir, "pages").select("page_id", kind.alias("intent"), F.when(F.col("page_id") % 4 > 0, (F.col("page_id") % 97).cast("double") / 8).alias("fh"))
    return own.join(dim, "intent").select("page_id", "intent", "fh", ops.ttl_seconds(F.col("t"), F.col("fh")).cast("double").alias("ttl"))


@query(
    """WITH e AS (SELECT user_id AS k, ts, event_id FROM events WHERE event_type IN ('purchase', 'signup')), p AS (SELECT user_id AS k, ts, event_id FROM events WHERE event_type NOT IN ('purchase', 'signup'))
SELECT p.event_id AS probe_id, coalesce(max(e.ts) + INTERVAL 6 HOUR > any_value(p.ts), FALSE) AS hit FROM p LEFT JOIN e ON e.k = p.k AND e.ts <= p.ts GROUP BY p.event_id"""
)
def cache_asof_hits(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    entries = events.where("event_type in ('purchase', 'signup')").select(F.col("user_id").alias("k"), F.col("ts").alias("stored_at"), (F.col("ts") + F.expr("interval 6 hours")).alias("expires_at"), F.col("event_id").cast("string").alias("payload"))
    probes = events.where("event_type not in ('purchase', 'signup')").select(F.col("user_id").alias("k"), F.col("event_id").alias("probe_id"), F.col("ts").alias("at"))
    return ops.as_of(probes, entries, "k").select("probe_id", "hit")


@query("SELECT user_id, max(ts) AS last_access FROM events GROUP BY user_id ORDER BY last_access DESC, user_id LIMIT 100")
def lru_keep(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"))
    return ops.least_recent(own, 100).select(F.col("key").alias("user_id"), "last_access")


# ---- streams, as batches ----


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    from quern.streaming import events as stream

    own = stream.tumbling(table(spark, sf_dir, "events"))
    return own.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM g GROUP BY user_id, g"""
)
def events_session(spark, sf_dir):
    from quern.streaming import events as stream

    own = stream.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return own.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


# ---- joins and graphs ----


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_requested(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_section(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("SELECT source AS url, array_to_string(list(lang ORDER BY o), ',') AS sections FROM (SELECT source, lang, min(doc_id) AS o FROM documents GROUP BY ALL) GROUP BY source")
def used_for_map(spark, sf_dir):
    own = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("ord")).select(F.col("lang").alias("section"), "ord", F.array("source").alias("urls"))
    return graph.used_for(own).select("url", F.array_join("sections", ",").alias("sections"))


_EDGES = "SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem UNION SELECT DISTINCT l_suppkey + 1000000, l_partkey + 1 FROM lineitem"


@query(
    f"""WITH e AS ({_EDGES}), d1 AS (SELECT DISTINCT dst AS node FROM e WHERE src = 1), d2 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM d1)),
a AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2) SELECT node, min(depth) AS depth FROM a GROUP BY node"""
)
def link_graph_bfs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"))
    edges = li.select(F.col("p").alias("src"), (F.col("s") + 1000000).alias("dst")).union(li.select(F.col("s") + 1000000, F.col("p") + 1)).distinct()
    return graph.walk(edges, spark.range(1, 2).select(F.col("id").alias("node")), 2)


@query("SELECT s AS source, o AS kept FROM (SELECT source AS s, min(doc_id) AS o FROM documents GROUP BY source) UNION ALL SELECT source, doc_id FROM documents WHERE FALSE")
def first_of_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("kept"))


# ---- sinks and batches ----


@query(_BM25 + " SELECT query_id, array_to_string(list(rank || '. d' || r.id || chr(10) || 'doc:' || r.id || chr(10) || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 700) ORDER BY rank), chr(10) || chr(10)) AS text FROM r JOIN documents ON doc_id = r.id WHERE rank <= 3 GROUP BY query_id")
def render_results(spark, sf_dir):
    own = _ranked(spark, sf_dir, 3).join(documents(spark, sf_dir), "id")
    name = F.col("id").cast("string")
    return sinks.render(own.select("query_id", "rank", F.concat(F.lit("d"), name).alias("title"), F.concat(F.lit("doc:"), name).alias("url"), F.col("text").alias("snippet")))


@query("SELECT user_id % 50 AS batch, count(*) AS queries, sum((event_type <> 'error')::INT)::BIGINT AS succeeded, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS providers, bool_and(event_id % 3 = 0) AS all_cached FROM events GROUP BY 1")
def batch_summary(spark, sf_dir):
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("batch"), F.col("event_id").alias("query_id"), (F.col("event_type") != "error").alias("ok"), F.array("event_type").alias("providers"), (F.col("event_id") % 3 == 0).alias("cached"))
    return sinks.batch_summary(own).withColumn("providers", F.array_join("providers", ","))


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    return sinks.repeated_ids(table(spark, sf_dir, "documents"), F.md5(F.col("text").cast("binary")).alias("key"))


@query("SELECT doc_id AS query_id, min(doc_id) OVER (PARTITION BY text) AS runs_as FROM documents")
def identical_requests(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")
    return sinks.identical_once(own, F.md5(F.col("text").cast("binary")))[1]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir)
