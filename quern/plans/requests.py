"""Queries over requests, stored answers and site files: small tables of bodies stand here as rows, as the driver's tables hold none."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import params, search
from quern.plans import sql as q
from quern.plans.catalog import SEARCHES, query, table, values
from quern.sources import feeds, providers, sites

ANSWERS = [
    (1, "marginalia", 0, "plain", 200, '{"results":[{"title":"T","url":"https://a.example/1","description":"one"},{"title":"","url":"https://a.example/2","description":"no title"},{"title":"U","url":"https://a.example/3","description":"two"}]}'),
    (1, "mwmbl", 1, "runs", 200, '{"results":[{"title":[{"value":"Bo"},{"value":"ld"}],"url":"http://b.example/1","extract":[{"value":"text"}]}]}'),
    (1, "hackernews", 2, "stories", 200, '{"hits":[{"title":"S","url":"","objectID":"7","story_text":"story","created_at":"2024-01-02T03:04:05Z"}]}'),
    (1, "github", 3, "repositories", 200, '{"items":[{"full_name":"o/r","html_url":"https://github.com/o/r","description":"code","pushed_at":"2024-01-02T00:00:00Z"}]}'),
    (1, "openalex", 4, "plain", 503, "down"),
    (2, "mdn", 0, "manuals", 200, '{"documents":[{"title":"Array","mdn_url":"/docs/Array","summary":"a list"}]}'),
    (2, "packages", 1, "packages", 200, '{"objects":[{"package":{"name":"left-pad","description":"pads","date":"2024-01-05T00:00:00Z"}}]}'),
    (2, "sec-filings", 2, "filings", 200, '{"hits":{"hits":[{"_id":"0001-24-05:doc.htm","_source":{"display_names":["ACME"],"file_type":"10-K","file_date":"2024-01-03","ciks":["000123"]}}]}}'),
    (2, "wikipedia", 3, "articles", 200, '{"lang":"de","query":{"search":[{"title":"Graph database","snippet":"nodes","timestamp":"2024-01-04T00:00:00Z"}]}}'),
    (2, "wikidata", 4, "entities", 200, '{"search":[{"label":"L","concepturi":"http://www.wikidata.org/entity/Q1","description":"thing"}]}'),
    (3, "marginalia", 0, "plain", 404, "{}"),
]
_FIELDS = {
    "plain": ("$.results[*]", "x->>'$.title'", "x->>'$.url'", "x->>'$.description'", "NULL"),
    "runs": ("$.results[*]", "array_to_string(x->>'$.title[*].value', '')", "regexp_replace(x->>'$.url', '^http://', 'https://')", "array_to_string(x->>'$.extract[*].value', '')", "NULL"),
    "stories": ("$.hits[*]", "x->>'$.title'", "coalesce(nullif(x->>'$.url', ''), 'https://news.ycombinator.com/item?id=' || (x->>'$.objectID'))", "x->>'$.story_text'", "x->>'$.created_at'"),
    "repositories": ("$.items[*]", "x->>'$.full_name'", "x->>'$.html_url'", "x->>'$.description'", "x->>'$.pushed_at'"),
    "manuals": ("$.documents[*]", "x->>'$.title'", "'https://developer.mozilla.org' || (x->>'$.mdn_url')", "x->>'$.summary'", "NULL"),
    "packages": ("$.objects[*]", "x->>'$.package.name'", "'https://www.npmjs.com/package/' || (x->>'$.package.name')", "x->>'$.package.description'", "x->>'$.package.date'"),
    "filings": ("$.hits.hits[*]", "(x->>'$._source.display_names[0]') || ' — ' || (x->>'$._source.file_type')", "'https://www.sec.gov/Archives/edgar/data/' || ltrim(x->>'$._source.ciks[0]', '0') || '/' || replace(split_part(x->>'$._id', ':', 1), '-', '') || '/' || split_part(x->>'$._id', ':', 2)", "(x->>'$._source.file_type') || ' ' || (x->>'$._source.file_date')", "x->>'$._source.file_date'"),
    "articles": ("$.query.search[*]", "x->>'$.title'", "'https://' || (body->>'$.lang') || '.wikipedia.org/wiki/' || replace(x->>'$.title', ' ', '_')", "x->>'$.snippet'", "x->>'$.timestamp'"),
    "entities": ("$.search[*]", "x->>'$.label'", "x->>'$.concepturi'", "x->>'$.description'", "NULL"),
}
_GOOD = f"a AS (SELECT * FROM {values(ANSWERS)} v(query_id, provider, list_ord, kind, status, body) WHERE status BETWEEN 200 AND 299)"
_RANKED = f"WITH {_GOOD}, r AS (" + " UNION ALL ".join(f"SELECT query_id, provider, list_ord, pos, {t} AS title, {u} AS url, {s} AS snippet, {w}::VARCHAR AS w FROM (SELECT query_id, provider, list_ord, body::JSON AS body, unnest(json_extract(body, '{rows}')) AS x, generate_subscripts(json_extract(body, '{rows}'), 1) AS pos FROM a WHERE kind = '{k}')" for k, (rows, t, u, s, w) in _FIELDS.items()) + "), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, list_ord ORDER BY pos) - 1 AS rank FROM r WHERE title <> '' AND url <> '')"


def answers(spark):
    return spark.createDataFrame(ANSWERS, "query_id int, provider string, list_ord int, kind string, status int, body string")


@query(_RANKED + " SELECT query_id, provider, list_ord, rank, title, url, snippet, epoch_ms(w::TIMESTAMP)::BIGINT AS published_ms FROM o")
def provider_rows(spark, sf_dir):
    """Stored answers of nine kinds of sources as ranked lists."""
    own = providers.ranked(answers(spark))
    return own.select("query_id", "provider", "list_ord", F.col("rank").cast("long").alias("rank"), "title", "url", "snippet", F.unix_millis("published_at").alias("published_ms"))


@query(f"SELECT query_id, provider, max(status BETWEEN 200 AND 299) AS ok, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END)::BIGINT AS rows FROM {values(ANSWERS)} v(query_id, provider, list_ord, kind, status, body) GROUP BY ALL")
def provider_outcomes(spark, sf_dir):
    return providers.outcomes(answers(spark).withColumn("rows", (F.col("status") == 200).cast("long")))


@query(f"SELECT query_id, (pos - 1)::INT AS list_ord, provider FROM (SELECT query_id, unnest(p) AS provider, generate_subscripts(p, 1) AS pos FROM {values([(a, b) for a, _, b in SEARCHES] + [(9, 'unknown')])} v(query_id, intent) JOIN (VALUES " + ", ".join(f"({q.lit(k)}, {q.q(v)})" for k, v in providers.ROUTES) + ") r(k, p) ON k = CASE WHEN intent = 'unknown' THEN 'general' ELSE intent END)")
def provider_routes(spark, sf_dir):
    return providers.routed(spark.createDataFrame([(a, b) for a, _, b in SEARCHES] + [(9, "unknown")], "query_id int, intent string"))


_WAVES = "SELECT (page_id % 40)::INT AS query_id, (1 + page_id % 3 // 2)::INT AS wave, url, (page_id * 37 % 1000)::INT AS arrival_ms FROM pages"


def _waves(spark, sf_dir):
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 40).cast("int").alias("query_id"), F.expr("cast(1 + (page_id % 3) div 2 as int)").alias("wave"), "url", F.expr("cast(page_id * 37 % 1000 as int)").alias("arrival_ms"))


@query(f"WITH l AS ({_WAVES}), n AS (SELECT query_id FROM l GROUP BY 1 HAVING count(DISTINCT CASE WHEN wave = 1 THEN url END) >= 5) SELECT query_id, wave, url FROM l WHERE wave = 1 OR query_id NOT IN (SELECT query_id FROM n)")
def provider_waves(spark, sf_dir):
    return providers.waves(_waves(spark, sf_dir), 5).select("query_id", "wave", "url")


@query(f"SELECT query_id, count(*) FILTER (WHERE arrival_ms <= 700) AS in_time, count(*) FILTER (WHERE arrival_ms > 700) AS late FROM ({_WAVES}) GROUP BY 1")
def provider_on_time(spark, sf_dir):
    good, late = providers.on_time(_waves(spark, sf_dir), F.lit(700))
    own = good.select("query_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(late.select("query_id", F.lit(0), F.lit(1)))
    return own.groupBy("query_id").agg(F.sum("a").alias("in_time"), F.sum("b").alias("late"))


FEEDS = [
    ("f", "en", 200, "<rss><item><title>One</title><link>https://x.example/1?utm_source=f</link><description>first text</description></item><item><title>Two</title><link>https://x.example/2</link><description></description></item></rss>"),
    ("g", "de", 200, '<feed><entry><title>Drei</title><link rel="alternate" href="https://y.example/3"/><summary>dritter</summary></entry></feed>'),
    ("h", "en", 304, ""),
    ("i", "en", 500, "<rss><item><title>No</title><link>https://x.example/9</link></item></rss>"),
]
BEFORE = [("h", "en", 0, "Old", "https://z.example/1", "kept", "2024-01-01 00:00:00"), ("i", "en", 0, "Recent", "https://z.example/2", "kept", "2024-01-31 23:30:00"), ("i", "en", 1, "Stale", "https://z.example/3", "gone", "2024-01-31 20:00:00"), ("f", "en", 0, "Replaced", "https://x.example/0", "gone", "2024-01-31 23:50:00")]


@query(
    f"""WITH f AS (SELECT feed, (pos - 1)::INT AS pos, x FROM (SELECT feed, unnest(regexp_extract_all(body, '<(item|entry)>(.*?)</(item|entry)>', 2, 's')) AS x, generate_subscripts(regexp_extract_all(body, '<(item|entry)>(.*?)</(item|entry)>', 2, 's'), 1) AS pos FROM {values(FEEDS)} v(feed, lang, status, body) WHERE status BETWEEN 200 AND 299)),
n AS (SELECT feed, pos, regexp_extract(x, '<title>(.*?)</title>', 1) AS title, coalesce(nullif(regexp_extract(x, 'href="([^"]+)"', 1), ''), regexp_extract(x, '<link>([^<?]*)', 1)) AS url, regexp_extract(x, '<(?:description|summary)>(.*?)</', 1) AS snippet FROM f)
SELECT * FROM n UNION ALL SELECT b.feed, pos, title, url, snippet FROM {values(BEFORE)} b(feed, lang, pos, title, url, snippet, fetched) JOIN {values([x[:3] for x in FEEDS])} v(feed, lang2, status) ON b.feed = v.feed
WHERE status = 304 OR (status NOT BETWEEN 200 AND 299 AND epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_ms(fetched::TIMESTAMP) <= 3600000)"""
)
def feed_refresh(spark, sf_dir):
    """Items of feeds after a pull: unchanged and failed ones keep what was there, for a while."""
    pulled = spark.createDataFrame(FEEDS, "feed string, lang string, status int, body string")
    before = spark.createDataFrame(BEFORE, "feed string, lang string, pos int, title string, url string, snippet string, f string").withColumn("fetched_at", F.to_timestamp("f")).withColumn("published_at", F.lit(None).cast("timestamp")).drop("f")
    out = feeds.refreshed(before, feeds.items(pulled), pulled.select("feed", "status"), F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return out.select("feed", "pos", "title", "url", F.coalesce("snippet", F.lit("")).alias("snippet"))


FILES = [
    ("https://a.example/robots.txt", "User-agent: *\nSitemap: https://a.example/index.xml\nDisallow: /x"),
    ("https://a.example/index.xml", "<sitemapindex><sitemap><loc>https://a.example/s1.xml</loc></sitemap><sitemap><loc>https://a.example/s2.xml</loc></sitemap></sitemapindex>"),
    ("https://a.example/s1.xml", "<urlset><url><loc>https://a.example/docs/old</loc><lastmod>2023-01-01</lastmod></url><url><loc>https://a.example/docs</loc></url></urlset>"),
    ("https://a.example/s2.xml", "<urlset><url><loc>https://a.example/docs/new</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a.example/docs/longer</loc></url><url><loc>https://a.example/blog</loc></url></urlset>"),
    ("https://b.example/sitemap.xml", "https://b.example/one\nhttps://b.example/three\n"),
    ("https://c.example/", '<a href="/in">in</a> <a href="https://other.example/out">out</a> <a href="https://c.example/whole">w</a> <a href="#top">t</a>'),
]
# Which addresses each site has, as told by its files: site, address, date.
_KNOWN = [("https://a.example", "https://a.example/docs/old", "2023-01-01"), ("https://a.example", "https://a.example/docs", None), ("https://a.example", "https://a.example/docs/new", "2024-01-01"), ("https://a.example", "https://a.example/docs/longer", None), ("https://b.example", "https://b.example/one", None), ("https://b.example", "https://b.example/three", None), ("https://c.example", "https://c.example/in", None), ("https://c.example", "https://c.example/whole", None)]


@query(f"SELECT site, row_number() OVER (PARTITION BY site ORDER BY d DESC NULLS LAST, length(url), url) AS place, url, CASE WHEN site LIKE '%c.example' THEN 'links' ELSE 'sitemap' END AS via FROM {values(_KNOWN)} v(site, url, d)")
def site_maps(spark, sf_dir):
    """Addresses of three sites: by an index of site maps, by a plain list, by the links of the front page; those under /docs where there are any."""
    own = spark.createDataFrame([("https://a.example",), ("https://b.example",), ("https://c.example",)], "site string")
    return sites.site_map(own, spark.createDataFrame(FILES, "url string, body string"), path_part="/docs").select("site", F.col("place").cast("long").alias("place"), "url", "via")


ASKS = [(1, "day", "fast", "tr-TR", "7.5", "claims", "https://a.example/x|*.B.example"), (2, "12", None, "en", None, None, "not a domain"), (3, "never", "slow", "EN", "900", "poem", "c.example"), (4, None, "deep", None, "x", "sources", None), (5, "-3", "balanced", "de-de", "-5", "report", "d.example|.d.example.")]


@query(
    f"""SELECT id, coalesce(w.h, CASE WHEN try_cast(fresh AS DOUBLE) > 0 THEN try_cast(fresh AS DOUBLE) END) AS hours, CASE WHEN depth IS NULL THEN 'balanced' WHEN depth IN ('fast', 'balanced', 'deep') THEN depth END AS depth, CASE WHEN regexp_matches(locale, '^[a-z]{{2}}(-[A-Z]{{2}})?$') THEN locale END AS locale,
CASE WHEN n IS NULL THEN 10 WHEN try_cast(n AS DOUBLE) IS NOT NULL THEN least(greatest(floor(try_cast(n AS DOUBLE) + 0.5), 1), 30)::INT END AS n, CASE WHEN mode IS NULL THEN 'results' WHEN mode IN ('results', 'sources', 'claims', 'report') THEN mode END AS mode,
CASE WHEN len(list_filter(d, lambda x: NOT regexp_matches(x, '^[a-z0-9.-]+\\.[a-z]{{2,}}$'))) = 0 THEN array_to_string(d, ',') END AS domains
FROM (SELECT *, list_transform(string_split(domains, '|'), lambda x: regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '^https?://', ''), '^\\*\\.', ''), '/.*$', '')) AS d FROM {values(ASKS)} v(id, fresh, depth, locale, n, mode, domains)) LEFT JOIN {values(params.WINDOWS)} w(name, h) ON name = lower(fresh)"""
)
def request_parameters(spark, sf_dir):
    own = spark.createDataFrame(ASKS, "id int, fresh string, depth string, locale string, n string, mode string, domains string")
    x = {k: F.col(k) for k in own.columns}
    return own.select("id", params.freshness(x["fresh"]).alias("hours"), params.depth(x["depth"]).alias("depth"), params.locale(x["locale"]).alias("locale"), params.whole_number(x["n"], 1, 30, 10).alias("n"), params.choice(x["mode"], params.MODES).alias("mode"), F.array_join(params.domains(F.split("domains", r"\|")), ",").alias("domains"))


@query(f"SELECT id, '[\"search\",\"general\",true,\"' || coalesce(depth, 'balanced') || '\",[],' || replace(to_json(list_sort(list_distinct(list_transform(string_split(coalesce(domains, ''), '|'), lambda x: regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '^\\*\\.', ''), '^\\.', ''), '\\.$', '')))))::VARCHAR, ', ', ',') || ',[],[],[]]' AS namespace FROM {values(ASKS)} v(id, fresh, depth, locale, n, mode, domains)")
def request_identity(spark, sf_dir):
    own = spark.createDataFrame(ASKS, "id int, fresh string, depth string, locale string, n string, mode string, domains string")
    none = F.array().cast("array<string>")
    return own.select("id", params.identity(F.lit("general"), F.lit(None).cast("boolean"), F.col("depth"), none, F.split(F.coalesce("domains", F.lit("")), r"\|"), none, none, none).alias("namespace"))


@query("SELECT user_id, left(sha256('pepper:' || CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || user_id WHEN user_id % 3 = 1 THEN '192.168.0.' || user_id ELSE 'unknown' END), 32) AS actor FROM (SELECT DISTINCT user_id FROM events)")
def request_actors(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("user_id").distinct()
    name = F.col("user_id").cast("string")
    forwarded = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), name, F.lit(", 1.1.1.1")))
    return own.select("user_id", params.actor(params.client(forwarded, F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("192.168.0."), name))), "pepper").alias("actor"))


@query(f"SELECT code, coalesce(status, 500)::INT AS status, code IN ({', '.join(map(q.lit, params.RETRYABLE))}) AS retryable FROM {values([(x,) for x, _ in params.ERRORS] + [('odd',)])} c(code) LEFT JOIN {values(params.ERRORS)} e(name, status) ON name = code")
def error_codes(spark, sf_dir):
    own = spark.createDataFrame([(x,) for x, _ in params.ERRORS] + [("odd",)], "code string")
    return own.select("code", params.status(F.col("code")).alias("status"), params.retryable(F.col("code")).alias("retryable"))


@query("SELECT * FROM " + values([(a, int(min(b, 99)), *rest) for a, b, *rest in search.PROFILES]) + " v(depth, sources, wait_ms, web_ms, vertical_ms, recovery_ms, enrich_ms, pages)")
def search_profiles(spark, sf_dir):
    own = spark.createDataFrame(search.PROFILES, "depth string, sources double, wait_ms int, web_ms int, vertical_ms int, recovery_ms int, enrich_ms int, pages int")
    return own.withColumn("sources", F.least("sources", F.lit(99.0)).cast("int"))
