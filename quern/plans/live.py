"""Queries over live data, fetched pages, research and what leaves the engine; bodies that the driver's tables don't hold stand here as rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import urls as u
from quern.operators import extract, ops, pages, research, sinks
from quern.plans import sql as q
from quern.plans.catalog import HOSTS, query, table, values
from quern.sources import live

WEATHER = [("a", 200, '{"current":{"time":"2024-02-01T10:00","temperature_2m":3.5,"apparent_temperature":1.0,"relative_humidity_2m":80,"precipitation":0.2,"weather_code":61,"wind_speed_10m":12},"daily":{"time":["2024-02-01","2024-02-02"],"weather_code":[61,3],"temperature_2m_max":[5,7],"temperature_2m_min":[1],"precipitation_sum":[2.5,0]}}'), ("b", 500, "{}"), ("c", 200, '{"current":{"weather_code":4}}')]
RATES = [("eur", 200, '{"base":"EUR","date":"2024-01-31","rates":{"USD":1.08,"TRY":32.9}}'), ("usd", 404, "{}"), ("gbp", 200, '{"date":"2024-01-31","rates":{"EUR":1.17}}')]
COINS = [("x", 200, '{"bitcoin":{"usd":42000,"usd_24h_change":-1.5,"last_updated_at":1706745600},"ether":{"usd":2300,"last_updated_at":1706745660}}')]
STOCKS = [("acme", 200, '{"chart":{"result":[{"meta":{"symbol":"ACME","longName":"Acme","currency":"USD","regularMarketPrice":12.5,"chartPreviousClose":10,"regularMarketTime":1706745600},"timestamp":[1706572800,1706659200,1706745600],"indicators":{"quote":[{"close":[9.5,null,12.5]}]}}]}}'), ("none", 200, '{"chart":{"result":null}}')]
SERIES = [("tr", "population", 200, '[{"page":1},[{"date":"2023","value":null,"country":{"value":"Türkiye"}},{"date":"2022","value":85.3,"country":{"value":"Türkiye"}},{"date":"2021","value":84.1,"country":{"value":"Türkiye"}}]]'), ("de", "gdp", 200, '[{"page":1},[{"date":"2022","value":4.08,"country":{"value":"Germany"}}]]'), ("fr", "cheese", 200, "[{},[]]")]
_A = "key string, status int, body string"
_OK = lambda rows: f"(SELECT key, body::JSON AS b FROM {values(rows)} v(key, status, body) WHERE status BETWEEN 200 AND 299)"
_COND = f"(SELECT * FROM {values(live.CONDITIONS)} c(code, condition))"


@query(f"SELECT key, b->>'$.current.time' AS observed_at, (b->>'$.current.temperature_2m')::DOUBLE AS temperature_c, (b->>'$.current.wind_speed_10m')::DOUBLE AS wind_kmh, (b->>'$.current.weather_code')::INT AS weather_code, condition FROM {_OK(WEATHER)} LEFT JOIN {_COND} ON code = (b->>'$.current.weather_code')::INT")
def live_weather(spark, sf_dir):
    return live.weather(spark.createDataFrame(WEATHER, _A)).select("key", "observed_at", "temperature_c", "wind_kmh", "weather_code", "condition")


@query(f"SELECT key, b->'$.daily.time'->>i AS date, condition, (b->'$.daily.temperature_2m_max'->>i)::DOUBLE AS max_c, (b->'$.daily.temperature_2m_min'->>i)::DOUBLE AS min_c, (b->'$.daily.precipitation_sum'->>i)::DOUBLE AS precipitation_mm FROM (SELECT key, b, unnest(range(json_array_length(b->'$.daily.time')::BIGINT))::INT AS i FROM {_OK(WEATHER)}) LEFT JOIN {_COND} ON code = (b->'$.daily.weather_code'->>i)::INT")
def live_forecast(spark, sf_dir):
    return live.forecast(spark.createDataFrame(WEATHER, _A))


@query(f"SELECT key, coalesce(b->>'$.base', upper(key)) AS base, b->>'$.date' AS date, k AS currency, (b->'$.rates'->>k)::DOUBLE AS rate FROM (SELECT key, b, unnest(json_keys(b->'$.rates')) AS k FROM {_OK(RATES)})")
def live_fx(spark, sf_dir):
    return live.fx(spark.createDataFrame(RATES, _A))


@query(f"WITH a AS (SELECT key, b, unnest(json_keys(b)) AS asset FROM {_OK(COINS)}) SELECT key, asset, 'usd' AS currency, (b->asset->>'$.usd')::DOUBLE AS price, (b->asset->>'$.usd_24h_change')::DOUBLE AS change_24h, max((b->asset->>'$.last_updated_at')::BIGINT) OVER (PARTITION BY key) AS observed FROM a")
def live_crypto(spark, sf_dir):
    return live.crypto(spark.createDataFrame(COINS, _A)).select("key", "asset", "currency", "price", "change_24h", F.unix_seconds("observed_at").alias("observed"))


@query(f"SELECT key, m->>'$.symbol' AS symbol, p AS price, c AS previous_close, round(p - c, 4) AS change, round((p - c) / c * 100, 3) AS change_pct, '2024-01-30:9.5,2024-02-01:12.5' AS closes FROM (SELECT key, b->'$.chart.result[0].meta' AS m, (b->>'$.chart.result[0].meta.regularMarketPrice')::DOUBLE AS p, (b->>'$.chart.result[0].meta.chartPreviousClose')::DOUBLE AS c FROM {_OK(STOCKS)}) WHERE m IS NOT NULL")
def live_stock(spark, sf_dir):
    own = live.stock(spark.createDataFrame(STOCKS, _A))
    return own.select("key", "symbol", "price", "previous_close", "change", "change_pct", F.array_join(F.transform("closes", lambda x: F.concat(x["date"], F.lit(":"), x["close"].cast("string"))), ",").alias("closes"))


@query(f"WITH r AS (SELECT key, indicator, unnest(from_json(body::JSON->1, '[\"JSON\"]')) AS x, generate_subscripts(from_json(body::JSON->1, '[\"JSON\"]'), 1) AS i FROM {values(SERIES)} v(key, indicator, status, body) WHERE indicator IN ({', '.join(q.lit(x[0]) for x in live.INDICATORS)})) SELECT key, indicator, x->>'$.country.value' AS country, x->>'$.date' AS year, (x->>'$.value')::DOUBLE AS value, row_number() OVER (PARTITION BY key, indicator ORDER BY i) = 1 AS is_latest FROM r WHERE x->>'$.value' IS NOT NULL")
def live_indicator(spark, sf_dir):
    return live.indicator(spark.createDataFrame(SERIES, "key string, indicator string, status int, body string"))


@query("SELECT n_name AS code, CASE WHEN n_nationkey = 0 THEN '2022' END AS population_year, CASE WHEN n_nationkey = 0 THEN 85.3::DOUBLE END AS population FROM nation")
def country_population(spark, sf_dir):
    """Countries with their population where a series is known: the series of 'tr' stands for the first nation's here."""
    first = table(spark, sf_dir, "nation").where("n_nationkey = 0").select("n_name")
    series = live.indicator(spark.createDataFrame(SERIES, "key string, indicator string, status int, body string")).where("key = 'tr'").crossJoin(first).withColumn("key", F.col("n_name")).drop("n_name")  # one row
    return live.with_population(table(spark, sf_dir, "nation").select(F.col("n_name").alias("code")), series)


NAMES = ["Türkiye", "ÇİN", "Côte d'Ivoire", "IRAK", "ığüşöç 12", ""]


@query(f"SELECT doc_id, regexp_replace(lower(translate(left(text, 40), '{live.LETTERS[0]}', '{live.LETTERS[1]}')), '[^a-z0-9]', '', 'g') AS plain FROM documents")
def plain_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", live.plain_name(F.left("text", F.lit(40))).alias("plain"))


# ---- pages ----

_STATUS = "[200, 202, 403, 429][page_id % 4 + 1]"
_SIGNS = "|".join(pages.ROBOT_TESTS)


@query(f"SELECT page_id, coalesce(regexp_matches({q.host('url')}, '(^|\\.)({'|'.join(x.replace('.', '[.]') for x in pages.UNEXTRACTABLE)})$'), FALSE) AS snippet_only, {_STATUS} IN (202, 403, 429) AND regexp_matches(lower(left(html, 4000)), '{_SIGNS}') AS robot_test, length(html) < 250 AND regexp_matches(html, {q.lit('(?i)(' + pages.NEEDS_SCRIPTS + ')')}) AS scripts FROM pages")
def page_rules(spark, sf_dir):
    own = table(spark, sf_dir, "pages")
    status = F.element_at(F.array(*map(F.lit, (200, 202, 403, 429))), (F.col("page_id") % 4 + 1).cast("int"))
    return own.select("page_id", pages.is_unextractable(F.col("url")).alias("snippet_only"), pages.is_robot_test(status, F.col("html")).alias("robot_test"), pages.needs_scripts(F.col("html")).alias("scripts"))


RULES = [(1, "https://meta.stackexchange.com/q/1", 403, "Please verify you are HUMAN", "Enable JavaScript to go on"), (2, "https://notstackoverflow.com/", 200, "captcha", "x" * 300 + " noscript"), (3, "not an address", 429, "x" * 4000 + "captcha", None), (4, "https://news.google.com/a", 202, "CF-Challenge", "JavaScript'i etkinleştir")]


@query("SELECT * FROM (VALUES (1, TRUE, TRUE, TRUE), (2, FALSE, FALSE, FALSE), (3, FALSE, FALSE, FALSE), (4, TRUE, TRUE, TRUE)) v(id, snippet_only, robot_test, scripts)")
def page_rule_cases(spark, sf_dir):
    """Hosts by whole labels, signs only with a status and near the start, scripts only on short pages."""
    own = spark.createDataFrame(RULES, "id int, url string, status int, body string, content string")
    return own.select("id", pages.is_unextractable(F.col("url")).alias("snippet_only"), pages.is_robot_test(F.col("status"), F.col("body")).alias("robot_test"), pages.needs_scripts(F.col("content")).alias("scripts"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM l WHERE contains({q.normalize('line')}, 'the')) SELECT doc_id, place, md5(left(line, 400)) AS context FROM h WHERE place <= 10")
def page_find(spark, sf_dir):
    out = pages.find(table(spark, sf_dir, "documents"), "doc_id", " The! ", "text")
    return out.select("doc_id", F.col("place").cast("long").alias("place"), F.md5(F.col("context").cast("binary")).alias("context"))


LINKS = [(1, 0, "Home", "https://x.example/"), (1, 1, "About us", "https://x.example/about"), (1, 2, "About", "https://x.example/a"), (1, 3, "Next »", "https://x.example/2"), (2, 0, "Archive", "https://y.example/?page=2"), (2, 1, "3", "https://y.example/?page=3"), (3, 0, "Contact", "https://z.example/c"), (3, 1, "Sonraki", "https://z.example/n")]
WANTED = [(1, "about"), (1, "us"), (2, "nothing"), (3, "CONTACT!")]


@query("SELECT * FROM (VALUES (1, 'about', 'https://x.example/a', 'https://x.example/2'), (1, 'us', 'https://x.example/about', 'https://x.example/2'), (2, NULL, NULL, 'https://y.example/?page=2'), (3, 'CONTACT!', 'https://z.example/c', 'https://z.example/n')) v(page, label, url, next)")
def page_links(spark, sf_dir):
    """Links by their text, the whole text before a part of it, and the way to the next page."""
    own = spark.createDataFrame(LINKS, "page int, pos int, text string, url string")
    asked = spark.createDataFrame(WANTED, "page int, label string")
    return pages.next_link(own).withColumnRenamed("url", "next").join(pages.link_for(own, asked), "page", "left").select("page", "label", "url", "next")


@query("SELECT * FROM (VALUES (1, 'şık'), (2, 'é'), (3, 'é'), (4, 'é'), (5, NULL)) v(id, body)")
def page_charsets(spark, sf_dir):
    """By the header, by the page's own tag, by default, and by default where the name isn't known."""
    rows = [(1, bytearray("şık".encode("windows-1254")), "text/html; charset=windows-1254"), (2, bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (3, bytearray("é".encode()), ""), (4, bytearray("é".encode()), "text/html; charset=no-such"), (5, None, "text/html")]
    own = spark.createDataFrame(rows, "id int, raw binary, kind string")
    return own.select("id", pages.decoded(F.col("raw"), F.col("kind")).alias("body"))


@query(f"SELECT page_id, coalesce({q.host('url')}, '') AS host FROM pages")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(u.host(F.col("url")), F.lit("")).alias("host"))


@query("""SELECT * FROM (VALUES (1, 'a & b'), (2, 'Ω £ A'), (3, '<x> "q"'), (4, '&copy; &#x110000; &#55296; &'), (5, '&lt;')) v(id, body)""")
def entities_decoded(spark, sf_dir):
    own = spark.createDataFrame([(1, "a &amp; b"), (2, "&#937; &#163; &#x41;"), (3, "&LT;x&gt; &quot;q&quot;"), (4, "&copy; &#x110000; &#55296; &"), (5, "&amp;lt;")], "id int, body string")
    return own.select("id", extract.all_entities(F.col("body")).alias("body"))


@query("SELECT event_type AS source, count(*) AS calls, round(1 - avg((event_id % 5 = 0)::INT::DOUBLE), 6) AS success_rate FROM events GROUP BY 1")
def source_health(spark, sf_dir):
    """Sources by success rate, the worst first, those with more calls before others."""
    own = table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), (F.col("event_id") % 5 != 0).alias("ok"))
    return ops.health(own).select(F.col("op").alias("source"), "calls", "success_rate")


DATED = [
    (1, '<meta property="article:published_time" content="2024-01-02T03:04:05Z"><meta name="lastmod" content="2024-02-03">'),
    (2, '<meta content="2024-01-05" itemprop="datePublished">'),
    (3, '<script type="application/ld+json">{"@graph":[{"datePublished":"2024-01-06","dateModified":"2024-01-07"}]}</script>'),
    (4, "<p>no date</p>"),
]


@query("SELECT id, published, modified FROM (VALUES (1, '2024-01-02 03:04:05', '2024-02-03 00:00:00'), (2, '2024-01-05 00:00:00', NULL), (3, '2024-01-06 00:00:00', '2024-01-07 00:00:00'), (4, NULL, NULL)) v(id, published, modified)")
def page_dates(spark, sf_dir):
    """Dates of meta tags, attributes in either order, then of JSON-LD."""
    html = F.col("html")
    ld = extract.json_ld_dates(html)
    show = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")
    own = spark.createDataFrame(DATED, "id int, html string").withColumn("ld", ld)
    return own.select("id", show(F.coalesce(extract.meta_date(html, extract.PUBLISHED), F.col("ld.published"))).alias("published"), show(F.coalesce(extract.meta_date(html, extract.MODIFIED), F.col("ld.modified"))).alias("modified"))


# ---- research ----


ALPHA, BETA = "The Alpha engine reached 340 kilometres in 1998 according to the official measured records.", "The Beta engine weighs 20 tonnes and was built in 1977 by the works."
SOURCES = [("alpha engine", False, 1, "https://a.example/1", "a", ALPHA), ("alpha engine", False, 2, "https://b.example/1", "b", ALPHA), ("beta engine", False, 1, "https://c.example/1", "c", BETA), ("beta engine ", True, 1, "https://d.example/2", "d", BETA)]


def _report(spark):
    known = spark.createDataFrame(SOURCES, "asked string, more boolean, ord int, url string, host string, text string")

    def lookup(planned):
        own = planned.join(known, (F.col("query") == F.col("asked")) | (F.col("more") & F.startswith(F.col("query"), F.col("asked"))))
        return own.select("query_id", "ord", "url", F.col("url").alias("title"), "host", F.lit(0.5).alias("credibility"), "text")

    return research.research(spark.createDataFrame([(7, "alpha engine, beta engine")], "query_id int, query string"), lookup, "standard")


@query("SELECT 7 AS question_id, * FROM (VALUES (700, 'alpha engine', 'https://a.example/1,https://b.example/1', FALSE), (701, 'beta engine', 'https://c.example/1,https://d.example/2', FALSE), (702, 'alpha engine, beta engine', '', TRUE), (703, 'alpha engine, beta engine tanım', '', TRUE), (704, 'alpha engine, beta engine nasıl çalışır', '', TRUE)) v(query_id, query, urls, is_gap)")
def research_sections(spark, sf_dir):
    """Five angles of a question; the one with a single source is searched again and gets a second."""
    return _report(spark)["sections"].select("question_id", "query_id", "query", F.array_join("urls", ",").alias("urls"), "is_gap")


# ---- what leaves the engine ----

UNSAFE = [(1, "https://example.com/a", "plain words"), (2, "https://www.pornhub.example/", "x"), (3, "https://example.com/b", "XXX films"), (4, "no address", "plain"), (5, "https://essex.example/", "the escort of a ship"), (6, "https://sussex.example/", "a denuded hill")]


@query("SELECT * FROM (VALUES (1, FALSE, 'unknown'), (2, TRUE, 'unknown'), (3, TRUE, 'unknown'), (4, TRUE, 'unknown'), (5, TRUE, 'unknown'), (6, FALSE, 'unknown')) v(id, unsafe, class)")
def url_safety(spark, sf_dir):
    own = spark.createDataFrame(UNSAFE, "id int, url string, body string")
    return own.select("id", u.is_unsafe(F.col("url"), F.col("body")).alias("unsafe"), u.host_class(F.coalesce(u.host(F.col("url")), F.lit(""))).alias("class"))


_SEEN = f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE replace({q.q(HOSTS)}[page_id % {len(HOSTS)} + 1], '://', CASE WHEN page_id % 2 = 0 THEN '://sub' || page_id || '.' ELSE '://' END) END AS url FROM pages"


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(h, {q.lit('|'.join(p))}) THEN {q.lit(k)}" for k, _, p in u.HOST_CLASSES) + f" ELSE 'unknown' END AS class, h AS host FROM (SELECT page_id, {q.host('url')} AS h FROM ({_SEEN})) WHERE h IS NOT NULL")
def host_classes(spark, sf_dir):
    """Pages' own hosts, and known hosts with or without a subdomain made of the page's number."""
    n = F.col("page_id")
    named = F.replace(F.get(F.array(*map(F.lit, HOSTS)), (n % len(HOSTS)).cast("int")), F.lit("://"), F.when(n % 2 == 0, F.concat(F.lit("://sub"), n.cast("string"), F.lit("."))).otherwise("://"))
    own = table(spark, sf_dir, "pages").select("page_id", u.host(F.when(n % 3 == 0, F.col("url")).otherwise(named)).alias("host")).where("host is not null")
    return own.select("page_id", u.host_class(F.col("host")).alias("class"), "host")


@query("SELECT source, '{\"source\":\"' || source || '\",\"count\":' || count(*) || ',\"results\":[' || string_agg('{\"rank\":' || rank || ',\"id\":' || doc_id || '}', ',' ORDER BY rank) || ']}' AS body FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE source IS NOT NULL) WHERE rank <= 3 GROUP BY source")
def envelopes(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("source is not null")
    own = own.withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rank <= 3")
    return sinks.envelope(own.select("source", "rank", F.col("doc_id").alias("id")), ["source"])


@query("SELECT doc_id AS query_id, 1 AS rank, lang AS title, source AS url, left(text, 40) AS snippet, n_chars / 1000 AS relevance FROM documents")
def shaped_sources(spark, sf_dir):
    """The lighter mode drops the content alone."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.lit(1).alias("rank"), F.col("lang").alias("title"), F.col("source").alias("url"), F.col("text").alias("content"), F.expr("left(text, 40)").alias("snippet"), (F.col("n_chars") / 1000).alias("relevance"))
    return sinks.shape(own, "sources")
