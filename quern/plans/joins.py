"""Queries of lookups, request checks and shapes over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import urls as u
from quern.operators import claims, fuse, lookups, params
from quern.operators.durable import shared
from quern.plans import sql as q
from quern.plans.catalog import _LISTS as _RANKED
from quern.plans.catalog import HOSTS
from quern.plans.catalog import lists as ranked_lists
from quern.plans.catalog import query, table, values
from quern.sources import stored

_H = f"h AS (SELECT page_id, {q.host('url')} AS h FROM pages), n AS (SELECT page_id, h, string_split(h, '.') AS p FROM h WHERE h IS NOT NULL)"
_LISTS = "CASE page_id % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'include' WHEN 2 THEN 'blocked' ELSE 'exclude' END AS kind"


@query(
    f"""WITH {_H}, l AS (SELECT (page_id * 7) % 40 AS list_id, {_LISTS}, CASE page_id % 4 WHEN 0 THEN array_to_string(p[-3:], '.') WHEN 1 THEN array_to_string(p[-2:], '.') ELSE h END AS d FROM n),
a AS (SELECT DISTINCT list_id, d FROM l WHERE kind = 'allowed'), i AS (SELECT DISTINCT list_id, d FROM l WHERE kind = 'include'),
w AS (SELECT DISTINCT a.list_id, CASE WHEN a.d = i.d OR ends_with(a.d, '.' || i.d) THEN a.d WHEN ends_with(i.d, '.' || a.d) THEN i.d END AS d FROM a JOIN i USING (list_id)),
allow AS (SELECT list_id, d FROM w WHERE d IS NOT NULL UNION ALL SELECT list_id, d FROM a WHERE list_id NOT IN (SELECT list_id FROM i) UNION ALL SELECT list_id, d FROM i WHERE list_id NOT IN (SELECT list_id FROM a)),
s AS (SELECT page_id, page_id % 40 AS list_id, h FROM h),
r AS (SELECT s.*, (SELECT arg_max(d, length(d)) FROM allow WHERE allow.list_id = s.list_id AND (h = d OR ends_with(h, '.' || d))) AS al, (SELECT arg_max(d, length(d)) FROM l WHERE l.list_id = s.list_id AND kind IN ('blocked', 'exclude') AND (h = d OR ends_with(h, '.' || d))) AS bl FROM s)
SELECT page_id, coalesce(bl, al) AS rule, h IS NOT NULL AND bl IS NULL AND (al IS NOT NULL OR list_id NOT IN (SELECT list_id FROM l WHERE kind IN ('allowed', 'include'))) AS passes FROM r"""
)
def domain_lists(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select("page_id", u.host(F.col("url")).alias("host"))
    parts, k = F.split("host", r"\."), F.col("page_id") % 4
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    kind = F.element_at(F.array(*map(F.lit, ("allowed", "include", "blocked", "exclude"))), k.cast("int") + 1)
    domain = F.when(k == 0, last(3)).when(k == 1, last(2)).when(k == 2, F.concat(F.lit("*."), F.col("host"))).otherwise(F.upper("host"))
    lists = own.where("host is not null").select((F.col("page_id") * 7 % 40).alias("list_id"), kind.alias("kind"), domain.alias("domain"))
    return lookups.pass_lists(own.select((F.col("page_id") % 40).alias("list_id"), "host", "page_id"), lists).select("page_id", "rule", "passes")


@query(
    """WITH p AS (SELECT lang, left(text, 3 + doc_id % 9) AS p, doc_id AS o FROM documents WHERE doc_id % 10 = 0 AND text IS NOT NULL)
SELECT doc_id, arg_min(p, o) AS found FROM documents d LEFT JOIN p ON p.lang IS NOT DISTINCT FROM d.lang AND starts_with(d.text, p.p) GROUP BY doc_id"""
)
def first_prefixes(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    prefixes = own.where("doc_id % 10 = 0 and text is not null").select("lang", F.expr("left(text, cast(3 + doc_id % 9 as int))").alias("p"), F.col("doc_id").alias("o"))
    return lookups.first_prefix(own, prefixes, ["lang"], "text", "p", "o").select("doc_id", "found")


_ORIGIN = "regexp_replace(regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"
_FROM, _TO = _ORIGIN.format("url"), _ORIGIN.format("nxt")


@query(
    f"""WITH RECURSIVE c AS (SELECT a.url, CASE WHEN a.page_id % 3 <> 0 THEN 301 ELSE 200 END AS status, CASE WHEN a.page_id % 3 = 0 OR a.page_id % 11 = 0 THEN NULL WHEN a.page_id % 7 = 1 THEN '/moved/' || a.page_id ELSE b.url END AS loc
      FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url) a LEFT JOIN (SELECT page_id, url FROM pages) b ON b.page_id = a.page_id // 2),
f AS (SELECT page_id, url, 0 AS hop, true AS keeps FROM pages
      UNION ALL SELECT page_id, nxt, hop + 1, keeps AND {_FROM} = {_TO}
      FROM (SELECT f.page_id, f.url, hop, keeps, CASE WHEN starts_with(loc, '/') THEN {_ORIGIN.format("f.url")} || loc ELSE loc END AS nxt FROM f JOIN c ON c.url = f.url WHERE status = 301 AND hop < 3) WHERE nxt IS NOT NULL),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY hop DESC) = 1),
s AS (SELECT page_id, hop, status FROM f LEFT JOIN c ON c.url = f.url)
SELECT l.page_id, l.url AS final_url, l.hop AS hops, (SELECT arg_max(s.status, s.hop) FROM s WHERE s.page_id = l.page_id AND s.status IS NOT NULL) AS status,
       CASE WHEN c.url IS NULL THEN 'missing' WHEN c.status = 301 AND loc IS NULL THEN 'no_target' WHEN c.status = 301 THEN 'too_many' END AS error, keeps AS keeps_credentials FROM l LEFT JOIN c ON c.url = l.url"""
)
def redirect_chains(spark, sf_dir):
    """Each page leads to the page of half its number, unless that number is a multiple of three."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = pages.groupBy("url").agg(F.min("page_id").alias("n"))
    to = pages.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"))
    n = F.col("n")
    crawl = own.join(to, F.expr("n div 2 = _p"), "left").select("url", F.when(n % 3 != 0, 301).otherwise(200).alias("status"), F.when((n % 3 == 0) | (n % 11 == 0), None).when(n % 7 == 1, F.concat(F.lit("/moved/"), n.cast("string"))).otherwise(F.col("_u")).alias("location"))
    return lookups.follow(pages.select("url", "page_id"), crawl).drop("url")


@query(
    """WITH r AS (SELECT doc_id // 20 AS request_id, doc_id % 20 AS place, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 50 = 7 THEN '4' ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 97 = 5 THEN ' ' ELSE repeat(text, CASE WHEN doc_id % 61 = 0 THEN 30 ELSE 1 END) END AS text FROM documents WHERE doc_id % 3 <> 0
           UNION ALL SELECT -1, doc_id // 3, doc_id::VARCHAR, text FROM documents WHERE doc_id % 3 = 0),
x AS (SELECT request_id, place, regexp_matches(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]') AS filled, length(text) AS n, sum(length(text)) OVER (PARTITION BY request_id ORDER BY place) AS upto, row_number() OVER (PARTITION BY request_id, coalesce(nullif(id, ''), place::VARCHAR) ORDER BY place) AS nth FROM r),
f AS (SELECT request_id, place, CASE WHEN NOT filled THEN 'no_text' WHEN n > 40000 THEN 'too_long' WHEN upto > 1500000 THEN 'too_much' WHEN nth > 1 THEN 'repeated_id' END AS reason FROM x),
c AS (SELECT request_id, count(*) AS documents FROM r GROUP BY request_id)
SELECT c.request_id, documents, CASE WHEN documents > 200 THEN 200 ELSE (SELECT min(place) FROM f WHERE f.request_id = c.request_id AND reason IS NOT NULL) END AS error_place,
       CASE WHEN documents > 200 THEN 'too_many' ELSE (SELECT arg_min(reason, place) FROM f WHERE f.request_id = c.request_id AND reason IS NOT NULL) END AS reason FROM c"""
)
def inline_document_checks(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = own.where("doc_id % 3 <> 0").select(F.expr("doc_id div 20").alias("request_id"), (F.col("doc_id") % 20).alias("place"), F.expr("case when doc_id % 9 = 0 then null when doc_id % 50 = 7 then '4' else cast(doc_id as string) end").alias("id"), F.expr("case when doc_id % 97 = 5 then ' ' else repeat(text, if(doc_id % 61 = 0, 30, 1)) end").alias("text"))
    return lookups.inline_documents(rows.unionByName(own.where("doc_id % 3 = 0").select(F.lit(-1).cast("long").alias("request_id"), F.expr("doc_id div 3").alias("place"), F.col("doc_id").cast("string").alias("id"), "text")))


_RAW = """SELECT doc_id, ['day', 'Week', '12', 'never', NULL, '-3', ' 7.5 '][doc_id % 7 + 1] AS fresh, CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN lang || '-' || upper(lang) WHEN 2 THEN upper(lang) END AS locale,
CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'x' || n_chars ELSE n_chars::VARCHAR END AS n, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 8 = 1 THEN [source, 'no domain'] ELSE ['https://' || source || '.example/x', '*.B.example'] END AS domains FROM documents"""


@query(
    f"""WITH r AS ({_RAW}), p AS (SELECT doc_id, fresh IS NOT NULL AS gf, locale IS NOT NULL AS gl, n IS NOT NULL AS gn, domains IS NOT NULL AS gd, coalesce(w.h, CASE WHEN try_cast(trim(fresh) AS DOUBLE) > 0 THEN try_cast(trim(fresh) AS DOUBLE) END) AS fresh, CASE WHEN regexp_matches(locale, '^[a-z]{{2}}(-[A-Z]{{2}})?$') THEN locale END AS locale,
  CASE WHEN n IS NULL THEN 10 WHEN try_cast(n AS DOUBLE) IS NOT NULL THEN least(greatest(floor(try_cast(n AS DOUBLE) + 0.5), 1), 30)::INT END AS n, list_transform(domains, lambda x: regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '^https?://', ''), '^\\*\\.', ''), '/.*$', '')) AS d
  FROM r LEFT JOIN {values(params.WINDOWS)} w(name, h) ON name = lower(fresh)),
v AS (SELECT *, CASE WHEN len(list_filter(d, lambda x: NOT regexp_matches(x, '^[a-z0-9.-]+\\.[a-z]{{2,}}$'))) = 0 THEN array_to_string(d, ',') END AS domains FROM p)
SELECT doc_id, fresh, locale, n, domains, CASE WHEN gf AND fresh IS NULL THEN 'fresh' WHEN gl AND locale IS NULL THEN 'locale' WHEN gn AND n IS NULL THEN 'n' WHEN gd AND domains IS NULL THEN 'domains' END AS error_field FROM v"""
)
def request_checks(spark, sf_dir):
    """Requests made of documents, good and bad: a value that was given without a meaning is an error, one that is absent is none."""
    raw = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "array('day', 'Week', '12', 'never', null, '-3', ' 7.5 ')[cast(doc_id % 7 as int)] as fresh", "case doc_id % 4 when 0 then lang when 1 then lang || '-' || upper(lang) when 2 then upper(lang) end as locale",
        "case when doc_id % 6 = 0 then null when doc_id % 13 = 0 then 'x' || n_chars else cast(n_chars as string) end as n", "case when doc_id % 5 = 0 then null when doc_id % 8 = 1 then array(source, 'no domain') else array('https://' || source || '.example/x', '*.B.example') end as domains",
    )
    x = {k: F.col(k) for k in raw.columns}
    out = params.parsed(raw, {"fresh": params.freshness(x["fresh"]), "locale": params.locale(x["locale"]), "n": params.whole_number(x["n"], 1, 30, 10), "domains": params.domains(x["domains"])})
    return out.select("doc_id", "fresh", "locale", "n", F.array_join("domains", ",").alias("domains"), "error_field")


_STORED = "SELECT 'p' || (page_id % 4) AS provider, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * (page_id * 5 % 240) AS fetched_at, page_id AS place, url FROM pages"


@query(f"SELECT provider, epoch_ms(fetched_at) AS fetched_ms, place, url FROM ({_STORED}) WHERE provider IN ('p1', 'p3') AND fetched_at >= TIMESTAMP '2024-01-03 12:00:00' AND fetched_at < TIMESTAMP '2024-01-09 00:00:00' AND place % 2 = 1 AND url LIKE 'https%'")
def stored_answers(spark, sf_dir):
    """Pages stored as answers of four providers over ten days, then read through the data source: files are chosen by provider and day."""
    own = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), (F.col("page_id") % 4).cast("string")).alias("provider"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(page_id * 5 % 240 as int))").alias("fetched_at"), F.col("page_id").cast("int").alias("place"), "url", F.lit("").alias("title"), F.lit("").alias("snippet"))
    folder = f"{shared(spark)}/answers-{uuid.uuid4().hex[:12]}"
    stored.store(own, folder)
    wanted = stored.answers(spark, folder).where("provider in ('p1', 'p3') and fetched_at >= timestamp'2024-01-03 12:00:00' and fetched_at < timestamp'2024-01-09 00:00:00' and place % 2 = 1 and url like 'https%'")
    return wanted.select("provider", F.unix_millis("fetched_at").alias("fetched_ms"), "place", "url")


@query(f"""SELECT doc_id, array_to_string([n || ' {claims.BASIS[0]}', '{claims.BASIS[1]} ' || printf('%.2f', c)] || CASE WHEN k > 0 THEN [k || ' {claims.BASIS[2]}'] ELSE [] END, '; ') AS basis
FROM (SELECT doc_id, doc_id % 7 + 1 AS n, (n_chars % 101)::DOUBLE / 100 AS c, n_chars % 5 AS k FROM documents)""")
def confidence_basis(spark, sf_dir):
    n, c, k = F.col("doc_id") % 7 + 1, (F.col("n_chars") % 101).cast("double") / 100, F.col("n_chars") % 5
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(claims.basis(n, c, k), "; ").alias("basis"))


@query(f"WITH {_RANKED} SELECT query_id, string_agg(provider, '+' ORDER BY o) AS provider, count(*) AS providers FROM (SELECT query_id, provider, min(list_ord) AS o FROM l GROUP BY query_id, provider) GROUP BY query_id")
def provider_concat(spark, sf_dir):
    return fuse.provider_names(ranked_lists(spark, sf_dir))


def _by_class(values_of: list[str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(h, {q.lit('|'.join(p))}) THEN {x}" for (_, _, p), x in zip(u.HOST_CLASSES, values_of, strict=True)) + f" ELSE {other} END"


@query(f"""SELECT page_id, CASE WHEN h IS NULL THEN {q.lit(fuse.NO_ADDRESS)} ELSE array_to_string(list_filter([{_by_class([q.lit(x) for x in fuse.CLASS_SIGNALS], 'NULL')}, CASE WHEN regexp_matches(h, {q.lit('|'.join(u.LOW_TRUST))}) THEN {q.lit(fuse.LOW_TRUST)} END,
CASE WHEN starts_with(url, 'http://') THEN {q.lit(fuse.PLAIN_HTTP)} END, CASE WHEN n > 1200 THEN {q.lit(fuse.FULL)} WHEN n < 200 THEN {q.lit(fuse.EMPTY)} END], lambda x: x IS NOT NULL), ',') END AS signals,
coalesce({_by_class([str(s in fuse.PRIMARY).upper() for _, s, _ in u.HOST_CLASSES], 'FALSE')}, FALSE) AS is_primary
FROM (SELECT page_id, url, {q.host('url')} AS h, length(html) % 2400 AS n FROM (SELECT page_id, html, CASE WHEN page_id % 3 = 0 THEN url ELSE replace({q.q(HOSTS)}[page_id % {len(HOSTS)} + 1], '://', CASE WHEN page_id % 2 = 0 THEN '://sub' || page_id || '.' ELSE '://' END) END AS url FROM pages))""")
def credibility_signals(spark, sf_dir):
    """Pages' own addresses, and known hosts with or without a subdomain made of the page's number."""
    n = F.col("page_id")
    named = F.replace(F.get(F.array(*map(F.lit, HOSTS)), (n % len(HOSTS)).cast("int")), F.lit("://"), F.when(n % 2 == 0, F.concat(F.lit("://sub"), n.cast("string"), F.lit("."))).otherwise("://"))
    own = table(spark, sf_dir, "pages").select("page_id", F.when(n % 3 == 0, F.col("url")).otherwise(named).alias("url"), (F.length("html") % 2400).alias("n"))
    out = own.select("page_id", fuse.assessment(F.col("url"), F.col("n")).alias("a"))
    return out.select("page_id", F.array_join("a.signals", ",").alias("signals"), "a.is_primary")
