"""Query plans: addresses in a query, intent, freshness, clean text, language, sub-questions. One select over a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as t

# ---- fixed values ----
NEWS_MARKERS = ["son", "dakika", "haber", "haberi", "haberler", "haberleri", "gundem", "guncel", "manset", "breaking", "news", "latest", "headlines", "update", "updates"]
INTENTS = [
    ("news", [r"\b(haber\w*|manşet\w*|gündem\w*)", r"\bson dakika\b", r"\b(breaking news|latest news|news about|in the news)\b", r"\b(announced|announcement|press release)\b", r"\b(bugün|bugun|dün|dun|this week|today|yesterday)\b"]),
    ("finance", [r"\b(fiyat|kur|dolar|euro|borsa|hisse|faiz|enflasyon|kripto|bitcoin)\b", r"\b(price|stock|shares|market cap|exchange rate|inflation|crypto)\b"]),
    ("product", [r"\b(satin al|satın al|kac para|kaç para|indirim|model|ozellik|özellik|karsilastir|karşılaştır)\b", r"\b(buy|review|vs\.?|compare|best|cheapest|specs|pricing)\b"]),
    ("academic", [r"\b(makale|arastirma|araştırma|calisma|çalışma|literatur|literatür|tez|doi)\b", r"\b(paper|study|research|journal|meta-analysis|preprint|arxiv)\b"]),
    ("technical", [r"\b(hata|kod|kurulum|api|kutuphane|kütüphane|framework|derleme)\b", r"\b(error|exception|install|npm|pip|docker|kubernetes|typescript|python|sdk|library)\b"]),
]
FRESHNESS = [(r"\b(son dakika|su an|şu an|right now|breaking news)\b", 1), (r"\b(bugun|bugün|today|son 24 saat)\b", 24), (r"\b(bu hafta|this week|son 7 gun|son 7 gün)\b", 168), (r"\b(bu ay|this month|son 30 gun|son 30 gün)\b", 720), (r"\b(20\d\d)\b", 8760)]
NATURAL_FRESHNESS = {"news": 24, "finance": 6}
FACETS = {
    "news": ["son gelişmeler", "arka plan", "tepkiler"],
    "finance": ["güncel veriler", "geçmiş eğilim", "uzman yorumları"],
    "product": ["özellikler", "fiyat", "alternatifler", "kullanıcı yorumları"],
    "academic": ["bulgular", "yöntem", "eleştiriler"],
    "technical": ["nasıl yapılır", "yaygın hatalar", "en iyi uygulamalar"],
    "general": ["tanım", "nasıl çalışır", "avantajlar ve dezavantajlar", "örnekler"],
}
BROWSABLE = [
    "com", "org", "net", "edu", "gov", "int", "mil", "io", "ai", "dev", "app", "co", "me", "info", "biz", "news", "blog", "tech", "xyz", "site", "online",
    "tr", "uk", "de", "fr", "nl", "es", "it", "se", "no", "fi", "dk", "pl", "pt", "ru", "ua", "jp", "cn", "kr", "in", "br", "mx", "ca", "au", "nz", "ch", "at",
    "be", "cz", "gr", "il", "ie", "hu", "ro", "bg", "rs", "hr", "sk", "si", "lt", "lv", "ee", "is", "eu",
]
POLITE = r"(?i)^(?:bana|lutfen|lütfen|please|can you|could you|acaba)\s+"
FILLER = r"\b(soyler misin|söyler misin|anlat|acikla|açıkla|tell me|explain)\b"
# ----------------------


def intent(query: Column) -> Column:
    """The first intent one of whose patterns matches, else general."""
    out = None
    for name, patterns in INTENTS:
        hit = t.matches(query, [p.replace(r"\w", "[A-Za-z0-9_]") for p in patterns])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def freshness_hours(query: Column, kind: Column) -> Column:
    """A window that the wording names, else the one that the intent has by nature, else null."""
    out = None
    for p, hours in FRESHNESS:
        own = F.when(t.matches(query, p), hours) if out is None else out.when(t.matches(query, p), hours)
        out = own
    for name, hours in NATURAL_FRESHNESS.items():
        out = out.when(kind == name, hours)
    return out


def clean(query: Column, kind: Column | None = None) -> Column:
    """The query without courtesy, fillers, final marks and stop words (also news markers, for news and finance); only courtesy goes where fewer than two words would stay."""
    own = F.regexp_replace(query, POLITE, "")
    own = F.regexp_replace(own, "(?i)" + FILLER.replace(r"\b", t.EDGE), "")
    own = F.trim(F.regexp_replace(F.regexp_replace(own, "[?!]+$", ""), r"\s+", " "))
    stop, markers = F.array(*map(F.lit, t.PLAIN_STOP)), F.array(*map(F.lit, NEWS_MARKERS))
    drop = F.lit(False) if kind is None else kind.isin("news", "finance")
    kept = F.filter(F.split(own, " "), lambda x: (x != "") & ~F.array_contains(stop, t.normalize(x)) & ~(drop & F.array_contains(markers, t.normalize(x))))
    return F.when(F.size(kept) >= 2, F.array_join(kept, " ")).otherwise(own)


def language(query: Column) -> Column:
    return F.when(query.rlike("[çğıöşüÇĞİÖŞÜ]") | t.matches(query, r"\b(nedir|nasil|nasıl|kimdir|hangi|neden)\b"), "tr").otherwise("en")


def decompose(query: Column, kind: Column, most: int) -> Column:
    """Parts between conjunctions that say something, the whole, and facets of the intent, distinct, up to `most`."""
    own = clean(query)
    parts = F.filter(F.transform(F.split(own, r"(?i)\s+(?:ve|veya|ile birlikte|and|or|as well as)\s+|[;,]\s+"), lambda x: F.trim(x)), lambda x: F.size(t.plain_tokens(x)) >= 2)
    facets = None
    for name, values in FACETS.items():
        row = F.array(*[F.concat(own, F.lit(" " + v)) for v in values])
        facets = F.when(kind == name, row) if facets is None else facets.when(kind == name, row)
    several = F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(several, F.array(own), facets)), 1, most)


def trim_mark(x: Column) -> Column:
    """An address without the sentence's punctuation after it; a closing bracket that it opened itself stays."""
    marks = ".,;:!?\\]}»”’"
    own = F.length(F.regexp_replace(x, "[^)]", "")) > F.length(F.regexp_replace(x, "[^(]", ""))
    return F.when(own, F.regexp_replace(x, f"[){marks}]+$", "")).otherwise(F.regexp_replace(x, f"[{marks}]+$", ""))


def addresses(query: Column, most: int = 3) -> Column:
    """(urls, remainder): addresses with a scheme, then bare hosts of a browsable suffix; distinct, without credentials, up to `most`."""
    schemed = F.transform(F.regexp_extract_all(query, F.lit("(?i)https?://[^\\s<>\"'`]+"), F.lit(0)), trim_mark)
    rest = F.aggregate(schemed, query, lambda a, x: F.replace(a, x, F.lit(" ")))
    bare = F.transform(F.regexp_extract_all(rest, F.lit("(?i)" + t.EDGE + "(?:www\\.)?(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\\.)+[a-z]{2,}(?:/[^\\s<>\"'`]*)?"), F.lit(0)), trim_mark)
    suffixes = F.array(*map(F.lit, BROWSABLE))
    bare = F.filter(bare, lambda x: F.array_contains(suffixes, F.element_at(F.split(F.lower(F.split(x, "/")[0]), r"\."), -1)))

    def whole(x: Column) -> Column:
        url = F.when(x.rlike("(?i)^https?://"), x).otherwise(F.concat(F.lit("https://"), x))
        host = F.try_parse_url(url, F.lit("HOST"))
        full = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.regexp_replace(F.regexp_replace(url, "(?i)^https?://", ""), "^[^/?#]*", F.lower(F.regexp_extract(url, "(?i)^https?://([^/?#]*)", 1))))
        full = F.when(full.rlike("^https?://[^/?#]*$"), F.concat(full, F.lit("/"))).otherwise(full)
        return F.when(F.contains(host, F.lit(".")) & F.try_parse_url(url, F.lit("USERINFO")).isNull(), full)

    ok = F.slice(F.array_distinct(F.array_compact(F.transform(F.concat(schemed, bare), whole))), 1, most)
    left = F.aggregate(bare, rest, lambda a, x: F.when(F.array_contains(ok, whole(x)), F.replace(a, x, F.lit(" "))).otherwise(a))
    return F.struct(ok.alias("urls"), F.trim(F.regexp_replace(left, r"\s+", " ")).alias("remainder"))


def plan(queries: DataFrame, sub_questions: int = 1) -> DataFrame:
    """queries (query_id, query) with intent, optimized, freshness_hours, language, urls, urls_only and sub_queries."""
    own = queries.withColumn("_a", addresses(F.col("query")))
    only = (F.size("_a.urls") > 0) & (F.col("_a.remainder") == "")
    own = own.withColumn("urls", F.col("_a.urls")).withColumn("urls_only", only).withColumn("_s", F.when(only | (F.col("_a.remainder") == ""), F.col("query")).otherwise(F.col("_a.remainder")))
    own = own.withColumn("intent", intent(F.col("_s")))
    own = own.withColumn("optimized", F.coalesce(F.nullif(clean(F.col("_s"), F.col("intent")), F.lit("")), F.trim("_s"))).withColumn("freshness_hours", freshness_hours(F.col("query"), F.col("intent"))).withColumn("language", language(F.col("_s")))
    subs = decompose(F.col("_s"), F.col("intent"), sub_questions) if sub_questions > 1 else F.array("optimized")
    return own.withColumn("sub_queries", subs).drop("_a", "_s")
