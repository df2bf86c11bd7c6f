"""Pages to text: titles, dates, readable blocks and links, by regular expressions over whole pages in native code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT, MAX_LINKS = 4000, 60
# ---- fixed values ----
DROPPED = ["script", "style", "noscript", "nav", "header", "footer", "aside", "svg", "form", "iframe", "template"]
BLOCKS = ["p", "li", "h1", "h2", "h3", "h4", "blockquote", "td"]
PUBLISHED = [("property", "article:published_time"), ("name", "article:published_time"), ("property", "og:published_time"), ("name", "publish-date"), ("name", "pubdate"), ("name", "date"), ("itemprop", "datePublished")]
MODIFIED = [("property", "article:modified_time"), ("name", "lastmod"), ("itemprop", "dateModified"), ("property", "og:updated_time")]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&ldquo;": "“", "&rdquo;": "”"}
FEED_ENTITIES = [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("hellip", "…"), ("rsquo", "’"), ("lsquo", "‘"), ("ldquo", "“"), ("rdquo", "”"), ("mdash", "—"), ("ndash", "–")]
# ----------------------


def once(x: Column, use) -> Column:
    """use(x), where x is computed once and not once for each use."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def firsts(items: Column, key) -> Column:
    """The first item of those with the same key, in order: sorted by key, so that no item meets all others."""

    def pick(rows: Column) -> Column:
        led = F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["k"] != x["k"]))
        return F.transform(F.array_sort(F.transform(led, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x")))), lambda x: x["x"])

    return once(F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))), pick)


def entities(x: Column) -> Column:
    """Named entities of the table, &amp; last so that nothing is decoded twice; unknown ones stay."""
    for a, b in ENTITIES.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.replace(x, F.lit("&amp;"), F.lit("&"))


def all_entities(x: Column) -> Column:
    """Numeric, hexadecimal and some named entities, in any case, each decoded once; unknown ones stay, as do numbers that are no character."""
    names = F.create_map(*[F.lit(v) for pair in FEED_ENTITIES for v in pair])

    def piece(p: Column) -> Column:
        code = F.lower(F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);", 1))
        n = F.when(F.startswith(code, F.lit("#x")), F.conv(F.substring(code, 3, 6), 16, 10)).when(F.startswith(code, F.lit("#")), F.substring(code, 2, 7)).try_cast("bigint")
        is_char = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = F.coalesce(F.try_element_at(names, code), F.when(is_char, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        return F.when((code == "") | char.isNull(), F.concat(F.lit("&"), p)).otherwise(F.concat(char, F.regexp_replace(p, "^[^;]*;", "")))

    return F.array_join(F.transform(F.split(x, "&"), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")


def plain(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(entities(F.regexp_replace(html, "<[^>]*>", "")), r"\s+", " "))


def title(html: Column, url: Column) -> Column:
    og = F.regexp_extract(html, r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']""", 1)
    own = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.coalesce(F.nullif(F.trim(entities(og)), F.lit("")), F.nullif(plain(own), F.lit("")), F.try_parse_url(url, F.lit("HOST")))


def stripped(html: Column) -> Column:
    """The page without comments and elements that hold no prose."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<(" + "|".join(DROPPED) + r")\b[^>]*>.*?</\1\s*>", "")


def container(html: Column) -> Column:
    """The first article, article body, main or main role; else the body; else all."""
    parts = [r"(?is)<article\b[^>]*>(.*?)</article>", r"""(?is)<[a-z]+[^>]*itemprop=["']articleBody["'][^>]*>(.*?)</(?:div|section|article)>""", r"(?is)<main\b[^>]*>(.*?)</main>", r"""(?is)<[a-z]+[^>]*role=["']main["'][^>]*>(.*?)</(?:div|section)>""", r"(?is)<body\b[^>]*>(.*)</body>"]
    found = lambda own, p: once(F.regexp_extract(own, p, 1), lambda x: F.when(x != "", x))
    return once(stripped(html), lambda own: F.coalesce(*[found(own, p) for p in parts], own))


def blocks(html: Column) -> Column:
    """Texts of more than 40 characters of block elements, the first of those that begin with the same 80 characters. A start tag ends what is open."""
    return _blocks(container(html))


def _blocks(content: Column) -> Column:
    tags = "|".join(BLOCKS)
    parts = F.regexp_extract_all(content, F.lit(rf"(?is)<(?:{tags})(?:\s[^>]*)?>(.*?)(?=</?(?:{tags})(?:\s[^>]*)?>|$)"), F.lit(1))
    return firsts(F.filter(F.transform(parts, plain), lambda x: F.length(x) > 40), lambda x: F.left(x, F.lit(80)))


def readable(html: Column) -> Column:
    """The blocks on lines of their own, else the container's text; up to 4000 characters."""
    text = lambda own, content: F.when(F.size(own) > 0, F.array_join(own, "\n")).otherwise(plain(content))
    return F.left(once(container(html), lambda content: once(_blocks(content), lambda own: text(own, content))), F.lit(LIMIT))


def resolved(h: Column, base: Column) -> Column:
    """An address as a page at `base` means it."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/")))
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).when(F.startswith(h, F.lit("/")), F.concat(root, h)).when(F.startswith(h, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), h)).otherwise(F.concat(folder, h))


def links(html: Column, base: Column) -> Column:
    """(text, url) of links with a text of up to 120 characters, resolved against the page's address, distinct by url, the first 60."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)(<a\b[^>]*href=["'][^"']*["'][^>]*>.*?)</a>"""), F.lit(1))
    own = F.transform(raw, lambda x: F.struct(plain(F.regexp_extract(x, r"(?is)^<a\b[^>]*>(.*)$", 1)).alias("text"), resolved(entities(F.regexp_extract(x, r"""(?is)href=["']([^"']*)["']""", 1)), base).alias("url")))
    own = F.filter(own, lambda x: (x["text"] != "") & (F.length(x["text"]) <= 120) & x["url"].rlike("^https?:"))
    return F.slice(firsts(own, lambda x: x["url"]), 1, MAX_LINKS)


def meta_date(html: Column, selectors: list[tuple[str, str]]) -> Column:
    """The first selector's date that can be read."""
    first = [F.regexp_extract(html, rf"""(?is)<meta[^>]*\b{a}=["']{n}["'][^>]*\b(?:content|datetime)=["']([^"']*)["']""", 1) for a, n in selectors]
    last = [F.regexp_extract(html, rf"""(?is)<meta[^>]*\b(?:content|datetime)=["']([^"']*)["'][^>]*\b{a}=["']{n}["']""", 1) for a, n in selectors]
    return F.coalesce(*[date(F.coalesce(F.nullif(x, F.lit("")), y)) for x, y in zip(first, last, strict=True)])


def date(x: Column) -> Column:
    """A time stamp from ISO 8601 or RFC 822 text; null for other texts."""
    short = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3,9},?\s+", "")
    return F.coalesce(F.try_to_timestamp(F.nullif(F.trim(x), F.lit(""))), F.try_to_timestamp(short, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(short, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(short, F.lit("d MMM yyyy")))


def json_ld_dates(html: Column) -> Column:
    """(published, modified) from the first JSON-LD block that can be read, its graph included."""
    own = F.regexp_extract(html, r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    node = "struct<datePublished:string,dateCreated:string,dateModified:string,`@graph`:array<struct<datePublished:string,dateCreated:string,dateModified:string>>>"
    one = F.from_json(own, node)
    many = F.from_json(own, f"array<{node}>")
    first = F.coalesce(one, many[0])
    graph = lambda name: F.element_at(F.filter(F.transform(first["@graph"], lambda x: x[name]), lambda x: x.isNotNull()), 1)
    return F.struct(F.coalesce(date(first["datePublished"]), date(first["dateCreated"]), date(graph("datePublished"))).alias("published"), F.coalesce(date(first["dateModified"]), date(graph("dateModified"))).alias("modified"))
