"""Addresses: parts, canonical keys, host rules and the policy that keeps private targets out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
TRACKING = r"^(?:utm_.*|fbclid|gclid)$"
HOST_CLASSES = [
    ("primary", 0.95, [r"(^|\.)gov(\.[a-z]{2})?$", r"(^|\.)gov\.tr$", r"(^|\.)edu(\.[a-z]{2})?$", r"(^|\.)europa\.eu$", r"(^|\.)who\.int$", r"(^|\.)un\.org$", r"(^|\.)tcmb\.gov\.tr$", r"(^|\.)tuik\.gov\.tr$"]),
    ("academic", 0.9, [r"(^|\.)doi\.org$", r"(^|\.)arxiv\.org$", r"(^|\.)nature\.com$", r"(^|\.)science\.org$", r"(^|\.)springer\.com$", r"(^|\.)sciencedirect\.com$", r"(^|\.)pubmed\.ncbi\.nlm\.nih\.gov$", r"(^|\.)ieee\.org$", r"(^|\.)acm\.org$"]),
    ("reference", 0.78, [r"(^|\.)wikipedia\.org$", r"(^|\.)britannica\.com$"]),
    ("news", 0.8, [r"(^|\.)reuters\.com$", r"(^|\.)apnews\.com$", r"(^|\.)bbc\.(com|co\.uk)$", r"(^|\.)ft\.com$", r"(^|\.)bloomberg\.com$", r"(^|\.)economist\.com$", r"(^|\.)nytimes\.com$", r"(^|\.)theguardian\.com$", r"(^|\.)aa\.com\.tr$", r"(^|\.)trthaber\.com$"]),
    ("docs", 0.85, [r"(^|\.)developer\.mozilla\.org$", r"(^|\.)docs\.[a-z0-9-]+\.[a-z]+$", r"(^|\.)nextjs\.org$", r"(^|\.)python\.org$", r"(^|\.)postgresql\.org$"]),
    ("community", 0.6, [r"(^|\.)stackoverflow\.com$", r"(^|\.)stackexchange\.com$", r"(^|\.)github\.com$", r"(^|\.)news\.ycombinator\.com$", r"(^|\.)reddit\.com$", r"(^|\.)medium\.com$", r"(^|\.)substack\.com$"]),
]
LOW_TRUST = [r"(^|\.)blogspot\.", r"(^|\.)wordpress\.com$", r"(^|\.)wixsite\.com$", r"(^|\.)pinterest\.", r"(^|\.)quora\.com$"]
PRIVATE_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4)]
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "metadata.google.internal", "metadata.goog", "instance-data"]
BLOCKED_ENDS = [".localhost", ".local", ".internal", ".cluster.local", ".onion"]
UNSAFE_HOST = [r"(^|\.)porn", "porno", "xvideos?", "xhamster", "xnxx", "redtube", "youporn", "pornhub", "brazzers", "onlyfans", "chaturbate", "camsoda", r"(^|\.)sex(y|shop)?\.", "escort", "hentai", "rule34"]
UNSAFE_TEXT = [r"\bporn(o|ô|hub)?\b", r"\bxxx\b", r"\bhentai\b", r"\bescort\b", r"\bnude?s?\b", r"\bcamgirl"]
# -----------------------------------------------------------------------------


def host(url: Column, bare: bool = True) -> Column:
    """Lower-cased host without a final dot, and without www. if bare; null for what can't be parsed."""
    out = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")
    return F.regexp_replace(out, r"^www\.", "") if bare else out


def url_key(url: Column) -> Column:
    """Canonical address: no fragment, tracking parameters, final slashes or www.; scheme, port, path case and other parameters stay."""
    own = F.regexp_replace(F.trim(url), r"#.*$", "")
    query = F.try_parse_url(own, F.lit("QUERY"))
    kept = F.filter(F.split(query, "&"), lambda p: ~F.lower(F.split(p, "=")[0]).rlike(TRACKING))
    port = F.regexp_extract(own, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*?(:\d+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(own, F.lit("PATH")), F.lit("")), "/+$", "")
    tail = F.when(query.isNotNull() & (F.size(kept) > 0), F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    full = F.concat(F.lower(F.try_parse_url(own, F.lit("PROTOCOL"))), F.lit("://"), host(own), port, path, tail)
    return F.coalesce(full, F.lower(url))


def host_matches(name: Column, pattern: Column) -> Column:
    """Equal or a subdomain; *., a leading and a trailing dot of the pattern don't count."""
    own = F.regexp_replace(F.lower(F.trim(pattern)), r"^\*?\.|\.$", "")
    return (name == own) | F.endswith(name, F.concat(F.lit("."), own))


def ipv4(name: Column) -> Column:
    """An IPv4 address, dotted or as one number, as a long; null for other hosts."""
    parts = F.split(name, r"\.")
    dotted = F.when(name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x.try_cast("int") <= 255), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.try_cast("long")))
    return F.coalesce(dotted, F.when(name.rlike(r"^\d{1,10}$"), name.try_cast("long")))


def is_private(name: Column) -> Column:
    """Hosts that a fetch must not reach: local names, private and reserved IPv4 ranges, also mapped into IPv6, and local IPv6."""
    bits = lambda a: int.from_bytes(bytes(map(int, a.split("."))))
    inside = lambda x: F.exists(F.array(*[F.struct(F.lit(bits(a) >> (32 - n)).alias("net"), F.lit(2 ** (32 - n)).cast("long").alias("size")) for a, n in PRIVATE_V4]), lambda r: F.floor(x / r["size"]) == r["net"])
    six = F.regexp_extract(name, r"^\[(.*)\]$", 1)
    mapped = F.regexp_extract(six, r"^::ffff:([0-9.]+)$", 1)
    hexed = F.regexp_extract_all(six, F.lit(r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$"), F.lit(1))
    low = F.regexp_extract(six, r"^::ffff:[0-9a-f]{1,4}:([0-9a-f]{1,4})$", 1)
    from_hex = F.when(F.size(hexed) > 0, F.conv(hexed[0], 16, 10).cast("long") * 65536 + F.conv(F.when(low != "", low), 16, 10).cast("long"))
    local = name.isin(BLOCKED_HOSTS) | F.exists(F.array(*map(F.lit, BLOCKED_ENDS)), lambda x: F.endswith(name, x)) | name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ipv4(name).isNull()
    six_local = six.rlike(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff.*)$")
    return local | F.coalesce(inside(ipv4(name)), F.lit(False)) | F.coalesce(inside(ipv4(F.when(mapped != "", mapped))), F.lit(False)) | F.coalesce(inside(from_hex), F.lit(False)) | ((six != "") & six_local)


def is_url_allowed(url: Column, blocked: list[str] | None = None, allowed: list[str] | None = None) -> Column:
    """http or https, without credentials, to a public host that the lists let through."""
    name = host(url, bare=False)
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & name.isNotNull() & ~is_private(name)
    for p in blocked or []:
        ok = ok & ~host_matches(name, F.lit(p))
    if allowed:
        ok = ok & F.exists(F.array(*map(F.lit, allowed)), lambda x: host_matches(name, x))
    return F.coalesce(ok, F.lit(False))


def host_class(name: Column) -> Column:
    """The first class whose patterns match: primary, academic, reference, news, docs, community, else unknown."""
    out = None
    for label, _, patterns in HOST_CLASSES:
        own = name.rlike("|".join(patterns))
        out = F.when(own, label) if out is None else out.when(own, label)
    return out.otherwise("unknown")


def is_unsafe(url: Column, text: Column) -> Column:
    """Adult hosts or words; what can't be parsed counts as unsafe."""
    from quern.functions.text import matches

    name = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(name.rlike("(?i)(?:" + "|".join(UNSAFE_HOST) + ")") | matches(text, UNSAFE_TEXT), F.lit(True))
