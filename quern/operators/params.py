"""Parameters of requests as columns: each parser gives a value, or null where the input isn't valid; absent ones take a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: named windows in hours, modes, most domains, status of each error code, codes worth trying again ----
WINDOWS = [("hour", 1.0), ("day", 24.0), ("week", 168.0), ("month", 720.0), ("year", 8760.0)]
MODES = ["results", "sources", "claims", "report"]
DEPTHS = ["fast", "balanced", "deep"]
MOST_DOMAINS = 25
ERRORS = [
    ("unauthorized", 401),
    ("rate_limited", 429),
    ("invalid_request", 400),
    ("query_too_long", 400),
    ("invalid_url", 400),
    ("blocked_url", 403),
    ("domain_not_allowed", 403),
    ("robots_disallowed", 403),
    ("fetch_failed", 502),
    ("fetch_timeout", 504),
    ("page_too_large", 413),
    ("unsupported_content_type", 415),
    ("captcha_encountered", 502),
    ("provider_failed", 502),
    ("no_provider_available", 503),
    ("no_results", 200),
    ("step_limit_reached", 400),
    ("budget_exhausted", 400),
    ("not_found", 404),
    ("database_unavailable", 503),
    ("internal_error", 500),
]
RETRYABLE = ["rate_limited", "fetch_failed", "fetch_timeout", "provider_failed", "no_provider_available", "database_unavailable"]
# ----------------------------------------------------------------------------------------------------------------------


def freshness(x: Column) -> Column:
    """Hours of a named window, or a positive number of hours."""
    named = F.create_map(*[F.lit(v) for pair in WINDOWS for v in pair])
    number = F.trim(x).try_cast("double")
    return F.coalesce(F.try_element_at(named, F.lower(x)), F.when((number > 0) & (number < float("inf")), number))


def refused(raw: Column, value: Column) -> Column:
    """Whether a parameter was given but has no meaning: absent and invalid ones both have a null value, and only the latter are an error."""
    return raw.isNotNull() & value.isNull()


def parsed(requests: DataFrame, values: dict[str, Column]) -> DataFrame:
    """requests with each parameter parsed (column name: its value), error (a code, or null) and error_field: the first parameter, in this order, that is refused."""
    bad = F.array_compact(F.array(*[F.when(refused(F.col(x), v), F.lit(x)) for x, v in values.items()]))
    out = requests.withColumn("error_field", F.get(bad, F.lit(0)))
    return out.withColumn("error", F.when(F.col("error_field").isNotNull(), F.lit("invalid_request"))).withColumns(values)


def choice(x: Column, allowed: list[str]) -> Column:
    """One of the allowed values; the first where none is given."""
    return F.when(x.isNull(), F.lit(allowed[0])).when(x.isin(allowed), x)


def depth(x: Column) -> Column:
    return F.when(x.isNull(), F.lit("balanced")).when(x.isin(DEPTHS), x)


def locale(x: Column) -> Column:
    """Two small letters, with or without a region of two capitals."""
    return F.when(x.rlike("^[a-z]{2}(-[A-Z]{2})?$"), x)


def whole_number(x: Column, least: int, most: int, default: int) -> Column:
    """Rounded half up and held between the bounds."""
    n = F.trim(x).try_cast("double")
    return F.when(x.isNull(), F.lit(default)).when(n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")), F.least(F.greatest(F.floor(n + 0.5), F.lit(least)), F.lit(most))).cast("int")


def domains(x: Column) -> Column:
    """Bare domains of a list of up to 25: no scheme, leading *. or path, in lower case. Null if there are more or one isn't a domain."""
    bare = F.transform(x, lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(d)), "^https?://", ""), r"^\*\.", ""), "/.*$", ""))
    ok = (F.size(x) <= MOST_DOMAINS) & F.forall(bare, lambda d: F.coalesce(d.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), F.lit(False)))
    return F.when(ok, bare)


def same_domains(x: Column) -> Column:
    """Domains as part of an identity: trimmed of dots, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda d: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(d)), r"^\*\.", ""), r"^\.", ""), r"\.$", ""))))


def identity(intent: Column, content: Column, deep: Column, urls: Column, allowed: Column, blocked: Column, include: Column, exclude: Column) -> Column:
    """What a stored answer is an answer to, as JSON: requests that differ in order or spelling of domains share it."""
    lists = [F.to_json(same_domains(x)) for x in (allowed, blocked, include, exclude)]
    parts = [F.lit('"search"'), F.concat(F.lit('"'), intent, F.lit('"')), F.coalesce(content, F.lit(True)).cast("string"), F.concat(F.lit('"'), F.coalesce(deep, F.lit("balanced")), F.lit('"')), F.to_json(urls), *lists]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def client(forwarded: Column, real: Column) -> Column:
    """The left-most address that was forwarded, else the real one, else unknown."""
    first = F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(real), F.lit("")), F.lit("unknown"))


def actor(value: Column, salt: str) -> Column:
    """A pseudonym: 32 hex digits of a salted SHA-256."""
    return F.left(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), F.lit(32))


def status(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in ERRORS for v in pair]), code), F.lit(500))


def retryable(code: Column) -> Column:
    return F.coalesce(code.isin(RETRYABLE), F.lit(False))
