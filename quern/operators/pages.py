"""Rules for fetched pages, and what a reader does on them: finding lines, choosing links, going on to the next page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.functions import urls as u

# ---- fixed values: hosts whose pages give nothing, signs of a test for robots and of pages that need scripts, next links ----
UNEXTRACTABLE = ["news.google.com", "stackoverflow.com", "serverfault.com", "superuser.com", "askubuntu.com", "stackexchange.com"]
ROBOT_TESTS = ["captcha", "cf-challenge", "checking your browser", "unusual traffic", "are you a robot", "verify you are human"]
ROBOT_STATUS, ROBOT_CHARS = [202, 403, 429], 4000
NEEDS_SCRIPTS, SCRIPT_CHARS = "enable javascript|javascript'i etkinleştir|requires javascript|noscript", 250
NEXT_LABELS = [r"(?i)^\s*(sonraki|ileri|devam)\s*$", r"(?i)^\s*(next|more|older)\s*(page|›|»|>)?\s*$", r"^\s*(›|»|>|→)\s*$"]
NEXT_URL = r"(?i)[?&](page|p|offset|start)=\d+"
MOST_FOUND, FOUND_CHARS = 10, 400
# --------------------------------------------------------------------------------------------------------------------------


def is_unextractable(url: Column) -> Column:
    name = u.host(url, bare=False)
    hit = F.lit(False)
    for x in UNEXTRACTABLE:
        hit = hit | u.host_matches(name, F.lit(x))
    return F.coalesce(hit, F.lit(False))


def is_robot_test(status: Column, body: Column) -> Column:
    """Whether an answer asks for a proof of being human: by status, and a sign in its first 4000 characters."""
    return F.coalesce(status.isin(ROBOT_STATUS) & F.lower(F.left(body, F.lit(ROBOT_CHARS))).rlike("|".join(ROBOT_TESTS)), F.lit(False))


def needs_scripts(content: Column) -> Column:
    return F.coalesce((F.length(content) < SCRIPT_CHARS) & content.rlike(f"(?i)({NEEDS_SCRIPTS})"), F.lit(False))


def charset(content_type: Column, head: Column) -> Column:
    """Named by the header, else by the page's own meta tags in its first bytes (as text), else UTF-8."""
    named = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    own = F.coalesce(named(content_type, r"""(?i)charset=["']?([\w-]+)"""), named(head, r"""(?i)<meta[^>]+charset=["']?([\w-]+)"""), named(head, r"""(?i)<meta[^>]+content=["'][^"']*charset=([\w-]+)"""))
    return F.lower(F.coalesce(own, F.lit("utf-8")))


def decoded(body: Column, content_type: Column) -> Column:
    """The text of a binary body, in Arrow batches; bytes that the character set doesn't know are replaced, unknown sets are read as UTF-8."""

    def one(b, name):
        try:
            return b.decode(name, "replace")
        except LookupError:
            return b.decode("utf-8", "replace")

    @F.pandas_udf("string")
    def read(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else one(bytes(b), n) for b, n in zip(bodies, names, strict=True)], dtype=object)

    return read(body, charset(content_type, F.decode(F.substring(body, 1, 2048), "ISO-8859-1")))


def find(pages: DataFrame, id_col: str, needle: str, content: str = "content") -> DataFrame:
    """(id_col, place, context): the first ten lines of each page that hold the words, cut to 400 characters. Words without a letter or digit find nothing."""
    word = t.normalize(F.lit(needle))
    lines = pages.select(id_col, F.posexplode(F.split(content, "\n")).alias("pos", "line")).where((word != "") & F.contains(t.normalize(F.col("line")), word))
    return lines.withColumn("place", F.row_number().over(W.partitionBy(id_col).orderBy("pos"))).where(F.col("place") <= MOST_FOUND).select(id_col, "place", F.left("line", F.lit(FOUND_CHARS)).alias("context"))


def link_for(links: DataFrame, asked: DataFrame) -> DataFrame:
    """(page, label, url): the first link of that text, else the first whose text holds it. links: (page, pos, text, url); asked: (page, label)."""
    own = links.withColumn("_t", t.normalize(F.col("text")))
    want = asked.withColumn("_w", t.normalize(F.col("label")))
    both = want.join(own, "page").where(F.contains(F.col("_t"), F.col("_w")))
    return both.groupBy("page", "label").agg(F.min_by("url", F.struct(F.col("_t") != F.col("_w"), F.col("pos"))).alias("url"))


def next_link(links: DataFrame) -> DataFrame:
    """(page, url) of the first link that says next, else of the first whose address counts pages."""
    label = F.col("text").rlike("|".join(f"(?:{p})" for p in NEXT_LABELS))
    own = links.withColumn("_tier", F.when(label, 0).when(F.col("url").rlike(NEXT_URL), 1)).where("_tier is not null")
    return own.groupBy("page").agg(F.min_by("url", F.struct("_tier", "pos")).alias("url"))
