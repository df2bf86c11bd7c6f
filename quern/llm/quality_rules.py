"""Quality rules whose thresholds follow the data: fences from mergeable quantile sketches per language and source.

A sketch is a histogram over log-linear buckets: counts by (language, source, measure, bucket), so that sketches merge by
adding counts, in any order and with the same result. Values below 64 are exact, others stand for their bucket, at most
1/32 wide. Texts are read once; only the measures of a document go on, and what is joined back are fences, one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm import common as c

#: Words a window of repeated words holds, and fixed rules below the adaptive ones: fewest words, most repeated words in 100.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A document fails a measure beyond REACH times the spread from the quartiles; the spread is at least the measure's slack.
REACH = 3
#: Documents are judged as if they had so many more words of their group's median, as measures of short texts vary.
PRIOR_WORDS = 50
#: Groups with fewer documents take the merged sketch of their language, and languages with fewer that of all.
SUPPORT = 100
#: Measures in thousandths: (name, counted, divided by, least spread, has a lower fence too).
MEASURES = [
    ("word_length", "word_chars", "n_words", 400, True),
    ("symbols", "n_symbols", "n_words", 100, False),
    ("dup_lines", "n_dup_lines", "n_lines", 200, False),
    ("repeats", "n_repeat_words", "n_words", 100, False),
]


def measure(docs: DataFrame, text: str = "text", id_col: str = "doc_id", by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row per row of docs: id_col, the two columns of by, and the counts of its whole text, all long.

    n_words: words; word_chars: code points in them; n_symbols: characters of #*$%&|<>; n_lines: lines with a word; n_dup_lines: those equal to an earlier one; n_repeat_words: words in 8-word windows found twice or more in the text.
    Null texts count as empty: all zeros. Windows of a text compare by 64-bit hashes of its words.
    Write the result (common.cut) before filtering by its columns, since Spark would repeat their expressions in the filter.
    """
    has_word = c.SPACES.removesuffix("+")
    own = docs.select(F.col(id_col).alias("_id"), *[F.col(x).alias(f"_by{k}") for k, x in enumerate(by)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    own = own.select("_id", "_by0", "_by1", F.regexp_extract_all("_t", F.lit(f"({c.SPACES})"), F.lit(1)).alias("w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(has_word)).alias("l"), F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    pair = lambda a, b: F.xxhash64(a, b)
    own = own.select("_id", "_by0", "_by1", "n_symbols", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("g"))
    # Hashes of 2, 4 and 8 words: each from two of half the width; ends that stick out go last.
    for width in (1, 2, 4):
        own = own.withColumn("g", F.zip_with("g", F.expr(f"slice(g, {width + 1}, size(g))"), pair))
    own = own.withColumn("g", F.expr(f"slice(g, 1, greatest(size(g) - {WINDOW - 1}, 0))"))
    own = own.withColumn("o", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    own = own.withColumn("o", F.expr("sort_array(transform(filter(o, (x, k) -> x.h <=> get(o, k - 1).h or x.h <=> get(o, k + 1).h), x -> x.i))"))
    covered = F.expr(f"aggregate(zip_with(o, slice(o, 2, size(o)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (acc, x) -> acc + x)")
    return own.select(F.col("_id").alias(id_col), *[F.col(f"_by{k}").alias(x) for k, x in enumerate(by)], "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def sketch(measured: DataFrame, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Sketches as rows (the columns of by, measure, bucket, n) over the documents that pass the fixed rules; sketches merge by adding n."""
    values = F.array(*[F.struct(F.lit(k).alias("measure"), F.expr(f"{count} * 1000 div {of}").alias("v")) for k, (_, count, of, _, _) in enumerate(MEASURES)])
    # No filter here: it would be pushed down as one huge expression, should measured not be a written table.
    rows = measured.select(*by, F.explode(F.when(~base_failed(), values)).alias("x")).select(*by, "x.*")
    bucket = F.expr("if(v < 64, v, shiftright(v, length(bin(v)) - 6) + 32 * (length(bin(v)) - 6))")
    return rows.groupBy(*by, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, docs, q1, q2, q3 of each sketch after merging all that agree in keys: the lower ends of the buckets of these ranks."""
    one = sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    part = W.partitionBy(*keys)
    ranked = one.withColumn("docs", F.sum("n").over(part)).withColumn("upto", F.sum("n").over(part.orderBy("bucket")))
    value = F.expr("if(bucket < 64, bucket, shiftleft(bucket % 32 + 32, cast(bucket div 32 - 1 as int)))")
    return ranked.groupBy(*keys, "docs").agg(*[F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), value)).alias(f"q{k}") for k in (1, 2, 3)])


def fences(sketches: DataFrame, by: tuple[str, str] = ("lang", "source"), support: int = SUPPORT) -> DataFrame:
    """One row per group: the columns of by and, for each measure, its middle (m), and its lower and upper fence (lo, hi)."""
    low, high = by
    own = quartiles(sketches, [*by, "measure"])
    wide = quartiles(sketches, [low, "measure"]).withColumnsRenamed({x: f"w_{x}" for x in (low, "measure", "docs", "q1", "q2", "q3")})
    total = quartiles(sketches, ["measure"]).withColumnsRenamed({x: f"t_{x}" for x in ("measure", "docs", "q1", "q2", "q3")})
    # Measures are four and total has four rows; a language's row meets its sources, as many as there are.
    rows = own.join(wide, (F.col(low).eqNullSafe(F.col(f"w_{low}"))) & (F.col("measure") == F.col("w_measure"))).join(F.broadcast(total), F.col("measure") == F.col("t_measure"))
    for k in (1, 2, 3):
        rows = rows.withColumn(f"q{k}", F.when(F.col("docs") >= support, F.col(f"q{k}")).when(F.col("w_docs") >= support, F.col(f"w_q{k}")).otherwise(F.col(f"t_q{k}")))
    slack = F.element_at(F.array(*[F.lit(x[3]) for x in MEASURES]), F.col("measure") + 1)
    rows = rows.withColumn("spread", REACH * F.greatest(F.col("q3") - F.col("q1"), slack))
    out = []
    for k, (name, _, _, _, both) in enumerate(MEASURES):
        pick = lambda x, k=k: F.max(F.when(F.col("measure") == k, x))
        out += [pick(F.col("q2")).alias(f"{name}_m"), pick(F.col("q1") - F.col("spread") if both else F.lit(-1).cast("long")).alias(f"{name}_lo"), pick(F.col("q3") + F.col("spread")).alias(f"{name}_hi")]
    return rows.groupBy(*by).agg(*out)


def judge(measured: DataFrame, fenced: DataFrame, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """measured with base_failed, failed (names of the measures beyond their fences) and kept; groups without a fence are judged by the fixed rules alone."""
    named = fenced.withColumnsRenamed({x: f"f_{x}" for x in by})
    out = measured.withColumn("base_failed", base_failed()).join(named, F.expr(" and ".join(f"`{x}` <=> `f_{x}`" for x in by)), "left")
    beyond = []
    for name, count, of, _, _ in MEASURES:
        value = F.expr(f"(1000 * {count} + {PRIOR_WORDS} * {name}_m) div ({of} + {PRIOR_WORDS})") if of == "n_words" else F.expr(f"1000 * {count} div {of}")
        beyond.append(F.when(~F.col("base_failed") & ~value.between(F.col(f"{name}_lo"), F.col(f"{name}_hi")), F.lit(name)))
    failed = F.array_compact(F.array(*beyond))
    return out.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).select(*measured.columns, "base_failed", "failed", "kept")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents, written once; sketches, fences and verdicts from those.

    Null and empty texts fail the fixed rules. Null languages and sources are groups of their own. Repeated rows count, and are judged, one by one. An empty table gives no rows.
    """
    measured = c.cut(measure(c.read(spark, sf_dir, "documents")), "op12-measures")
    out = judge(measured, fences(sketch(measured)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RATES = "[" + ", ".join(f"{{'measure': {k}, 'v': {count} * 1000 // {of}}}" for k, (_, count, of, _, _) in enumerate(MEASURES)) + "]"
_QUARTILES = """SELECT {keys} measure, docs, min(CASE WHEN 4 * upto >= docs THEN v END) AS q1, min(CASE WHEN 4 * upto >= 2 * docs THEN v END) AS q2, min(CASE WHEN 4 * upto >= 3 * docs THEN v END) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} measure) AS docs, sum(n) OVER (PARTITION BY {keys} measure ORDER BY v) AS upto FROM (SELECT {keys} measure, v, sum(n) AS n FROM sk GROUP BY {keys} measure, v))
    GROUP BY {keys} measure, docs"""
_SLACK = "[" + ", ".join(str(x[3]) for x in MEASURES) + "]"
_TEST = " AND ".join(
    f"EXISTS (SELECT 1 FROM fe WHERE fe.lang IS NOT DISTINCT FROM b.lang AND fe.source IS NOT DISTINCT FROM b.source AND measure = {k} AND "
    + (f"(1000 * {count} + {PRIOR_WORDS} * q2) // ({of} + {PRIOR_WORDS})" if of == "n_words" else f"1000 * {count} // {of}")
    + f" BETWEEN {'q1 - spread' if both else '-1'} AND q3 + spread)"
    for k, (_, count, of, _, both) in enumerate(MEASURES)
)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda k: array_to_string(w[k:k + {WINDOW - 1}], ' '))) AS s FROM d WHERE len(w) >= {WINDOW}),
hit AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM hit, range({WINDOW}) AS x(k) GROUP BY r),
b0 AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b0),
v AS (SELECT lang, source, unnest({_RATES}, recursive := true) FROM b WHERE NOT base_failed),
sk AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS v, count(*) AS n FROM v GROUP BY ALL),
own AS ({_QUARTILES.format(keys="lang, source,")}), wide AS ({_QUARTILES.format(keys="lang,")}), total AS ({_QUARTILES.format(keys="")}),
q AS (SELECT own.lang, own.source, own.measure, {", ".join(f"CASE WHEN own.docs >= {SUPPORT} THEN own.q{k} WHEN wide.docs >= {SUPPORT} THEN wide.q{k} ELSE total.q{k} END AS q{k}" for k in (1, 2, 3))}
      FROM own JOIN wide ON own.lang IS NOT DISTINCT FROM wide.lang AND own.measure = wide.measure JOIN total ON own.measure = total.measure),
fe AS (SELECT *, {REACH} * greatest(q3 - q1, {_SLACK}[measure + 1]) AS spread FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_TEST} AS kept FROM b
"""
