"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source has a budget of words, shared by weight and held to `most` times its own size. A budget of several times a
source's size takes whole epochs first; the rest is drawn without replacement: every document gets an exponential key
-ln(u) / weight from a reproducible u, and documents go in by ascending key until their prefix sum comes nearest to the rest.

The prefix sum never sorts a whole source in one task: keys fall into cells of about `cell` documents (an equal-width cut
of exp(-key) times the rows of the source), cells are summed, and only the one cell that the rest ends in is sorted.

A null or blank text has no words: it is taken 0 times in words but counts as a document. A null source is a source
of its own, last in order. Repeated rows are documents of their own; ties go by key, then id. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import common as c


def ranked(df: DataFrame, col: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of a column, nulls last: sorted by range; only one count a partition meets in one task."""
    part = df.repartitionByRange(F.col(col).asc_nulls_last()).withColumn("_p", F.spark_partition_id())
    part = c.cut(part.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(F.col(col).asc_nulls_last()))), "ranked")
    before = part.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(W.orderBy("_p")) - F.col("_n"))
    return part.join(before.select(F.col("_p").alias("_q"), "_b"), F.col("_p") == F.col("_q")).withColumn(name, F.col("_i") + F.col("_b") - 1).drop("_p", "_q", "_i", "_b")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: float, share: float = 1.0) -> DataFrame:
    """sizes(source, size) with a budget each: weights in the sources' order, repeating, and the excess over `most` times the size reshared until none is above."""
    own = c.cut(ranked(sizes, "source", "_r").withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_r", F.lit(len(weights))) + 1).cast("int")).cast("double")), "mix-sources")
    total = (own.agg(F.sum("size").alias("t")).first()["t"] or 0) * share
    level = 0.0
    while True:  # each turn holds at least one more source to its limit, in practice most of them in two or three
        held = F.col("size") * most <= F.col("w") * level
        got = own.agg(F.sum(F.when(~held, F.col("w"))).alias("w"), F.sum(F.when(held, F.col("size"))).alias("s")).first()
        if not got["w"]:
            level = float("inf")
            break
        new = (total - most * (got["s"] or 0)) / got["w"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    limit = F.col("size") * F.lit(float(most))
    return own.withColumn("target", limit if level == float("inf") else F.least(limit, F.col("w") * F.lit(level))).drop("_r")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, share: float = 1.0, cell: int = 2048, seed: str = "mix") -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, taken (its words that the mix takes, repeats counted) and copies.

    quality: rows (id, weight) by which a document's chance in the drawn part is scaled; 1 for the others.
    """
    size = F.coalesce(F.regexp_count(text, F.lit(c.SPACES)), F.lit(0)).cast("long")
    base = docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), size.alias("size"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_name"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_t"))
    weight = F.lit(1.0)
    if quality is not None:
        known = quality.select(F.col("id").alias("_qid"), F.col("weight").cast("double").alias("_w")).where("_qid is not null").groupBy("_qid").agg(F.max("_w").alias("_w"))
        base = base.join(known, F.col("_id") == F.col("_qid"), "left")
        weight = F.coalesce("_w", F.lit(1.0))
    key = -F.log(c.unit(F.lit(seed), "_name", "_t")) / F.col("_q")
    base = c.cut(base.withColumn("_q", weight).withColumn("_key", key).select("_id", "source", "size", "_name", "_t", "_q", "_key"), "mix-docs")
    sizes = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("_rows"), F.max("_q").alias("_top"))
    plan = c.cut(targets(sizes, weights, most, share), "mix-targets").select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", "_rows", "_top")
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    # exp(-key * top) falls as the key grows: equal cuts of it hold about `cell` documents each, fewer where weights lie below the top.
    n = F.ceil(F.col("_rows") / F.lit(cell))
    keyed = base.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_cell", F.floor((1 - F.exp(-F.col("_key") * F.col("_top"))) * n))
    cells = keyed.groupBy("_s", "_cell").agg(F.sum("size").alias("_words"), F.max("_rest").alias("_rest"))
    w = W.partitionBy("_s").orderBy("_cell")
    cells = cells.withColumn("_before", F.coalesce(F.sum("_words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = cells.where("_before < _rest and _before + _words >= _rest").groupBy("_s").agg(F.min("_cell").alias("_end"), F.min_by("_before", "_cell").alias("_before"))
    last = c.cut(plan.join(last.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2"), "mix-ends")
    marked = base.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_cell", F.floor((1 - F.exp(-F.col("_key") * F.col("_top"))) * n))
    edge = F.coalesce(F.col("_cell") == F.col("_end"), F.lit(False))
    sums = W.partitionBy("_s", "_cell").orderBy("_key", "_name", "_t").rowsBetween(W.unboundedPreceding, -1)
    ends = marked.where(edge).withColumn("_prior", F.coalesce(F.sum("size").over(sums), F.lit(0)) + F.col("_before"))
    # A document goes in if the sum comes nearer to the rest with it than without.
    ends = ends.withColumn("_in", (F.col("_prior") + F.col("size") / 2 <= F.col("_rest")).cast("long")).drop("_prior")
    rest = marked.where(~edge).withColumn("_in", F.coalesce((F.col("_cell") < F.col("_end")).cast("long"), F.lit(0).cast("long")))
    copies = F.col("_epochs") + F.col("_in")
    return rest.unionByName(ends).select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for documents labelled good, 1/2 for those labelled bad; unlabelled ones stay at 1."""
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(c.read(spark, sf_dir, "documents"), quality=label_weights(c.read(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT d.doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, coalesce(CAST(d.doc_id AS VARCHAR), '') AS name,
             md5(coalesce(text, '')) AS t, CAST(coalesce(q, 1.0) AS DOUBLE) AS q FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
k AS (SELECT *, -ln((CAST(('0x' || substr(md5('mix|' || name || '|' || t), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
l AS (SELECT arg_min(level, cap / w) FILTER (WHERE level * w <= cap) AS level FROM f),
p AS (SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, w * l.level) END AS target FROM r, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM p),
x AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, name, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST((epochs + CASE WHEN prior + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x
"""
