"""The stages of the corpus pipeline: each calls one operator and lets its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import common as c
from quern.llm import decontam, jaccard_join, langid, line_dedup, mixing

#: Documents whose language is less likely than this are rejected, as are those without any letter.
LEAST_SCORE = 0.5


def _shape(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs in their order; n_chars, where there is one, follows the text."""
    return out.select(*[F.length("text").cast(docs.schema[x].dataType).alias(x) if x == "n_chars" else F.col(f"`{x}`") for x in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the model rejects go."""
    out = langid.identify(docs.withColumnsRenamed({x: f"_in_{x}" for x in docs.columns if x in ("lang_pred", "score")}), langid.model_of(docs))
    out = out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return out.withColumnsRenamed({f"_in_{x}": x for x in ("lang_pred", "score")}).select(*[f"`{x}`" for x in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go, and documents of which nothing is left."""
    own = docs.withColumnsRenamed({x: f"_in_{x}" for x in docs.columns if x in ("n_lines", "n_removed")})
    out = line_dedup.dedup_lines(own).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).drop("n_lines", "n_removed")
    return _shape(out.withColumnsRenamed({f"_in_{x}": x for x in ("n_lines", "n_removed")}), docs)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key: 128 bits of id and text, which no null and no repeated id leaves open; only equal rows share one."""
    k1, k2 = line_dedup.row_key("text", "doc_id")
    return docs.select("*", F.concat_ws(":", k1.cast("string"), k2.cast("string")).alias("_key"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each component the document of the least id stays (nulls last), once; texts without a word all stay."""
    keyed = _keyed(docs)
    out = jaccard_join.jaccard_join(keyed, id_col="_key").distinct()
    ids = keyed.select(F.col("_key").alias("_k"), "doc_id").distinct()
    own = out.join(ids, F.col("_key") == F.col("_k")).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "n_shingles")).alias("x"))
    own = own.select(F.col("x._key").alias("_kept"), (F.col("x.n_shingles") == 0).alias("_blank"))
    rows = keyed.join(own, F.col("_key") == F.col("_kept")).withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(F.xxhash64(*[F.col(f"`{x}`") for x in docs.columns]))))
    return rows.where("_n = 1 or _blank").select(*[f"`{x}`" for x in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of an item go."""
    keyed = _keyed(docs)
    hit = decontam.decontaminate(keyed, c.read(spark, sf_dir, "benchmark"), id_col="_key").where("contaminated").select(F.col("_key").alias("_hit")).distinct()
    return keyed.join(hit, F.col("_key") == F.col("_hit"), "left_anti").drop("_key")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: what is taken of each document, and how often."""
    return mixing.mix(docs, quality=mixing.label_weights(c.read(spark, sf_dir, "labels")))
