"""Pages as a graph: breadth-first walks over links, and the sections that a source is used for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within `depth` links of the start, at their least distance. edges: (src, dst); start: (node).

    One join a level; nodes that are known leave by an anti join. Levels are few by contract, so the lineage stays short.
    """
    known = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = known
    for level in range(1, depth + 1):
        front = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        known = known.unionByName(front)
    return known


def used_for(sections: DataFrame) -> DataFrame:
    """(url, sections): where each address is used, in order. sections: (section, ord, urls)."""
    own = sections.select("section", "ord", F.explode("urls").alias("url")).groupBy("url", "section").agg(F.min("ord").alias("ord"))
    return own.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section"))), lambda x: x["section"]).alias("sections"))
