"""Which of many terms a text holds: one pass over each text, whatever the number of terms.

All distinct terms make an Aho-Corasick automaton, which each task builds from a broadcast of checked size; a text goes through it once.
Only hits leave the scan, and meet the queries by an equality join. More terms than the bound go in blocks, each a pass of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the terms that one automaton holds at most (or one longer term).
BLOCK_CHARS = 1 << 20


def hits(rows: DataFrame, keys: list[str], fields: list[str], terms: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """keys, field, term: each term that is part of the text in a field of a row, once a row and field.

    terms: (term), any number, repeated or null ones too; empty terms and null texts have no hits. Letters compare as they are.
    """
    wanted = terms.select(F.col("term").cast("string").alias("term")).where("term <> ''").distinct()
    chars = wanted.agg(F.sum(F.length("term") + 8)).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in keys) + ", field string, term string"

    def scan(own: list[str]) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(own)

        def work(batches):
            import ahocorasick
            import numpy as np
            import pyarrow as pa

            machine = ahocorasick.Automaton()
            for i, x in enumerate(sent.value):
                machine.add_word(x, i)
            machine.make_automaton()
            for batch in batches:
                for field in fields:
                    row, found = [], []
                    for r, text in enumerate(batch.column(field).to_pylist()):
                        if text:
                            own_hits = {i for _, i in machine.iter(text)}
                            row += [r] * len(own_hits)
                            found += sorted(own_hits)
                    if row:
                        at = pa.array(np.array(row, dtype=np.int64))
                        yield pa.RecordBatch.from_arrays([*[batch.column(x).take(at) for x in keys], pa.array([field] * len(row)), pa.array([sent.value[i] for i in found])], names=[*keys, "field", "term"])

        return rows.select(*dict.fromkeys([*keys, *fields])).mapInArrow(work, schema)

    parts = [wanted if n == 1 else wanted.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k) for k in range(n)]
    lists = [[r["term"] for r in p.collect()] for p in parts]
    lists = [x for x in lists if x] or [[]]
    if lists == [[]]:
        return rows.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, [scan(x) for x in lists])


def asked_terms(queries: DataFrame, terms) -> DataFrame:
    """(query_id, term, times, n): how often a query has a term, and how many terms it has, repeated ones counted."""
    own = queries.select("query_id", terms.alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    return own.groupBy("query_id", "n", "term").agg(F.count("*").alias("times"))


def best_of_all(scored: DataFrame, ids: DataFrame, queries: DataFrame, id_col: str, limit: int, value=0.0) -> DataFrame:
    """(query_id, id, rank, score) of the best `limit` of all ids, where those not in scored have the score `value`, below all others; ties by id.

    A query has places left only if fewer than limit are scored: among its first 2 * limit ids enough others are found.
    """
    from pyspark.sql import Window as W

    n = queries.select("query_id").join(scored.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < limit).select("query_id")
    first = ids.select(id_col).orderBy(id_col).limit(2 * limit)
    rest = n.crossJoin(F.broadcast(first)).join(scored.select("query_id", id_col), ["query_id", id_col], "left_anti").withColumn("score", F.lit(value).cast("double"))
    every = scored.select("query_id", id_col, "score").unionByName(rest)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), id_col))
    return every.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", id_col, "rank", "score")
