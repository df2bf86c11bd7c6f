"""Diverse ranking against plain greedy picks over all matching documents."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators import rank


def plain_mmr(rows, k, d):
    """rows: (id, rank, score, terms) by rank."""
    left, picks, out = sorted(rows, key=lambda r: r[1]), [], []
    top = left[0][2] if left else 1
    while left and len(out) < k:
        value = lambda r: (1 - d) * r[2] / top - d * max((len(r[3] & x) / (min(len(r[3]), len(x)) or 1) for x in picks), default=0.0)  # noqa: B023, E731
        best = max(left, key=lambda r: (value(r), -r[1]))
        left.remove(best)
        picks.append(best[3])
        out.append(best[0])
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    words = [a + b for a in ("kan", "lor", "mis", "nut", "per", "rit", "sol", "tem") for b in ("tel", "mor", "vas", "zin", "dup", "gar", "hob")]
    rows = [(f"d{i:03}", " ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) + (" zebra" if i < 400 else "") + " otter" * (i % 3)) for i in range(450)]
    rows += [("same1", rows[0][1]), ("same2", rows[0][1])]
    return spark.createDataFrame(rows, "id string, text string").repartition(4)


@pytest.mark.parametrize("diversity,first", [(0.0, None), (0.3, 8), (0.7, 20), (1.0, 16)])
def test_mmr_reads_as_far_as_needed(spark, corpus, diversity, first):
    queries = spark.createDataFrame([("a", "zebra otter"), ("b", "kantel"), ("c", "nothing matches")], "query_id string, query string")
    ranked = rank.bm25(corpus, queries, None)
    terms = {r["id"]: set(r["w"]) for r in corpus.select("id", t.rank_tokens(F.col("text")).alias("w")).collect()}
    got = {}
    for r in rank.mmr(corpus, queries, 12, diversity, first=first).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    rows = ranked.select("query_id", "id", "rank", F.round("score", 9).alias("score")).collect()
    want = {q: plain_mmr([(r["id"], r["rank"], r["score"], terms[r["id"]]) for r in rows if r["query_id"] == q], 12, diversity) for q in ("a", "b")}
    assert got == want


def test_four_hundred_matches_give_three_hundred_picks(spark, corpus):
    out = rank.rerank(corpus, spark.createDataFrame([(1, "zebra")], "query_id int, query string"), 300, 0.2)
    rows = out.collect()
    assert len(rows) == 300 and sorted(r["rank"] for r in rows) == list(range(1, 301)) and all(r["score"] > 0 and len(r["matched_terms"]) == 1 for r in rows)
    # More places than matches: the rest match nothing.
    few = rank.rerank(corpus, spark.createDataFrame([(1, "zebra")], "query_id int, query string"), 420, 0.2).collect()
    matching = corpus.where("text like '%zebra%'").count()
    assert len(few) == 420 and sum(r["score"] > 0 for r in few) == matching and all(r["rank"] > matching for r in few if r["score"] == 0)


def test_ids_of_any_type_but_their_own(spark):
    queries = spark.createDataFrame([(1, "zebra")], "query_id long, query string")
    docs = spark.createDataFrame([("x", "zebra kan"), ("y", "zebra zebra"), ("z", "lor")], "id string, text string")
    assert [r["id"] for r in rank.rerank(docs, queries, 3, 0.5).orderBy("rank").collect()] == ["y", "x", "z"]
    for bad in ("x", None):
        with pytest.raises(ValueError):
            rank.rerank(docs.union(spark.createDataFrame([(bad, "zebra")], "id string, text string")), queries, 3, 0.5)
    assert rank.mmr(docs.limit(0), queries, 3, 0.5).count() == 0
