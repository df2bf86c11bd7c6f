"""BM25 over a supplied corpus, best passages, and reranking by maximal marginal relevance.

Queries come in batches: every operator is keyed by query_id and takes tables, not one request. Only tokens that some query has
leave the scan; corpus statistics are one pre-aggregated row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as t
from quern.operators.durable import kept

K1, B, TITLE_WEIGHT = 1.2, 0.75, 2.5


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times, first): each distinct term of a query, how often it is in it, and where first."""
    own = queries.select("query_id", F.posexplode(t.rank_tokens(F.col("query"))).alias("pos", "term"))
    return own.groupBy("query_id", "term").agg(F.count("*").alias("times"), F.min("pos").alias("first"))


def weighted_length(docs: DataFrame, title: str | None = None) -> DataFrame:
    """(id, length): number of tokens, those of the title 2.5 times."""
    own = F.size(t.rank_tokens(F.col("text"))).cast("double")
    if title:
        own = own + F.size(t.rank_tokens(F.coalesce(F.col(title), F.lit("")))) * TITLE_WEIGHT
    return docs.select("id", own.alias("length"))


def term_frequencies(docs: DataFrame, terms: DataFrame, title: str | None = None) -> DataFrame:
    """(id, term, tf): weighted frequencies of the terms that some query has."""
    own = docs.select("id", F.explode(t.rank_tokens(F.col("text"))).alias("term"), F.lit(1.0).alias("w"))
    if title:
        own = own.unionByName(docs.select("id", F.explode(t.rank_tokens(F.coalesce(F.col(title), F.lit("")))).alias("term"), F.lit(TITLE_WEIGHT).alias("w")))
    return own.join(terms.select("term").distinct(), "term").groupBy("id", "term").agg(F.sum("w").alias("tf"))


#: Forms of wanted and dropped words up to which they are sent to all tasks; beyond, Spark joins them as it sees fit.
SENT_FORMS = 1_000_000


def counted(docs: DataFrame, terms: DataFrame, title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, term, tf) of the terms that some query has, and (id, length): as term_frequencies and weighted_length, but each distinct form of the corpus is stemmed once.

    The corpus is read twice: for its distinct forms, and to count, where a form is looked up among those that make a wanted term or none at all.
    Counts are gathered per document before they are shuffled.
    """
    word = F.lit(r"[\p{L}\p{N}][\p{L}\p{N}_.-]*")
    fields = [("text", 1.0), *([(title, TITLE_WEIGHT)] if title else [])]
    parts = [docs.select("id", F.lit(w).alias("w"), F.explode_outer(F.regexp_extract_all(F.coalesce(F.col(x), F.lit("")), word, F.lit(0))).alias("form")) for x, w in fields]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    stems = every.select("form").where("form is not null").distinct().withColumn("term", F.get(t.rank_tokens(F.col("form")), F.lit(0)))
    wanted = terms.select(F.col("term").alias("_t")).distinct()
    forms = kept(stems.join(wanted, F.col("term") == F.col("_t"), "left").where("_t is not null or term is null").select(F.col("form").alias("_f"), "term"))
    known = F.broadcast(forms) if forms.count() <= SENT_FORMS else forms
    # Per document and term: the weight of its forms. A form that makes no term counts for nothing, one that nobody asks for counts for the length.
    met = every.join(known.withColumn("_hit", F.lit(True)), F.col("form") == F.col("_f"), "left")
    weight = F.when(F.col("form").isNull() | (F.col("_hit") & F.col("term").isNull()), 0.0).otherwise(F.col("w"))
    counts = kept(met.groupBy("id", "term").agg(F.sum(weight).alias("tf")))
    return counts.where("term is not null"), counts.groupBy("id").agg(F.sum("tf").alias("length"))


def bm25(docs: DataFrame, queries: DataFrame, top_k: int | None = 10, title: str | None = None) -> DataFrame:
    """(query_id, id, rank, score, relative, matched_terms) of the best documents of each query that match it at all.

    docs: (id, text[, title]); queries: (query_id, query). Scores that agree to nine digits are ties, as the order of additions may vary; ties go by id. Repeated query terms count again.
    """
    terms = query_terms(queries)
    tf, length = counted(docs, terms, title)
    stats = length.agg(F.count("*").alias("n_docs"), F.avg("length").alias("average"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    hits = tf.join(terms, "term").join(df, "term").join(length, "id").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    average = F.when(F.col("average") > 0, F.col("average")).otherwise(1.0)
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    scored = hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.array_sort(F.collect_list(F.struct("first", "term"))).alias("m"))
    scored = scored.withColumn("relative", F.round(F.col("score") / F.max("score").over(W.partitionBy("query_id")), 4))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    out = scored.select("query_id", "id", place.alias("rank"), "score", "relative", F.transform("m", lambda x: x["term"]).alias("matched_terms"))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def passages(ranked: DataFrame, docs: DataFrame, queries: DataFrame, most: int = 320) -> DataFrame:
    """Ranked rows with best_passage: the run of sentences of at most `most` characters (or one longer) with the most distinct terms.

    Ties go to the shorter run, then the earlier; without hits the first two sentences stand. Texts are joined only after the cut; their sentences are
    rows, tokenized once each, and a run is a join of a sentence with those after it within reach: each is at least one character and its space.
    """
    terms = queries.select("query_id", F.array_distinct(t.rank_tokens(F.col("query"))).alias("terms"))
    base = ranked.select("query_id", "id").join(docs.select("id", t.passage_sentences(F.col("text")).alias("s")), "id")
    rows = base.select("query_id", "id", F.posexplode("s").alias("i", "x")).withColumn("n", F.length("x") + 1)
    w = W.partitionBy("query_id", "id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("tokens", t.rank_tokens(F.col("x")))
    hits = rows.join(terms, "query_id").select("query_id", "id", "i", "n", "at", F.array_intersect(F.array_distinct("tokens"), "terms").alias("hit"))
    a, b = hits.alias("a"), hits.alias("b")
    near = (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.id") == F.col("b.id")) & (F.col("b.i") >= F.col("a.i")) & ((F.col("b.i") == F.col("a.i")) | (F.col("b.at") + F.col("b.n") - F.col("a.at") <= most))
    runs = a.join(b, near).select(F.col("a.query_id").alias("query_id"), F.col("a.id").alias("id"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), (F.col("b.at") + F.col("b.n") - F.col("a.at")).alias("len"), F.col("b.hit").alias("hit"))
    own = W.partitionBy("query_id", "id", "i").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    runs = runs.withColumn("hits", F.size(F.array_distinct(F.flatten(F.collect_list("hit").over(own)))))
    best = runs.groupBy("query_id", "id").agg(F.max_by(F.struct("i", "j", "hits"), F.struct("hits", -F.col("len"), -F.col("i"))).alias("b"))
    whole = base.join(best, ["query_id", "id"], "left")
    text = F.when(F.coalesce(F.col("b.hits"), F.lit(0)) <= 0, F.array_join(F.slice("s", 1, 2), " ")).otherwise(F.array_join(F.slice("s", F.col("b.i") + 1, F.col("b.j") - F.col("b.i") + 1), " "))
    return ranked.join(whole.select("query_id", "id", F.nullif(F.left(text, F.lit(most)), F.lit("")).alias("best_passage")), ["query_id", "id"])


def _picked(rows, top_k: int, diversity: float):
    """Greedy picks from rows (query_id, id, rank, score, terms, top, most, have, total) by query: (query_id, id, rank, score, done, terms).

    A query's rows are its best ones given the `have` picks before, with their greatest overlap with these. Overlaps only grow with more picks, so a row outside is worth
    no more than the last row here was: picking goes on as long as the best row is worth at least that. The first pick is always certain.
    """
    from itertools import groupby

    def near(a: set, b: set) -> float:
        return len(a & b) / (min(len(a), len(b)) or 1)

    for query, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)
        have, total = own[0][7], own[0][8]
        # [value, -rank, id, score, top, terms, most]
        left = [[(1 - diversity) * r[3] / r[5] - diversity * r[6], -r[2], r[1], r[3], r[5], set(r[4]), r[6]] for r in own]
        floor = min((x[0], x[1]) for x in left) if have + len(left) < total else (float("-inf"), 0)
        out = []
        while left and have + len(out) < top_k:
            best = max(left, key=lambda x: (x[0], x[1]))
            if (best[0], best[1]) < floor:
                break
            left.remove(best)
            out.append(best)
            for x in left:
                x[6] = max(x[6], near(x[5], best[5]))
                x[0] = (1 - diversity) * x[3] / x[4] - diversity * x[6]
        done = have + len(out) >= min(top_k, total)
        for place, x in enumerate(out, have + 1):
            yield query, x[2], place, x[3], done, list(x[5])


#: Queries whose picks are sent to all tasks; beyond, Spark joins them as it sees fit.
SENT_PICKS = 1_000


def mmr(docs: DataFrame, queries: DataFrame, top_k: int = 10, diversity: float = 0.5, ranked: DataFrame | None = None, title: str | None = None, first: int | None = None) -> DataFrame:
    """(query_id, id, rank, score) picked greedily from all matching documents by (1 - d) * relative score - d * greatest overlap with what is picked; ties by score, then id.

    All matching documents are valued in one pass over their terms, where they lie; the best `first` rows of each query (4 * top_k, 256 at least) go on to one task a query, which picks from them as
    long as no document beyond these can win, and then a next pass values all again. A pass picks one document a query at least. Terms compare by 64-bit hashes.
    Ids may be of any type and must be unique; documents without an id are left out. ranked: what bm25 gave without a cut, if it is there already.
    """
    best = kept((bm25(docs, queries, None, title) if ranked is None else ranked).where("id is not null").select("query_id", "id", "rank", F.round("score", 9).alias("score")))
    words = t.rank_tokens(F.col("text")) if title is None else F.concat(t.rank_tokens(F.coalesce(F.col(title), F.lit(""))), t.rank_tokens(F.col("text")))
    sizes = best.groupBy("query_id").agg(F.count("*").alias("total"), F.greatest(F.max("score"), F.lit(1e-300)).alias("top"))
    kinds = dict(best.dtypes)
    front = first or max(256, 4 * top_k)
    asks = best.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("query_id", "rank", "score")).alias("asks"))
    matched = docs.join(asks.select("_id"), F.col("id") == F.col("_id"), "left_semi").select("id", F.transform(F.array_distinct(words), lambda x: F.xxhash64(x)).alias("terms"))
    matched = kept(matched.join(asks, F.col("id") == F.col("_id")).select("id", "terms", "asks"))
    few = sizes.count() <= SENT_PICKS
    names = ["query_id", "id", "rank", "score", "terms", "top", "most", "have", "total"]

    def work(batches):
        import pyarrow as pa

        keys = []

        def rows():
            for batch in batches:
                keys[:] = [batch.schema.field("query_id").type, batch.schema.field("id").type]
                yield from zip(*[batch.column(x).to_pylist() for x in names], strict=True)

        held = list(_picked(rows(), top_k, diversity))
        if held:
            kind = [*keys, pa.int32(), pa.float64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], x) for k, x in enumerate(kind)], names=["query_id", "id", "rank", "score", "done", "terms"])

    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, rank int, score double, done boolean, terms array<bigint>"
    picks = None
    for _ in range(top_k + 1):  # a pass picks at least one document a query, the last one finds that nothing is open
        if picks is None:
            state = sizes.withColumns({"seen": F.array().cast("array<array<bigint>>"), "gone": F.array().cast(f"array<{kinds['id']}>")})
        else:
            told = picks.groupBy("query_id").agg(F.collect_list("terms").alias("seen"), F.collect_list("id").alias("gone"), F.max("done").alias("done"))
            state = kept(sizes.join(told, "query_id").where("not done").drop("done"))
            if state.isEmpty():
                break
        state = F.broadcast(state) if few else state
        size = lambda a, b: F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
        near = F.array_max(F.transform("seen", lambda s: F.size(F.array_intersect("terms", s)) / size(F.col("terms"), s)))
        rows = matched.select("id", "terms", F.explode("asks").alias("a")).select("id", "terms", "a.*").join(state, "query_id").where(~F.array_contains("gone", F.col("id")))
        rows = rows.select("query_id", "id", "rank", "score", "top", F.coalesce(near, F.lit(0.0)).alias("most"), F.size("gone").alias("have"), "total")
        value = F.lit(1 - diversity) * F.col("score") / F.col("top") - F.lit(float(diversity)) * F.col("most")
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(value.desc(), "rank"))).where(F.col("place") <= front).drop("place")
        rows = kept(rows).join(matched.select(F.col("id").alias("_id"), "terms"), F.col("id") == F.col("_id"))
        part = rows.select(*names).repartition("query_id").sortWithinPartitions("query_id", "rank")
        found = part.mapInArrow(work, schema)
        picks = kept(found if picks is None else picks.unionByName(found))
    return picks.select("query_id", "id", "rank", "score")


def rerank(docs: DataFrame, queries: DataFrame, top_k: int = 10, diversity: float = 0.0, passage: int = 320, title: str | None = None) -> DataFrame:
    """(query_id, id, rank, score, relative, matched_terms, best_passage): the best documents of each query, then others by id up to top_k.

    With a diversity, the matching ones are picked by mmr from all that match. Others, which match no term, have score 0, no terms and no passage.
    Ids may be of any type; as the API does, repeated and missing ids are refused (ValueError).
    """
    if docs.groupBy("id").count().where("id is null or count > 1").limit(1).count():
        raise ValueError("documents need ids, each of its own")
    every = kept(bm25(docs, queries, None, title)) if diversity else bm25(docs, queries, top_k, title)
    best = every
    if diversity:
        picked = mmr(docs, queries, top_k, diversity, every, title).select(F.col("query_id").alias("_q"), F.col("id").alias("_i"), F.col("rank").alias("_r"))
        best = every.join(picked, (F.col("query_id") == F.col("_q")) & (F.col("id") == F.col("_i"))).withColumn("rank", F.col("_r")).drop("_q", "_i", "_r")
    n = queries.select("query_id").distinct().join(every.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < top_k)
    # Places are left only where fewer than top_k documents match: among the first 2 * top_k by id enough others are found.
    first = docs.select("id").orderBy("id").limit(2 * top_k)
    rest = n.crossJoin(first).join(every.select("query_id", "id"), ["query_id", "id"], "left_anti")
    rest = rest.withColumn("rank", F.col("n").cast("int") + F.row_number().over(W.partitionBy("query_id").orderBy("id"))).where(F.col("rank") <= top_k)
    own = passages(best, docs, queries, passage)
    return own.unionByName(rest.select("query_id", "id", "rank", F.lit(0.0).alias("score"), F.lit(0.0).alias("relative"), F.array().cast("array<string>").alias("matched_terms")), allowMissingColumns=True)
