"""Benchmark decontamination by winnowing.

Every run of `window` consecutive words keeps the least of its k-gram hashes, so a run that a document shares with a
benchmark item keeps the same one on both sides. Fingerprints of the items meet those of the documents; a hit is
extended: the windows around it are looked up whole, and all their words count as hit.

The benchmark is joined in blocks of bounded size, each sent to all executors; a larger benchmark takes more blocks.
Documents are never shuffled for one block; for more, only the hit spans are.

Nulls and empty texts have no words: no hits. A null item_id counts as an item but is not listed. Repeated item rows
count once by item_id. Repeated documents are rows of their own. An empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as c

#: Characters of benchmark text sent to the executors at once.
BLOCK_CHARS = 16_000_000
OUT = "r long, n_words long, starts array<int>, ends array<int>, items array<long>"


def _lengths(window: int, n: int) -> tuple[int, int]:
    """k and the number of k-grams of a window of n words: the last is 1 for windows shorter than `window`."""
    k = (window + 1) // 2 if n == window else n
    return k, n - k + 1


def index(texts: list[str], window: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of window: fingerprints, window hashes, and the items (by position) of each window hash."""
    import pyarrow as pa

    b, at = c.texts(pa.array(texts, type=pa.string()))
    h, first = c.words(b, at, c.ALNUM, c.LOWER)
    windows: dict[int, list[tuple[np.ndarray, int]]] = {}
    prints: dict[int, list[np.ndarray]] = {}
    for i in range(len(texts)):
        own = h[first[i] : first[i + 1]]
        if n := min(len(own), window):
            k, w = _lengths(window, n)
            windows.setdefault(n, []).append((c.grams(own, n), i))
            prints.setdefault(n, []).append(c.sliding_min(c.grams(own, k), w))
    out = []
    for n, own in sorted(windows.items()):
        pairs = np.unique(np.array([(int(x), i) for g, i in own for x in g], dtype=c.U), axis=0)
        keys, starts = np.unique(pairs[:, 0], return_index=True)
        out.append((n, np.unique(np.concatenate(prints[n])), keys, np.append(starts, len(pairs)), pairs[:, 1].astype(np.int64)))
    return out


def hits(h: np.ndarray, table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the words of one or more texts that lie in a window of the table, and (word, row of the table's windows) of each hit."""
    flags = np.zeros(len(h) + 1, dtype=np.int32)
    found = []
    for t, (n, prints, keys, _, _) in enumerate(table):
        if len(h) < n:
            continue
        k, w = _lengths(window, n)
        g = c.grams(h, k)
        low = c.sliding_min(g, w)
        at = np.searchsorted(prints, low)
        at[at == len(prints)] = 0
        start = np.flatnonzero(prints[at] == low)  # runs whose fingerprint some item has
        if not len(start):
            continue
        own = c.grams(h[start[:, None] + np.arange(n)].ravel(), n)[::n] if n > 1 else c.grams(h[start], 1)
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        same = keys[at] == own
        start, at = start[same], at[same]
        flags[start] += 1
        flags[start + n] -= 1
        found.append(np.stack([start, np.full(len(start), t), at], axis=1))
    return np.cumsum(flags[:-1]) > 0, np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def scan(batches, table, window: int):
    """Arrow batches of (r, text) to (r, n_words, spans of hit words, rows of items)."""
    import pyarrow as pa

    for batch in batches:
        b, at = c.texts(batch.column("text"))
        rows = batch.column("r").to_numpy(zero_copy_only=False)
        n_words, starts, ends, items = [], [], [], []
        for i, j in c.slabs(at):
            own = at[i : j + 1] - at[i]
            h, first = c.words(b[at[i] : at[j]], own, c.ALNUM, c.LOWER)
            # A random number between texts keeps windows from reaching over: no item has it.
            sep = c.mix(np.arange(first[-1] + 1, first[-1] + j - i + 1, dtype=c.U) * c.U(0x9E3779B97F4A7C15))
            h = np.insert(h, first[1:], sep)
            begin = first + np.arange(j - i + 1)
            flags, found = hits(h, table, window)
            flags[begin[1:] - 1] = False
            s, e = c.runs(flags)
            of = np.searchsorted(begin, s, side="right") - 1
            cut = np.searchsorted(of, np.arange(j - i + 1))
            doc = np.searchsorted(begin, found[:, 0], side="right") - 1
            of_doc: dict[int, set[int]] = {}
            for d, t, k in zip(doc, found[:, 1], found[:, 2], strict=True):
                _, _, _, first_item, item = table[t]
                of_doc.setdefault(int(d), set()).update(item[first_item[k] : first_item[k + 1]].tolist())
            for d in range(j - i):
                n_words.append(int(first[d + 1] - first[d]))
                starts.append((s[cut[d] : cut[d + 1]] - begin[d]).tolist())
                ends.append((e[cut[d] : cut[d + 1]] - begin[d]).tolist())
                items.append(sorted(of_doc.get(d, ())))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names=["r", "n_words", "starts", "ends", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", id_col: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, spans (of hit words, from 0), item_ids (as sorted strings), contaminated."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.length("text") + 40).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("text"))
    many = blocks > 1
    keyed = source.withColumn("r", F.xxhash64("_id", "text")) if many else source
    parts = []
    for n in range(blocks):
        # Items are dealt to blocks by hash: block_chars bounds what the driver reads here, up to one item's length.
        rows = (bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if many else bench).collect()
        names = sorted({x["item_id"] for x in rows if x["item_id"] is not None})
        at = {x: i for i, x in enumerate(names)}
        table = index([x["text"] for x in rows], window)
        # Rows of the block become rows of its sorted ids, so that repeated items count once; null ids all count as one.
        own = np.array([at.get(x["item_id"], len(names)) for x in rows], dtype=np.int64)
        table = [(n, p, k, s, own[i]) for n, p, k, s, i in table]
        sent = spark.sparkContext.broadcast(table)
        label = spark.sparkContext.broadcast(names)
        parts.append(_scan_block(keyed, sent, label, window))
    if not many:
        return _shape(parts[0], id_col)
    one = parts[0]
    for x in parts[1:]:
        one = one.unionByName(x)
    # Each row of documents comes once from each block; equal rows have equal results, so they are counted and dealt out again.
    merged = one.groupBy("_id", "_key").agg(F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"), F.max("anon").alias("anon"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.floor(F.count("*") / blocks).alias("copies"))
    merged = merged.withColumn("spans", F.expr("""aggregate(spans, cast(array() as array<struct<s:int,e:int>>), (acc, x) ->
        if(size(acc) > 0 and element_at(acc, -1).e >= x.s, concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e)))), concat(acc, array(x))))"""))
    return _shape(merged.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), id_col)


def _scan_block(source: DataFrame, sent, label, window: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["r", "text"])
            names = np.array([*label.value, None], dtype=object)
            for out in scan([numbered], sent.value, window):
                ids, anon = [], []
                for x in out.column("items").to_pylist():
                    anon.append(bool(x) and x[-1] == len(names) - 1)
                    ids.append([names[i] for i in x if i < len(names) - 1])
                spans = [[{"s": s, "e": e} for s, e in zip(a, b, strict=True)] for a, b in zip(out.column("starts").to_pylist(), out.column("ends").to_pylist(), strict=True)]
                key = batch.column("r") if "r" in batch.schema.names else pa.nulls(batch.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("_id"), key, out.column("n_words"), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(anon, pa.bool_()), pa.array(ids, pa.list_(pa.string()))], names=["_id", "_key", "n_words", "spans", "anon", "item_ids"])

    kind = dict(source.dtypes)["_id"]
    return source.mapInArrow(run, f"_id {kind}, _key long, n_words long, spans array<struct<s:int,e:int>>, anon boolean, item_ids array<string>")


def _shape(df: DataFrame, id_col: str) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]))
    return df.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), "spans", "item_ids", (F.size("item_ids") + F.col("anon").cast("int")).cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests: items as a SHA-256 of their sorted ids."""
    out = decontaminate(c.read(spark, sf_dir, "documents"), c.read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
