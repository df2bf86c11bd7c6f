"""Periodic run detection by Kolpakov and Kucherov: every maximal repetition of words in a text, in linear time.

A text is cut into the factors of its LZ factorisation, which a suffix automaton yields. Runs that cross or touch the
border of a factor come from Main's algorithm (longest common extensions by Z functions around each border); all
others lie inside a factor and are copied from its earlier occurrence. Each text is one row, and rows stay where they
are: nothing is shuffled, whatever the sizes of sources or of groups of copies.

A run of length >= least and >= exponent * period repeats at least `least - least / exponent` words one period later.
Stretches of a text without such a repeated gram at a fitting distance hold no run, so factorisation starts only where
there is one. That filter compares hashes and errs only by keeping more; the algorithm itself compares words.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as c

LEAST = 24
EXPONENT = 3
#: Bytes of text that one output batch of a worker holds, or a single longer text.
SLAB = 1 << 22


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """The LZ factorisation of x as (start, end, start of the earlier occurrence, or -1): each factor is the longest prefix of the rest that starts earlier too, or a new word."""
    goes, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for i, w in enumerate(x):
        own = len(goes)
        goes.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and w not in goes[p]:
            goes[p][w] = own
            p = link[p]
        if p >= 0:
            q = goes[p][w]
            if length[p] + 1 != length[q]:
                # The strings of q up to this length now end here too: they get a state of their own.
                twin = len(goes)
                goes.append(goes[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = twin
                while p >= 0 and goes[p].get(w) == q:
                    goes[p][w] = twin
                    p = link[p]
                q = twin
            link[own] = q
        last = own
    out, i, n = [], 0, len(x)
    while i < n:
        state, j = 0, i
        while j < n:
            to = goes[state][x[j]]
            if first[to] >= j:
                break
            state = to
            j += 1
        if j == i:
            out.append((i, i + 1, -1))
            i += 1
        else:
            out.append((i, j, first[state] - (j - i) + 1))
            i = j
    return out


def z_function(x: list[int]) -> list[int]:
    """For each position, how far x from there on agrees with the beginning of x; 0 at position 0."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def crossing(x: list[int], at: int, before: int, after: int, least: int, exponent: int):
    """Main's algorithm: (start, end, period) of the repetitions that cross or touch the border `at` between factors of these lengths.

    A run that ends in the right factor starts less than one period before the left one, or that factor could have been longer. So periods, and how far to look, are bounded by both lengths.
    """
    most = (before + after - 1) // (exponent - 1)
    if most < 1 or (before + after - 1) * exponent < least * (exponent - 1):
        return
    width = min(at, before + most)
    left, right = x[at - width : at], x[at : at + after]
    back = left[::-1]
    p_right = min(most, after)
    z_back = z_function([*back, -1, *right[:p_right][::-1], *back])
    z_fore = z_function([*right, -1, *left, *right])
    for p in range(1, p_right + 1):
        suffix, prefix = z_back[width + 1 + p_right - p], z_fore[p] if p < after else 0
        if suffix + p + prefix >= max(least, exponent * p):
            yield at - suffix, at + p + prefix, p
    for p in range(1, min(most, width) + 1):
        suffix, prefix = z_back[p] if p < width else 0, z_fore[after + 1 + width - p]
        if suffix + p + prefix >= max(least, exponent * p):
            yield at - p - suffix, at + prefix, p


def repetitions(x: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of x as (start, end, least period), sorted: maximal, length >= max(least, exponent * period)."""
    n, parts = len(x), factors(x)
    found: dict[tuple[int, int], int] = {}
    for (a, b, _), (_, e, _) in pairwise([*parts, (n, n, -1)]):
        for s, t, p in crossing(x, b, b - a, e - b, least, exponent):
            # Repetitions that go on beyond what was looked at are met at another border.
            if not (s and x[s - 1] == x[s - 1 + p]) and not (t < n and x[t] == x[t - p]):
                found[s, t] = min(p, found.get((s, t), p))
    runs = sorted((s, t, p) for (s, t), p in found.items())
    for start, end, source in parts:
        if source < 0 or end - start < least + 2:
            continue
        k = bisect_right(runs, (source, n, n))
        while k < len(runs) and runs[k][0] < source + end - start:
            s, t, p = runs[k]
            k += 1
            copy = (s + start - source, t + start - source)
            # Neighbours inside the factor are copied as well, so that the copy is maximal too.
            if copy[1] < end and copy not in found:
                found[copy] = p
                insort(runs, (*copy, p))
    return runs


def stretches(ids: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Parts of a text that hold all its runs: those covered by grams that come again within a third (1 / exponent) of the part's length."""
    width = least - least // exponent
    g = c.grams(c.mix(ids.astype(c.U)), width)
    ordered = np.sort(g)
    if not len(g) or not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(g, kind="stable")
    near = np.full(len(g) + 1, len(ids), dtype=np.int64)
    same = g[order[1:]] == g[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    near[a] = b - a
    near[b] = np.minimum(near[b], b - a)
    near = near[:-1]
    live = near < len(ids)
    while True:
        at = np.flatnonzero(live)
        change = np.zeros(len(ids) + 1, dtype=np.int32)
        change[at] = 1
        change[at + width] -= 1
        s, e = c.runs(np.cumsum(change[:-1]) > 0)
        if not len(s):
            return []
        of = np.searchsorted(s, at, side="right") - 1
        keep = near[at] * exponent <= (e - s)[of]
        if keep.all():
            return [(int(x), int(y)) for x, y in zip(s, e, strict=True) if y - x >= least]
        live[at[~keep]] = False


def runs_of(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """The runs of a list of words (or other hashable values) as (start, length, least period), sorted."""
    if len(words) < least:
        return []
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(words) - len(number) < least - least // exponent:
        return []
    return [(s + a, t - s, p) for a, b in stretches(np.array(ids), least, exponent) for s, t, p in repetitions(ids[a:b], least, exponent)]


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    out, at = [], 0
    for s, e in sorted((s + p, s + n) for s, n, p in runs):
        if e > at:
            out += words[at : max(at, s)]
            at = e
    return out + words[at:]


def find_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per row of docs: id_col, n_words, runs (start, length, period by start, then period), collapsed (the kept words joined by one space).

    Words are maximal runs of other bytes than ASCII white space; a run has length >= max(least, exponent * period), and no neighbouring word extends it.
    Null and empty texts: no words, no runs, an empty collapsed text. Equal ids, null ids and repeated rows: a row each. An empty table gives no rows. Other columns of docs are neither read nor returned, whatever their names.
    Memory of a worker: one batch, and for its longest stretch with repeated grams some 0.5 KB a word.
    """
    if exponent < 2 or least < 2 * exponent:
        raise ValueError("exponent >= 2 and least >= 2 * exponent")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("_text"))

    def work(batches):
        import pyarrow as pa

        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            b, at = c.texts(batch.column("_text"))
            raw = b.tobytes()
            for i, j in c.slabs(at, SLAB):
                n_words, all_runs, left = [], [], []
                for k in range(i, j):
                    words = raw[at[k] : at[k + 1]].split()
                    runs = runs_of(words, least, exponent)
                    n_words.append(len(words))
                    all_runs.append(runs)
                    left.append(b" ".join(kept_words(words, runs) if runs else words))
                flat = np.array([r for x in all_runs for r in x], dtype=np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *map(len, all_runs)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], fields=list(kind)))
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(n_words, pa.int64()), lists, pa.array(left, pa.binary()).cast(pa.string())], names=["_id", "n_words", "runs", "collapsed"])

    out = own.mapInArrow(work, f"_id {dict(own.dtypes)['_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("_id", id_col)


def strongest(name: str) -> Column:
    """Of a column of arrays of runs the one with the greatest length / period; ties: least start, then least period. Null if there is none."""
    better = "r.length * b.period > b.length * r.period or (r.length * b.period = b.length * r.period and (r.start < b.start or (r.start = b.start and r.period < b.period)))"
    return F.expr(f"if(size({name}) = 0, null, aggregate(slice({name}, 2, size({name})), {name}[0], (b, r) -> if({better}, r, b)))")


def damaged(docs: DataFrame) -> DataFrame:
    """doc_id and text with the contract's damage: where h % 10 = 0, words from a on repeat with period p. A null doc_id has no h and a text without words no a: these texts stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({c.SPACES})"), F.lit(1))))
    cut = own.select("doc_id", "text", "w", F.size("w").cast("long").alias("n"), F.floor(F.col("h") / 10).alias("g")).selectExpr("doc_id", "text", "w", "n", "g", "g % nullif(n, 0) as a")
    cut = cut.selectExpr("doc_id", "text", "w", "n", "a", "1 + floor((n - a) / (3 + g % 8)) as p")
    again = F.expr("array_join(transform(sequence(0L, n - 1), i -> element_at(w, cast(if(i < a, i, a + (i - a) % p) as int) + 1)), ' ')")
    return cut.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's damage, then all runs and their digests."""
    out = find_runs(damaged(c.read(spark, sf_dir, "documents")))
    best = out.withColumn("best", strongest("runs"))
    spans = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    milli = F.expr("best.length * 1000 div best.period")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), F.sha2(spans, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: CRC-32 of a decimal id in SQL, bit by bit; what follows is gaps and islands over pairs of equal words a period apart.
CRC = "list_reduce([4294967295] || list_transform(string_split({x}, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda h, b: list_reduce([xor(h, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, k: xor(v >> 1, (v & 1) * 3988292384)))"
ORACLE = rf"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor({CRC.format(x="CAST(doc_id AS VARCHAR)")}, 4294967295) AS h FROM documents),
d1 AS (SELECT *, CAST(len(w) AS BIGINT) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM d3),
x AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS t FROM d WHERE n > 0),
m AS (SELECT a.r, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.r = b.r AND a.t = b.t AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
k AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island),
z AS (SELECT r, s, len, min(q) AS q FROM k WHERE len >= greatest(24, 3 * q) GROUP BY r, s, len),
best AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1),
digest AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS spans FROM z GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM z),
kept AS (SELECT x.r, string_agg(x.t, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN gone ON x.r = gone.r AND x.i = gone.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, len * 1000 // q AS exponent_milli, sha256(coalesce(spans, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN digest USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
