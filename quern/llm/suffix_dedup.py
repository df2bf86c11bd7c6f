"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts anywhere else.

Shards are formed so that equal strings meet. Each window of `length` bytes picks its least gram of `gram` bytes (by hash, the
leftmost of equals), so equal windows pick alike; windows in a row with the same pick form a segment. A segment whose pick occurs nowhere
else holds no repeat and goes no further. The others are dealt to shards by their pick, equal segments once with their
number. Each shard concatenates its segments (with a byte between them that UTF-8 never has), builds a suffix array by
Larsson-Sadakane refinement (only unsorted groups are sorted again, by the ranks at twice the depth) and the
common prefixes of neighbours by Kasai's algorithm, in as many lanes as numpy takes; a window repeats if a neighbour shares
`length` bytes, or if its whole segment occurs again. A pick with more than `crowd` different segments is dealt to several
shards by the segments' hashes; these export their windows in sorted order, and binary search in the others' merges them.

Texts are UTF-8 bytes, nulls empty; matches never cross documents, may overlap, and are judged on the input. Repeated rows
repeat each other. Strings shorter than `length` hold no repeat. Empty tables give no rows. Segments and windows compare by
hashes of 128 bits in all (pick and content); within shards bytes are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as c

#: Windows handled at once, bits of a position among them, bytes of a shard.
PIECE, POS, SHARD = 1 << 19, 20, 2 << 20
GAP = 0xFF
#: The least numbers with a second, third, ... byte.
BOUNDS = c.U(1) << (np.arange(1, 8, dtype=c.U) * c.U(8))


def segments(b: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """(pick, start, windows, content hash) of the runs of valid windows with the same pick. b holds at most 2**POS bytes."""
    n = len(b) - length + 1
    p = c.prefix(b)
    i = np.arange(len(b) - gram + 1)
    g = c.mix((p[gram:] - p[:-gram]) * c.powers(len(p), inverse=True)[: len(i)])
    low = c.sliding_min((g << c.U(POS)) | i.astype(c.U), length - gram + 1)[:n]
    ok = valid[:n]
    new = np.ones(n, dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], n)
    use = ok[s]
    s, e = s[use], e[use]
    pick = g[(low[s] & c.U((1 << POS) - 1)).astype(np.int64)] >> c.U(POS)
    return pick, s, e - s, c.span_hash(p, s, e + length - 1)


def _cut(batches, length: int, gram: int):
    import pyarrow as pa

    for batch in batches:
        b, at = c.texts(batch.column("text"))
        k1, k2 = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("k1", "k2"))
        for i, j in c.slabs(at, PIECE):
            whole, own = b[at[i] : at[j]], at[i : j + 1] - at[i]
            for lo in range(0, max(1, len(whole) - length + 1), PIECE):  # more than one piece only for a single long text
                part = whole[lo : lo + PIECE + length - 1]
                if len(part) < length:
                    continue
                valid = np.ones(len(part), dtype=bool)
                for end in own[1:] - lo:
                    if end > 0:
                        valid[max(0, end - length + 1) : end] = False
                pick, s, m, digest = segments(part, valid, length, gram)
                d = np.searchsorted(own, lo + s, side="right") - 1
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(k1[i + d]), pa.array(k2[i + d]), pa.array(pick.view(np.int64)), pa.array(digest.view(np.int64)), pa.array((lo + s - own[d]).astype(np.int64)), pa.array(m.astype(np.int32))], names=["k1", "k2", "pick", "digest", "s", "m"])


def packed(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first highest."""
    x = np.concatenate((t, np.zeros(8, np.uint8))).astype(c.U)
    one = (x[:-1] << c.U(8)) | x[1:]
    two = (one[:-2] << c.U(16)) | one[2:]
    return ((two[:-4] << c.U(32)) | two[4:])[: len(t)]


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions in the order of their suffixes, or of the first `depth` bytes at least, by Larsson-Sadakane refinement."""
    n = len(t)
    one = np.concatenate((t.astype(c.U) + c.U(1), np.zeros(7, c.U)))  # nine bits a byte: 0 is the end
    two = (one[:-1] << c.U(9)) | one[1:]
    four = (two[:-2] << c.U(18)) | two[2:]
    key = (four[:n] << c.U(27)) | (two[4 : n + 4] << c.U(9)) | one[6 : n + 6]
    sa = np.argsort(key)
    head = np.ones(n, dtype=bool)
    head[1:] = key[sa][1:] != key[sa][:-1]
    return _refine(sa, head, depth, 7)


def _refine(sa: np.ndarray, head: np.ndarray, depth: int | None, h: int) -> np.ndarray:
    """Order the groups that h bytes leave unsorted by the ranks h bytes on, doubling h each time."""
    n = len(sa)
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = group
    while depth is None or h < depth:
        single = head & np.append(head[1:], True)
        at = np.flatnonzero(~single)  # places in unsorted groups
        if not len(at):
            break
        pos = sa[at]
        nxt = pos + h
        two = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort((rank[pos].astype(c.U) << c.U(32)) | two.astype(c.U))
        sa[at] = pos[order]
        g, two = rank[pos][order], two[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (two[1:] != two[:-1])
        head[at] = new
        rank[sa[at]] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2
    return sa


def kasai(t: np.ndarray, sa: np.ndarray, most: int, lane: int = 512) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the array, up to `most`; 0 for the first.

    Kasai's walk through the text keeps the last length less one; lanes of `lane` positions walk side by side.
    """
    n = len(t)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n
    word = np.append(packed(t), c.U(0))
    out = np.zeros(n, dtype=np.int32)
    start = np.arange(0, n, lane)
    kept = np.zeros(len(start), dtype=np.int64)
    for step in range(lane):
        i = start + step
        live = np.flatnonzero(i < n)
        i = i[live]
        j = before[i]
        l = np.maximum(kept[live] - 1, 0)
        l[j == n] = 0
        go = np.flatnonzero((j < n) & (l < most))
        while len(go):
            p, q = i[go] + l[go], j[go] + l[go]
            diff = word[np.minimum(p, n)] ^ word[np.minimum(q, n)]
            same = np.where(diff == 0, 8, 7 - np.searchsorted(BOUNDS, diff, side="right"))
            same = np.minimum(same, np.minimum(n - p, n - q))
            l[go] += same
            go = go[(same == 8) & (l[go] < most)]
        l = np.minimum(l, most)
        kept[live] = l
        out[i] = l
    lcp = out[sa]
    lcp[0] = 0
    return lcp


def repeated(parts: list[bytes], length: int) -> np.ndarray:
    """For the parts joined by GAP bytes: at which positions a string of `length` bytes starts that also starts elsewhere in them."""
    t = np.frombuffer(bytes([GAP]).join(parts) + bytes([GAP]), dtype=np.uint8)
    flags = np.zeros(len(t), dtype=bool)
    if len(t) <= length:
        return flags
    sa = suffix_array(t)  # to the end: Kasai leans on the exact order
    lcp = kasai(t, sa, length)
    hit = lcp >= length
    hit[:-1] |= lcp[1:] >= length
    flags[sa[hit]] = True
    end = -1
    for x in parts:  # strings that reach over a part's end are none of it
        end += len(x) + 1
        flags[max(end - length + 1, 0) : end + 1] = False
    return flags


def _shard(table, length: int):
    """One shard: (k1, k2, s, e) windows that repeat in it, of segments that occur once; and the windows of crowded picks, sorted."""
    import pyarrow as pa

    rows = table.sort_by([("pick", "ascending"), ("digest", "ascending")])
    parts = [x.as_py() for x in rows.column("bytes")]
    flags = repeated(parts, length)
    begin = np.concatenate(([0], np.cumsum([len(x) + 1 for x in parts])))
    once = np.array(rows.column("n").to_numpy()) == 1
    s, e = c.runs(flags)
    of = np.searchsorted(begin, s, side="right") - 1
    use = once[of]
    s, e, of = s[use] - begin[of[use]], e[use] - begin[of[use]], of[use]
    col = lambda name: rows.column(name).to_numpy()
    k1, k2, first = col("k1"), col("k2"), col("s")
    out = {"k1": pa.array(k1[of]), "k2": pa.array(k2[of]), "s": pa.array(first[of] + s), "e": pa.array(first[of] + e), "cell": pa.nulls(len(of), pa.int64()), "payload": pa.nulls(len(of), pa.binary())}
    found = [pa.table(out)]
    crowded = np.flatnonzero(col("crowd") > 1)
    if len(crowded):
        code = []
        for i in crowded:
            b = np.frombuffer(parts[i], dtype=np.uint8)
            m = len(b) - length + 1
            p = c.prefix(b)
            at = np.arange(m)
            one = c.span_hash(p, at, at + length)
            two = c.mix(one ^ c.mix((p[length:] - p[:-length] + c.U(1)) * c.powers(len(p), inverse=True)[:m] ^ c.U(0x5851F42D4C957F2D)))
            row = np.empty(m, dtype=[("one", "<u8"), ("pick", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i8")])
            row["one"], row["pick"], row["k1"], row["k2"], row["s"] = two, rows.column("pick")[int(i)].as_py(), k1[i], k2[i], first[i] + at
            code.append(row)
        code = np.concatenate(code)
        code = code[np.argsort(code["one"], kind="stable")]
        cells = (code["one"] >> c.U(52)).astype(np.int64)
        cuts = np.searchsorted(cells, np.arange(4097))
        full = [x for x in range(4096) if cuts[x] < cuts[x + 1]]
        none = pa.nulls(len(full), pa.int64())
        found.append(pa.table({"k1": none, "k2": none, "s": none, "e": none, "cell": pa.array(full, pa.int64()), "payload": pa.array([code[cuts[x] : cuts[x + 1]].tobytes() for x in full], pa.binary())}))
    return pa.concat_tables(found)


def _merge(table):
    """One range of the crowded picks' windows: those that binary search finds in another shard's export."""
    import pyarrow as pa

    kind = [("one", "<u8"), ("pick", "<i8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i8")]
    blocks = [np.frombuffer(x.as_py(), dtype=kind) for x in table.column("payload")]
    merged = np.sort(np.concatenate([np.unique(x["one"]) for x in blocks]))
    out = []
    for x in blocks:
        # Its own export holds a window once: a second place in the merged order belongs to another shard.
        n = np.searchsorted(merged, x["one"], side="right") - np.searchsorted(merged, x["one"], side="left")
        out.append(x[n > 1])
    hit = np.concatenate(out)
    return pa.table({"k1": pa.array(hit["k1"].copy()), "k2": pa.array(hit["k2"].copy()), "s": pa.array(hit["s"].copy()), "e": pa.array(hit["s"] + 1)})


def repeats(docs: DataFrame, text: str, id_col: str, length: int, gram: int, crowd: int) -> DataFrame:
    """(k1, k2, s, e): runs of windows of each document that start elsewhere too, not merged."""
    base = docs.select(F.xxhash64(F.col(id_col), F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text), F.col(id_col)).alias("k2"), F.col(text).cast("string").alias("text"))
    runs = c.cut(base.mapInArrow(lambda x: _cut(x, length, gram), "k1 long, k2 long, pick long, digest long, s long, m int"), "suffix-runs")
    twice = runs.groupBy("pick").agg(F.count("*").alias("t")).where("t > 1").select(F.col("pick").alias("p2"))
    alive = c.cut(runs.join(twice, F.col("pick") == F.col("p2"), "left_semi"), "suffix-alive")
    o = F.xxhash64("k1", "k2", "s")
    classes = alive.groupBy("pick", "digest").agg(F.count("*").alias("n"), *[F.min_by(x, o).alias(x) for x in ("k1", "k2", "s", "m")])
    classes = c.cut(classes, "suffix-classes")
    sizes = classes.groupBy("pick").agg(F.count("*").alias("kinds")).where("kinds > 1").select(F.col("pick").alias("p2"), "kinds")
    several = classes.join(sizes, F.col("pick") == F.col("p2")).withColumn("crowd", F.ceil(F.col("kinds") / F.lit(crowd)).cast("int"))
    total = several.agg(F.sum(F.col("m") + length).alias("n")).first()["n"] or 0
    shards = int(total / SHARD) + 1
    shard = F.pmod(F.xxhash64("pick", F.pmod("digest", F.col("crowd").cast("long"))), F.lit(shards))
    want = several.select("k1", "k2", F.struct("pick", "digest", "n", "s", "m", "crowd", shard.alias("shard")).alias("x")).groupBy("k1", "k2").agg(F.collect_list("x").alias("want")).withColumnsRenamed({"k1": "j1", "k2": "j2"})
    got = base.join(want, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")))
    parts = got.mapInArrow(lambda x: _slices(x, length), "shard long, pick long, digest long, n long, crowd int, k1 long, k2 long, s long, bytes binary")
    found = c.cut(parts.groupBy("shard").applyInArrow(lambda t: _shard(t, length), "k1 long, k2 long, s long, e long, cell long, payload binary"), "suffix-found")
    merged = found.where("cell is not null").groupBy("cell").applyInArrow(_merge, "k1 long, k2 long, s long, e long")
    again = classes.where("n > 1").select(F.col("pick").alias("p2"), F.col("digest").alias("d2"))
    whole = alive.join(again, (F.col("pick") == F.col("p2")) & (F.col("digest") == F.col("d2")), "left_semi").select("k1", "k2", "s", (F.col("s") + F.col("m")).alias("e"))
    return whole.union(found.where("cell is null").select("k1", "k2", "s", "e")).union(merged)


def _slices(batches, length: int):
    """The bytes of the segments that are wanted of each text."""
    import pyarrow as pa

    for batch in batches:
        b, at = c.texts(batch.column("text"))
        out: dict[str, list] = {x: [] for x in ("shard", "pick", "digest", "n", "crowd", "k1", "k2", "s", "bytes")}
        for i, (k1, k2, want) in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("want").to_pylist(), strict=True)):
            for x in want:
                for name in ("shard", "pick", "digest", "n", "crowd", "s"):
                    out[name].append(x[name])
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["bytes"].append(b[at[i] + x["s"] : at[i] + x["s"] + x["m"] + length - 1].tobytes())
        kinds = {"crowd": pa.int32(), "bytes": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(x, pa.int64())) for x, v in out.items()], names=list(out))


def _remove(batches, length: int):
    import pyarrow as pa

    for batch in batches:
        b, at = c.texts(batch.column("text"))
        starts, ends, kept = [], [], []
        found = batch.column("found")
        cuts, none = found.offsets.to_numpy(), found.is_null().to_numpy(zero_copy_only=False)
        first, last = (found.values.field(x).to_numpy(zero_copy_only=False) for x in ("s", "e"))
        for i in range(batch.num_rows):
            own = b[at[i] : at[i + 1]]
            if none[i] or cuts[i] == cuts[i + 1]:
                starts.append([])
                ends.append([])
                kept.append(own.tobytes())
                continue
            change = np.zeros(len(own) + 1, dtype=np.int32)
            np.add.at(change, first[cuts[i] : cuts[i + 1]].astype(np.int64), 1)
            np.add.at(change, last[cuts[i] : cuts[i + 1]].astype(np.int64) + length - 1, -1)
            gone = np.cumsum(change[:-1]) > 0
            s, e = c.runs(gone)
            starts.append(s.tolist())
            ends.append(e.tolist())
            kept.append(own[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["_id", "n_bytes", "starts", "ends", "kept"])


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 200, gram: int = 40, crowd: int = 4096) -> DataFrame:
    """One row per document: id_col, n_bytes, starts and ends of the removed runs, kept (the other bytes, joined)."""
    found = repeats(docs, text, id_col, length, gram, crowd).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("j1"), F.xxhash64(F.lit(1), F.col(text), F.col(id_col)).alias("j2"), F.col(text).cast("string").alias("text"))
    both = base.join(found, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left").select("_id", "text", "found")
    kind = dict(base.dtypes)["_id"]
    return both.mapInArrow(lambda x: _remove(x, length), f"_id {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary").withColumnRenamed("_id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(c.read(spark, sf_dir, "documents"))
    gone = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256) by a dictionary of all strings: for tests."""
    data = [(x or "").encode() for x in texts]
    seen: dict[bytes, int] = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        s, _ = c.runs(gone)
        out.append((len(b), int(gone.sum()), len(s), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
