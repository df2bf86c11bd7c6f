"""What the operators share: durable cuts of lineage, connected components, text as bytes in numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts for mixing and the Jaccard join: maximal runs of other characters than these.
SPACES = r"[^\x20\x09-\x0D]+"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary one, on a local master alone: no other executor would see it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", d)
    return f"{d.rstrip('/')}/quern-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors cost nothing that stands before this point.

    by: a column to bucket by, so that aggregates and joins on it need no shuffle of this table afterwards.
    The shuffle files behind a query are removed once it is done, from the first cut of a session on; they would otherwise stay until the driver collects garbage.
    """
    spark = df.sparkSession
    name = f"{tag}-{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{name}"
    if spark.conf.get(CLEANUP, "false") != "true":
        spark.conf.set(CLEANUP, "true")
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        table = "quern_" + name.replace("-", "_")
        writer.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
        out = spark.table(table)
    out._quern_cut = (path, by and table)
    return out


def release(*cuts: DataFrame) -> None:
    """Empty the tables behind these cuts, which nothing may read any more."""
    for df in cuts:
        path, table = df._quern_cut
        df.sparkSession.createDataFrame([], "x int").coalesce(1).write.mode("overwrite").parquet(path)
        if table:
            df.sparkSession.sql(f"drop table {table}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc", rounds: int = 40) -> DataFrame:
    """Connected components by alternating large and small stars: (node, root) of every node in edges, root its least node.

    Each round is two joins on the node with its least neighbour, pre-aggregated before the shuffle; the join of a
    star's centre is one that Spark can split. Rounds grow with the logarithm of the longest path.
    Null ends are left out; loops and repeated edges change nothing; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = cut(e, tag)
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
        small = large.join(least, F.col("a") == F.col("c")).select(F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("x")).select("x.*").distinct()
        e = cut(small, tag)
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def unit(*cols: Column | str) -> Column:
    """A reproducible number in (0, 1) from the first 52 bits of an MD5; the same in other SQL engines."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


# ---- text as bytes in numpy -------------------------------------------------

U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random 64-bit number for each byte.
BYTE = mix(np.arange(1, 257, dtype=U) * U(_MUL))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base modulo 2^64, or of its inverse."""
    key = "inv" if inverse else "pow"
    have = _POW.get(key)
    if have is None or len(have) < n:
        base = pow(_MUL, -1, 1 << 64) if inverse else _MUL
        out = np.full(max(n, 1 << 16), U(base), dtype=U)
        out[0] = 1
        _POW[key] = have = np.cumprod(out, dtype=U)
    return have[:n]


def prefix(b: np.ndarray) -> np.ndarray:
    """P of length n + 1 with P[e] - P[s] = the polynomial hash of bytes s..e, times the s-th power of the base."""
    out = np.zeros(len(b) + 1, dtype=U)
    np.cumsum(BYTE[b] * powers(len(b)), out=out[1:])
    return out


def span_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans s..e from their prefix sums, lengths included."""
    return mix((p[e] - p[s]) * powers(len(p), inverse=True)[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items, joined from blocks whose widths are the binary digits of k; empty if there are fewer."""
    n, base = len(h) - k + 1, 0xC2B2AE3D27D4EB4F
    if n <= 0:
        return h[:0]
    acc, done, width, block = None, 0, 1, h
    while True:
        if k & width:
            if acc is None:
                acc = block
            else:
                m = min(len(acc), len(block) - done)
                acc = acc[:m] * U(pow(base, width, 1 << 64)) + block[done : done + m]
            done += width
        if done == k:
            return mix(acc[:n].copy())
        block = block[:-width] * U(pow(base, width, 1 << 64)) + block[width:]
        width *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    width, out = 1, x
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:n], out[w - width : w - width + n])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (nulls: empty) and where each value starts and ends in them."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[at[0] : at[-1]] if len(at) else b[:0], at - (at[0] if len(at) else 0)


def slabs(at: np.ndarray, most: int = 1 << 21):
    """Ranges of values whose bytes come to at most `most`, or single longer values."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(b: np.ndarray, at: np.ndarray, is_word: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slab of texts, and the number of the first word of each text (with the end as the last)."""
    flag = is_word[b]
    start = flag.copy()
    start[1:] &= ~flag[:-1]
    inner = at[(at > 0) & (at < len(b))]
    start[inner] = flag[inner]
    s = np.flatnonzero(start)
    stop = ~flag
    nxt = np.empty(len(b) + 1, dtype=bool)
    nxt[: len(b)] = stop
    nxt[len(b)] = True
    nxt[inner] = True
    bounds = np.flatnonzero(nxt)
    e = bounds[np.searchsorted(bounds, s, side="right")] if len(s) else s
    return span_hash(prefix(lower[b]), s, e), np.searchsorted(s, at)


_ALL = np.arange(256, dtype=np.uint8)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
NOT_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
#: Digits, letters A-Z in either case and whatever is not ASCII.
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
