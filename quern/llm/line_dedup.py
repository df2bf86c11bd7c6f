"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line is lower-cased and trimmed; blank lines are never compared. Its shingles are the strings of `width` UTF-16 units
at every position, so that each character lies in one; a shorter line is one shingle. Equal lines meet first and
travel on once. Signatures: one 64-bit hash a shingle, and its least value under each of rows * groups exclusive-or masks,
each a permutation. A band is `rows` of these values; the bands part them twice over, so that no two bands share more
than one value. Lines that agree in a band are candidates; exact Jaccard similarity of the shingle sets decides.

No bucket emits all its pairs: its members meet one pivot, then several, and links form components; only buckets whose
members still lie in several components go on, and only pairs across components whose sketches are near enough are made.
Of each component one line stays: that of the least hash of document and place, so which one depends on nothing else.

Recall by calculation, for the defaults (24 values, 12 bands of 4): 0.990 at a similarity of 0.8, 0.9998 at 0.9, of one
pair on its own. The sketches lose less than one pair in two hundred at 0.8.

A line is known by a 64-bit hash of its text; a document by 128 bits of its id and text, so repeated rows keep the same lines.
Null texts have no lines and stay null. Empty tables give no rows. All other columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import common as c

#: Fields of a short sketch, of three bits each, and how many of them two lines may differ in.
FIELDS, APART = 21, 9
#: Words of a long sketch: 64 hash buckets each.
WORDS = 64
#: What is trimmed from lines.
BLANKS = "\t\n\x0b\x0c\r "
#: Shingles that one row holds, as columns for signatures and as an array for sets.
COLUMNS, ARRAY = 4, 24
#: Bytes of a line up to which its set is one array; sets of longer lines are rows.
LONG = 1 << 20


def masks(n: int) -> list[int]:
    """n fixed 64-bit numbers, the digits of a multiplicative sequence."""
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        y = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        out.append((y ^ (y >> 32)) - (1 << 63))
    return out


def band_rows(rows: int, groups: int) -> list[list[int]]:
    """Which values each band holds: the values in a grid of rows x groups, parted once by columns and once by diagonals."""
    return [[groups * a + (b + turn * a) % groups for a in range(rows)] for turn in range(2) for b in range(groups)]


def row_key(text: str, id_col: str) -> list[Column]:
    return [F.xxhash64(F.col(id_col), F.col(text)).alias("k1"), F.xxhash64(F.lit(1), F.col(text), F.col(id_col)).alias("k2")]


def occurrences(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(k1, k2, pos, o, norm, d): every line that isn't blank, with hashes of its place and its text."""
    key = docs.select(*row_key(text, id_col), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    # btrim walks the whole line, so it is left to lines with a blank at an end: those below "!" may begin with one.
    trimmed, below = F.btrim("line", F.lit(BLANKS)), F.col("line") < "!"
    ends = reduce(Column.__or__, [F.endswith("line", F.lit(x)) for x in BLANKS], below)
    norm = F.lower(F.when(ends, trimmed).otherwise(F.col("line")))
    return key.where(~below | (trimmed != "")).select("k1", "k2", "pos", F.xxhash64("k1", "k2", "pos").alias("o"), norm.alias("norm")).withColumn("d", F.xxhash64("norm"))


def _units(norm: str) -> Column:
    return F.encode(norm, "UTF-16BE")


def _last(units: str, width: int) -> Column:
    """Where the last shingle starts."""
    return F.expr(f"greatest(int(length({units}) / 2) - {width}, 0)")


def _from(width: int, n: int) -> list[Column]:
    """Hashes of the n shingles of u from s on, none beyond the last, at z."""
    return [F.xxhash64(F.expr(f"substring(u, 2 * least(s + {j}, z) + 1, {2 * width})")) for j in range(n)]


def shingles(lines: DataFrame, width: int, *own: str) -> DataFrame:
    """(*own, h): a row for each position of each line, with the hash of the shingle there. Positions of bytes, so that no text is scanned twice."""
    at = lines.select(*own, _units("norm").alias("u")).select(*own, "u", F.explode(F.sequence(F.lit(0), _last("u", width))).alias("i"))
    return at.select(*own, F.xxhash64(F.expr(f"substring(u, 2 * i + 1, {2 * width})")).alias("h"))


def _several(lines: DataFrame, width: int) -> DataFrame:
    """(d, h0..): rows of COLUMNS shingles each, the last one again where there are no more. An aggregate is looked up and stored once a row."""
    at = lines.select("d", _units("norm").alias("u")).select("d", "u", _last("u", width).alias("z")).select("d", "u", "z", F.explode(F.expr(f"sequence(0, z, {COLUMNS})")).alias("s"))
    return at.select("d", *[h.alias(f"h{j}") for j, h in enumerate(_from(width, COLUMNS))])


def _least(cols: list[str]) -> str:
    """The least of several numbers that are not null, by comparisons: least() keeps a null flag for each and takes a third longer."""
    if len(cols) == 1:
        return cols[0]
    x, y = _least(cols[: len(cols) // 2]), _least(cols[len(cols) // 2 :])
    return f"if({x} < {y}, {x}, {y})"


def signatures(lines: DataFrame, width: int, rows: int, groups: int) -> DataFrame:
    """(d, q, bands): a short sketch of each line and a hash for each band. lines holds each d once and is dealt by it, so nothing is shuffled here."""
    ms = masks(rows * groups)
    sig = _several(lines, width).groupBy("d").agg(*[F.min(F.expr(_least([f"(h{j} ^ {m}L)" for j in range(COLUMNS)]))).alias(f"m{i}") for i, m in enumerate(ms)])
    q = F.expr(" | ".join(f"shiftleft((m{i % len(ms)} >> {20 + i}) & 7, {3 * i})" for i in range(FIELDS)))
    return sig.select("d", q.alias("q"), F.array(*[F.xxhash64(F.lit(k), *[F.col(f"m{i}") for i in own]) for k, own in enumerate(band_rows(rows, groups))]).alias("bands"))


def near(a: str, b: str) -> Column:
    """Whether two short sketches differ in few enough fields: 3.7 of 21 on average at a similarity of 0.8, 18 of strangers."""
    x = f"({a} ^ {b})"
    return F.expr(f"bit_count(({x} | {x} >> 1 | {x} >> 2) & {sum(1 << 3 * i for i in range(FIELDS))}L) <= {APART}")


def long_sketches(lines: DataFrame, width: int) -> DataFrame:
    """(d, w0.., c): which of 64 * WORDS hash buckets hold a shingle of the line, and how many."""
    own = lambda w: F.expr(f"if((h >> 6 & 15) = {w}, shiftleft(1L, int(h & 63)), 0L)")
    each = shingles(lines, width, "d").groupBy("d", F.expr(f"int(h >> 10 & {WORDS // 16 - 1})").alias("g")).agg(*[F.bit_or(own(w)).alias(f"v{w}") for w in range(16)])
    whole = each.groupBy("d").agg(*[F.coalesce(F.max(F.when(F.col("g") == w // 16, F.col(f"v{w % 16}"))), F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)])
    return whole.select("d", F.expr(" + ".join(f"bit_count(w{w})" for w in range(WORDS))).cast("long").alias("c"), *[f"w{w}" for w in range(WORDS)])


def alike(x: str, y: str, percent: int) -> Column:
    """Whether two long sketches differ in no more buckets than sets of that similarity do on average, and 3.3 standard deviations.

    n members fill n' = B (1 - exp(-n / B)) of B buckets; of sets a and b of similarity s the union has (a + b) / (1 + s) members.
    """
    bins, union = 64 * WORDS, 1 + percent / 100
    size = lambda z: f"ln(1 - least({z}.c, {bins - 1}) / {bins}D)"  # noqa: E731  minus members by buckets
    empty = f"exp(({size(x)} + {size(y)}) / {union})"
    mean = f"({2 * bins} * (1 - {empty}) - {x}.c - {y}.c)"
    apart = " + ".join(f"bit_count({x}.w{w} ^ {y}.w{w})" for w in range(WORDS))
    return F.expr(f"{apart} <= {mean} + 3.3 * sqrt(greatest({mean}, 0) * (1 - {empty}) + 1) + 1")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose shingle sets have 100 * intersection >= percent * union.

    Each pair's rows stay in the partition of its join. Sets are arrays, filled from rows of several shingles; those of a pair with a longer line than LONG are rows, as such a set may not fit in memory.
    """
    x = texts.select(F.col("d").alias("a"), F.col("norm").alias("x"))
    y = texts.select(F.col("d").alias("b"), F.col("norm").alias("y"))
    both = pairs.hint("shuffle_hash").join(x, "a").join(y, "b").select("a", "b", _units("x").alias("ux"), _units("y").alias("uy"))
    long = F.expr(f"greatest(length(ux), length(uy)) > {2 * LONG}")
    out = _by_arrays(both.where(~long), width, percent)
    return out if texts.where(F.octet_length("norm") > LONG).isEmpty() else out.union(_by_rows(both.where(long), width, percent))


def _by_arrays(both: DataFrame, width: int, percent: int) -> DataFrame:
    at = both.select("a", "b", "ux", "uy", _last("ux", width).alias("zx"), _last("uy", width).alias("zy")).withColumn("i", F.explode(F.expr(f"sequence(0, zx div {ARRAY} + zy div {ARRAY} + 1)")))
    at = at.withColumn("k", F.expr(f"i - zx div {ARRAY} - 1")).select("a", "b", "k", *[F.expr(f"if(k < 0, {x}, {y})").alias(n) for x, y, n in (("ux", "uy", "u"), ("zx", "zy", "z"), (f"int(i * {ARRAY})", f"int(k * {ARRAY})", "s"))])
    each = at.select("a", "b", "k", F.array(*_from(width, ARRAY)).alias("h"))
    sets = each.groupBy("a", "b").agg(*[F.flatten(F.collect_list(F.when(side, F.col("h")))).alias(n) for side, n in ((F.col("k") < 0, "x"), (F.col("k") >= 0, "y"))])
    common = sets.select("a", "b", "x", "y", F.size(F.array_intersect("x", "y")).cast("long").alias("i"))
    linked = lambda x, y: f"i * {100 + percent} >= ({x} + {y}) * {percent}"
    return common.where(F.expr(linked("size(array_distinct(x))", "size(array_distinct(y))"))).select("a", "b")


def _by_rows(both: DataFrame, width: int, percent: int) -> DataFrame:
    size = lambda u: F.expr(f"greatest(int(length({u}) / 2) - {width - 1}, 1)")
    at = both.select("a", "b", "ux", "uy", size("ux").alias("nx"), F.explode(F.sequence(F.lit(0), size("ux") + size("uy") - 1)).alias("i"))
    each = at.select("a", "b", F.expr("if(i < nx, 1, 2)").alias("side"), F.xxhash64(F.expr(f"if(i < nx, substring(ux, 2 * i + 1, {2 * width}), substring(uy, 2 * (i - nx) + 1, {2 * width}))")).alias("h"))
    sets = each.groupBy("a", "b", "h").agg(F.bit_or("side").alias("sides"))
    return sets.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("sides") == 3).alias("i")).where(F.col("i") * 100 >= F.col("n") * percent).select("a", "b")


def buckets(sigs: DataFrame, first: int, n: int) -> DataFrame:
    """(band, d, q, p, qp): for each of n bands that several lines share, its lines but the least, which is p. The table is shuffled once, for the aggregate and the join."""
    table = sigs.select("d", "q", F.explode(F.slice("bands", first + 1, n)).alias("band")).where("band is not null and d is not null").repartition("band")  # the filter that the join would set on one side only
    several = table.groupBy(F.col("band").alias("b2")).agg(F.min("d").alias("p"), F.min_by("q", "d").alias("qp"), F.max("d").alias("last")).where("p <> last")
    return table.join(several.hint("shuffle_hash"), (F.col("band") == F.col("b2")) & (F.col("d") != F.col("p"))).select("band", "d", "q", "p", "qp")


def across() -> Column:
    """Whether rows x and y are of one band and different components, and near by their short sketches."""
    return (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root")) & near("x.q", "y.q")


def all_across(ends: DataFrame, percent: int) -> DataFrame:
    """(d, p): each pair across components that shares a band and that both sketches let through, made once, in the least of the bands that hold both (own: the bands of a line's rows)."""
    x, y = ends.alias("x"), ends.alias("y")
    once = F.expr("x.d < y.d and array_min(array_intersect(x.own, y.own)) = x.band")
    return x.join(y, across() & alike("x", "y", percent) & once).select(F.col("x.d").alias("d"), F.col("y.d").alias("p"))


def line_components(lines: DataFrame, sigs: DataFrame, width: int, groups: int, percent: int, pivots: int) -> DataFrame:
    """(node, root) of the lines that have a similar one."""
    halves = [c.cut(buckets(sigs, k * groups, groups), "line-buckets") for k in range(2)]  # one after the other, for their shuffles' disk
    held = halves[0].union(halves[1])
    roots = None

    def ids(*cols: DataFrame) -> DataFrame:
        return reduce(DataFrame.union, cols).toDF("d2").distinct().hint("shuffle_hash")

    def texts(own: DataFrame) -> DataFrame:
        return c.cut(lines.select("d", "norm").join(own, F.col("d") == F.col("d2"), "left_semi"), "line_texts", by="d")

    def known(df: DataFrame, col: str = "d", name: str = "root") -> DataFrame:
        own = roots.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        return df.join(own, F.col(col) == F.col("n2"), "left").withColumn(name, F.coalesce("r2", F.col(col))).drop("n2", "r2")

    def joined(pairs: DataFrame, own: DataFrame) -> DataFrame:
        links = c.cut(verified(pairs, own, width, percent), "line-links")
        out = c.cut(c.components(links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "line-roots")
        c.release(pairs, links, *([] if roots is None else [roots]))
        return out

    def once(pairs: DataFrame) -> DataFrame:
        return c.cut(pairs.select(F.least("d", "p").alias("a"), F.greatest("d", "p").alias("b")).distinct(), "line-pairs")

    # The least line of a bucket meets all others; then it leaves, as all its pairs there are settled.
    first = once(held.where(near("q", "qp")))
    own = texts(ids(first.select("a"), first.select("b")))
    roots = joined(first, own)
    rest = c.cut(known(held.select("band", "d", "q")), "line-rest")
    c.release(*halves, own)
    more = rest.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("band").alias("b2"))
    open_ = c.cut(rest.join(more.hint("shuffle_hash"), F.col("band") == F.col("b2"), "left_semi"), "line-open")
    # What is left are mostly strangers that share a band by chance: only lines with a partner across components and near by sketch go on.
    x, y = open_.alias("x"), open_.alias("y")
    live = c.cut(x.join(y, across(), "left_semi"), "line-live")
    c.release(rest, open_)
    if live.isEmpty():
        c.release(live)
        return roots
    own = texts(ids(live.select("d")))
    rows, live = live, live.withColumn("own", F.collect_set("band").over(W.partitionBy("d")))
    last = c.cut(live.join(long_sketches(own, width).withColumnRenamed("d", "d3"), F.col("d") == F.col("d3")).drop("d3"), "line-last")
    c.release(rows)
    # Some pivots a bucket join what is dense; then come all pairs across components: the first pivot has left its band, but then its pairs there are settled.
    part = F.expr(f"pmod(xxhash64(1, d), {pivots})")
    chosen = last.groupBy(F.col("band").alias("b2"), part.alias("k")).agg(F.min("d").alias("p"))
    x, y = last.alias("x"), last.join(chosen.drop("k"), (F.col("band") == F.col("b2")) & (F.col("d") == F.col("p")), "left_semi").alias("y")
    roots = joined(once(x.join(y, across() & alike("x", "y", percent)).select(F.col("x.d").alias("d"), F.col("y.d").alias("p"))), own)
    ends = c.cut(known(last.drop("root")), "line-ends")
    roots = joined(once(all_across(ends, percent)), own)
    c.release(own, last, ends)
    return roots


def removals(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, rows: int = 4, groups: int = 6, percent: int = 80, pivots: int = 4) -> DataFrame:
    """(k1, k2, words): the lines of each document that go, as bits in 64-bit words; documents that keep all aren't in it."""
    occ = occurrences(docs, text, id_col)
    lines = c.cut(occ.groupBy("d").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.first("norm").alias("norm")), "lines", by="d")
    sigs = c.cut(signatures(lines, width, rows, groups), "line-signatures")
    roots = line_components(lines, sigs, width, groups, percent, pivots)
    own = lines.select("d", "lo", "hi").join(roots, F.col("d") == F.col("node"), "left").where("lo <> hi or root is not null").withColumn("root", F.coalesce("root", "d"))
    keep = own.groupBy("root").agg(F.min("lo").alias("stay")).withColumnRenamed("root", "r2")
    decide = c.cut(own.select("d", "root").join(keep, F.col("root") == F.col("r2")).select(F.col("d").alias("d2"), "stay"), "line-stay")
    c.release(lines, sigs, roots)
    gone = occ.select("k1", "k2", "pos", "o", "d").join(decide, F.col("d") == F.col("d2")).where("o <> stay")
    bits = gone.groupBy("k1", "k2", F.expr("pos div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bits = bits.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    out = c.cut(bits.select("k1", "k2", F.expr("transform(sequence(0, array_max(map_keys(m))), w -> coalesce(m[w], 0L))").alias("words")), "line-bits")
    c.release(decide)
    return out


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """All columns of docs, with duplicate lines taken out of the text, and n_lines, n_removed (columns of these names are replaced)."""
    bits = removals(docs, text, id_col, **how).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    k1, k2 = row_key(text, id_col)
    rest = [x for x in docs.columns if x.lower() not in ("n_lines", "n_removed")]
    base = docs.select(F.struct(*[F.col(f"`{x}`") for x in rest]).alias("row"), k1, k2)
    out = base.join(bits.hint("shuffle_hash"), (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    gone = F.coalesce(F.aggregate(F.coalesce("words", F.array().cast("array<bigint>")), F.lit(0), lambda a, x: a + F.bit_count(x)), F.lit(0))
    old = F.col("row").getField(text)
    kept = F.expr(f"array_join(filter(split(row.`{text}`, '\\n'), (x, i) -> getbit(coalesce(get(words, cast(i div 64 as int)), 0L), i % 64) = 0), '\\n')")
    new = F.when(F.col("words").isNull(), old).otherwise(kept)
    cols = [new.alias(x) if x == text else F.col("row").getField(x).alias(x) for x in rest]
    return out.select(*cols, F.coalesce(F.size(F.split(old, "\n")), F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(c.read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
