"""Language identification by a byte convolutional network, trained here in numpy.

Texts are cut into windows of `window` bytes, all of them, the last one padded. Each window passes a layer of filters over 2, 3
and 4 bytes (a filter is a sum of one learned vector a byte and offset, so two offsets fold into one table look-up at
prediction), a rectifier, the greatest value of each filter, and a softmax; a text's scores are the mean over its windows.

Training learns only from the text and label of the rows given: at most `per_class` different texts of each label, cut to
4096 characters, and one window of each an epoch. That bound is the only one: prediction reads whole texts. A null text, or one without a letter, is
`und` with score 0. Without any training rows every text is `und`. Ties go to the first label in order. Repeated rows are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import common as c

WIDTHS = (2, 3, 4)


@dataclass
class Model:
    labels: list[str]
    window: int
    tables: list[np.ndarray]  # for each width: offset x byte x filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def fold(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width: (offset, table of two bytes or one)."""
        folded = []
        for t in self.tables:
            own = [(o, (t[o][:, None, :] + t[o + 1][None, :, :]).reshape(65536, -1).astype(np.float32)) for o in range(0, len(t) - 1, 2)]
            folded.append(own + ([(len(t) - 1, t[-1].astype(np.float32))] if len(t) % 2 else []))
        return folded


def windows(text: bytes, size: int) -> np.ndarray:
    """All windows of a text, zeros after its end."""
    n = max(1, -(-len(text) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, size)


def train(texts: list[bytes], labels: list[str], window: int = 256, filters: int = 8, epochs: int = 15, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross entropy of one window a text, drawn anew each epoch."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.searchsorted(names, labels)
    # Vectors of bytes start alike whatever the label is.
    tables = [rng.normal(0, 0.3, (w, 256, filters)) for w in WIDTHS]
    params = [*tables, np.zeros(filters * len(WIDTHS)), rng.normal(0, 0.1, (filters * len(WIDTHS), len(names))), np.zeros(len(names))]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), 128):
            pick = order[k : k + 128]
            x = np.zeros((len(pick), window), dtype=np.int64)
            for r, i in enumerate(pick):
                s = rng.integers(0, max(1, len(texts[i]) - window + 1))
                own = np.frombuffer(texts[i][s : s + window], dtype=np.uint8)
                x[r, : len(own)] = own
            pooled, best = [], []
            for t, w in zip(params, WIDTHS, strict=False):
                n = window - w + 1
                z = sum(t[o][x[:, o : o + n]] for o in range(w))
                a = z.argmax(axis=1)
                best.append(a)
                pooled.append(np.take_along_axis(z, a[:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + params[-3]
            hidden = np.maximum(raw, 0)
            logit = hidden @ params[-2] + params[-1]
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p /= len(pick)
            back = (p @ params[-2].T) * (raw > 0)
            grads = [np.zeros_like(t) for t in params[: len(WIDTHS)]]
            for w, width in enumerate(WIDTHS):
                g = back[:, w * filters : (w + 1) * filters]
                for o in range(width):
                    at = np.take_along_axis(x, best[w] + o, axis=1)
                    np.add.at(grads[w][o], (at, np.arange(filters)[None, :]), g)
            grads += [back.sum(axis=0), hidden.T @ p + 1e-4 * params[-2], p.sum(axis=0)]
            step += 1
            for q, g in enumerate(grads):
                m[q] += 0.1 * (g - m[q])
                v[q] += 0.001 * (g * g - v[q])
                params[q] -= rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    return Model(names, window, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def scores(model: Model, folded, x: np.ndarray) -> np.ndarray:
    """Softmax of each window."""
    x = x.astype(np.int32)
    pair = (x[:, :-1] << 8) | x[:, 1:]
    pooled = []
    for own, width in zip(folded, WIDTHS, strict=True):
        n = x.shape[1] - width + 1
        z = None
        for o, table in own:
            part = table[(pair if len(table) > 256 else x)[:, o : o + n]]
            z = part if z is None else z.__iadd__(part)
        pooled.append(z.max(axis=1))
    hidden = np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0)
    logit = hidden @ model.out + model.out_bias
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def predict(model: Model, folded, texts: list[bytes], block: int = 64) -> np.ndarray:
    """Mean scores of each text over all its windows, which are scored in blocks across texts."""
    parts = [windows(t, model.window) for t in texts]
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    x = np.concatenate(parts) if parts else np.zeros((0, model.window), np.uint8)
    total = np.zeros((len(texts), len(model.labels)))
    for k in range(0, len(x), block):
        np.add.at(total, of[k : k + block], scores(model, folded, x[k : k + block]))
    return total / np.bincount(of, minlength=len(texts))[:, None]


def sampled(rows: DataFrame, text: str = "text", label: str = "lang", per_class: int = 1000, most_labels: int = 1024, chars: int = 4096) -> DataFrame:
    """(t, y): at most per_class different texts of each label, drawn by their hash, each cut to `chars` characters from a drawn place on.

    The bound is per_class * most_labels * chars characters; of more labels the most frequent are learned. Copies of a
    text count and are drawn once. Labels are counted first, so the draw is a filter of the scan and only drawn rows are shuffled.
    """
    base = rows.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("y")).where(F.col("y").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = base.groupBy("y").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n")).orderBy(F.desc("n"), "y").limit(most_labels).collect()
    if not counts:
        return base.where("false")
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["y"], min(1.0, per_class / max(1, r["n"])))])
    h = F.xxhash64("t", "y")
    drawn = base.where(F.pmod(h, F.lit(1 << 40)) / F.lit(float(1 << 40)) < share[F.col("y")])
    start = F.pmod(F.xxhash64(F.lit(1), "t"), F.greatest(F.length("t") - chars, F.lit(0)) + 1).cast("int") + 1
    drawn = drawn.select("y", h.alias("h"), F.substring("t", start, F.lit(chars)).alias("t")).dropDuplicates(["y", "h"])
    return drawn.withColumn("k", F.row_number().over(W.partitionBy("y").orderBy("h"))).where(F.col("k") <= per_class).select("t", "y", "h")


def learn(rows: DataFrame, text: str = "text", label: str = "lang", **how) -> Model | None:
    """A model of the labels of rows, from a bounded sample of each (see sampled)."""
    bounds = {k: how.pop(k) for k in ("per_class", "most_labels", "chars") if k in how}
    sample = sorted(sampled(rows, text, label, **bounds).collect(), key=lambda x: (x["h"], x["y"]))
    if not sample:
        return None
    return train([x["t"].encode() for x in sample], [x["y"] for x in sample], **how)


def identify(docs: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs with the predicted label and its score (columns of these names are replaced)."""
    kept = [x for x in docs.columns if x.lower() not in (pred.lower(), score.lower())]
    row = docs.select(F.struct(*[F.col(f"`{x}`") for x in kept]).alias("row"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"))
    if model is None:
        return row.select("row.*", F.lit("und").alias(pred), F.lit(0.0).alias(score))
    sent = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))  # plain values: workers need no copy of this package

    def run(batches):
        import pyarrow as pa

        own = Model(**sent.value)
        folded = own.fold()
        for batch in batches:
            column = batch.column("text")
            b, at = c.texts(column)
            none = column.is_null().to_numpy(zero_copy_only=False)
            labels, best = np.array(["und"] * len(none), dtype=object), np.zeros(len(none))
            for i, j in c.slabs(at, 1 << 20):
                use = [k for k in range(i, j) if not none[k]]
                if use:
                    p = predict(own, folded, [b[at[k] : at[k + 1]].tobytes() for k in use])
                    labels[use] = np.array(own.labels, dtype=object)[p.argmax(axis=1)]
                    best[use] = p.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(labels.tolist(), pa.string()), pa.array(best)], names=["row", "lp", "ls"])

    from pyspark.sql import types as T

    schema = T.StructType([row.schema["row"], T.StructField("lp", T.StringType()), T.StructField("ls", T.DoubleType())])
    return row.mapInArrow(run, schema).select("row.*", F.col("lp").alias(pred), F.least(F.col("ls"), F.lit(1.0)).alias(score))


def held_out(id_col: str) -> Column:
    """Rows kept from training: crc32 of the id as text is a multiple of 5. A null id is neither trained on nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_of(docs: DataFrame, **how) -> Model | None:
    return learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("text", "lang"), **how)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), model_of(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
