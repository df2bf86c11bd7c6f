"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each whole text. Votes are counted by pattern (at most 3 to the
number of labellers, however many documents); expectation-maximisation over the patterns estimates the prior and each
labeller's rates of right and wrong votes, no labels being given. The posterior of a pattern is its documents' label. These posterior
labels train a linear scorer over hashed byte trigrams, word shapes and repetitions, by logistic regression on a sample of about
`sample` different texts by hash; that bound is the only one. Scores are computed for all documents from whole texts.

A null or blank text gets no votes, the prior as posterior and a score of 0. Repeated rows are rows of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as c

LABELLERS = ("letters", "symbols", "capitals", "variety", "echo", "digits", "word_length", "sentences")
#: For each labeller: good up to the first figure, bad from the second on.
LIMITS = {"letters": (0.18, 0.3), "symbols": (0.004, 0.03), "capitals": (0.12, 0.4), "variety": (0.55, 0.8), "echo": (0.02, 0.15), "digits": (0.04, 0.2), "word_length": (0.35, 0.6), "sentences": (0.5, 0.9)}
BUCKETS = 1 << 12
_B = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_B >= 65) & (_B <= 90), (_B >= 97) & (_B <= 122), (_B >= 48) & (_B <= 57)
_LETTER = _UPPER | _LOWER | (_B >= 128)
_SYMBOL = np.isin(_B, np.frombuffer(b"#$%&*|!^~<>{}[]\\=+_@", np.uint8))
_END = np.isin(_B, np.frombuffer(b".!?:;", np.uint8))


def measures(b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The figure that each labeller judges by, from the bytes and the word hashes of a text: greater is worse."""
    count = np.bincount(b, minlength=256)
    n, letters, words = max(len(b), 1), max(count[_LETTER].sum(), 1), max(len(h), 1)
    different = len(np.unique(h))
    echo = (h[1:] == h[:-1]).sum() + (h[2:] == h[:-2]).sum()
    mean = count[_LETTER].sum() / words
    return np.array([1 - (count[_LETTER].sum() + count[32] + count[10]) / n, count[_SYMBOL].sum() / n, count[_UPPER].sum() / letters, 1 - different / words if len(h) >= 20 else 0.6, echo / words, count[_DIGIT].sum() / n, abs(mean - 6) / 10, 1 / (1 + 10 * count[_END].sum() / words) if len(h) >= 20 else 0.6])


def votes(x: np.ndarray) -> str:
    """A character a labeller: 1 good, 0 bad, - nothing."""
    return "".join("1" if v <= LIMITS[k][0] else "0" if v >= LIMITS[k][1] else "-" for k, v in zip(LABELLERS, x, strict=True))


def features(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A hashed vector of length one: byte trigrams by kind of byte and as they are, and the labellers' figures in steps."""
    out = np.zeros(BUCKETS, dtype=np.float32)
    if len(b) >= 3:
        kind = KIND[b].astype(np.int64)
        shape = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:]
        own = np.bincount(shape, minlength=512)[:512]
        out[:512] = np.sqrt(own / len(b))
        raw = b[:-2].astype(np.uint32) * np.uint32(0x01000193) ^ b[1:-1].astype(np.uint32) * np.uint32(0x9E3779B1) ^ b[2:].astype(np.uint32) * np.uint32(0x85EBCA6B)
        out[512:] = 0.5 * np.sqrt(np.bincount((raw >> np.uint32(8)) % np.uint32(BUCKETS - 512), minlength=BUCKETS - 512) / len(b))
    steps = np.minimum((x * 16).astype(np.int64), 15)
    out[(steps * 31 + np.arange(len(x)) * 613 + 512) % BUCKETS] += 0.5
    return out / max(np.sqrt((out * out).sum()), 1e-9)


KIND = np.select([_UPPER, _LOWER, _DIGIT, _B >= 128, _SYMBOL, _END, (_B == 32) | ((_B >= 9) & (_B <= 13))], [0, 1, 2, 3, 4, 5, 6], 7).astype(np.uint8)


def _read(batch):
    """(row, bytes, word hashes) of each text of a batch."""
    b, at = c.texts(batch.column("text"))
    for i, j in c.slabs(at, 1 << 20):
        own = at[i : j + 1] - at[i]
        part = b[at[i] : at[j]]
        h, first = c.words(part, own, c.NOT_SPACE, c.LOWER)
        for d in range(j - i):
            yield part[own[d] : own[d + 1]], h[first[d] : first[d + 1]]


def _vote(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(measures(b, h)) if len(h) else "-" * len(LABELLERS) for b, h in _read(batch)], pa.string())], names=["pattern"])


def agree(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """(prior of good, accuracies: labeller x class x vote, posterior of each pattern) by expectation-maximisation.

    The start is a majority vote. Votes are independent given the class; abstention is a vote of its own.
    """
    if not patterns:
        return 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3), {}
    v = np.array([["0-1".index(x) for x in p] for p, _ in patterns])
    n = np.array([k for _, k in patterns], dtype=float)
    good, bad = (v == 2).sum(axis=1), (v == 0).sum(axis=1)
    post = np.clip((good + 1) / (good + bad + 2), 0.05, 0.95)
    rates = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        for k in range(v.shape[1]):
            for vote in range(3):
                own = n * (v[:, k] == vote)
                rates[k, 1, vote], rates[k, 0, vote] = (own * post).sum() + 1, (own * (1 - post)).sum() + 1
        rates /= rates.sum(axis=2, keepdims=True)
        score = np.log(prior / (1 - prior)) + sum(np.log(rates[k, 1, v[:, k]] / rates[k, 0, v[:, k]]) for k in range(v.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return float(prior), rates, {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, both classes weighing alike."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    y = y.astype(np.float32)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = y / share + (1 - y) / (1 - share)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = (p - y) * weight / len(y)
        own = x.T @ g + 1e-5 * w
        m += 0.1 * (own - m)
        s += 0.001 * (own * own - s)
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
        b -= rate * g.sum()
    return w, b


def classify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample: int = 4000, cut_off: float = 0.5) -> DataFrame:
    """One row per document: id_col, votes, posterior, score, keep (score of cut_off or more)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("string").alias("text"))
    counts = base.select("text").mapInArrow(_vote, "pattern string").groupBy("pattern").count().collect()  # as many rows as there are patterns
    patterns = sorted((r["pattern"], r["count"]) for r in counts)
    rows = sum(n for _, n in patterns)
    prior, _, posterior = agree([(p, n) for p, n in patterns if set(p) != {"-"}])
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = base.where("text is not null").where(u < F.lit(sample / max(rows, 1))).select("text").dropDuplicates()  # a hash picks all copies of a text or none: one of them is enough, and the bound holds
    kind = "pattern string, x array<float>"

    def learn(batches):
        import pyarrow as pa

        for batch in batches:
            own = [(m := measures(b, h), features(b, m)) for b, h in _read(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([votes(m) for m, _ in own], pa.string()), pa.array([x for _, x in own], pa.list_(pa.float32()))], names=["pattern", "x"])

    got = drawn.mapInArrow(learn, kind).orderBy(F.xxhash64("pattern", "x")).toArrow()
    label = np.array([posterior.get(p, prior) for p in got.column("pattern").to_pylist()])
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(len(label), BUCKETS) if len(label) else np.zeros((0, BUCKETS), np.float32)
    del got
    model = fit(x, label) if len(label) else (np.zeros(BUCKETS), 0.0)
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1], posterior, prior))

    def score(batches):
        import pyarrow as pa

        w, bias, post, start = sent.value
        for batch in batches:
            names, probable, scores = [], [], []
            for b, h in _read(batch):
                if not len(h):
                    names.append("-" * len(LABELLERS))
                    probable.append(start)
                    scores.append(0.0)
                    continue
                m = measures(b, h)
                names.append(votes(m))
                probable.append(post.get(names[-1], start))
                scores.append(float(1 / (1 + np.exp(-np.clip(features(b, m) @ w + bias, -50, 50)))))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(names, pa.string()), pa.array(probable, pa.float64()), pa.array(scores, pa.float64())], names=["_id", "votes", "posterior", "score"])

    out = base.mapInArrow(score, f"_id {dict(base.dtypes)['_id']}, votes string, posterior double, score double")
    return out.select(F.col("_id").alias(id_col), "votes", "posterior", "score", (F.col("score") >= cut_off).alias("keep"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(c.read(spark, sf_dir, "documents"))
