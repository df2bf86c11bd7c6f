"""Adaptive quality rules against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import quality_rules as q

WORD = r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    text = text or ""
    w = re.findall(WORD, text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def bucket(v):
    return v if v < 64 else (v >> (v.bit_length() - 6)) << (v.bit_length() - 6)


def quartiles(values):
    v = sorted(map(bucket, values))
    return [next(x for k, x in enumerate(v, 1) if 4 * k >= j * len(v)) for j in (1, 2, 3)]


def plain_kept(rows, support):
    """rows: (id, lang, source, text); which of them are kept."""
    m = [(*r[:3], *plain_measures(r[3])) for r in rows]
    failed = [x[3] < 20 or 100 * x[8] > 30 * x[3] for x in m]
    rate = lambda x, k: 1000 * (x[4], x[5], x[7], x[8])[k] // (x[3], x[3], x[6], x[3])[k]
    out = []
    for x, bad in zip(m, failed, strict=True):
        ok = not bad
        for k in range(4):
            if bad:
                break
            for same in (lambda y: y[1:3] == x[1:3], lambda y: y[1] == x[1], lambda y: True):  # noqa: B023
                group = [rate(y, k) for y, b in zip(m, failed, strict=True) if not b and same(y)]
                if len(group) >= support:
                    break
            lo, mid, hi = quartiles(group)
            spread = 3 * max(hi - lo, (400, 100, 200, 100)[k])
            v = (1000 * (x[4], x[5], x[7], x[8])[k] + 50 * mid) // (x[3] + 50) if k != 2 else rate(x, k)
            ok &= (lo - spread if k == 0 else -1) <= v <= hi + spread
        out.append(ok)
    return out


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(600):
        n = rng.choice([5, 25, 60, 200])
        w = ["x" * rng.randint(2, 9) + str(rng.randrange(50)) for _ in range(n)]
        kind = rng.random()
        if kind < 0.06:
            w = [x + "$$$" * rng.randint(1, 3) for x in w]
        elif kind < 0.1:
            w = [x * 4 for x in w]
        elif kind < 0.2:
            w = w + w[: rng.randint(8, n)] if n > 8 else w
        text = "".join(x + rng.choice([" ", " ", "  ", "\n", "\t"]) for x in w)
        if kind > 0.9:
            text = "\n".join(["same line again here"] * rng.randint(1, 9) + [text])
        rows.append((i, rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b", "b", None]), text))
    return rows + [(600, "en", "a", None), (601, None, None, ""), (602, "fr", "z", " \n \t"), (602, "fr", "z", " \n \t"), (None, "en", "b", rows[3][3])]


def test_measures(spark):
    texts = [x[3] for x in corpus()] + ["é 😀 #|\n\n#|", "a b c d e f g h a b c d e f g h", "a a a a a a a a a", "q " * 30_000, "one\x0btwo\x1c three", "a\n a\na\n a\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({x: F.lit("clash") for x in ("lang", "source", "g", "o", "w", "l", "n_words", "_t")})
    got = {r["doc_id"]: tuple(r)[3:] for r in q.measure(df).collect()}
    assert got == {i: plain_measures(x) for i, x in enumerate(texts)}


@pytest.mark.parametrize("support", [1, 40, 100, 10_000])
def test_verdicts(spark, support):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").repartition(5)
    m = q.measure(df)
    got = sorted((tuple(r[x] for x in ("doc_id", "lang", "source", "n_words", "word_chars", "kept")) for r in q.judge(m, q.fences(q.sketch(m), support=support)).collect()), key=repr)
    want = sorted(((*r[:3], *plain_measures(r[3])[:2], k) for r, k in zip(rows, plain_kept(rows, support if support <= 600 else 1), strict=True)), key=repr) if support <= 600 else None
    if want:
        assert got == want
        assert 20 < sum(not x[-1] and x[3] >= 20 for x in got) < 200
    assert len(got) == len(rows)
    # Junk that the fixed rules let pass is caught, and no text of the plain kind.
    judged = {r["doc_id"]: r for r in q.judge(m, q.fences(q.sketch(m), support=support)).collect()}
    for i, _, _, text in rows[:600]:
        n, _, symbols, *_, repeated = plain_measures(text)
        if n >= 20 and 100 * repeated <= 30 * n:
            assert not (symbols > 2 * n and judged[i]["kept"]) and ("symbols" in judged[i]["failed"]) <= (symbols > 0)


def test_sketches_merge(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, lang string, source string, text string")
    m = q.measure(df)
    whole = sorted(map(repr, q.fences(q.sketch(m)).collect()))
    halves = q.sketch(m.where("doc_id % 2 = 0")).union(q.sketch(m.where("doc_id % 2 = 1 or doc_id is null")))
    assert sorted(map(repr, q.fences(halves).collect())) == whole


def test_query_edges(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("kept", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    out = q.op12_quality_rules(spark, f"{tmp_path}/a")
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(((r["doc_id"], r["kept"]) for r in out.collect()), key=repr) == sorted(((r[0], k) for r, k in zip(rows, plain_kept(rows, 100), strict=True)), key=repr)
    assert q.op12_quality_rules(spark, f"{tmp_path}/b").count() == 0
