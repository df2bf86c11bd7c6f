"""Periodic runs against all periods at all places."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import runs

SCHEMA = "doc_id long, text string"


def plain_runs(x, least, exponent):
    """Every period, every stretch whose words repeat that much later; of equal stretches the least period."""
    best = {}
    for p in range(1, len(x) // exponent + 1):
        i = 0
        while i < len(x) - p:
            j = i
            while j < len(x) - p and x[j] == x[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 3), (4, 2), (9, 3), (12, 4), (7, 3)])
def test_same_as_brute_force(least, exponent):
    rng = random.Random(least * 10 + exponent)
    found = 0
    for _ in range(700):
        n = rng.randint(0, 90)
        x = [rng.randrange(rng.choice([1, 2, 3, 5, 40])) for _ in range(n)]
        if n > 5 and rng.random() < 0.7:
            a, k = rng.randrange(n), rng.randint(2, 9)
            x = [x[i] if i < a else x[a + (i - a) % (1 + (n - a) // k)] for i in range(n)]
            if rng.random() < 0.4:
                x[rng.randrange(n)] = 99
        x += x[: rng.randint(0, n)] if rng.random() < 0.3 else []
        want = plain_runs(x, least, exponent)
        assert runs.runs_of(x, least, exponent) == want
        assert [(s, e - s, p) for s, e, p in runs.repetitions(x, least, exponent)] == want
        found += len(want)
    assert found > 100


def test_factors_occur_earlier():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.randrange(3) for _ in range(rng.randint(0, 60))]
        at = 0
        for s, e, source in runs.factors(x):
            assert s == at and (source == -1 and e == s + 1 and x[s] not in x[:s] or x[source : source + e - s] == x[s:e] and source < s)
            # No longer prefix starts earlier.
            assert e == len(x) or not any(x[k : k + e - s + 1] == x[s : e + 1] for k in range(s)) or source == -1
            at = e
        assert at == len(x)


def test_long_periodic_text():
    x = [str(i * i % 4001) for i in range(2000)] * 12 + ["end"]
    assert runs.runs_of(x) == [(0, 24_000, 2000)] and runs.kept_words(x, runs.runs_of(x)) == [*x[:2000], "end"]
    assert runs.runs_of(["a"] * 50_000) == [(0, 50_000, 1)]


def test_find_runs_edges(spark):
    twice = "a b c " * 10 + "x y " + "p q " * 12
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, twice), (5, twice), (None, twice), (6, "é ü " * 30 + "\n end"), (7, "w " * 23), (8, "w " * 24), (9, "\x0bw\x0c" * 24), (10, "u v w x y z " * 4 + "q " * 40_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("clash") for x in ("runs", "collapsed", "n_words", "_text", "n", "w", "h")}).repartition(3)
    out = {(r["doc_id"], i): r for i, r in enumerate(runs.find_runs(df).collect())}
    by = {}
    for (k, _), r in out.items():
        by.setdefault(k, []).append(r)
    assert len(out) == len(rows) and len(by[5]) == 2
    spans = lambda k: [tuple(x) for x in by[k][0]["runs"]]
    assert [spans(k) for k in (1, 2, 3, 4, 7)] == [[]] * 5 and by[1][0]["collapsed"] == "" and by[4][0]["collapsed"] == "one" and by[3][0]["n_words"] == 0
    assert spans(5) == spans(None) == [(0, 30, 3), (32, 24, 2)] and by[5][0]["collapsed"] == "a b c x y p q"
    assert spans(6) == [(0, 30, 1)] and by[6][0]["collapsed"] == "é ü end" and spans(8) == spans(9) == [(0, 24, 1)]
    assert spans(10) == [(0, 24, 6), (24, 40_000, 1)] and by[10][0]["n_words"] == 40_024
    assert runs.find_runs(df.limit(0)).count() == 0 and runs.find_runs(df).columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError):
        runs.find_runs(df, exponent=1)


def test_strongest_ties(spark):
    df = spark.sql("select * from values (0, array(named_struct('start', 5L, 'length', 30L, 'period', 3L), named_struct('start', 1L, 'length', 40L, 'period', 4L), named_struct('start', 1L, 'length', 50L, 'period', 5L), named_struct('start', 0L, 'length', 99L, 'period', 10L))), (1, array()) as t(i, runs)")
    got = {r["i"]: r["b"] for r in df.select("i", runs.strongest("runs").alias("b")).collect()}
    assert tuple(got[0]) == (1, 40, 4) and got[1] is None


def test_query_against_brute_force(spark, tmp_path):
    """The whole query, damage included, on texts that are short enough for brute force."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(rng.choice([2, 5, 60]))}" for _ in range(rng.randint(0, 130)))) for i in range(150)] + [(150, None), (None, "a " * 30), (7, "  odd space\n" * 30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, damaged = [], 0
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            damaged += 1
        r = plain_runs(w, 24, 3)
        best = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {k for s, m, p in r for k in range(s + p, s + m)}
        want.append((i, len(r), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in r)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert damaged > 8 and sorted(map(tuple, runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_damage_spares_texts_without_words(spark):
    """Whatever the id's checksum: of sixty ids some have h % 10 = 0, and their share of words is no division by zero."""
    ids = list(range(60))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)
    rows = [(i, x) for i in ids for x in ("", " \t\n", None)]
    got = runs.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
