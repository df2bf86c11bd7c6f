"""Ordered state in blocks against folds over a key's whole history."""

import random

import pytest

from quern.operators import ops


def plain_breaker(rows):
    """rows: (ts, id, ok) in order; (id, asked, state)."""
    failures, until, out = 0, 0, []
    for ts, i, ok in rows:
        if failures >= 4 and ts < until:
            out.append((i, False, "open"))
            continue
        out.append((i, True, "half-open" if failures >= 4 else "closed"))
        failures = 0 if ok else failures + 1
        until = ts + min(600_000, 30_000 * 2 ** max(0, failures - 4)) if failures >= 4 else 0
    return out


def plain_window(rows, limit, width):
    count, reset, out = 0, None, []
    for ts, i in rows:
        if reset is None or ts >= reset:
            count, reset = 0, ts + width
        count += 1
        out.append((i, count, count <= limit, 0 if count <= limit else reset - ts))
    return out


def plain_smooth(values):
    a = 0.0
    for x in values:
        a = float(int(x + 0.5)) if a == 0 else float(int(a * (1 - ops.ALPHA) + x * ops.ALPHA + 0.5))
    return a


@pytest.fixture(scope="module")
def events():
    rng = random.Random(6)
    rows, ts = [], 0
    for i in range(3000):
        ts += rng.choice([0, 0, 100, 5000, 40_000, 700_000 if rng.random() < 0.02 else 10])
        key = rng.choice(["hot"] * 12 + ["warm", "cold", None]) if i % 7 else f"k{i % 300}"
        rows.append((key, ts, i, rng.random() < (0.8 if (ts // 400_000) % 2 else 0.1), float(rng.choice([0, 0.3, 5, 80, 900, 9000]))))
    return rows


def of_keys(rows):
    out = {}
    for key, *rest in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(key, []).append(rest)
    return out


@pytest.mark.parametrize("size", [7, 100, 4096])
def test_blocks_equal_folds(spark, events, size):
    df = spark.createDataFrame(events, "key string, ts long, id long, ok boolean, x double").repartition(5)
    own = of_keys(events)
    got = {r["id"]: (r["asked"], r["state"]) for r in ops.breaker(df.withColumnRenamed("key", "source"), tie=["id"], size=size).collect()}
    want = {i: (a, s) for rows in own.values() for i, a, s in plain_breaker([r[:3] for r in rows])}
    assert sum(s == "half-open" for _, s in want.values()) > 5 and sum(s == "open" for _, s in want.values()) > 100
    assert {k: v for k, v in got.items() if want[k] != v} == {} and len(got) == len(events)
    got = {r["id"]: (r["count"], r["allowed"], r["retry_ms"]) for r in ops.fixed_window(df, "key", 3, 60_000, tie=["id"], size=size).collect()}
    want = {i: (n, a, w) for rows in own.values() for i, n, a, w in plain_window([r[:2] for r in rows], 3, 60_000)}
    assert {k: v for k, v in got.items() if want[k] != v} == {} and len(got) == len(events)
    got = {r["key"]: r["ema"] for r in ops.smoothed(df, "key", ["ts", "id"], "x", size=size).collect()}
    assert got == {k: plain_smooth([r[3] for r in rows]) for k, rows in own.items()}


def test_no_rows_and_no_times(spark):
    df = spark.createDataFrame([("a", None, True), (None, 5, None), (None, 5, None), (None, 5, None), (None, 5, None), (None, 6, True)], "source string, ts long, ok boolean")
    assert sorted(r["state"] for r in ops.breaker(df).collect()) == ["closed"] * 4 + ["open"]
    assert ops.breaker(df.limit(0)).count() == 0 and ops.fixed_window(df.limit(0), "source", 3, 10).count() == 0
    assert ops.smoothed(df.limit(0), "source", ["ts"], "ts").count() == 0


def test_hot_key_is_linear(spark):
    """Four times the calls of one key take about four times as long, not sixteen times."""
    import time

    took = []
    for n in (100_000, 400_000):
        df = spark.range(n).selectExpr("'s' as source", "id * 700 as ts", "id % 11 = 0 as ok")
        began = time.time()
        assert ops.breaker(df).where("asked").count() > 0
        took.append(time.time() - began)
    assert took[1] < 8 * took[0]
