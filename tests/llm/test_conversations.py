"""Conversation repair: audits against all edits, replayed rows against plain loops."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(signature, most):
    """The least (cost, audit) of all edits that cost at most `most`."""
    best = [(most + 1, "")]

    def go(i, roles, cost, audit):
        if cost > best[0][0] or not re.match(r"s?(ua)*u?\Z", roles):
            return
        if i == len(signature) and re.match(r"(s?(ua)+)?\Z", roles):
            best[0] = min(best[0], (cost, audit))
        for x in "ua":
            go(i, roles + x, cost + 3, audit + "I")
        if i < len(signature):
            extra = 3 if signature[i].isupper() else 0
            go(i + 1, roles, cost + 4, audit + "D")
            if signature[i] != "x":
                go(i + 1, roles + signature[i].lower(), cost + extra, audit + "K")
                for x in "ua":
                    go(i + 1, roles + x, cost + extra + 3, audit + "R")

    go(0, "", 0, "")
    return best[0]


def test_solver_against_all_edits():
    rng = random.Random(3)
    for _ in range(250):
        s = "".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(0, 5)))
        got = cv.solve(s)
        assert got == all_edits(s, got[0]), s


def test_solver_on_long_signatures():
    assert cv.solve("ua" * 30_000) == (0, "K" * 60_000) and cv.solve("x" * 5000) == (20_000, "D" * 5000) and cv.solve("") == (0, "")
    cost, audit = cv.solve("u" * 2001)
    assert cost == 3 * 1000 + 3 and audit.count("R") + audit.count("I") == 1001


def initial(role):
    return role[:1] if role[:1] in ("s", "u", "a") else "o"


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, nulls replaced, in order; what the query returns of it."""
    seen, codes, counts = set(), "", [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(cv.BLANKS)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        codes += "x" if fault in (0, 1) else initial(role).upper() if fault == 2 else initial(role)
    marks = [initial(r) for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit = cv.solve(codes)
    kept, i = [], 0
    for x in audit:
        if x != "D":
            kept.append((x, *rows[i][1:]) if x != "I" else (x, "", ""))
        i += x != "I"
    roles = (["system"] if len(kept) % 2 else []) + ["user", "assistant"] * (len(kept) // 2)
    lines = [f"{role if x == 'K' else want}:{text}" for (x, role, text), want in zip(kept, roles, strict=True)]
    assert re.match(r"(s?(ua)+)?\Z", "".join(x[0] for x in lines))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def cases():
    rng = random.Random(8)
    rows = []
    for conv in [*range(120), None]:
        for turn in sorted(rng.sample(range(14), rng.randint(0, 9))):
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", "Why? ", "Ok.", f"text {turn}.", f"é {turn}…", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn, None]) if rng.random() < 0.2 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows + [(500, 0, "user", "Hi.")] * 3 + [(501, 0, "user", "x" * 200_000)] + [(502, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)]


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for k, v in out.items()}


def test_query_against_brute_force(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("clash") for x in ("copies", "pos", "audit", "code", "id")}).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    want = {k: plain_repair(v) for k, v in damage(rows).items()}
    got = cv.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 1, "user", "So?"), (3, 0, "assistant", "Hm."), (4, None, "user", None)], SCHEMA)
    audited, fed = cv.repair(df)
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in audited.collect()} == {1: ("KDK", 4), 2: ("KKI", 3), 3: ("IK", 3), 4: ("D", 4)}
    assert sorted(map(tuple, cv.repaired(fed).collect())) == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Yes.", "K"), (2, 0, "system", "Be kind.", "K"), (2, 1, "user", "So?", "K"), (2, 2, "assistant", "", "I"), (3, 0, "user", "", "I"), (3, 1, "assistant", "Hm.", "K")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert cv.op13_conversation_repair(spark, str(tmp_path)).count() == 0
    audited, fed = cv.repair(spark.createDataFrame([], SCHEMA))
    assert audited.count() == 0 and cv.repaired(fed).count() == 0


@pytest.mark.parametrize("signature,audit", [("ua", "KK"), ("sua", "KKK"), ("s", "D"), ("su", "KKI"), ("o", "D"), ("oa", "RK"), ("aa", "RK")])
def test_audits(signature, audit):
    assert cv.solve(signature)[1] == audit
