"""Conversation structure repair: the roles of a conversation are edited, as cheaply as can be, into (system? (user assistant)+)?.

Signature deduplication: a conversation's roles and faults become a compact string, one letter a row. Far fewer strings
than conversations differ, so each is solved once, by a memoised recursion; the audits are joined back by signature and
replayed over the rows, which stream by in order. A conversation is one row of the result, so its letters are gathered; its texts never are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import common as c
from quern.llm.runs import CRC

BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the wanted roles: nothing yet, after the system's, the user's, the assistant's turn. A letter leads from one to the next.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DONE = (0, 3)
#: The one role, user's or assistant's, that may follow each state.
WANTED = ("u", "u", "a", "u")
#: How many rows the recursion goes down at a time.
STRIDE = 100
NEVER = 1 << 60


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, ties by the least string.

    Letters of a signature: s, u, a or o (any other role), capital if truncated; x for rows that must go. Letters of an audit: Keep, Rerole, Delete, Insert.
    """
    n = len(signature)
    memo: list[list[int]] = [[-1] * (n + 1) for _ in WANTED]

    def steps(i: int, q: int):
        """(letter, cost, row, state) of every edit that is allowed before row i in state q, but for insertions."""
        code = signature[i]
        yield "D", DELETE, i + 1, q
        if code != "x":
            extra = TRUNCATED if code.isupper() else 0
            if (q, code.lower()) in NEXT:
                yield "K", extra, i + 1, NEXT[q, code.lower()]
            yield "R", extra + REROLE, i + 1, NEXT[q, WANTED[q]]

    def plain(i: int, q: int) -> int:
        """The cheapest way on from row i in state q whose first edit is no insertion."""
        if memo[q][i] < 0:
            memo[q][i] = (0 if q in DONE else NEVER) if i == n else min(cost + best(j, to) for _, cost, j, to in steps(i, q))
        return memo[q][i]

    def best(i: int, q: int) -> int:
        out, paid = plain(i, q), 0
        for _ in range(2):  # a third insertion would come back to a state
            q, paid = NEXT[q, WANTED[q]], paid + INSERT
            out = min(out, paid + plain(i, q))
        return out

    for i in range(n, 0, -STRIDE):
        for q in range(len(WANTED)):
            best(i, q)
    total = best(0, 0)
    # Of all cheapest audits the least: the states that one beginning can lead to, all at the same row, go on together.
    audit, i, states = [], 0, {0}
    while not (i == n and any(q in DONE for q in states)):
        ways: dict[str, set[int]] = {}
        for q in states:
            left = best(i, q)
            for letter, cost, j, to in [*(steps(i, q) if i < n else ()), ("I", INSERT, i, NEXT[q, WANTED[q]])]:
                if cost + best(j, to) == left:
                    ways.setdefault(letter, set()).add(to)
        letter = min(ways)
        audit.append(letter)
        states, i = ways[letter], i + (letter != "I")
    return total, "".join(audit)


def place(rows: DataFrame) -> DataFrame:
    """Rows in their order, with faults. rows: conv_id, turn, role, text (neither null), copies (of this row, at least 1).

    Rows stand by turn, nulls first, then by role and text, so that equal rows are neighbours; those become one row with their number.
    Gives conv_id, turn, pos (place of the first copy), copies, role, text, code (its letter), initial, and the counts blank, duplicate, truncated, illegal, new_turn.
    """
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.asc_nulls_first("turn"), "role", "text"]
    conv = W.partitionBy("conv_id").orderBy(*order)
    one = one.repartition("conv_id").withColumn("again", F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1)
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    one = one.withColumns({"bare": F.substring(bare, -1, 1), "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o")})
    one = one.withColumns({"blank": F.col("bare") == "", "ends": F.col("bare").isin(".", "!", "?")})
    before = F.lag("initial").over(conv)
    out = one.withColumns({
        "pos": F.sum("copies").over(conv.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("copies"),
        "illegal": F.col("copies") - 1 + F.coalesce((~F.concat(before, F.col("initial")).isin("su", "ua", "au")).cast("long"), F.lit(0)),
        "new_turn": (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(conv))).cast("long"),
    })
    code = F.when(F.col("blank") | F.col("again"), "x").when(F.col("ends"), F.col("initial")).otherwise(F.upper("initial"))
    return out.select(
        "conv_id", "turn", "pos", "copies", "role", "text", code.alias("code"), "illegal", "new_turn",
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1 + F.col("again").cast("long")).alias("duplicate"),
        (~F.col("blank") & ~F.col("again") & ~F.col("ends")).cast("long").alias("truncated"),
    )


def audits(placed: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), signature, audit. Each distinct signature is solved once."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat("code", F.expr("repeat('x', cast(copies - 1 as int))")).alias("code")))), lambda x: x["code"]), "")
    per = placed.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("new_turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(x).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal")], letters.alias("signature"),
    )
    per = c.cut(per, "conv-signatures")

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column("s").to_pylist()
            solved = [solve(x) for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array([x for x, _ in solved], pa.int64()), pa.array([x for _, x in solved], pa.string())], names=["s", "cost", "audit"])

    solved = per.select(F.col("signature").alias("s")).distinct().mapInArrow(work, "s string, cost long, audit string")
    return per.join(solved, F.col("signature") == F.col("s")).drop("s")


def feed(placed: DataFrame, audited: DataFrame) -> DataFrame:
    """All rows of a conversation behind one another on one partition, its audit first: what replaying reads."""
    heads = audited.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("copies"), F.col("audit").alias("role"), F.lit("").alias("text"))
    return heads.union(placed.select("conv_id", "pos", F.col("copies").cast("long"), "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def replay(rows):
    """Rows of a feed to (conv_id, number, role, text, edit), edit by edit; a head gives (conv_id, -1, audit, '', '') first."""
    letters, at, number, first = "", 0, 0, 0

    def inserted():
        nonlocal at, number
        while at < len(letters) and letters[at] == "I":
            yield conv, number, ("user", "assistant")[(number - first) % 2], "", "I"
            at, number = at + 1, number + 1

    for conv, pos, copies, role, text in rows:
        if pos < 0:
            # As many repaired rows as letters but deletions; an odd number begins with the system's turn.
            letters, at, number = role, 0, 0
            first = (len(letters) - letters.count("D")) % 2
            yield conv, -1, role, "", ""
            yield from inserted()
            continue
        edit = letters[at]
        if edit != "D":
            yield conv, number, role if edit == "K" else ("user", "assistant")[(number - first) % 2], text, edit
            number += 1
        # Further copies of a row are all deleted; insertions among them stay insertions.
        at += 1
        yield from inserted()
        for _ in range(copies - 1):
            at += 1
            yield from inserted()


def _rows(batches):
    for batch in batches:
        yield from zip(*[batch.column(x).to_pylist() for x in ("conv_id", "pos", "copies", "role", "text")], strict=True)


def _batches(rows, names, kinds, most: int = 4096):
    import pyarrow as pa

    held: list = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    if held:
        yield batch()


def repaired(fed: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, number (from 0), role, text, edit (K, R or I)."""
    kind = dict(fed.dtypes)["conv_id"]

    def work(batches):
        import pyarrow as pa

        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]

        def again():
            yield first
            yield from batches

        yield from _batches((r for r in replay(_rows(again())) if r[1] >= 0), ["conv_id", "number", "role", "text", "edit"], kinds)

    return fed.mapInArrow(work, f"conv_id {kind}, number long, role string, text string, edit string")


def digests(fed: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: of the repaired rows as `role:text`, joined by newlines; rows stream through the hash."""
    kind = dict(fed.dtypes)["conv_id"]

    def work(batches):
        import pyarrow as pa

        first = next(batches, None)
        if first is None:
            return

        def again():
            yield first
            yield from batches

        def hashed():
            now = None
            for conv, number, role, text, _ in replay(_rows(again())):
                if number < 0:
                    if now:
                        yield now[0], now[1].hexdigest()
                    now = conv, hashlib.sha256()
                else:
                    now[1].update(f"{chr(10) if number else ''}{role}:{text}".encode())
            yield now[0], now[1].hexdigest()

        yield from _batches(hashed(), ["conv_id", "repaired_sha256"], [first.schema.field("conv_id").type, pa.string()])

    return fed.mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, feed) of conversations: audits has a row each, and repaired(feed) their rows after the edits.

    Null roles and texts are one space, so such rows are blank, or of another role, which can't be kept; so is an empty role. Null turns stand first and don't count for gaps. Null ids are one conversation. Ties of turn stand by role, then text; equal rows are duplicates. An empty table gives none. Other columns are not read.
    """
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(y) for x, y in ((role, "role"), (text, "text"))], F.col(copies).cast("long").alias("copies") if copies else F.lit(1).cast("long").alias("copies"))
    placed = c.cut(place(own), "conv-rows", by="conv_id")
    audited = c.cut(audits(placed), "conv-audits")
    return audited, feed(placed, audited)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text, copies; by a CRC-32 of conv_id:turn, in which a null is one space."""
    own = rows.select("conv_id", "turn", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    own = own.withColumn("k", F.crc32(F.concat_ws(":", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")]).cast("binary")) % 20).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's damage, then the repair; conversations without any row left get zeros and the hash of nothing."""
    rows = c.read(spark, sf_dir, "conversations")
    audited, fed = repair(damaged(rows), copies="copies")
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    done = audited.join(digests(fed).withColumnRenamed("conv_id", "d"), F.expr("conv_id <=> d"))
    counts = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(done, F.expr("id <=> conv_id"), "left").select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same in SQL: a dynamic programme over (cost, audit) pairs, from the last row of each signature to its first."""
    pair = lambda cost, letter, q: f"{{'c': CAST(b{q}.c + {cost} AS BIGINT), 'a': '{letter}' || b{q}.a}}"
    never = f"{{'c': CAST({NEVER} AS BIGINT), 'a': ''}}"
    zero = "{'c': CAST(0 AS BIGINT), 'a': ''}"
    extra = f"(CASE WHEN code <> lower(code) THEN {TRUNCATED} ELSE 0 END)"
    plain = []
    for q in range(len(WANTED)):
        ways = [pair(DELETE, "D", q), f"CASE WHEN code = 'x' THEN {never} ELSE {pair(f'{extra} + {REROLE}', 'R', NEXT[q, WANTED[q]])} END"]
        ways += [f"CASE WHEN lower(code) = '{x}' THEN {pair(extra, 'K', to)} ELSE {never} END" for (p, x), to in NEXT.items() if p == q]
        plain.append(f"list_sort([{', '.join(ways)}])[1] AS p{q}")
    closed = []
    for q in range(len(WANTED)):
        once = NEXT[q, WANTED[q]]
        twice = NEXT[once, WANTED[once]]
        closed.append(f"list_sort([p{q}, {{'c': p{once}.c + {INSERT}, 'a': 'I' || p{once}.a}}, {{'c': p{twice}.c + {2 * INSERT}, 'a': 'II' || p{twice}.a}}])[1] AS b{q}")
    return rf"""
WITH RECURSIVE d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor({CRC.format(x="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")}, 4294967295) % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM d0, range(2) AS x(again) WHERE k <> 0 AND (again = 0 OR k = 3)),
o AS (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial, right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS mark,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS nth FROM o),
f AS (SELECT *, CASE WHEN mark = '' THEN 1 ELSE 0 END AS blank, CASE WHEN mark <> '' AND nth > 1 THEN 1 ELSE 0 END AS duplicate, CASE WHEN mark NOT IN ('', '.', '!', '?') AND nth = 1 THEN 1 ELSE 0 END AS truncated,
        CASE WHEN lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS illegal FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank) AS blank, sum(duplicate) AS duplicate, sum(truncated) AS truncated, sum(illegal) AS illegal,
        string_agg(CASE WHEN blank + duplicate > 0 THEN 'x' WHEN truncated = 1 THEN upper(initial) ELSE initial END, '' ORDER BY rn) AS sig FROM f GROUP BY conv_id),
start AS (SELECT DISTINCT sig, {zero} AS p0, {never} AS p1, {never} AS p2, {zero} AS p3 FROM g),
dp AS (SELECT sig, CAST(len(sig) AS BIGINT) AS i, {", ".join(closed)} FROM start
       UNION ALL SELECT sig, i - 1 AS i, {", ".join(closed)} FROM (SELECT *, {", ".join(plain)} FROM (SELECT *, sig[i] AS code FROM dp WHERE i > 0))),
a AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM g JOIN dp USING (sig) WHERE i = 0),
e AS (SELECT *, audit[k + 1] AS edit, len(replace(audit[1:k], 'I', '')) + 1 AS rn, len(replace(audit[1:k], 'D', '')) AS number, len(replace(audit, 'D', '')) % 2 AS first FROM (SELECT *, unnest(range(len(audit))) AS k FROM a)),
r AS (SELECT e.conv_id, string_agg(concat(CASE WHEN edit = 'K' THEN role WHEN (number - first) % 2 = 0 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY number) AS body
      FROM e LEFT JOIN o ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.rn = o.rn WHERE edit <> 'D' GROUP BY e.conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN g ON i.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN a ON i.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON i.conv_id IS NOT DISTINCT FROM r.conv_id
"""


ORACLE = _oracle()
