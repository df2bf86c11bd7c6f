"""State that events change in their order, without a key's whole history in one task.

Events are sorted by (key, time, tie) over all partitions and cut into blocks of a bounded number of rows, so that a hot key is
many blocks. Each block becomes a small table: which state it leaves behind for each state it may be entered in. A prefix pass over these
tables, not over events, gives each block its first state; then blocks give their rows, each on its own. All steps are linear.

A jump machine has a few modes. An event that is asked in some mode leads to a mode and a wait; events before its end are passed by.
Circuit breakers and fixed windows are such machines. Smoothing that is monotone in its state is the other kind of block table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.durable import kept

BLOCK = 1 << 12
NEVER = -(1 << 62)
#: Steps of a smoothing after which all states have come near to one another.
SETTLED = 64


def blocks(events: DataFrame, key: str, ts: str, tie: list[str], size: int = BLOCK) -> DataFrame:
    """events with `_block`, which rises along (key, ts, tie); events without a time are left out. Written once, as blocks follow from a sample."""
    order = [F.col(key), F.col(ts), *map(F.col, tie)]
    own = events.where(F.col(ts).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(own.withColumn("_block", F.expr(f"monotonically_increasing_id() div {size}")))


def _segments(table, key: str, order: list[str]):
    """A block sorted, and where the events of one key begin and end in it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # Nulls first, as Spark has sorted: the first and the last key of a block are those that may go on beyond it.
    table = table.take(pc.sort_indices(table, [(x, "ascending") for x in [key, *order]], null_placement="at_start")).combine_chunks()
    own = table.column(key).combine_chunks()
    if len(own) < 2:
        return table, [(0, len(own))] if len(own) else []
    a, b = own.slice(0, len(own) - 1), own.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    at = np.flatnonzero(~np.asarray(same.cast(pa.bool_()).to_numpy(zero_copy_only=False))) + 1
    return table, list(zip([0, *at.tolist()], [*at.tolist(), len(own)], strict=True))


def _jumps(ts: np.ndarray, step: Callable, columns: dict[str, np.ndarray], modes: int):
    """For each event and mode: the mode and time that follow, and the event that is asked next (len(ts): none here)."""
    n = len(ts)
    to, wait = step(np.arange(modes).reshape(-1, 1), columns)
    to, until = np.ascontiguousarray(np.broadcast_to(to, (modes, n)).T), ts.reshape(-1, 1) + np.broadcast_to(wait, (modes, n)).T
    after = np.maximum(np.searchsorted(ts, until), np.arange(1, n + 1).reshape(-1, 1))
    return to, until, after


#: Of a block's table: the mode it is entered in, up to which end of a wait, then mode, end of wait and rows since the last asked one.
EXITS = ("m", "upto", "to", "end", "past")


def _exits(ts: np.ndarray, to: np.ndarray, until: np.ndarray, after: np.ndarray, waiting: list[int]) -> list[np.ndarray]:
    """EXITS as arrays: what a block does to a state that waits until some time, by modes and times. Modes that never wait are only entered at the first event."""
    n, modes = to.shape
    node = np.arange(n * modes)
    # Pointers from node to node; the last one of a way points at itself, n * modes further on. Each round doubles the reach.
    way = np.concatenate([np.where(after < n, after * modes + to, n * modes + node.reshape(n, modes)).ravel(), n * modes + node])
    while (way[: n * modes] < n * modes).any():
        way = way[way]
    last = (way[: n * modes] - n * modes).reshape(n, modes)
    ends = [np.flatnonzero(np.append(last[1:, m] != last[:-1, m], True)) if m in waiting else np.zeros(1, np.int64) for m in range(modes)]
    m, j = np.repeat(np.arange(modes), [len(x) for x in ends]), np.concatenate(ends)
    e = last[j, m]
    return [m, ts[j], to.ravel()[e], until.ravel()[e], n - e // modes]


def jump_machine(events: DataFrame, key: str, ts: str, tie: list[str], step: Callable, modes: int, waiting: list[int], inputs: list[str], size: int = BLOCK) -> DataFrame:
    """events with asked, mode, since, until, by a machine that begins in mode 0.

    step(modes as a column, inputs as arrays) gives arrays (next mode, wait); only steps to the modes in waiting may have a wait. asked: whether the event found no wait; mode: in which it was asked,
    else the mode that waits; since: its place from the last asked event on (1: that one); until: the end of the wait that it began or stands in.
    ts: long. Events without a time are left out; of equal times the ties decide; a null key is a key.
    """
    cut = blocks(events, key, ts, tie, size)
    kinds = dict(cut.dtypes)
    order = [ts, *tie]

    def arrays(part) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        return part.column(ts).to_numpy(), {x: part.column(x).to_numpy() for x in inputs}

    def summaries(table):
        import pyarrow as pa

        table, own = _segments(table, key, order)
        rows = []
        # Only the first and the last key of a block can go on beyond it.
        for s, e in dict.fromkeys([own[0], own[-1]]):
            at, columns = arrays(part := table.slice(s, e - s))
            rows.append((part.column(key)[0].as_py(), part.column("_block")[0].as_py(), e - s, int(at[-1]), *_exits(at, *_jumps(at, step, columns, modes), waiting)))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([table.schema.field(key).type, pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * len(EXITS)])], names=[key, "_block", "n", "last", *EXITS])

    def prefix(table):
        import pyarrow as pa

        table = table.sort_by("_block")
        mode, until, since, rows = 0, NEVER, 0, []
        for k in range(table.num_rows):
            block, n, last = (table.column(x)[k].as_py() for x in ("_block", "n", "last"))
            rows.append((block, mode, until, since))
            if until > last:
                since += n
                continue
            modes_of, upto, *left = (table.column(x)[k].values.to_numpy() for x in EXITS)
            at, end = np.searchsorted(modes_of, [mode, mode + 1])
            at += np.searchsorted(upto[at:end], until) if end - at > 1 else 0
            mode, until, since = (int(x[at]) for x in left)
        return pa.table({"_block": pa.array([r[0] for r in rows], pa.int64()), key: pa.array(table.column(key).to_pylist(), table.schema.field(key).type), **{x: pa.array([r[k] for r in rows], pa.int64()) for k, x in enumerate(("mode", "until", "since"), 1)}}).select([key, "_block", "mode", "until", "since"])

    def walk(table, starts):
        import pyarrow as pa

        if not table.num_rows:  # no block is without rows, but either side may be asked for
            return pa.Table.from_arrays([pa.array([], f.type) for f in out_schema(table)], schema=out_schema(table))
        table, own = _segments(table, key, order)
        first = {k: x for k, *x in zip(*[starts.column(x).to_pylist() for x in (key, "mode", "until", "since")], strict=True)}
        asked, mode, since, end = np.zeros(table.num_rows, bool), *(np.zeros(table.num_rows, np.int64) for _ in range(3))
        for s, e in own:
            at, columns = arrays(part := table.slice(s, e - s))
            m, until, before = first.get(part.column(key)[0].as_py(), (0, NEVER, 0))
            to, untils, after = _jumps(at, step, columns, modes)
            j, way, in_mode = int(np.searchsorted(at, until)), [], []
            to_l, after_l = to.tolist(), after.tolist()
            while j < e - s:
                way.append(j)
                in_mode.append(m)
                j, m = after_l[j][m], to_l[j][m]
            way, in_mode = np.array(way, np.int64), np.array(in_mode, np.int64)
            of = np.searchsorted(way, np.arange(e - s), side="right") - 1
            head = int((of < 0).sum())
            asked[s + way] = True
            mode[s : s + head], end[s : s + head], since[s : s + head] = first.get(part.column(key)[0].as_py(), (0, 0, 0))[0], until, before + 1 + np.arange(head)
            k = of[head:]
            mode[s + head : e] = to[way[k], in_mode[k]]
            mode[s + way] = in_mode
            end[s + head : e] = untils[way[k], in_mode[k]]
            since[s + head : e] = np.arange(head, e - s) - way[k] + 1
        for name, x in (("asked", asked), ("mode", mode), ("since", since), ("until", end)):
            table = table.append_column(name, pa.array(x))
        return table.drop_columns(["_block"])

    def out_schema(table):
        import pyarrow as pa

        return pa.schema([*[f for f in table.schema if f.name != "_block"], ("asked", pa.bool_()), ("mode", pa.int64()), ("since", pa.int64()), ("until", pa.int64())])

    columns = [x for x in cut.columns if x != "_block"]
    tables = cut.groupBy("_block").applyInArrow(summaries, f"`{key}` {kinds[key]}, _block long, n long, last long, " + ", ".join(f"`{x}` array<long>" for x in EXITS))
    starts = tables.groupBy(key).applyInArrow(prefix, f"`{key}` {kinds[key]}, _block long, mode long, until long, since long")
    return cut.groupBy("_block").cogroup(starts.groupBy("_block")).applyInArrow(walk, ", ".join(f"`{x}` {kinds[x]}" for x in columns) + ", asked boolean, mode long, since long, until long")


def _steps(states: np.ndarray, xs: np.ndarray, alpha: float) -> np.ndarray:
    for x in xs:
        states = np.where(states == 0, np.floor(x + 0.5), np.floor(states * (1 - alpha) + x * alpha + 0.5))
    return states


def _smooth_table(xs: np.ndarray, alpha: float, top: float) -> tuple[float, list[tuple[float, float]]]:
    """What a block makes of state 0, and of states from 1 to top: (from which on, result), as results rise with states."""
    zero = float(_steps(np.zeros(1), xs, alpha)[0])
    head, tail = xs[:SETTLED], xs[SETTLED:]
    at = np.array([1.0, max(top, 1.0)])
    got = _steps(at, head, alpha)
    while True:
        # Halve every gap between states whose results differ, until neighbours do.
        wide = np.flatnonzero((got[1:] != got[:-1]) & (at[1:] - at[:-1] > 1))
        if not len(wide):
            break
        more = np.floor((at[wide] + at[wide + 1]) / 2)
        place = np.searchsorted(at, more)
        at, got = np.insert(at, place, more), np.insert(got, place, _steps(more, head, alpha))
    first = np.concatenate([[True], got[1:] != got[:-1]])
    at, got = at[first], _steps(got[first], tail, alpha)
    first = np.concatenate([[True], got[1:] != got[:-1]])
    return zero, list(zip(at[first].tolist(), got[first].tolist(), strict=True))


def smoothed(calls: DataFrame, key: str, order: list[str], value: str, alpha: float, size: int = BLOCK) -> DataFrame:
    """(key, ema): exponential smoothing of values that are not negative, rounded at each step, begun anew from 0. Calls without a value or a place are left out."""
    own = calls.select(key, *order, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    cut = blocks(own, key, order[0], order[1:], size)
    kind = dict(cut.dtypes)[key]
    # One number for all tables: no state exceeds the greatest value, rounded.
    top = float(np.floor((cut.agg(F.max("_x")).first()[0] or 0.0) + 0.5))

    def summaries(table):
        import pyarrow as pa

        table, parts = _segments(table, key, order)
        rows = []
        for k, (s, e) in enumerate(parts):
            part = table.slice(s, e - s)
            xs = part.column("_x").to_numpy()
            # Only the first key of a block may have begun before it.
            zero, ways = _smooth_table(xs, alpha, top) if not k else (float(_steps(np.zeros(1), xs, alpha)[0]), [])
            rows.append((part.column(key)[0].as_py(), part.column("_block")[0].as_py(), zero, [x for x, _ in ways], [y for _, y in ways]))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([table.schema.field(key).type, pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())])], names=[key, "_block", "zero", "at", "to"])

    tables = cut.groupBy("_block").applyInArrow(summaries, f"`{key}` {kind}, _block long, zero double, at array<double>, to array<double>")
    one = tables.withColumn("_first", F.min("_block").over(_by(key))).withColumn("_last", F.max("_block").over(_by(key)))

    def fold(table):
        import pyarrow as pa

        table, state = table.sort_by("_block"), 0.0
        for zero, at, to in zip(*[table.column(x).to_pylist() for x in ("zero", "at", "to")], strict=True):
            state = zero if state == 0 else to[bisect_right(at, state) - 1]
        return pa.table({key: table.column(key).slice(0, 1), "ema": pa.array([state])})

    whole = one.where("_first = _last").select(key, F.col("zero").alias("ema"))
    return whole.unionByName(one.where("_first < _last").drop("_first", "_last").groupBy(key).applyInArrow(fold, f"`{key}` {kind}, ema double"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)
