"""Embedding near-dedup by hierarchical navigable small-world graphs.

Equal vectors of a label travel once, with their number. The vectors of a label are dealt by hash to shards of about `shard`;
each shard's graph is built in one task and kept as one binary row. Every pair of shards of a label is a unit of work: blocks of the one shard's
vectors search the other's graph with a beam. A beam whose whole content passes the threshold is widened for that vector;
then an audit compares `audit` vectors with brute force, and the beam of all is doubled until the recall is `recall`
(at the latest it holds the whole shard). Candidates are verified by cosine in double precision. Tasks return numbers of
links and the edges of a spanning forest, never all pairs; components are formed from these.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing; vectors of
different lengths don't compare. Repeated rows link with each other and come out once each. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common as c

SHARD, BLOCK, DEGREE, BEAM = 8192, 1024, 12, 48


class Graph:
    """Levels of neighbour lists over unit vectors; level 0 holds all, each further level about one in DEGREE of the one below."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels

    @staticmethod
    def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 3) -> Graph:
        order = np.random.default_rng(seed).permutation(len(x))
        levels, nodes = [], order
        while True:
            levels.append(nodes)
            if len(nodes) <= degree:
                break
            nodes = nodes[: max(1, len(nodes) // degree)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(len(levels) - 1, -1, -1):
            done.insert(0, (levels[depth], Graph._level(x, levels[depth], done, degree * (2 if depth == 0 else 1), beam)))
        return Graph(x, done)

    @staticmethod
    def _level(x: np.ndarray, nodes: np.ndarray, above, degree: int, beam: int) -> np.ndarray:
        """Neighbours (by place in nodes; -1: none) of a level, whose nodes go in in batches no larger than what is in."""
        own = x[nodes]
        links = np.full((len(nodes), degree), -1, dtype=np.int32)
        graph = Graph(x, above)
        i, size = 1, 1
        while i < len(nodes):
            j = min(len(nodes), i + size)
            q = own[i:j]
            if i <= 4 * beam:
                sims = q @ own[:i].T
                k = min(beam, i)
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                sims = np.take_along_axis(sims, near, axis=1)
            else:
                near, sims = Graph._search(own, links, q, graph._enter(q, nodes, i), beam)
            inner = q @ q.T
            for r in range(j - i):
                mates = np.flatnonzero(inner[r, :r] > (sims[r].min() if len(sims[r]) else -2))
                cand = np.concatenate((near[r], i + mates))
                value = np.concatenate((sims[r], inner[r, mates]))
                ok = cand >= 0
                chosen = Graph._choose(own, cand[ok], value[ok], degree)
                links[i + r, : len(chosen)] = chosen
                for t in chosen:
                    free = np.flatnonzero(links[t] < 0)
                    if len(free):
                        links[t, free[0]] = i + r
                    else:
                        both = np.append(links[t], i + r)
                        kept = Graph._choose(own, both, own[both] @ own[t], degree)
                        links[t] = -1
                        links[t, : len(kept)] = kept
            i, size = j, min(256, j)
        return links

    @staticmethod
    def _choose(own: np.ndarray, cand: np.ndarray, value: np.ndarray, degree: int) -> np.ndarray:
        """The nearest ones, but only those nearer to the node than to a chosen one, then the others up to degree / 2."""
        order = np.argsort(-value, kind="stable")
        cand, value = cand[order], value[order]
        among = own[cand] @ own[cand].T
        picked: list[int] = []
        for k in range(len(cand)):
            if len(picked) == degree:
                break
            if not picked or among[k, picked].max() <= value[k]:
                picked.append(k)
        if len(picked) < degree // 2:
            rest = [k for k in range(len(cand)) if k not in picked]
            picked += rest[: degree // 2 - len(picked)]
        return cand[picked]

    def _enter(self, q: np.ndarray, nodes: np.ndarray, limit: int) -> np.ndarray:
        """For each query, a place in `nodes` (below limit) to start from, found by greedy descent through the levels above."""
        if not self.levels:
            return np.zeros((len(q), 1), dtype=np.int64)
        start = np.zeros((len(q), 1), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            own, links = self.levels[depth]
            start, _ = Graph._search(self.x[own], links, q, start, 4)
            start = np.where(start < 0, 0, start)
        # Each level's nodes are the first ones of the level below: places carry over.
        return np.where(start < limit, start, 0)

    @staticmethod
    def _search(own: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of many queries side by side: the places (-1: none) and similarities of the beam's content."""
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(own)), dtype=bool)
        ids = np.full((len(q), beam), -1, dtype=np.int64)
        sims = np.full((len(q), beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((len(q), beam), dtype=bool)
        k = min(start.shape[1], beam)
        for t in range(k):
            new = ~seen[rows, start[:, t]]
            ids[:, t] = np.where(new, start[:, t], -1)
            sims[:, t] = np.where(new, np.einsum("qd,qd->q", q, own[start[:, t]]), -np.inf)
            open_[:, t] = new
            seen[rows, start[:, t]] = True
        live = rows
        while len(live):
            best = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
            go = open_[live, best]
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = False
            near = links[ids[live, best]]
            bad = (near < 0) | seen[live[:, None], near]
            safe = np.where(near < 0, 0, near)
            value = np.einsum("qd,qkd->qk", q[live], own[safe])
            value[bad] = -np.inf
            seen[np.repeat(live, near.shape[1])[~bad.ravel()], safe.ravel()[~bad.ravel()]] = True
            all_ids = np.concatenate((ids[live], near), axis=1)
            all_sims = np.concatenate((sims[live], value), axis=1)
            all_open = np.concatenate((open_[live], ~bad), axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, top, axis=1)
            sims[live] = np.take_along_axis(all_sims, top, axis=1)
            open_[live] = np.take_along_axis(all_open, top, axis=1) & np.isfinite(sims[live])
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def query(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and similarities for each query."""
        nodes, links = self.levels[0]
        start = Graph(self.x, self.levels[1:])._enter(q, nodes, len(nodes))
        ids, sims = Graph._search(self.x[nodes], links, q, start, min(beam, len(nodes)))
        return np.where(ids < 0, -1, nodes[np.maximum(ids, 0)]), sims

    def pack(self) -> bytes:
        head = np.array([len(self.levels)] + [s for n, l in self.levels for s in l.shape], dtype=np.int32)
        return b"".join([head.tobytes()] + [y.astype(np.int32).tobytes() for n, l in self.levels for y in (n, l)])

    @staticmethod
    def unpack(x: np.ndarray, data: bytes) -> Graph:
        a = np.frombuffer(data, dtype=np.int32)
        shapes = a[1 : 1 + 2 * a[0]].reshape(-1, 2)
        at, levels = 1 + 2 * a[0], []
        for n, d in shapes:
            levels.append((a[at : at + n].astype(np.int64), a[at + n : at + n + n * d].reshape(n, d)))
            at += n + n * d
        return Graph(x, levels)


def search_all(graph: Graph, q: np.ndarray, threshold: float, audit: int, recall: float, beam: int = BEAM) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query rows, index rows) of all candidates of threshold - 1e-4 or more, beams widened until the audit passes."""
    low, n = threshold - 1e-4, len(graph.x)
    probe = np.arange(len(q))[:: max(1, len(q) // audit)] if audit else np.arange(0)
    truth = [set(np.flatnonzero(s >= low).tolist()) for s in (q[probe] @ graph.x.T)] if len(probe) else []
    while True:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        rows, wide = np.arange(len(q)), min(beam, n)
        while len(rows):
            again = []
            for k in range(0, len(rows), 256):
                own = rows[k : k + 256]
                if wide >= n:
                    r, i = np.nonzero(q[own] @ graph.x.T >= low)
                    found.append((own[r], i))
                    continue
                ids, sims = graph.query(q[own], wide)
                hit = (sims >= low) & (ids >= 0)
                full = hit.all(axis=1)
                r, k2 = np.nonzero(hit & ~full[:, None])
                found.append((own[r], ids[r, k2]))
                again.append(own[full])
            rows = np.concatenate(again) if again else rows[:0]
            wide = min(n, wide * 2)
        got: dict[int, set[int]] = {int(p): set() for p in probe}
        for r, i in found:
            for a, b in zip(r[np.isin(r, probe)].tolist(), i[np.isin(r, probe)].tolist(), strict=True):
                got[a].add(b)
        want = sum(map(len, truth))
        if beam >= n or not want or sum(len(t & got[int(p)]) for p, t in zip(probe, truth, strict=True)) >= recall * want:
            return found
        beam *= 2


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that join two trees, by union-find."""
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while (p := parent.setdefault(a, a)) != a:
            parent[a] = parent[p] if p in parent else p
            a = parent[a]
        return a

    keep = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist(), strict=True)):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return u[keep], v[keep]


def unit_vectors(v: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow: scaled by the greatest component first."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _build(table):
    import pyarrow as pa

    table = table.sort_by("rep")
    v = np.array(table.column("v").to_pylist(), dtype=np.float64)
    x = unit_vectors(v)
    graph = Graph.build(x.astype(np.float32))
    one = lambda name: table.column(name)[:1]
    return pa.table(
        {"label": one("label"), "dim": one("dim"), "shard": one("shard"), "size": pa.array([len(v)], pa.int32()), "ids": pa.array([table.column("rep").to_numpy().astype(np.int64).tobytes()], pa.binary()), "copies": pa.array([table.column("n").to_numpy().astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()), "graph": pa.array([graph.pack()], pa.binary())}
    )


def _join(batches, threshold: float, audit: int, recall: float):
    """A block of one shard's vectors against another shard's graph: links of each vector, and edges that join components."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            ids, copies, x, jds, kopies, y = (np.frombuffer(row[k], dtype=t) for k, t in (("ids", np.int64), ("copies", np.int64), ("vectors", np.float64), ("ids2", np.int64), ("copies2", np.int64), ("vectors2", np.float64)))
            x, y = x.reshape(len(ids), -1), y.reshape(len(jds), -1)
            s = slice(row["block"] * BLOCK, (row["block"] + 1) * BLOCK)
            graph = Graph.unpack(y.astype(np.float32), row["graph2"])
            own = x[s]
            found = search_all(graph, own.astype(np.float32), threshold, audit, recall)
            r, i = (np.concatenate(z) if found else np.zeros(0, np.int64) for z in (zip(*found, strict=True) if found else ((), ())))
            # Within one shard a pair may be found from either side, and each vector finds itself.
            if row["shard"] == row["shard2"]:
                a = r + s.start
                r, i = r[a != i], i[a != i]
            ok = np.concatenate([np.einsum("kd,kd->k", own[r[k : k + 65536]], y[i[k : k + 65536]]) >= threshold for k in range(0, len(r), 65536)]) if len(r) else np.zeros(0, bool)
            r, i = r[ok], i[ok]
            u, v = ids[s][r], jds[i]
            n1 = np.bincount(r, weights=kopies[i], minlength=len(own)).astype(np.int64)
            out_u, out_n = [ids[s][n1 > 0]], [n1[n1 > 0]]
            if row["shard"] != row["shard2"]:
                n2 = np.bincount(i, weights=copies[s][r], minlength=len(y)).astype(np.int64)
                out_u.append(jds[n2 > 0])
                out_n.append(n2[n2 > 0])
            fu, fv = forest(u, v)
            cu, cn = np.concatenate(out_u), np.concatenate(out_n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((cu, fu))), pa.array(np.concatenate((np.zeros(len(cu), np.int64), fv)), mask=np.arange(len(cu) + len(fu)) < len(cu)), pa.array(np.concatenate((cn, np.zeros(len(fu), np.int64))))], names=["u", "v", "n"])


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, shard: int = SHARD, audit: int = 64, recall: float = 0.99) -> DataFrame:
    """One row per vector: id_col (a long), n_links, component_id, kept."""
    base = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = "label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    base = base.withColumn("good", F.coalesce(F.expr(good), F.lit(False))).withColumn("key", F.when(F.col("good"), F.struct("label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))))
    reps = base.where("good").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = c.cut(reps.select("key.label", "key.v", F.size("key.v").alias("dim"), "rep", "n"), "embed-reps")
    counts = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(shard)).alias("shards"))
    total = counts.agg(F.sum("shards").alias("n")).first()["n"] or 0
    if not total:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts = counts.select(F.col("label").alias("l2"), F.col("dim").alias("d2"), "shards")
    dealt = reps.join(counts, (F.col("label") == F.col("l2")) & (F.col("dim") == F.col("d2"))).select("label", "dim", "v", "rep", "n", F.pmod(F.xxhash64("rep"), F.col("shards")).alias("shard"))
    kind = dict(reps.dtypes)["label"]
    # Building takes long for few bytes: each shard gets a partition of its own, about, whatever its size.
    parts = int(min(total * 3, 10_000))
    blobs = dealt.repartition(parts, "label", "dim", "shard").groupBy("label", "dim", "shard").applyInArrow(_build, f"label {kind}, dim int, shard long, size int, ids binary, copies binary, vectors binary, graph binary")
    blobs = c.cut(blobs, "embed-graphs")
    other = blobs.select(F.col("label").alias("l2"), F.col("dim").alias("d2"), F.col("shard").alias("shard2"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("vectors").alias("vectors2"), F.col("graph").alias("graph2"))
    keys = blobs.select(F.col("label").alias("kl"), F.col("dim").alias("kd"), F.col("shard").alias("ks"), "size")
    mates = blobs.select(F.col("label").alias("ml"), F.col("dim").alias("md"), F.col("shard").alias("ms"))
    units = keys.join(mates, (F.col("kl") == F.col("ml")) & (F.col("kd") == F.col("md")) & (F.col("ks") <= F.col("ms"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / F.lit(BLOCK)).cast("int")))).drop("ml", "md", "size")
    units = units.join(blobs.drop("graph", "size"), (F.col("kl") == F.col("label")) & (F.col("kd") == F.col("dim")) & (F.col("ks") == F.col("shard"))).drop("label", "dim", "ks").join(other, (F.col("kl") == F.col("l2")) & (F.col("kd") == F.col("d2")) & (F.col("ms") == F.col("shard2")))
    units = units.select("shard", "shard2", "block", "ids", "copies", "vectors", "ids2", "copies2", "vectors2", "graph2", "kl", "kd").repartition(int(min(max(64, total * 4), 20_000)), "kl", "kd", "shard", "shard2", "block")
    links = c.cut(units.drop("kl", "kd").mapInArrow(lambda x: _join(x, threshold, audit, recall), "u long, v long, n long"), "embed-links")
    found = links.where("v is null").groupBy("u").agg(F.sum("n").alias("found"))
    roots = c.components(links.where("v is not null"), "u", "v", "embed-cc")
    own = reps.select(F.struct("label", "v").alias("k2"), "rep", "n").join(found, F.col("rep") == F.col("u"), "left").drop("u").join(roots, F.col("rep") == F.col("node"), "left")
    out = base.join(own, F.col("key") == F.col("k2"), "left")
    root = F.coalesce("root", "rep", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("found", F.lit(0))).cast("long").alias("n_links"), root.alias("component_id"), (F.col("id") == root).alias("kept"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.read(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT r, vec_id, label, v, len(v) AS dim, sqrt(list_inner_product(v, v)) AS norm FROM e
      WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS x, b.r AS y FROM g a JOIN g b ON a.label = b.label AND a.dim = b.dim AND a.r <> b.r
         WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
walk(r, t) AS (SELECT r, r FROM e UNION SELECT walk.r, link.y FROM walk JOIN link ON walk.t = link.x),
comp AS (SELECT walk.r, min(o.vec_id) AS component_id FROM walk JOIN e o ON o.r = walk.t GROUP BY walk.r),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN comp USING (r) LEFT JOIN n ON n.x = e.r
"""
