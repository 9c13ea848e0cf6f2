"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one class. Classes are dealt to shards by hash; each shard builds its
graph in one task (bounded by ``SHARD``) and every class queries every shard, in blocks.
Each block audits its recall, on its own queries and on shard vectors moved to a known
cosine, against brute force, widening all beams until the audit passes. A beam that ends
full of links stands in a dense place: one of those queries leads, a walk over the ground
layer from its beam gathers all nodes within twice the links' angle, and as any link of a
query within that angle of the leader is among them, all such queries are compared with
them in one matrix product. Cosines that single precision can't decide are computed in
double precision. A task puts out each query's number of links in its shard and links that
span what it found, never all pairs; components are united from the latter.
"""

from __future__ import annotations

import io
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, materialise, table

COSINE = 0.95
#: Vectors of a shard and queries of a block, at most; at least LEAST of each.
SHARD, BLOCK, LEAST = 65_536, 131_072, 4
#: Queries that a task holds at once, and audits.
CHUNK = 16_384
#: Tasks of the search, at most: each takes its pairs of shard and block one after another.
TASKS = 20_000
#: Links of a node on the ground layer (half above), beam while building, first beam of a search.
DEGREE, BUILD, BEAM = 24, 48, 16
#: Recall that an audit asks for, recall below which a run fails, an audit's queries and probes.
RECALL, LEAST_RECALL, AUDIT = 0.99, 0.9, 96
#: Queries that are searched at once, and cosines that are held at once.
HELD, CELLS = 512, 1 << 23


class Graph:
    """A layered graph over unit vectors, built in growing batches and searched for many queries at once."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, build: int = BUILD, seed: int = 5):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(degree)).astype(np.int64), 8)
        level[self.order[:1]] = level.max(initial=0)
        self.level, self.build = level, build
        self.layers = [np.full((n, degree if k == 0 else degree // 2), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        at = 0
        while at < n:
            batch = self.order[at : at + max(1, min(1024, at if at > 64 else 64 if at == 0 else at))]
            self._insert(batch, at)
            at += len(batch)

    def _insert(self, batch: np.ndarray, before: int) -> None:
        q = self.x[batch]
        entry = np.repeat(self.order[:1][None, :], len(batch), axis=0) if before else np.zeros((len(batch), 0), dtype=np.int64)
        own = q @ q.T
        for k in range(len(self.layers) - 1, -1, -1):
            if before:
                beam = self.build if (self.level[batch] >= k).any() else 4
                ids, sims = self._layer(q, entry, k, beam)
                entry = ids[:, :8]
            else:
                ids, sims = np.full((len(batch), 0), -1, dtype=np.int64), np.zeros((len(batch), 0), dtype=np.float32)
            on = self.level[batch] >= k
            if not on.any():
                continue
            mine = own.copy()
            mine[:, ~on] = -2
            np.fill_diagonal(mine, -2)
            near = np.argsort(-mine, axis=1)[:, : min(self.build, len(batch))]
            near_sims = np.take_along_axis(mine, near, axis=1)
            ids = np.concatenate([ids, np.where(near_sims > -2, batch[near], -1)], axis=1)[on]
            sims = np.concatenate([sims, near_sims], axis=1)[on]
            chosen = self._choose(ids, np.where(ids >= 0, sims, -2), self.layers[k].shape[1])
            self.layers[k][batch[on]] = chosen
            self._back(batch[on], chosen, k)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """For each row, neighbours that are nearer to it than to each other, then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(degree * 2, self.build)]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        out = np.full((len(ids), degree), -1, dtype=np.int32)
        for a in range(0, len(ids), 512):
            i, s = ids[a : a + 512], sims[a : a + 512]
            v = self.x[np.maximum(i, 0)]
            among = v @ v.transpose(0, 2, 1)
            kept = np.zeros(i.shape, dtype=bool)
            for c in range(i.shape[1]):
                kept[:, c] = (i[:, c] >= 0) & ~(kept[:, :c] & (among[:, c, :c] > s[:, c, None])).any(axis=1) & (kept.sum(axis=1) < degree)
            rank = np.where(i < 0, 3, np.where(kept, 0, 1)) * 4 - s
            best = np.argsort(rank, axis=1, kind="stable")[:, :degree]
            got = np.take_along_axis(i, best, axis=1)
            out[a : a + 512, : got.shape[1]] = got
        return out

    def _back(self, nodes: np.ndarray, chosen: np.ndarray, k: int) -> None:
        layer = self.layers[k]
        src, dst = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        for width in (16, 128, 4096):
            low = {16: 0, 128: 16, 4096: 128}[width]
            sel = (count > low) & ((count <= width) | (width == 4096))
            if not sel.any():
                continue
            t, f, c = to[sel], first[sel], count[sel]
            step = max(1, 4096 // width) * 8
            for a in range(0, len(t), step):
                tt, ff, cc = t[a : a + step], f[a : a + step], np.minimum(c[a : a + step], width)
                grid = ff[:, None] + np.arange(int(cc.max()))[None, :]
                new = np.where(np.arange(int(cc.max()))[None, :] < cc[:, None], src[np.minimum(grid, len(src) - 1)], -1)
                new = np.where((new[:, :, None] == layer[tt][:, None, :]).any(axis=2), -1, new)
                ids = np.concatenate([layer[tt], new], axis=1).astype(np.int64)
                sims = np.where(ids >= 0, np.einsum("bd,bkd->bk", self.x[tt], self.x[np.maximum(ids, 0)]), -2)
                layer[tt] = self._choose(ids, sims, layer.shape[1])

    def _layer(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of one layer from entry nodes: ids and cosines, best first, -1 where there are fewer."""
        ids_out, sims_out = [], []
        for a in range(0, len(q), 256):
            i, s = self._some(q[a : a + 256], entry[a : a + 256], self.layers[k], beam)
            ids_out.append(i), sims_out.append(s)
        return np.concatenate(ids_out), np.concatenate(sims_out)

    def _some(self, q, entry, layer, beam):
        b, width = len(q), max(4, beam // 8)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, len(self.x)), dtype=bool)
        ids = np.full((b, beam), -1, dtype=np.int64)
        sims = np.full((b, beam), -2, dtype=np.float32)
        done = np.ones((b, beam), dtype=bool)
        e = entry[:, :beam]
        ids[:, : e.shape[1]] = e
        sims[:, : e.shape[1]] = np.where(e >= 0, np.einsum("bd,bkd->bk", q, self.x[np.maximum(e, 0)]), -2)
        done[:, : e.shape[1]] = e < 0
        seen[np.broadcast_to(rows, e.shape)[e >= 0], e[e >= 0]] = True
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims, done = (np.take_along_axis(z, order, axis=1) for z in (ids, sims, done))
        live = np.flatnonzero(~done.all(axis=1))
        while len(live):
            i, s, d = ids[live], sims[live], done[live]
            turn = np.cumsum(~d, axis=1)
            pick = ~d & (turn <= width)
            d |= pick
            at = np.argsort(~pick, axis=1, kind="stable")[:, :width]
            nodes = np.where(np.take_along_axis(pick, at, axis=1), np.take_along_axis(i, at, axis=1), -1)
            new = np.where(nodes[:, :, None] >= 0, layer[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            r = live[:, None]
            new[seen[r, np.maximum(new, 0)]] = -1
            keep = (new >= 0).any(axis=0)
            new = new[:, keep]
            ok = new >= 0
            rr = np.broadcast_to(r, new.shape)
            seen[rr[ok], new[ok]] = True
            ns = np.where(ok, np.einsum("bd,bkd->bk", q[live], self.x[np.maximum(new, 0)]), -2)
            i, s, d = np.concatenate([i, new], axis=1), np.concatenate([s, ns], axis=1), np.concatenate([d, ~ok], axis=1)
            if i.shape[1] > beam:
                order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
                i, s, d = (np.take_along_axis(z, order, axis=1) for z in (i, s, d))
            i[s <= -2] = -1
            ids[live], sims[live], done[live] = i, s, d | (i < 0)
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes that a beam finds, best first, down the layers."""
        entry = np.repeat(self.order[:1][None, :], len(q), axis=0)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._layer(q, entry, k, 8)[0]
        return self._layer(q, entry, 0, beam)

    def around(self, p: np.ndarray, entry: np.ndarray, least: float) -> np.ndarray:
        """Nodes at cosine ``least`` or more with p that a walk over such nodes, along ground links either way, reaches from entry."""
        if not hasattr(self, "back"):
            flat = self.layers[0].ravel()
            order = np.argsort(flat, kind="stable")
            self.back = order // self.layers[0].shape[1], np.searchsorted(flat[order], np.arange(len(self.x) + 1))
        source, start = self.back
        seen = np.zeros(len(self.x), dtype=bool)
        front, out = np.unique(entry[entry >= 0]), []
        while len(front):
            seen[front] = True
            front = front[self.x[front] @ p >= least]
            out.append(front)
            size = start[front + 1] - start[front]
            into = source[np.arange(size.sum()) + np.repeat(start[front] - np.r_[0, np.cumsum(size)[:-1]], size)] if len(front) else front
            front = np.unique(np.concatenate([self.layers[0][front].ravel(), into]))
            front = front[front >= 0]
            front = front[~seen[front]]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)

    def pieces(self, q: np.ndarray, cosine: float, beam: int):
        """What has cosine or more: (queries, nodes, None), a pair at each place, or (queries, nodes, matrix of cosines)."""
        ids, sims = self.search(q, min(beam, len(self.x)))
        hit = (ids >= 0) & (sims >= cosine)
        full = hit.all(axis=1) & (ids.shape[1] < len(self.x))
        row, col = np.nonzero(hit & ~full[:, None])
        yield row, ids[row, col], None
        left, reach = np.flatnonzero(full), 2 * math.acos(min(1.0, cosine))
        while len(left):
            p = q[left[0]]
            near = q[left] @ p >= cosine
            near[0] = True
            nodes = self.around(p, ids[left[0]], math.cos(reach) if reach < math.pi else -2.0)
            step = max(1, CELLS // max(len(nodes), 1))
            for a in range(0, int(near.sum()), step):
                some = left[near][a : a + step]
                yield some, nodes, q[some] @ self.x[nodes].T
            left = left[~near]

    def links(self, q: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) at the cosine or more, as pairs: for a few queries."""
        found = [np.zeros((0, 2), dtype=np.int64)]
        for rows, nodes, sims in self.pieces(q, cosine, beam):
            if sims is not None:
                i, j = np.nonzero(sims >= cosine)
                rows, nodes = rows[i], nodes[j]
            found.append(np.stack([rows, nodes], axis=1))
        out = np.concatenate(found)
        return out[:, 0], out[:, 1]


def audited_beam(graph: Graph, q: np.ndarray, cosine: float = COSINE, recall: float = RECALL, beam: int = BEAM, seed: int = 3) -> tuple[int, float]:
    """The first beam of a search of q that the audit asks for, and the recall that it measured.

    Recall is the mean over those audited queries that have a link, each with the share of
    its own links, so that a query in a large group weighs no more than one with one link."""
    rng = np.random.default_rng(seed)
    probes = graph.x[rng.integers(0, len(graph.x), AUDIT)].astype(np.float64)
    noise = rng.standard_normal(probes.shape)
    noise -= (noise * probes).sum(axis=1, keepdims=True) * probes
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    near = min(1.0, cosine + 0.3 * (1 - cosine))
    probes = near * probes + math.sqrt(1 - near * near) * noise
    audit = np.concatenate([q[rng.integers(0, len(q), AUDIT)], probes.astype(np.float32)])
    truth = audit @ graph.x.T >= cosine
    has, many = truth.any(axis=1), truth.sum(axis=1)
    while True:
        i, j = graph.links(audit, cosine, beam)
        got = np.bincount(i[truth[i, j]], minlength=len(audit))
        r = float((got[has] / many[has]).mean()) if has.any() else 1.0
        if r >= recall or beam >= len(graph.x):
            return beam, r
        beam *= 2


def spanning(rows: np.ndarray, nodes: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Links (name, name) that join what a matrix of hits joins; ``rows`` and ``nodes`` name its sides."""
    label = np.where(hit.any(axis=1), np.arange(len(rows)), len(rows))
    while True:
        of = np.where(hit, label[:, None], len(rows)).min(axis=0, initial=len(rows))
        new = np.minimum(label, np.where(hit, of[None, :], len(rows)).min(axis=1, initial=len(rows)))
        if (new == label).all():
            break
        label = new
    names, told = np.concatenate([rows, nodes]), np.concatenate([label, of])
    ok = told < len(rows)
    return np.stack([names[ok], rows[told[ok]]], axis=1)


def _units(batches):
    """dim and unit vector (doubles as bytes) of each vector; dim 0 where it can't link."""
    import pyarrow as pa

    for b in batches:
        dims, units = [], []
        for v in b.column(1).to_pylist():
            unit = None
            if v and None not in v:
                a = np.asarray(v, dtype=np.float64)
                top = np.abs(a).max()
                if np.isfinite(top) and top > 0 and np.isfinite(a).all():
                    a = a / top
                    unit = (a / np.linalg.norm(a)).tobytes()
            dims.append(len(v) if unit else 0), units.append(unit or b"")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "dim", "unit"])


def _pack(**arrays) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _build(group):
    """One shard's graphs, a row for each dimension."""
    import pyarrow as pa

    dims, packed = [], []
    dim = group.column("dim").to_numpy()
    for d in np.unique(dim):
        part = group.filter(pa.array(dim == d)).sort_by("cls")
        x = np.frombuffer(b"".join(part.column("unit").to_pylist()), dtype=np.float64).reshape(-1, d)
        g = Graph(x)
        dims.append(int(d))
        packed.append(_pack(cls=part.column("cls").to_numpy(), n=part.column("n").to_numpy(), x=x, order=g.order[:1], **{f"layer{k}": a for k, a in enumerate(g.layers)}))
    return pa.table({"shard": pa.array([group.column("shard")[0].as_py()] * len(dims), pa.int32()), "dim": pa.array(dims, pa.int32()), "graph": pa.array(packed, pa.binary())})


def _open(packed: bytes):
    z = np.load(io.BytesIO(packed))
    g = Graph.__new__(Graph)
    g.x, g.order = z["x"].astype(np.float32), z["order"]
    g.layers = [z[f"layer{k}"] for k in range(sum(name.startswith("layer") for name in z.files))]
    return g, z["cls"], z["n"], z["x"]


def _query(batches):
    """Rows by (shard, dim, block), the graph before its queries.

    Out: (class, null, vectors of the shard that it links with, audited recall), and links
    (class, class, null, null) that span what was found."""
    import pyarrow as pa

    graph = cls = size = x = key = None
    ids, units = [], []

    def rows(a, b=None, n=None, recall=None):
        of = lambda v, kind: pa.array(v, kind) if v is not None else pa.nulls(len(a), kind)
        return pa.RecordBatch.from_arrays([of(a, pa.int64()), of(b, pa.int64()), of(n, pa.int64()), of(recall, pa.float64())], names=["a", "b", "n", "recall"])

    def answer():
        if graph is None or not ids:
            return
        q, own = np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(ids), -1), np.asarray(ids)
        single, unsure = q.astype(np.float32), max(1e-4, 1e-6 * q.shape[1])  # far above single precision's error
        least = COSINE - unsure
        beam, recall = audited_beam(graph, single, least)
        count = np.zeros(len(ids), dtype=np.int64)
        for a in range(0, len(ids), HELD):
            for i, j, sims in graph.pieces(single[a : a + HELD], least, beam):
                i = i + a
                if sims is None:
                    ok = own[i] != cls[j]
                    ok &= np.einsum("nd,nd->n", q[i], x[j]) >= COSINE
                    i, j = i[ok], j[ok]
                    np.add.at(count, i, size[j])
                    pairs = forest(np.stack([own[i], cls[j]], axis=1)) if len(i) else ()
                else:
                    hit = sims >= COSINE
                    r, c = np.nonzero(np.abs(sims - COSINE) <= unsure)
                    for k in range(0, len(r), 65536):
                        rr, cc = r[k : k + 65536], c[k : k + 65536]
                        hit[rr, cc] = np.einsum("nd,nd->n", q[i[rr]], x[j[cc]]) >= COSINE
                    hit &= own[i][:, None] != cls[j][None, :]
                    count[i] += hit @ size[j]
                    pairs = spanning(own[i], cls[j], hit)
                if len(pairs):
                    yield rows(pairs[:, 0], pairs[:, 1])
        yield rows(own, n=count, recall=np.full(len(ids), recall))

    for b in batches:
        for shard, dim, block, cl, data in zip(*(c.to_pylist() for c in b.columns)):
            if (shard, dim, block) != key:
                yield from answer()
                key, graph, ids, units = (shard, dim, block), None, [], []
            if cl is None:
                graph, cls, size, x = _open(data)
            else:
                ids.append(cl), units.append(data)
                if len(ids) == CHUNK:
                    yield from answer()
                    ids, units = [], []
    yield from answer()


def evenly_named(spark, n: int) -> DataFrame:
    """index, name: for each partition of n, a number that is dealt to it by hash."""
    number = F.col("id").cast("int")
    some = spark.range(64 * n).select(number.alias("name"), F.pmod(F.hash(number), F.lit(n)).alias("index"))
    return some.groupBy("index").agg(F.min("name").alias("name"))


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for each row of vectors.

    ``recall`` is the least that the audits of the searches for a vector measured, null for
    one that can't link; a run with one under LEAST_RECALL raises an error.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths. Equal vectors link as any others;
    repeated rows count as vectors of their own. A null vec_id takes part but names no
    component unless all ids in it are null. Other columns are ignored; an empty table
    gives no rows."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = v.mapInArrow(_units, "vec_id long, dim int, unit binary").withColumn("k1", F.xxhash64("unit", "dim")).withColumn("k2", F.xxhash64(F.lit(1), "unit", "dim"))
    units = materialise(units.withColumn("own", F.monotonically_increasing_id()), "units")
    linkable = units.where("dim > 0")
    classes = linkable.groupBy("k1", "k2").agg(F.first("unit").alias("unit"), F.first("dim").alias("dim"), F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min("own").alias("cls"))
    classes = materialise(classes, "classes")
    n = classes.count()
    shards = max(LEAST, -(-n // SHARD))
    blocks = max(LEAST, -(-n // BLOCK))
    spark = vectors.sparkSession
    dealt = classes.select(F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).cast("int").alias("shard"), "dim", "cls", "n", "unit")
    # a task for each shard: by names that don't meet in one partition; shards are few
    named = dealt.join(F.broadcast(evenly_named(spark, shards)), F.col("shard") == F.col("index"), "left").withColumn("name", F.coalesce("name", -1 - F.col("shard"))).drop("index")
    graphs = materialise(named.repartition(shards, "name").groupBy("name").applyInArrow(_build, "shard int, dim int, graph binary"), "graphs")
    asked = classes.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.pmod(F.xxhash64("k2"), F.lit(blocks)).cast("int").alias("block"), "cls", F.col("unit").alias("data"))
    shown = graphs.select("shard", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast("long").alias("cls"), F.col("graph").alias("data"))
    rows = asked.unionByName(shown).repartition(min(shards * blocks, TASKS), "shard", "dim", "block").sortWithinPartitions("shard", "dim", "block", F.col("cls").asc_nulls_first())
    found = materialise(rows.mapInArrow(_query, "a long, b long, n long, recall double"), "found")
    worst = found.agg(F.min("recall")).first()[0]
    if worst is not None and worst < LEAST_RECALL:
        raise ValueError(f"an audit found a recall of {worst:.3f}")
    degree = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("others"), F.min("recall").alias("recall"))
    named = classes.join(degree, classes.cls == degree.c, "left").join(components(found.where("b is not null").select("a", "b")), F.col("cls") == F.col("node"), "left")
    named = named.select("k1", "k2", "least", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), F.coalesce("root", "cls").alias("root"), "recall")
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("comp"))
    named = named.join(least, F.col("root") == F.col("r")).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), "links", "comp", "recall")
    out = units.join(named, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & (F.col("dim") > 0), "left")
    comp = F.when(F.col("dim") > 0, F.col("comp")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"), "recall")


def op5_hnsw_links(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_hnsw_links": op5_hnsw_links}
