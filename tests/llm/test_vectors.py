import numpy as np
import pyarrow as pa

from tallyward.llm import vectors as v

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)


def clusters(rng, n, dim=64, groups=40):
    centres = rng.standard_normal((groups, dim))
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 4):
        x[i] = centres[rng.integers(groups)] + 0.12 * rng.standard_normal(dim)
    return x.astype(np.float32)


def test_graph_finds_links_and_large_groups():
    rng = np.random.default_rng(1)
    x = clusters(rng, 3000).astype(np.float64)
    x = np.concatenate([x, rng.standard_normal(64) + 0.03 * rng.standard_normal((600, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    truth = unit @ unit.T >= 0.95
    g = v.Graph(unit)
    beam, recall = v.audited_beam(g, unit.astype(np.float32))
    i, j = g.links(unit.astype(np.float32), 0.95, beam)
    got = np.zeros_like(truth)
    got[i, j] = True
    assert recall >= v.RECALL and (got & truth).sum() / truth.sum() > 0.97


def test_large_group_beside_sparse_links(spark):
    """A third of the vectors in one group: all its links, and the few of the others, at either size."""
    rng = np.random.default_rng(4)
    for n in (900, 3600):
        x = rng.standard_normal((n, 32))
        x[: n // 3] = x[0] + 0.1 * rng.standard_normal((n // 3, 32))
        x[n // 2 : n // 2 + 100] = x[n // 2 + 100 : n // 2 + 200] + 0.1 * rng.standard_normal((100, 32))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        truth = unit @ unit.T >= 0.95
        g = v.Graph(unit)
        beam, recall = v.audited_beam(g, unit.astype(np.float32))
        i, j = g.links(unit.astype(np.float32), 0.95, beam)
        got = np.zeros_like(truth)
        got[i, j] = True
        assert recall >= v.RECALL and not (got & (unit @ unit.T < 0.95 - 1e-5)).any()
        mean = (got & truth).sum(axis=1) / truth.sum(axis=1)
        assert mean.mean() > 0.99 and mean[: n // 3].min() == 1.0
        np.fill_diagonal(truth, False)
        table = {r.vec_id: r for r in v.near_vectors(spark.createDataFrame([(k, [float(z) for z in r], 0, "") for k, r in enumerate(x)], "vec_id long, embedding array<double>, label int, n_links string")).collect()}
        links = np.array([table[k].n_links for k in range(n)])
        assert (links[: n // 3] == truth.sum(axis=1)[: n // 3]).all() and links.sum() >= 0.999 * truth.sum()
        assert {table[k].component_id for k in range(n // 3)} == {0} and min(r.recall for r in table.values()) >= v.LEAST_RECALL


def test_spanning_joins_what_hits_join():
    rng = np.random.default_rng(6)
    for _ in range(50):
        hit = rng.random((int(rng.integers(1, 12)), int(rng.integers(0, 12)))) < 0.15
        rows, nodes = np.arange(len(hit)), 100 + np.arange(hit.shape[1])
        i, j = np.nonzero(hit)
        group = lambda p: {frozenset(x) for x in _groups(p)}
        assert group(np.stack([rows[i], nodes[j]], axis=1)) == group(v.spanning(rows, nodes, hit))


def _groups(pairs):
    of = {}
    for a, b in pairs.tolist():
        joined = of.setdefault(a, {a}) | of.setdefault(b, {b})
        for k in joined:
            of[k] = joined
    return [s for s in of.values() if len(s) > 1]


def test_table_agrees_with_brute_force(spark):
    rng = np.random.default_rng(2)
    x = clusters(rng, 1200)
    x[1000:1100] = x[0]
    x[1100:1110] = 3 * x[4]
    rows = [(i, [float(z) for z in r], 0, "a") for i, r in enumerate(x)]
    bad = [(5000, None, 0, "a"), (5001, [0.0] * 64, 0, "a"), (5002, [float("nan")] + [1.0] * 63, 0, "a"), (5003, [float("inf")] * 64, 0, "a"), (5004, [None] + [1.0] * 63, 0, "a"), (5005, [], 0, "a")]
    short = [(6000, [1.0, 0.0], 0, "a"), (6001, [1.0, 0.01], 0, "b")]
    got = {r.vec_id: r for r in v.near_vectors(spark.createDataFrame(rows + bad + short, SCHEMA)).collect()}
    truth = brute(x.astype(np.float64))
    found = np.array([got[i].n_links for i in range(1200)])
    assert found.sum() >= 0.98 * truth.sum() and (found <= truth.sum(axis=1)).all()
    label = np.arange(1200)
    while True:
        new = np.array([min(label[i], *label[truth[i]]) if truth[i].any() else label[i] for i in range(1200)])
        if (new == label).all():
            break
        label = new
    assert np.mean([got[i].component_id == label[i] for i in range(1200)]) > 0.98
    for b in bad:
        assert (got[b[0]].n_links, got[b[0]].component_id, got[b[0]].kept) == (0, b[0], True)
    assert got[6000].n_links == got[6001].n_links == 1 and got[6001].component_id == 6000
    assert v.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_of_a_block_answer_like_one(monkeypatch):
    rng = np.random.default_rng(9)
    x = clusters(rng, 700).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(700)
    data = [u.tobytes() for u in unit]
    table = pa.table({"name": pa.array([0] * 700, pa.int32()), "shard": pa.array([0] * 700, pa.int32()), "dim": pa.array([64] * 700, pa.int32()), "cls": ids, "n": np.ones(700, dtype=np.int64), "unit": pa.array(data, pa.binary())})
    graph = v._build(table)["graph"][0].as_py()
    rows = pa.record_batch({"shard": pa.array([0] * 701, pa.int32()), "dim": pa.array([64] * 701, pa.int32()), "block": pa.array([0] * 701, pa.int32()), "cls": pa.array([None, *ids.tolist()], pa.int64()), "data": pa.array([graph, *data], pa.binary())})
    want = brute(x).sum(axis=1)
    for chunk in (10_000, 100, 350):
        monkeypatch.setattr(v, "CHUNK", chunk)
        out = pa.Table.from_batches(list(v._query([rows.slice(0, 200), rows.slice(200)]))).to_pylist()
        counts = {r["a"]: r["n"] for r in out if r["b"] is None}
        assert sorted(counts) == ids.tolist() and sum(counts.values()) >= 0.98 * want.sum()
        assert all(counts[i] <= want[i] for i in counts)
