import random
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tallyward.llm import sharding

SCHEMA = "doc_id long, text string, c string, _part string, hash int"


def brute(sizes, n):
    best = None
    for k in range(min(n, len(sizes))):
        for c in combinations(range(1, len(sizes)), k):
            e = [0, *c, len(sizes)]
            m = max(sum(sizes[a:b]) for a, b in zip(e, e[1:]))
            best = m if best is None else min(best, m)
    return best


def test_capacity_and_cuts_agree_with_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([1, 2, 5, 30]) for _ in range(rng.randint(1, 9))]
        n = rng.randint(1, 5)
        cap, starts = sharding.plan(sizes, n)
        assert cap == brute(sizes, n)
        edges = [0, *starts, len(sizes)]
        assert edges == sorted(edges) and len(edges) == n + 1
        parts = [sizes[a:b] for a, b in zip(edges, edges[1:])]
        assert max(map(sum, parts)) <= cap
        assert sum(bool(p) for p in parts) == min(n, len(sizes)) or max(sizes) == cap


def test_rows_slots_and_groups(spark):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(0, 300) + str(i)) for i in range(3000)] + [(9000 + i, "same") for i in range(1500)]
    rows += [(None, None), (1, None), (7, ""), (5, "w5"), (5, "w5"), (8, "é" * 50)]
    out = sharding.shard(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        t = (r.text or "").encode()
        assert r.size == len(t) + 16 and r.crc == zlib.crc32(t)
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(40))
    for s, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    homes = {}
    for r in out:
        homes.setdefault(r.text or "", set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    total, largest = sum(r.size for r in out), 1500 * 20
    assert max(sum(r.size for r in rs) for rs in by.values()) <= total / 40 + largest


def test_least_capacity_over_single_groups(spark):
    """From four ranges on, finer ones lead to the least capacity over all groups of equal hashes."""
    rng = random.Random(4)
    for case in range(4):
        hashes = [rng.getrandbits(64) - 2**63 for _ in range(120)] + [5, 6, 7, -1, -2]
        rows = [(h, rng.choice([16, 20, 300, 5000])) for h in hashes for _ in range(rng.choice([1, 1, 3]))]
        df = spark.createDataFrame(rows, "hash long, size long")
        groups = {}
        for h, n in rows:
            groups[h] = groups.get(h, 0) + n
        sizes = [groups[h] for h in sorted(groups, key=lambda h: h % 2**64)]
        for n_shards in (1, 3, 10):
            known = sharding.ranges(df, n_shards, bits=2, most_rows=16)
            assert known.size.sum() == sum(sizes) and (known.start()[1:] > known.start()[:-1]).all()
            assert sharding.plan(known.size.tolist(), n_shards)[0] == sharding.smallest_capacity(sizes, n_shards)
            assert n_shards > 3 or len(known.size) < len(sizes)


def test_clashing_names_and_long_texts(spark):
    names = ["doc_id", "text", "size", "_size", "shard", "hash", "_s", "in_part", "a b", "COUNT"]
    rows = [(k, "x" * (500_000 if k == 3 else 10), *[str(k)] * 8) for k in range(50)]
    out = sharding.shard(spark.createDataFrame(rows, names))
    assert out.columns == [*names, "__size", "crc", "_shard", "slot"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 50 and all(got[k]["a b"] == got[k].hash == str(k) for k in got) and got[3]["__size"] == 500_016


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_least_capacity_where_large_groups_leave_all_ranges_open(spark):
    """Large groups make both capacities differ until they stand alone, which takes more ranges than may be held if all are divided at once."""
    n, n_shards = 60_000, 10
    df = spark.range(n).select(F.xxhash64("id").alias("hash"), F.when(F.col("id") % 4_000 == 77, 60_000).otherwise(16 + F.col("id") % 5).cast("long").alias("size")).localCheckpoint()
    known = sharding.ranges(df, n_shards, bits=8, most_rows=1024)
    at = df.groupBy("hash").agg(F.sum("size").alias("size")).toPandas()
    sizes = at["size"].to_numpy()[np.argsort(at["hash"].to_numpy().view(np.uint64))]
    total = np.r_[0, np.cumsum(sizes)]

    def fits(cap):
        done = 0
        for _ in range(n_shards):
            done = int(np.searchsorted(total, total[done] + cap, side="right")) - 1
        return done == len(sizes)

    cap = sharding.plan(known.size.tolist(), n_shards)[0]
    assert known.size.sum() == sizes.sum() and fits(cap) and not fits(cap - 1)
    assert len(known.size) < n // 4
