import random

import numpy as np
from pyspark.sql import functions as F

from tallyward.llm import jaccard, simhash

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    return {frozenset(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in root}


def found(spark, rows):
    got = {}
    for r in jaccard.groups(spark.createDataFrame(rows, SCHEMA).withColumn("__row", F.col("doc_id"))).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    return {frozenset(x) for x in got.values()}


def texts(seed, n):
    """Texts of 6 bases with 0 to 8 words changed, most under one long common beginning."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 30))
    common, bases = [word() for _ in range(60)], [[word() for _ in range(80)] for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " "), (3, "a b"), (4, "A  b"), (5, "a b c")]
    while len(rows) < n:
        words = (common if rng.random() < 0.7 else []) + list(rng.choice(bases))
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = word()
        rows.append((len(rows), " ".join(words)))
    return rows


def test_groups_agree_with_brute_force(spark, monkeypatch):
    rows = texts(1, 160)
    want = brute(rows)
    assert len(want) > 20 and max(map(len, want)) > 10
    assert found(spark, rows) == want
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)  # another order, the same result
    assert found(spark, rows) == want


def test_dedup_drops_what_three_bits_miss(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    near, far = list(words), list(words)
    for k in range(4):
        near[20 + 40 * k] = f"x{k}"  # 20 of 196 shingles: 176 / 216 in common
    for k in range(5):
        far[20 + 40 * k if k < 4 else 10] = f"y{k}"  # 171 / 221
    a, b, c = " ".join(words), " ".join(near), " ".join(far)
    assert bin(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).count("1") > 3
    kept = simhash.dedup(spark.createDataFrame([(7, b), (3, a), (5, c)], SCHEMA))
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {3, 5}


def test_bitmaps_differ_in_no_more_bits_than_sets_in_members():
    rng = np.random.default_rng(5)
    for n, m in ((0, 0), (0, 3), (1, 1), (40, 50), (64, 65), (100, 120), (900, 1100), (5000, 5000)):
        common = rng.integers(0, 2**63, min(n, m) // 2, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, k - len(common), dtype=np.uint64)])) for k in (n, m))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert jaccard.differing(jaccard.bitmap(a), jaccard.bitmap(b)) <= apart
        assert jaccard.differing(jaccard.bitmap(a), jaccard.bitmap(a)) == 0


def test_links_tried_first_do_not_change_the_groups(spark):
    rows = texts(2, 120)
    got = {}
    for r in jaccard.groups(spark.createDataFrame(rows, SCHEMA).withColumn("__row", F.col("doc_id")), near=simhash.links).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    assert {frozenset(x) for x in got.values()} == brute(rows)


def test_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    names = ["doc_id", "text", "row", "dropped", "_row", "a.b", "cls", "__row"]
    kept = simhash.dedup(spark.createDataFrame([(2, text, 1, 1, 1, 1, 1, 7), (1, text, 2, 2, 2, 2, 2, 8)], names))
    assert kept.columns == names and [tuple(r) for r in kept.collect()] == [(1, text, 2, 2, 2, 2, 2, 8)]


def test_empty_table(spark):
    assert jaccard.groups(spark.createDataFrame([], SCHEMA).withColumn("__row", F.col("doc_id"))).count() == 0


def test_dedup_counts_rows(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(1, one), (2, one), (2, two), (5, three), (5, one), (None, three), (None, two), (None, "alone, without a number"), (6, two), (6, "of its own kind")]
    kept = simhash.dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(1, one), (2, two), (5, three), (None, "alone, without a number"), (6, "of its own kind")]))
