import random

import numpy as np
from xxhash import xxh64_intdigest

from tallyward.llm import common, simhash

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(ids, fps):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min(x for x, r in zip(ids, root) if r == root[i]) for i in range(len(fps))]


def test_fingerprint_agrees_with_the_definition():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "Été ÉTÉ été a", " ".join(rng.choice("ab cd ef gh".split()) for _ in range(40_000))]
    texts += [" ".join(rng.choice(["x", "Y z", "ß", "w,"]) for _ in range(n)) for n in (3, 4, 50)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_groups_agree_with_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(120):
        words = rng.choice(base).split()
        if k % 3:
            words[rng.randrange(len(words))] = f"w{k}"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "  "), (5, base[5]), (None, base[7])]
    got = simhash.groups(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    ids = [10**9 if i is None else i for i, _ in rows]
    want = brute(ids, [slow_fingerprint(t) for _, t in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == sorted((-1 if i == 10**9 else i, c) for i, c in zip(ids, want))


def test_hot_buckets_are_split_without_loss(spark):
    rng = np.random.default_rng(3)
    fps = {0}
    while len(fps) < 400:
        fps.add(int(rng.choice(sorted(fps))) ^ (1 << int(rng.integers(0, 40))) ^ (1 << int(rng.integers(0, 40))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute(fps, fps)
    for cap in (20, 10_000):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, cap=cap)).collect()}
        assert [found.get(f, f) for f in fps] == want


def test_empty_table_and_dedup(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.groups(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(4, text), (2, text), (2, text), (9, "other words here now"), (None, "third text of its own kind")]
    kept = simhash.dedup(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]


def test_links_of_a_hub_are_dealt_out(spark, monkeypatch):
    rng = random.Random(6)
    links = [(7, k) for k in range(100, 400)] + [(1000, k) for k in range(500, 700)] + [(k, rng.randrange(2000, 2100)) for k in range(2100, 2300)] + [(400, 1000), (3, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {tuple(r) for r in common.components(df).collect()}
    monkeypatch.setattr(common, "HUB", 40)
    before = set(common.tables(spark))
    assert {tuple(r) for r in common.components(df).collect()} == want
    assert {r for n, r in want if n in (399, 450)} == {7} and (1000, 400) in want and len(set(common.tables(spark)) - before) == 1
