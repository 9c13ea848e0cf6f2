import random

import pytest

from tallyward.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, target string, key int"


def fill(sizes, weights, passes=3):
    total, capped = sum(sizes), {}
    while True:
        left = {i for i in range(len(sizes)) if i not in capped}
        w = sum(weights[i] for i in left)
        share = {i: (total - sum(capped.values())) * weights[i] / w for i in left} if left else {}
        over = {i: passes * sizes[i] for i in left if share[i] > passes * sizes[i]}
        if not over:
            return [capped[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_targets_agree_with_repeated_resharing(spark):
    rng = random.Random(1)
    for case in range(3):
        sources = [f"s{i:02}" for i in range(rng.randint(1, 9))] + [None]
        sizes = [rng.choice([1, 10, 1000, 50_000]) for _ in sources]
        got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(zip(sources, sizes)), "source string, size long")).collect()}
        want = fill(sizes, [1 + i % 3 for i in range(len(sources))])
        for s, t in zip(sources, want):
            assert got[s].target == pytest.approx(t, rel=1e-9)


def test_each_source_meets_its_target(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None]), " ".join("w" * rng.randint(1, 30))) for i in range(400)]
    rows += [(400, "a", None), (401, "b", ""), (402, "b", "one  two\x0bthree "), (402, "b", "one  two\x0bthree "), (None, "c", "x y"), (403, "tiny", "only words")]
    first = [mixing_digest(spark, rows) for _ in range(2)]
    assert first[0] == first[1]
    by = {}
    for doc, source, size, source_size, target, taken in first[0]:
        assert 0 <= taken <= 3 * size
        t = by.setdefault(source, [target, source_size, 0, 0])
        t[2] += taken
        t[3] += size
    for target, source_size, taken, size in by.values():
        assert size == source_size and abs(taken - target) <= 1
    assert sum(t[0] for t in by.values()) == pytest.approx(sum(t[1] for t in by.values()))
    assert sum(size for d, _, size, *_ in first[0] if d == 402) == 6


def mixing_digest(spark, rows):
    from pyspark.sql import functions as F

    plan, known = mixing.schedule(frame(spark, rows).repartition(3))
    taken = plan.groupBy(F.col("uid").alias("u")).agg(F.sum("taken").alias("taken"))
    out = known.join(taken, F.col("uid") == F.col("u"), "left").fillna({"taken": 0})
    return sorted(((-1 if r.doc_id is None else r.doc_id, str(r.source), r.size, r.source_size, r.target, r.taken) for r in out.collect()))


def test_schedule_is_in_order_and_shares_hold_all_along(spark):
    rows = [(i, "ab"[i % 2], "w " * 10) for i in range(600)]
    plan, _ = mixing.schedule(frame(spark, rows))
    got = plan.collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert [r.total for r in got] == [sum(r.taken for r in got[: k + 1]) for k in range(len(got))]
    assert got[-1].total == 6000 and got[-1].finish <= 1
    for n in (90, 300):
        part = got[:n]
        share = sum(r.taken for r in part if r.source == "b") / sum(r.taken for r in part)
        assert share == pytest.approx(2 / 3, abs=0.05)


def test_mix_and_empty_tables(spark):
    rows = [(i, "a", f"{i} " * 40) for i in range(100)] + [(500, "b", "tiny doc")]
    out = mixing.mix(frame(spark, rows))
    assert out.columns == ["doc_id", "source", "text", "size", "target", "key"]
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(500) == 3 and max(ids.count(i) for i in range(100)) == 1
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, "a", None), (2, "b", "")])).count() == 0


def test_mix_is_in_finish_order_whatever_the_names(spark):
    names = ["doc_id", "source", "text", "uid", "of", "pass", "finish", "size", "a.b", "_uid"]
    rows = [(i, "ab"[i % 2], f"{i} " * 10, *["x"] * 7) for i in range(300)] + [(300, None, "long " * 3000, *["x"] * 7)]
    out = mixing.mix(spark.createDataFrame(rows, names))
    assert out.columns == names
    got = out.collect()
    assert set(got[0]["a.b"] for r in got) == {"x"}
    for n in (60, 150):
        assert sum(r.source == "b" for r in got[:n]) / max(1, sum(r.source in ("a", "b") for r in got[:n])) == pytest.approx(2 / 3, abs=0.08)


def test_truncation_at_the_budget(spark):
    """Against serving the copies one after another."""
    rng = random.Random(5)
    rows = [(i, rng.choice("abbbc"), "w " * rng.choice([1, 5, 40, 700])) for i in range(150)]
    plan, known = mixing.schedule(frame(spark, rows))
    got, budget = plan.collect(), sum(int(t.target) for t in known.select("source", "target").distinct().collect())
    spent = 0
    for r in got:
        assert spent < budget and r.taken <= r.size
        spent += r.taken
        assert r.total == spent
    assert spent == budget
    served = {}
    for r in got:  # each source's own clock
        served[r.source] = served.get(r.source, 0) + r.size
        assert r.finish == pytest.approx(min(served[r.source] / r.target, 1.0))
