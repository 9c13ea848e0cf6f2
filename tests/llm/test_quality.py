import numpy as np

from tallyward.llm import quality
from tallyward.llm.common import sample_of, table

SF = "/root/testdata/sf0.01"


def test_em_finds_accuracies_of_simulated_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    says = np.where(rng.random((20_000, 5)) < right, truth[:, None], ~truth[:, None])
    votes = np.where(rng.random((20_000, 5)) < 0.2, quality.ABSTAIN, np.where(says, quality.GOOD, quality.BAD))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, given, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.02
    for k, r in enumerate(right):
        assert abs(given[1, k, quality.GOOD] / (1 - given[1, k, quality.ABSTAIN]) - r) < 0.03
    assert ((post >= 0.5) == (patterns[:, 0] == quality.GOOD))[counts > 300].mean() > 0.8


def test_labelled_documents_agree(spark):
    out, learned = quality.scores(table(spark, SF, "documents"))
    got = {r.doc_id: r.quality for r in out.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    hit = [(got[d] >= quality.REJECT) == (q == 1) for d, q in labels.items()]
    assert len(got) == 1000 and np.mean(hit) > 0.97
    assert 0.6 < learned["prior"] < 0.99


def test_odd_rows_and_keeping(spark):
    schema = "doc_id long, text string, quality string, row string, votes int"
    good = "The harbour was quiet, and nobody came down to the boats before noon. Later the wind turned, as it does here. "
    rows = [(i, good * (1 + i % 3) + f"End {i}.") for i in range(60)] + [(100 + i, "BUY!! NOW!! $$$ ### CHEAP!! " * 20) for i in range(12)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, good), (3, rows[3][1]), (203, good * 2000)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], schema)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 2 and None in ids and 203 in ids and set(range(60)) <= set(ids)
    assert not set(ids) & {*range(100, 112), 200, 201, 202}
    assert quality.keep_good(df.limit(0)).count() == 0


def test_sample_is_bounded_where_keys_repeat(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id) as k", "id % 7 as v")
    for most in (500, 5000, 40_000):
        got = [r.k for r in sample_of(df, ["k"], most, 3).collect()]
        assert len(got) <= most and len(set(got)) == len(got) and len(got) > 0.55 * min(most, 20_000)
    assert sample_of(df.limit(0), ["k"], 10, 3).count() == 0


def test_clashing_names(spark):
    names = ["doc_id", "text", "row", "bad", "quality", "a.b", "__row", "_row"]
    good = "The harbour was quiet, and nobody came down to the boats before noon. Later the wind turned, as it does here. "
    kept = quality.keep_good(spark.createDataFrame([(k, good + str(k), *"abcdef") for k in range(20)] + [(99, "$$$ ###", *"uvwxyz")], names))
    assert kept.columns == names and {tuple(r)[2:] for r in kept.collect()} == {tuple("abcdef")}
