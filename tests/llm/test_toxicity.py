import numpy as np

from tallyward.llm import toxicity as t
from tallyward.llm.common import table


def test_ordinal_fit_finds_weights_and_thresholds():
    rng = np.random.default_rng(1)
    w, theta = np.array([2.0, -1.0, 0.5, 0.0]), np.array([1.0, 2.5])
    rows = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(20_000)]
    z = np.array([w[r].sum() for r in rows])
    grades = ((z + rng.logistic(size=len(z)))[:, None] > theta).sum(axis=1)
    got, found = t.fit_ordinal(rows, grades, 4, 2, l2=0.0)
    assert np.abs(got - w).max() < 0.15 and np.abs(found - theta).max() < 0.15


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = t.fit(docs, labels, fold="doc_id % 5 <> 0")
    test = t.severity(docs, model).join(labels.where("doc_id % 5 = 0"), "doc_id").toPandas()
    hit = test.p_toxic >= t.TOXIC
    assert hit[test.toxic == 1].mean() > 0.9 and hit[test.toxic == 0].mean() < 0.01
    assert np.allclose(test.severity, test.p_toxic) and set(test.grade) == {0, 1}  # the labels are 0 and 1


def test_several_grades(spark):
    """Labels 0, 2 and 5 are three grades; worse words are told by more of the same weight."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        grade = int(rng.integers(0, 3))
        bad = ["", "nastyword", "nastyword vileword foulword"][grade]
        rows.append((i, " ".join(rng.choice(["plain", "kind", "quiet", "other", "even"], 12)) + " " + bad))
        labels.append((i, [0, 2, 5][grade]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = t.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), fold="doc_id < 600")
    got = {r.doc_id: r for r in t.severity(docs, model).collect()}
    assert len(model.thresholds) == 2 and np.mean([got[i].grade == [0, 2, 5].index(g) for i, g in labels[600:]]) > 0.95
    assert all(abs(got[i].severity - [0, 2, 5].index(g)) < 0.5 for i, g in labels[600:])


def test_bounds_hold_where_ids_repeat(spark):
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "concat('text vile', id % 5) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").union(spark.createDataFrame([(7, 1)] * 50, "doc_id long, toxic int"))
    seen = []
    real = t.fit_ordinal
    t.fit_ordinal = lambda rows, *a, **k: seen.append(len(rows)) or real(rows, *a, **k)
    try:
        t.LEAST, least = 1, t.LEAST
        t.fit(docs, labels.selectExpr("doc_id", "if(doc_id % 5 = 1, 1, 0) as toxic"), sample=200)
    finally:
        t.fit_ordinal, t.LEAST = real, least
    assert all(n <= 200 for n in seen)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} " + ("vileword here" if i % 4 == 0 else "kind here"), 1.0) for i in range(200)] + [(500, None, 1.0), (501, "", 1.0), (None, "vileword", 1.0), (0, "again", 1.0), (501, "longer " * 200_000, 1.0)], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(200)] + [(None, 1, 1), (3, None, 1), (7, 0, 1)], "doc_id long, toxic int, quality int")
    model = t.fit(docs, labels)
    got = t.severity(docs, model).collect()
    assert len(got) == 205
    assert all((r.p_toxic > 0.5) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and 0 < r.doc_id < 200)
    assert t.severity(docs, t.fit(docs, labels.limit(0))).where("p_toxic > 0.01").count() == 0
    assert t.severity(docs.limit(0), model).count() == 0
