import corpus_pipeline
from tallyward.llm import decontaminate, quality, simhash
from tallyward.llm.common import materialise, table, tables

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    bench = table(spark, SF, "benchmark")
    columns, sizes = docs.columns, [docs.count()]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = materialise(stage(spark, docs, SF), "test")
        sizes.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            asked = {r.doc_id for r in before.select("doc_id").collect()} & labels.keys()
            assert sum((d in ids) == (labels[d] == 1) for d in asked) > 0.97 * len(asked)
        if k == 1:
            assert simhash.groups(docs).where("doc_id <> component_id").count() == 0
            assert len(ids) == sizes[-1]
        if k == 2:
            assert decontaminate.leaks(docs, bench).count() == 0
            gone = {r.doc_id for r in before.select("doc_id").collect()} - ids
            assert gone == {r.doc_id for r in decontaminate.leaks(before, bench).collect()}
        if k == 3:
            assert max(r["count"] for r in docs.groupBy("doc_id").count().collect()) <= 3
        if k == 4:
            assert sizes[-1] == sizes[-2] and {r.shard for r in docs.select("shard").distinct().collect()} == set(range(40))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "empty")
    assert docs.count() == 0
    assert quality.REJECT == 0.5


def test_run_leaves_the_last_tables_only(spark):
    before = set(tables(spark))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    left = [p.rsplit("/", 1)[1].split("-")[1] for p in set(tables(spark)) - before]
    assert left == ["stage3"] and {"doc_id", "text", "shard", "slot"} <= set(out.columns)
    for s in range(40):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_odd_rows_pass_through_all_stages(spark):
    """Nulls, repeats, a very long text and columns whose names clash with the operators' own."""
    good = "The harbour of {0} was quiet, and nobody came down to the boats of {0} before noon. Later the wind turned, as it does here; {0} slept on. "
    names = ["doc_id", "text", "source", "row", "hash", "uid", "finish", "dropped", "shard", "a b.c"]
    word = lambda i: "".join(chr(97 + (i // 26**k + 3 * k) % 26) for k in range(6))
    rows = [(i, " ".join(good.format(word(i * 7 + j)) for j in range(3)), "ab"[i % 2] if i % 5 else None) for i in range(60)]
    rows += [(60, None, "a"), (61, "", "b"), (None, rows[3][1], "a"), (3, rows[3][1], "a"), (None, good.format("nowhere"), None), (62, " ".join(good.format(word(i)) for i in range(3000)), "b")]
    docs = spark.createDataFrame([(*r, *[str(k)] * 7) for k, r in enumerate(rows)], "doc_id long, text string, source string, row string, hash string, uid string, finish string, dropped string, shard string, `a b.c` string")
    assert docs.columns == names
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF), "odd")
        assert docs.columns == (names if k < 4 else [*names, "_shard", "slot"]), name
        got = docs.collect()
        kept.append(got)
        assert all(r["a b.c"] == r.row == r.hash and rows[int(r.row)][0] == r.doc_id for r in got)
    ids = [{r.doc_id for r in got} for got in kept]
    assert 60 not in ids[0] and 61 not in ids[0] and {3, 62, None} <= ids[0]
    texts = [r.text for r in kept[1]]
    assert len(set(texts)) == len(texts) and {r.doc_id for r in kept[1] if r.text == rows[3][1]} == {3}
    assert max(len(r.text) for r in kept[2]) > 300_000 and kept[3] and len(kept[3]) == len(kept[4])
    assert len({r.source for r in kept[3]}) == 3


def test_stages_chained_without_writing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() > 0
