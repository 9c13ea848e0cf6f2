from collections import Counter

import pytest

from tallyward.llm import tokencount as t

SCHEMA = "doc_id long, text string, n_tokens string, step int"
TEXTS = [None, "", " ", "One two  three\n\n four's", "été naïve 你好 🙂", "x" * 5000, "a b " * 20_000, "12345 678\t\r\n!!! ...", "One two  three\n\n four's"]


def test_counts_are_those_of_the_whole_encoding():
    count, enc = t.counter(), t.encoder()
    for text in TEXTS:
        assert count(text) == len(enc.encode_ordinary(text or ""))


def test_suffix_sums_and_limits(spark):
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in enumerate(TEXTS)], SCHEMA)
    enc = t.encoder()
    lengths = [len(enc.encode_ordinary(x or "")) for x in TEXTS]
    hist = t.histogram(df)
    assert {r.n_tokens: r.n_docs for r in hist.collect()} == Counter(lengths)
    rows = t.suffix_sums(hist).collect()
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.n_tokens)] == sorted(set(lengths))
    for r in rows:
        longer = [x for x in lengths if x > r.n_tokens]
        assert (r.docs_longer, r.tokens_longer) == (len(longer), sum(longer))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r.quantile == pytest.approx(1 - len(longer) / len(lengths))
    for r in t.at_limits(hist, [0, 5, 512, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
        assert r.fitting_docs == sum(x <= r.context_limit for x in lengths) and r.lost_tokens == sum(lengths) - r.truncated_total
    assert t.length_at(t.suffix_sums(hist), 0.5).first().n_tokens == sorted(lengths)[4]
    assert t.suffix_sums(t.histogram(df.limit(0))).count() == 0
