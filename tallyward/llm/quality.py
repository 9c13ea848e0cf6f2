"""Document quality from weak labels.

Eight heuristic labellers each vote good, bad or abstain; most only ever see one kind of
junk, so that a text which they don't call bad isn't good for that. Votes of all documents are
counted by pattern (3 ** 8 patterns at most); expectation-maximisation over the counts
estimates each labeller's accuracies and the share of good documents, and with them the
probability that a pattern's documents are good. A logistic scorer on hashed features of
the form of a text learns those probabilities from ``SAMPLE`` documents, the ones whose
id and text hash lowest, and scores every document. Documents under 0.5 are rejected.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, materialise, new_names, sample_of, small, table

#: Documents that the scorer is fitted on, at most.
SAMPLE = 20_000
BITS = 14
REJECT = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2

_SHAPES = bytes(
    120 if 97 <= b <= 122 or b >= 128 else 88 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 32 if b in b" \t\r\x0b\x0c" else b
    for b in range(256)
)
_RUNS = re.compile(rb"([xX9])\1+")
_PLAIN = re.compile(rb"[\"'(]*[xX9]+(?:['\-][xX9]+)*[.,;:!?\"')]?").fullmatch
_SPECIAL = bytes(b for b in range(33, 127) if chr(b) not in ".,;:!?'\"()-" and not chr(b).isalnum())
LABELLERS = ("symbols", "repeats", "capitals", "bare_marks", "variety", "short_words", "sentences", "plain_words")


def _bad(is_bad: bool) -> int:
    return BAD if is_bad else ABSTAIN


def describe(raw: bytes | None) -> tuple[int, dict[str, float]]:
    """Votes (base 3, first labeller lowest) and features of one whole text."""
    raw = raw or b""
    words = raw.split()
    n = len(words)
    if not n:
        return sum(BAD * 3**k for k in range(len(LABELLERS))), {"empty": 1.0}
    shape = raw.translate(_SHAPES)
    chars = len(raw) - raw.count(b" ") - raw.count(b"\n") or 1
    upper, lower = shape.count(b"X"), shape.count(b"x")
    special = len(raw) - len(raw.translate(None, _SPECIAL)) + 2 * raw.count(b"!!")
    same = sum(map(bytes.__eq__, words, words[1:]))
    shapes = Counter(_RUNS.sub(rb"\1", shape).split())
    bare = sum(c for s, c in shapes.items() if not s.strip(b".,;:!?'\"()-|*#$%&/\\+=<>_~^@[]{}`"))
    ends = sum(c for s, c in shapes.items() if s[-1:] in b".!?")
    plain = sum(c for s, c in shapes.items() if _PLAIN(s))
    kinds = len(set(words))
    short = sum(c for s, c in Counter(map(len, words)).items() if s <= 3)
    long = n >= 20
    votes = (
        _bad(special / chars >= 0.06),
        _bad(same / n >= 0.2),
        _bad(upper / (upper + lower or 1) >= 0.5),
        _bad(bare / n >= 0.1),
        _bad(long and kinds / min(n, 200) <= 0.25),
        _bad(long and short / n <= 0.05),
        GOOD if 0.02 <= ends / n <= 0.35 else _bad(long and ends / n < 0.002),
        GOOD if plain / n >= 0.9 else _bad(plain / n < 0.75),
    )
    features = {"shape " + s[:16].decode("ascii"): c / n for s, c in shapes.most_common(64)}
    features |= {"same": same / n, "special": special / chars, "upper": upper / (upper + lower or 1), "bare": bare / n, "plain": plain / n, "variety": kinds / n, "short": short / n}
    features |= {f"{name} at {min(9, int(10 * x))}": 0.5 for name, x in (("same", same / n), ("special", special / chars), ("upper", upper / (upper + lower or 1)), ("bare", bare / n), ("plain", plain / n))}
    return sum(v * 3**k for k, v in enumerate(votes)), features


def hashed(features: dict[str, float], bits: int = BITS) -> tuple[list[int], list[float]]:
    from xxhash import xxh32_intdigest

    out: dict[int, float] = {}
    for name, x in features.items():
        k = xxh32_intdigest(name) & ((1 << bits) - 1)
        out[k] = out.get(k, 0.0) + x
    return list(out), list(out.values())


def _described(batches):
    import pyarrow as pa

    for b in batches:
        votes, at, x = [], [], []
        for t in b.column(1).to_pylist():
            v, f = describe(t)
            k, y = hashed(f)
            votes.append(v), at.append(k), x.append(y)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], names=["row", "votes", "at", "x"])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
    """Posterior of good for each pattern, the labellers' table [good, labeller, vote], the prior of good.

    ``patterns``: (n, labellers) of votes. The start takes bad votes to be rare for good
    documents and good votes to be rarer for bad ones, which fixes which class is which."""
    k = patterns.shape[1]
    given = np.tile(np.array([[0.4, 0.4, 0.2], [0.6, 0.05, 0.35]])[:, None, :], (1, k, 1))
    prior = 0.5
    for _ in range(rounds):
        like = np.log(given[:, np.arange(k)[None, :], patterns]).sum(axis=2) + np.log([[1 - prior], [prior]])
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        was, prior = prior, float(np.clip((counts * post).sum() / max(counts.sum(), 1), 1e-6, 1 - 1e-6))
        for y, w in ((0, counts * (1 - post)), (1, counts * post)):
            for v in range(3):
                given[y, :, v] = ((patterns == v) * w[:, None]).sum(axis=0) + 0.5
        given /= given.sum(axis=2, keepdims=True)
        if abs(was - prior) < 1e-9:
            break
    return post, given, prior


def fit_logistic(at, x, y, weight=None, bits: int = BITS, rounds: int = 300, l2: float = 1e-4, rate: float = 0.5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on sparse rows; y may be probabilities. Full-batch Adam."""
    size = (1 << bits) + 1
    rows = np.repeat(np.arange(len(at)), [len(a) for a in at])
    cols, vals = np.concatenate([*at, []]).astype(np.int64), np.concatenate([*x, []]).astype(np.float64)
    y, w, m, v = np.asarray(y, dtype=np.float64), np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, vals * w[cols], minlength=len(at)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / max(len(at), 1)
        g = np.append(np.bincount(cols, vals * e[rows], minlength=size - 1), e.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def scores(docs: DataFrame, sample: int = SAMPLE, row: str | None = None) -> tuple[DataFrame, dict]:
    """(doc_id, row, weak, quality) for each row of docs, and what was learned.

    ``row`` is the column of docs that numbers its rows, or else numbers them; ``weak`` is
    the posterior of a row's votes, ``quality`` the scorer's probability of good. Null,
    empty and blank texts are bad by every labeller; long texts are taken whole. Repeated
    rows and ties score alike, and the scorer learns from one of them; other columns are
    ignored. An empty table gives no rows."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    got = docs.select(F.struct(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content")).alias("row"), F.col("text").cast("binary"))
    got = materialise(got.mapInArrow(_described, "row struct<row:long,doc_id:long,content:long>, votes int, at array<int>, x array<float>").select("row.*", "votes", "at", "x"), "described")
    count = got.groupBy("votes").count().orderBy("votes").toPandas()
    votes, n = count["votes"].to_numpy(dtype=np.int64), count["count"].to_numpy(dtype=np.float64)
    patterns = np.stack([votes // 3**k % 3 for k in range(len(LABELLERS))], axis=1) if len(votes) else np.zeros((0, len(LABELLERS)), dtype=np.int64)
    post, given, prior = expectation_maximisation(patterns, n)
    picked = sample_of(got.select("doc_id", "content", "row"), ["doc_id", "content"], sample, 7).select(F.col("row").alias("picked"))
    rows = got.join(F.broadcast(picked), F.col("row") == F.col("picked")).select("votes", "at", "x").toPandas() if len(votes) else None  # SAMPLE rows
    y = dict(zip(votes.tolist(), post.tolist()))
    w = fit_logistic(rows["at"].to_list(), rows["x"].to_list(), [y[v] for v in rows["votes"]]) if rows is not None else np.zeros((1 << BITS) + 1)

    def scored(batches):
        import pyarrow as pa

        for b in batches:
            ids, size = b.column(3), np.diff(b.column(3).offsets.to_numpy())
            at, x = ids.flatten().to_numpy(), b.column(4).flatten().to_numpy()
            z = np.bincount(np.repeat(np.arange(b.num_rows), size), w[at] * x, minlength=b.num_rows) + w[-1]
            weak = np.array([y[v] for v in b.column(2).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weak), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "row", "weak", "quality"])

    out = got.select("doc_id", "row", "votes", "at", "x").mapInArrow(scored, "doc_id long, row long, weak double, quality double")
    learned = {"prior": prior, "accuracy": {name: {"bad": given[0, k, BAD], "good": given[1, k, GOOD]} for k, name in enumerate(LABELLERS)}, "weights": w}
    return out, learned


def keep_good(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of docs that the scorer keeps, whatever their ids.

    Null, empty and blank texts go; long texts are judged whole; repeated rows and ties
    stay or go together. Columns of any name pass through; an empty table gives no rows."""
    row, bad_row = new_names(docs, "row", "bad")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "scored")
    out, _ = scores(numbered.select(row, "doc_id", "text"), row=row)
    bad = materialise(out.where(F.col("quality") < reject).select(F.col("row").alias(bad_row)), "bad")
    return numbered.join(small(bad), F.col(row) == F.col(bad_row), "left_anti").select(*columns_of(docs))


def op4_weak_quality(spark, sf_dir):
    out, _ = scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "weak", "quality", (F.col("quality") >= REJECT).alias("kept"))


QUERIES = {"op4_weak_quality": op4_weak_quality}
