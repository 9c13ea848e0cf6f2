"""SimHash near-duplicates through pivot distance tables.

Fingerprints: 64 bits of 3-word shingles. Two fingerprints link at ``radius`` (3)
or fewer differing bits. The search is whole: of five blocks of bits two at least
are equal in any pair within the radius, so equal pairs of blocks (26 bits) bring
every such pair together. There, each fingerprint has a table of Hamming distances
to 32 reference fingerprints; by the triangle inequality a pair whose distances to
any reference differ by more than the radius can't link and is discarded; what
survives is verified bit by bit. Equal fingerprints are one class from the start,
and tasks put out spanning links only, so large groups of copies never become
pairs. A bucket with more than ``cap`` classes is split into chunks, and each pair
of chunks is a task of its own: nothing is dropped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import columns_of, components, forest, materialise, new_names, release, small, table

RADIUS = 3
WIDTHS = (13, 13, 13, 13, 12)
CAP = 2048


def _references(n: int = 32) -> np.ndarray:
    """n fixed 64-bit references: steps of the golden ratio, mixed (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


REFERENCES = _references()


def fingerprint(text: bytes | None) -> int:
    """SimHash of the 3-word shingles of a whole text (A-Z lower-cased); 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - 2
    for at in range(0, n, 16384):
        part = words[at : at + 16386]
        h = np.fromiter([xxh64_intdigest(b" ".join(s), 42) for s in zip(part, part[1:], part[2:])], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    import pyarrow as pa

    for b in batches:
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), one row for each row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _block_keys(fp):
    parts, shift = [], 0
    for w in WIDTHS:
        parts.append(F.shiftrightunsigned(fp, shift).bitwiseAND((1 << w) - 1))
        shift += w
    pairs = combinations(range(len(WIDTHS)), 2)
    return F.array(*[F.lit(k << 26) + F.shiftleft(parts[i], 13) + parts[j] for k, (i, j) in enumerate(pairs)])


def close(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels of the groups of linked fingerprints in one bucket: index of the first member."""
    table_ = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.argsort(table_[:, 0], kind="stable")
    fps, table_ = fps[order], table_[order]
    n, links = len(fps), []
    last = np.searchsorted(table_[:, 0], table_[:, 0] + radius, side="right")
    for a in range(0, n, 256):
        b, end = min(n, a + 256), int(last[min(n, a + 256) - 1])
        far = np.zeros((b - a, end - a), dtype=np.int8)
        for k in range(table_.shape[1]):
            np.maximum(far, np.abs(table_[a:b, None, k] - table_[None, a:end, k]), out=far)
        i, j = np.nonzero(far <= radius)
        i, j = i[j > i] + a, j[j > i] + a
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        if ok.any():
            links.append(forest(np.stack([i[ok], j[ok]], axis=1)))
    label = np.arange(n)
    if links:
        f = forest(np.concatenate(links))
        label[f[:, 0]] = f[:, 1]
    out = np.empty(n, dtype=np.int64)
    out[order] = order[label]
    return out


def _run_links(key: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Spanning links between fingerprints of equal key; both arrays sorted by key."""
    found, start = [], np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    many = np.repeat(size, size)
    for lag in range(1, min(16, int(size.max(initial=1)))):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & (many[lag:] <= 16))
        if not len(i):
            break
        a, b, left = fps[i], fps[i + lag], np.ones(len(i), dtype=bool)
        for r in REFERENCES:  # the pivot table's columns, one by one
            left &= np.abs(np.bitwise_count(a ^ r).astype(np.int8) - np.bitwise_count(b ^ r).astype(np.int8)) <= RADIUS
        left &= np.bitwise_count(a ^ b) <= RADIUS
        found.append(np.stack([a[left], b[left]], axis=1))
    for s, n in zip(start[size > 16], size[size > 16]):
        run = np.unique(fps[s : s + n])
        label = close(run)
        off = label != np.arange(len(run))
        found.append(np.stack([run[off], run[label[off]]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)


def _links(batches):
    """Links within runs of equal key; the rows come sorted by key."""
    import pyarrow as pa

    def out(key, fps):
        found = _run_links(key, fps).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    key, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(key) and key[0] != key[-1]:
            cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
            yield out(key[:cut], fps[:cut])
            key, fps = key[cut:], fps[cut:]
    if len(key):
        yield out(key, fps)


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints ``fp``."""
    keys = fps.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    hot = keys.groupBy("key").count().where(F.col("count") > cap).select("key", F.ceil(F.col("count") / cap).cast("int").alias("chunks"))
    cut = keys.join(hot, "key", "left").withColumn("mine", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("chunks"))))
    runs = cut.select("key", "fp", "mine", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("other"))
    run = F.when((F.col("mine") == 0) & (F.col("other") == 0), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    return runs.select(run.alias("run"), "fp").repartition("run").sortWithinPartitions("run").mapInArrow(_links, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable), for each row of docs.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows, ties and equal doc_ids stay, each with its class. A null doc_id takes part
    but names no component; a component of null doc_ids only has a null id. Columns
    other than doc_id and text are ignored; an empty table gives an empty table."""
    prints = materialise(fingerprints(docs), "prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes))
    named = classes.join(roots, classes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(least, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(by_fp, prints.fp == by_fp.f).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies: the one of the least doc_id, null last.

    Near copies are joined by texts of 0.8 or more of their 5-word shingles in common.
    Fingerprints of these shingles bring close ones together (``links``), each link
    verified on the whole sets; ``jaccard.groups`` then finds every pair that three bits
    miss. Rows count, not ids: different texts of one doc_id, or of none, are apart. Null
    and empty texts are copies of each other; long texts are taken whole; of equal rows
    one stays; columns of any name pass through; an empty table gives an empty table."""
    row, dropped_row = new_names(docs, "row", "dropped")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = jaccard.groups(numbered.select(row, "doc_id", "text"), row, near=links)
    first = rows.groupBy(F.col("root").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    dropped = materialise(rows.join(first, F.col("root") == F.col("of")).where("row <> least.row").select(F.col("row").alias(dropped_row)), "dropped")
    release(rows)
    return numbered.join(small(dropped), F.col(row) == F.col(dropped_row), "left_anti").select(*columns_of(docs))


def op7_simhash_pivots(spark, sf_dir):
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op7_simhash_pivots": op7_simhash_pivots}
