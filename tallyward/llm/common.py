"""What the operators share: tables, the shared folder, components, prefix sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the word pattern ``[^\x20\x09-\x0D]+`` sees it.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, a local session) a folder of this machine is set,
    but never on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(spark, "_tallyward_dir", None)
        if path is None:
            folder = tempfile.mkdtemp(prefix="tallyward-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            path = spark._tallyward_dir = "file://" + folder
    return path.rstrip("/")


#: Bytes of a batch of rows on its way to a Python worker: few rows where texts are long.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


@contextmanager
def small_batches(spark: SparkSession):
    """Queries that run inside send batches of BATCH bytes at most."""
    key, most = BATCH
    was = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyward-{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyward_path = path
    tables(spark).append(path)
    return out


def tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``materialise`` has written in this session and that are still there."""
    if not hasattr(spark, "_tallyward_tables"):
        spark._tallyward_tables = []
    return spark._tallyward_tables


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in tables(spark):
        tables(spark).remove(path)


def release(*frames: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_tallyward_path", None):
            drop(df.sparkSession, path)


#: Rows of a few numbers up to which a table is broadcast: some 30 MB.
BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, a table of a few numbers in a row, broadcast if it has BROADCAST rows at most; beyond, a join shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def tidy(query):
    """The query with its result as the only table that it leaves, where it keeps any in between."""

    @wraps(query)
    def run(spark, sf_dir):
        before = set(tables(spark))
        out = query(spark, sf_dir)
        between = set(tables(spark)) - before
        if between:
            out = materialise(out, query.__name__)
        for path in between:
            drop(spark, path)
        return out

    return run


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add: each with as many underscores before it as df's own columns leave free."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def columns_of(df: DataFrame) -> list:
    """The columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def forest(pairs: np.ndarray) -> np.ndarray:
    """Spanning links (node, smallest node of its group) of an (n, 2) array."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[at[:, 0]], root[at[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[at[:, 0]], low)
        np.minimum.at(new, root[at[:, 1]], low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return np.stack([nodes[keep], nodes[root[keep]]], axis=1)


def _forests(batches):
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            f = forest(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1])], names=["u", "v"])


#: Links of a node above which they are dealt to several tasks.
HUB = 1_000_000


def _with_least(links: DataFrame, node: str, other: str, n: int) -> DataFrame:
    """links with ``m``, the least ``other`` of the node; ``n``: how many links there are.

    The least of a node with more than HUB links is repeated for as many parts as its
    links are dealt to; with HUB links in all there is none."""
    least = links.groupBy(node).agg(F.min(other).alias("m"), F.count("*").alias("k"))
    if n <= HUB:
        return links.join(least.drop("k"), node)
    least = materialise(least, "least")
    parts = F.ceil(F.col("k") / HUB).cast("int")
    hubs = least.where(F.col("k") > HUB).select(F.col(node).alias("hub"), parts.alias("parts"))
    dealt = links.join(small(hubs), F.col(node) == F.col("hub"), "left")
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("parts"))).cast("int")).drop("hub", "parts")
    return dealt.join(least.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("k"), [node, "part"]).drop("part")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): node, root (smallest node).

    Batches of links are first cut to spanning forests; then large-star and
    small-star rounds alternate until nothing changes, each written to the shared
    folder. Nodes without a link to another node are not returned. Null ends and
    self-links are ignored; an empty table gives an empty table."""
    clean = links.select(F.col(links.columns[0]).cast("long").alias("u"), F.col(links.columns[1]).cast("long").alias("v")).where("u <> v")
    star = materialise(clean.mapInArrow(_forests, "u long, v long").distinct(), "links")
    before, n = None, star.count()
    while True:
        kept = set(tables(star.sparkSession))
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).toDF("x", "y")
        large = _with_least(both, "x", "y", 2 * n).where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v")).distinct()
        if 2 * n > HUB:
            large = materialise(large, "large")
        small_star = _with_least(large, "u", "v", 2 * n).select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))))
        new = materialise(small_star.where("a <> b").distinct().toDF("u", "v"), "star")
        for path in set(tables(star.sparkSession)) - kept - {new._tallyward_path}:
            drop(star.sparkSession, path)
        release(star)
        star = new
        now = tuple(star.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first())
        if now == before:
            out = star.toDF("node", "root")
            out._tallyward_path = star._tallyward_path
            return out
        before, n = now, now[0]


def running(df: DataFrame, by: list[str], bucket: str, order: list, value: str, out: str, offset=None) -> DataFrame:
    """Inclusive running sum of ``value`` within ``by``, ordered by ``bucket`` then ``order``.

    Sums per bucket are added up first, so that one group spreads over as many
    tasks as it has buckets."""
    per = df.groupBy(*by, bucket).agg(F.sum(value).alias("__in"))
    per = per.withColumn("__before", F.sum("__in").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__in"))
    per = per.select(*[F.col(c).alias(f"__{c}") for c in [*by, bucket]], "__before")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col(bucket) == F.col(f"__{bucket}")]
    cond = same[0]
    for c in same[1:]:
        cond &= c
    w = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(per, cond, "left").withColumn(out, F.sum(value).over(w) + F.col("__before")).drop("__before", *[f"__{c}" for c in [*by, bucket]])


def thinned(df: DataFrame, keys: list[str], most: int, seed: int) -> DataFrame:
    """Rows of different keys, those whose keys hash lowest: about ``most`` where df has more.

    A threshold on the hash, from the number of rows, leaves somewhat fewer but for chance
    and one row for each key, however many rows share it. Nothing is sorted or gathered."""
    of = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40))
    share = 0.99 * most / max(df.count(), 1)
    few = df if share >= 0.99 else df.where(of < int((1 << 40) * share))
    return few.dropDuplicates(keys)


def sample_of(df: DataFrame, keys: list[str], most: int, seed: int) -> DataFrame:
    """``thinned``, and ``most`` rows at most: what chance leaves beyond goes. For narrow rows: they pass through one task."""
    of = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40))
    return thinned(df, keys, most, seed).orderBy(of, *keys).limit(most)


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; null has none."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(SPACE))), F.lit(0)).cast("long")
