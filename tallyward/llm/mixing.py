"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each source's documents are shuffled by a seeded hash, once for each pass over the
source. A document copy finishes at virtual time: the source's words so far, this copy
included, divided by the source's target. Serving copies by finish time gives each
source its share at every point. All copies are sorted by finish time, their words added
up in that order, and the mix is truncated where the total reaches the budget, the sum of
all targets: at virtual time 1. The copy that a source is serving then finishes there,
taken in part, so that each source's words equal its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, materialise, new_names, running, table, word_count

SEED = 20240229
#: Most times that one document is taken.
PASSES = 3
#: Hash ranges into which a pass over a source is cut for its running sums.
RANGES = 1024
#: Ranges of a unit of virtual time, in which words are added up before the ranges' own sums are.
TICKS = 8_192
WEIGHTS = (1, 2, 3)


def _placed(df: DataFrame, order: list, tag: str) -> DataFrame:
    """df as a table in an order over all partitions, with the number of each row's partition."""
    return materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), tag)


def targets(sizes: DataFrame, passes: int = PASSES, weights=WEIGHTS) -> DataFrame:
    """source, source_size, weight, target: shares by weight, capped at ``passes`` sizes.

    Sources by code point, null last, weigh ``weights`` in turn. Shares above the cap
    are cut to it and the excess is shared again by weight among the others: in order of
    cap per weight, a source is capped if its cap is below its share of what the sources
    before it leave. One row for each source; ranks and sums run over sorted partitions, so
    that there may be as many sources as documents."""
    by_name = [F.col("source").asc_nulls_last()]
    per = _placed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), by_name, "sources")
    per = running(per.withColumn("one", F.lit(1)), [], "part", by_name, "one", "rank").drop("part", "one")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(passes))).withColumn("each", F.col("cap") / F.col("weight")).drop("rank")
    by_cap = [F.col("each"), F.col("source").asc_nulls_last()]
    per = _placed(per, by_cap, "caps")
    whole = F.broadcast(per.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weights")))  # one row
    shared = running(running(per, [], "part", by_cap, "cap", "caps"), [], "part", by_cap, "weight", "weighed").crossJoin(whole)
    shared = shared.withColumn("share", (F.col("all") - F.col("caps") + F.col("cap")) / (F.col("weights") - F.col("weighed") + F.col("weight")))
    first = F.struct("each", F.col("source").isNull().alias("last"), "source")
    level = F.broadcast(shared.where("each >= share").agg(F.min_by("share", first).alias("level")))  # one row
    return per.crossJoin(level).select("source", "source_size", "weight", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def schedule(docs: DataFrame, passes: int = PASSES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix (uid, doc_id, source, size, source_size, target, pass, finish, taken, total) and all rows with their sizes.

    The mix is in order of virtual finish time, range-sorted over all partitions;
    ``total`` is its words up to and with a copy. ``uid`` numbers the rows of docs for this
    run. Null sources are a source, null texts and texts without words have size 0 and
    finish with whatever precedes them; they are in the mix with 0 words. A text of any
    length is one document, taken in part where it stands at the end. Repeated rows are
    documents of their own; ties in time go by uid. With no words at all, nothing is
    taken. Columns other than doc_id, source and text are ignored; an empty table gives an
    empty mix."""
    sized = docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content"),
    ).withColumn("uid", F.monotonically_increasing_id())
    sized = materialise(sized, "sizes")
    goal = materialise(targets(sized, passes), "targets")
    budget = goal.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    known = sized.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    n = F.greatest(F.lit(1), F.least(F.lit(passes), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))).cast("int")
    copies = known.withColumn("pass", F.explode(F.sequence(F.lit(0), n - 1)))
    copies = copies.withColumn("key", F.xxhash64(F.lit(seed), "pass", "doc_id", "content"))
    copies = copies.withColumn("range", F.pmod(F.shiftright("key", 54), F.lit(RANGES)))
    copies = running(copies, ["source", "pass"], "range", ["key", "doc_id", "uid"], "size", "so_far")
    done = F.col("pass") * F.col("source_size") + F.col("so_far")
    left = F.floor(F.col("target") - done + F.col("size"))  # of the target when this copy begins
    served = F.when((left > 0) & (left < F.col("size")), left).otherwise(F.col("size")).cast("long")
    copies = copies.withColumns({"served": served, "finish": F.when(F.col("target") > 0, F.when(served < F.col("size"), 1.0).otherwise(done / F.col("target")))})
    # the budget is spent at time 1: what finishes from 2 on is beyond it in any order
    timed = copies.where("finish < 2").withColumn("tick", F.floor(F.col("finish") * TICKS))
    timed = running(timed, [], "tick", ["finish", "uid", "pass"], "served", "total")
    cut = timed.withColumn("taken", F.least("served", F.lit(budget) - F.col("total") + F.col("served"))).where(F.col("total") - F.col("served") < budget)
    out = cut.select("uid", "doc_id", "source", "size", "source_size", "target", "pass", "finish", "taken", F.least("total", F.lit(budget)).alias("total"))
    return out.repartitionByRange("finish", "uid", "pass").sortWithinPartitions("finish", "uid", "pass"), known


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, in order of finish time; a copy taken in part stays if over half of it is.

    Null and empty texts have no words and stay out, however long texts are one row;
    repeated rows are rows of their own; null sources are a source. Columns of any name
    pass through; an empty table gives an empty mix."""
    uid, of, finish, turn = new_names(docs, "uid", "of", "finish", "pass")
    numbered = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "mixed")
    plan, _ = schedule(numbered.select(F.col(uid).alias("doc_id"), "source", "text"))
    plan = plan.where(F.col("taken") * 2 > F.col("size")).select(F.col("doc_id").alias(of), F.col("finish").alias(finish), F.col("pass").alias(turn))
    out = numbered.join(plan, F.col(uid) == F.col(of)).repartitionByRange(finish, uid, turn).sortWithinPartitions(finish, uid, turn)
    return out.select(*columns_of(docs))


def op9_fair_mix(spark, sf_dir):
    plan, known = schedule(table(spark, sf_dir, "documents"))
    taken = plan.groupBy(F.col("uid").alias("u")).agg(F.sum("taken").alias("taken"), F.min("finish").alias("first_finish"))
    out = known.join(taken, F.col("uid") == F.col("u"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_finish")


QUERIES = {"op9_fair_mix": op9_fair_mix}
