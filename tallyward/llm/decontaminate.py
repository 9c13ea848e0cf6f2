r"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

A text becomes tokens in which numbers, names (a capital inside a sentence) and units
after numbers carry a type mark before their value. Its template has the marks alone.
Windows of five template tokens of every document are hash-joined with those of the
benchmark. Matches of a document and an item are lined up by offset; an item whose
windows are covered to 0.8 or more in any of its spellings is a leak if its slots are consistent: each value
that the item has in a slot stands for one value in the document, as it does where a
question was copied or only given new numbers and names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, materialise, new_names, small, table

WINDOW = 5
COVERED = 0.8
#: Offsets that may differ within one passage: words put in or left out.
SLACK = 5
#: Share of an item's slot values that may stand for more than one value.
LOOSE = 0.2
#: Fewest template tokens in a window that aren't marks.
LITERAL = 2
#: Windows of the benchmark up to which they are broadcast (64 MB at 64 bytes each).
BROADCAST_WINDOWS = 1_000_000

#: Marks, from the private use area.
NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = "km|cm|mm|kg|mg|ml|miles?|feet|foot|inch(?:es)?|yards?|met(?:er|re)s?|grams?|pounds?|ounces?|lit(?:er|re)s?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?|mph|kmh|hz|m|g|l|s|h"


def tokens(text):
    """Tokens of a text; numbers, names and units begin with their mark."""
    t = F.regexp_replace(text, r"(\p{Lu})(?=\p{Ll})(?<=[\p{Ll}\p{N},;:]\s\p{Lu})", NAME + "$1")
    t = F.regexp_replace(F.lower(t), r"[.,:/](?<=\d.)(?=\d)", "")
    t = F.regexp_replace(t, rf"(\d(?<![\p{{L}}\d]\d)\d*) ?({UNITS}|%)(?![\p{{L}}\d])", f"{NUM}$1 {UNIT}$2")
    t = F.regexp_replace(t, rf"\d(?<![\p{{L}}\d{NUM}{UNIT}]\d)\d*(?![\p{{L}}\d])", NUM + "$0")
    return F.split(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{NUM}{NAME}{UNIT}%]+")


def template(tokens_):
    """The tokens with marks in place of numbers, names and units."""
    return F.split(F.regexp_replace(F.array_join(tokens_, " "), f"([{NUM}{NAME}{UNIT}])[^ ]*", "$1"), " ")


def _windows(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each window: the columns ``keep``, at, h, literal; tok is left for slots.

    h is of the template, or, where it is nearly all marks (not literal), of the values."""
    df = df.select(*keep, tokens(F.col("text")).alias("tok")).withColumn("tpl", template(F.col("tok")))
    df = df.where(F.size("tpl") >= WINDOW)
    df = df.select(*keep, "tok", "tpl", F.explode(F.sequence(F.lit(0), F.size("tpl") - WINDOW)).alias("at"))
    part, own = ([F.get(c, F.col("at") + k) for k in range(WINDOW)] for c in ("tpl", "tok"))
    literal = sum((F.when(x.isin("", NUM, NAME, UNIT), 0).otherwise(1) for x in part), F.lit(0)) >= LITERAL
    return df.select(*keep, "at", F.when(literal, F.xxhash64(*part)).otherwise(F.xxhash64(F.lit("own"), *own)).alias("h"), literal.alias("literal"), "tok")


def bench_windows(benchmark: DataFrame) -> DataFrame:
    """h, item_id, pos, slots, counts: the windows of all items that say something.

    An item is written in three ways, and coverage is counted for each apart: of all its
    windows, and of the literal ones where they are half or more; of the literal ones of
    all ways besides. ``counts`` has a number for each count that the window is part of,
    and how many windows that count has."""
    clean = benchmark.select("item_id", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{M}\p{N}%]+$", "").alias("text"))
    # inside a sentence of a document, an item's first word passes for a name; in a copy in one case, no name does
    ways = clean.select("item_id", F.posexplode(F.array(F.col("text"), F.concat(F.lit(NAME), "text"), F.lower("text"))).alias("way", "text"))
    w = _windows(ways, ["item_id", "way"])
    w = w.select("h", "item_id", "way", "literal", F.col("at").alias("pos"), F.slice("tok", F.col("at") + 1, WINDOW).alias("slots"))
    one, item = Window.partitionBy("item_id", "way"), Window.partitionBy("item_id")
    w = w.withColumns({"n": F.count("*").over(one), "n_literal": F.count_if("literal").over(one), "n_any": F.size(F.collect_set(F.when(F.col("literal"), F.col("pos"))).over(item))})
    count = lambda k, n: F.struct(k.cast("int").alias("count"), F.col(n).cast("int").alias("n_windows"))
    counts = F.array_compact(F.array(
        F.when(F.col("literal"), count(F.lit(-1), "n_any")),
        F.when(F.col("literal") & (F.col("n_literal") * 2 >= F.col("n")), count(F.col("way"), "n_literal")),
        F.when(F.col("n_literal") < F.col("n"), count(F.col("way") + 10, "n")),
    ))
    return w.groupBy("h", "item_id", "pos").agg(F.first("slots").alias("slots"), F.array_distinct(F.flatten(F.collect_list(counts))).alias("counts"))


def leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, coverage, at (first word), n_slots, n_loose, verbatim: every leak.

    Null and empty texts and items of fewer than five words match nothing; where nearly
    all of an item is marks, only its own values do. Rows of one doc_id are one document; repeated rows
    and items don't change the result; each text of an item_id, or of none, is an item. Documents whose doc_id is null are reported under
    it. Other columns are ignored; an empty table on either side gives no leaks."""
    texts = materialise(benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item_id", "text"]), "items")
    items = materialise(bench_windows(texts.select(F.col("item").alias("item_id"), "text")), "bench")
    side = items if items.count() > BROADCAST_WINDOWS else F.broadcast(items)
    w = _windows(docs, ["doc_id"])
    if side is items:
        w = w.withColumn("tok", F.slice("tok", F.col("at") + 1, WINDOW)).withColumn("zero", F.lit(0))
    else:
        w = w.withColumn("zero", F.col("at"))
    hit = w.join(side, "h").select("doc_id", "item_id", "counts", "pos", (F.col("at") - F.col("pos")).alias("off"), F.slice("tok", F.col("zero") + 1, WINDOW).alias("here"), F.col("slots").alias("there"))
    is_slot = lambda x: F.substring(x["there"], 1, 1).isin(NUM, NAME, UNIT)
    hit = hit.withColumn("slots", F.filter(F.arrays_zip("there", "here"), is_slot)).drop("here", "there").select("*", F.inline("counts")).drop("counts")
    # a document has few windows of an item: the passage's own
    per = hit.groupBy("doc_id", "item_id", "count", "off", "n_windows").agg(F.collect_set("pos").alias("pos"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    near = Window.partitionBy("doc_id", "item_id", "count").orderBy("off").rangeBetween(-SLACK, SLACK)
    per = per.withColumns({
        "hit": F.size(F.array_distinct(F.flatten(F.collect_list("pos").over(near)))),
        "slots": F.array_distinct(F.flatten(F.collect_list("slots").over(near))),
    })
    best = per.groupBy("doc_id", "item_id", "count", "n_windows").agg(F.max_by(F.struct("hit", "off", "slots"), F.struct("hit", F.col("off") * -1)).alias("b"))
    best = best.select("doc_id", "item_id", (F.col("b.hit") / F.col("n_windows")).alias("coverage"), F.greatest(F.lit(0), F.col("b.off")).alias("at"), F.col("b.slots").alias("slots"))
    best = best.where(F.col("coverage") >= covered)
    values = F.array_distinct(F.transform("slots", lambda s: s["there"]))
    loose = F.filter(values, lambda v: F.size(F.array_distinct(F.transform(F.filter(F.col("slots"), lambda s: s["there"] == v), lambda s: s["here"]))) > 1)
    best = best.withColumns({"n_slots": F.size(values), "n_loose": F.size(loose), "verbatim": ~F.exists("slots", lambda s: s["there"] != s["here"])})
    best = best.where(F.col("n_loose") <= F.col("n_slots") * LOOSE)
    row = F.struct("coverage", "at", "n_slots", "n_loose", "verbatim")
    return best.groupBy("doc_id", "item_id").agg(F.max_by(row, F.struct("coverage", "verbatim", F.col("at") * -1, "n_slots", F.col("n_loose") * -1)).alias("b")).select("doc_id", F.col("item_id").alias("item"), "b.*").join(texts.select("item", "item_id"), "item").select("doc_id", "item_id", "coverage", "at", "n_slots", "n_loose", "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak: rows of one doc_id are one document, a row without doc_id is one by its text.

    Null and empty texts have no leak and stay; long texts are searched whole; repeated
    rows go or stay together. Columns of any name pass through; an empty table on either
    side changes nothing."""
    key, bad_key = new_names(docs, "key", "bad")
    numbered = docs.withColumn(key, F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))))
    found = leaks(numbered.select(F.col(key).alias("doc_id"), "text"), benchmark)
    bad = materialise(found.select(F.col("doc_id").alias(bad_key)).distinct(), "leaks")
    return numbered.join(small(bad), F.col(key) == F.col(bad_key), "left_anti").select(*columns_of(docs))


def op1_template_leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_template_leaks": op1_template_leaks}
