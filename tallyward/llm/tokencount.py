"""Token counts as an exact histogram of encoded lengths.

Every document is encoded whole; documents of one length become one row. Suffix sums over
the rows answer totals, quantiles and totals under truncation for every context limit
without going back to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, running, table

#: A byte-level BPE as ranks. A path on every executor, or a file sent along with the job.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's public tokenizer splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that are summed together first.
STEP = 1024
#: Pieces whose lengths a worker remembers.
REMEMBER = 500_000


def encoder(ranks: str = RANKS):
    """The tiktoken encoding of a rank file; a worker reads it once."""
    import base64

    import tiktoken

    kept = vars(tiktoken).setdefault("_tallyward", {})
    if ranks not in kept:
        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[ranks] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
    return kept[ranks]


def counter(ranks: str = RANKS):
    """A function from a text to its number of tokens, the same as encoding it whole.

    The tokenizer never merges across pieces of its pattern, so lengths of pieces add
    up; common pieces are encoded once."""
    import regex

    encode, split, seen = encoder(ranks).encode_ordinary, regex.compile(PATTERN).findall, {}

    def count(text: str | None) -> int:
        total, get = 0, seen.get
        for piece in split(text or ""):
            n = get(piece)
            if n is None:
                n = len(encode(piece))
                if len(piece) < 64:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen[piece] = n
            total += n
        return total

    return count


def lengths(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """n_tokens of each row of docs. Null and empty texts have none."""

    def counted(batches):
        import pyarrow as pa

        count = counter(ranks)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([count(t) for t in b.column(0).to_pylist()], pa.int64())], names=["n_tokens"])

    return docs.select("text").mapInArrow(counted, "n_tokens long")


def histogram(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """n_tokens, n_docs: one row for each length, over all documents.

    Null and empty texts have length 0, long texts their whole length. Repeated rows count
    each time; columns other than text are ignored; an empty table gives an empty
    histogram."""
    return lengths(docs, ranks).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length, as a context limit: documents and tokens of it, of it or more, and under truncation.

    docs_longer and tokens_longer count documents above the limit; truncated_total is
    what all documents keep when cut to the limit; quantile is the share of documents
    that fit. Sums run within steps of lengths and over the steps' totals."""
    h = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / STEP).cast("long").alias("step"))
    h = running(h, [], "step", ["n_tokens"], "n_docs", "docs_up_to")
    h = running(h, [], "step", ["n_tokens"], "tokens", "tokens_up_to")
    whole = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("all_tokens"))
    h = h.crossJoin(F.broadcast(whole))  # one row
    longer = F.col("all_docs") - F.col("docs_up_to")
    return h.select(
        "n_tokens", "n_docs", "tokens", longer.alias("docs_longer"), (F.col("all_tokens") - F.col("tokens_up_to")).alias("tokens_longer"),
        (F.col("tokens_up_to") + F.col("n_tokens") * longer).alias("truncated_total"), (F.col("docs_up_to") / F.col("all_docs")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, fitting_docs, truncated_total, lost_tokens for any limits, from the histogram."""
    total = F.sum(F.col("n_tokens") * F.col("n_docs"))
    aggs = []
    for x in limits:
        kept = F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs"))
        aggs.append(F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs"))), F.lit(0)).alias("fitting_docs"), F.coalesce(kept, F.lit(0)).alias("truncated_total"), F.coalesce(total - kept, F.lit(0)).alias("lost_tokens")))
    return hist.agg(F.array(*aggs).alias("x")).select(F.inline("x"))


def length_at(sums: DataFrame, share: float) -> DataFrame:
    """n_tokens: the least length at which ``share`` of the documents fit (suffix_sums as input)."""
    return sums.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op2_length_histogram(spark, sf_dir):
    return suffix_sums(materialise(histogram(table(spark, sf_dir, "documents")), "lengths"))


QUERIES = {"op2_length_histogram": op2_length_histogram}
