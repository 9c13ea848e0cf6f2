"""Sharding by a minimax contiguous partition.

Atomic groups are the groups of equal texts, in the order of the text's 64-bit hash. Their
sizes first come to the driver as those of ``2 ** BITS`` ranges of the hash. Ranges that
can't be cut give the largest capacity that could be needed, ranges that can be cut
anywhere the smallest; a cut of any partition in between lies in the few ranges between
the cuts of these two, which are summed in finer ranges, until both capacities are one:
the least over all groups, found without all groups on the driver. Binary search finds
each capacity, greedy filling checks it; the cuts then go there, each as near to an even
share of what is left as the capacity and the shards still to come allow. Law: ``bytes``.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, materialise, new_names, release, table

N_SHARDS = 40
BITS = 16
#: Finer ranges that are summed in one go, at most.
ROWS = 65_536
#: Parts of a shard that are numbered apart, before the parts' offsets are added.
PARTS = 1024


def smallest_capacity(sizes, n_shards: int) -> int:
    """The least capacity at which ``sizes``, in order, fill n_shards or fewer contiguous shards."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + int(s))

    def fits(cap: int) -> bool:
        at = used = 0
        while at < len(sizes) and used <= n_shards:
            at = bisect.bisect_right(total, total[at] + cap) - 1
            used += 1
        return used <= n_shards

    low = max(max(sizes, default=0), -(-total[-1] // n_shards))
    high = max(low, total[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def cuts(sizes, n_shards: int, cap: int) -> list[int]:
    """Index of the first group of each shard after the first; no shard exceeds cap."""
    total = [0]
    for s in sizes:
        total.append(total[-1] + int(s))
    n = len(sizes)
    # earliest[k]: first start from which k shards can hold the rest
    earliest, at = [n], n
    for _ in range(n_shards):
        at = bisect.bisect_left(total, total[at] - cap) if at else 0
        earliest.append(max(0, at))
    out, at = [], 0
    for left in range(n_shards - 1, 0, -1):
        most = bisect.bisect_right(total, total[at] + cap) - 1
        even = total[at] + (total[n] - total[at]) / (left + 1)
        best = bisect.bisect_left(total, even)
        if best > at + 1 and best <= n and even - total[best - 1] <= total[min(best, n)] - even:
            best -= 1
        # every shard gets a group while there are groups to give
        best = max(min(max(best, at + 1), most, max(n - left, at)), min(earliest[left], most))
        out.append(best)
        at = best
    return out


def plan(sizes, n_shards: int) -> tuple[int, list[int]]:
    cap = smallest_capacity(sizes, n_shards)
    return cap, cuts(sizes, n_shards, cap)


@dataclass
class Ranges:
    """Ranges of the hash in order: prefix of ``depth`` bits, bytes, whether it holds more than one hash."""

    prefix: np.ndarray
    depth: np.ndarray
    size: np.ndarray
    many: np.ndarray

    def start(self) -> np.ndarray:
        """The first hash of each range, in signed order (the sign bit turned)."""
        first = self.prefix.astype(np.uint64) << (64 - self.depth).astype(np.uint64)
        return (first ^ np.uint64(1 << 63)).view(np.int64)

    def reach(self, cap: int, n_shards: int, fluid: bool) -> list[int]:
        """Ends, in bytes, of greedily filled shards; ``fluid``: a range of many hashes may be cut anywhere, else nowhere."""
        total = np.r_[0, np.cumsum(self.size)]
        at, out = 0, []
        for _ in range(n_shards):
            end = min(at + cap, int(total[-1]))
            k = int(np.searchsorted(total, end, side="right")) - 1
            if not (fluid and k < len(self.many) and self.many[k]):
                end = max(int(total[k]), at)
            at = end
            out.append(at)
        return out

    def between(self, n_shards: int) -> tuple[int, int, np.ndarray]:
        """The smallest and largest capacity that the least over all groups can have, and the ranges where they differ."""
        whole, n = int(self.size.sum()), n_shards
        high = smallest_capacity(self.size.tolist(), n)
        low, top = max(int(self.size[~self.many].max(initial=0)), -(-whole // n)), high
        while low < top:
            mid = (low + top) // 2
            low, top = (low, mid) if self.reach(mid, n, True)[-1] >= whole else (mid + 1, top)
        if low >= high:
            return high, high, np.zeros(0, dtype=np.int64)
        return low, high, self.unsure(low, high, n)

    def unsure(self, low: int, high: int, n_shards: int) -> np.ndarray:
        """The ranges of many hashes where shards may end at a capacity from low to high."""
        total = np.r_[0, np.cumsum(self.size)]
        asked = np.zeros(len(self.size) + 1, dtype=np.int64)
        for a, b in zip(self.reach(low, n_shards, False), self.reach(high, n_shards, True)):
            first, last = np.searchsorted(total, a, side="right") - 1, np.searchsorted(total, b, side="left")
            if first < last:
                asked[first] += 1
                asked[last] -= 1
        return np.flatnonzero((np.cumsum(asked[:-1]) > 0) & self.many)


def _ranges(rows: DataFrame, depth: int) -> Ranges:
    """The ranges of ``depth`` bits that (hash, size) rows have; one row each comes to the driver."""
    per = rows.groupBy(F.shiftrightunsigned("hash", 64 - depth).alias("prefix")).agg(F.sum("size").alias("size"), (F.min("hash") < F.max("hash")).alias("many")).toPandas()
    prefix = per["prefix"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(prefix)
    return Ranges(prefix[order], np.full(len(order), depth), per["size"].to_numpy(dtype=np.int64)[order], per["many"].to_numpy(dtype=bool)[order])


def ranges(rows: DataFrame, n_shards: int, bits: int = BITS, most_rows: int = ROWS) -> Ranges:
    """Ranges of the hash of (hash, size) rows, fine enough for the least capacity over single hashes, however many there are.

    Where many ranges are asked for, the capacity in the middle is tried first, from the
    first shards on: where one ends is known before the next one's end is looked for."""
    known, few = _ranges(rows, bits), max(1, most_rows // 16)
    while True:
        low, high, asked = known.between(n_shards)
        if not len(asked):
            return known
        if len(asked) > few:
            middle = (low + high) // 2
            asked = known.unsure(middle, middle, n_shards)[:few]
        depth = int(known.depth[asked].min())
        asked = asked[known.depth[asked] == depth]
        deeper = min(64, depth + max(1, (most_rows // len(asked)).bit_length() - 1))
        wanted = rows.sparkSession.createDataFrame([(int(p),) for p in known.prefix[asked].view(np.int64)], "wanted long")
        some = rows.join(F.broadcast(wanted), F.shiftrightunsigned("hash", 64 - depth) == F.col("wanted"), "left_semi")  # most_rows ranges at most
        finer = _ranges(some, deeper)
        kept = np.ones(len(known.size), dtype=bool)
        kept[asked] = False
        both = Ranges(*(np.concatenate([getattr(known, c)[kept], getattr(finer, c)]) for c in ("prefix", "depth", "size", "many")))
        order = np.argsort(both.start(), kind="stable")
        known = Ranges(both.prefix[order], both.depth[order], both.size[order], both.many[order])


def shard(docs: DataFrame, n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """The rows of docs and four columns: size, crc, shard and slot (with underscores before, where docs has such a column).

    Null text counts as no bytes (size 16, CRC-32 0) and goes with the empty text; a long
    text counts whole, and one that fills more than a shard makes that shard larger.
    Repeated rows each take a slot; ties in a slot's order are between rows alike in
    doc_id and text. Columns of any name pass through. An empty table gives no rows; with
    fewer groups than shards, some shards stay empty."""
    size, crc, number, slot, group, part, count, in_shard, in_part, before = new_names(docs, "size", "crc", "shard", "slot", "hash", "part", "count", "in_shard", "in_part", "before")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.withColumns({size: (F.octet_length(text) + 16).cast("long"), crc: F.crc32(text.cast("binary")), group: F.xxhash64(text)})
    slim = materialise(sized.select(F.col(group).alias("hash"), F.col(size).alias("size")), "hashes")
    known = ranges(slim, n_shards, bits)
    release(slim)
    _, starts = plan(known.size.tolist(), n_shards)
    first = known.start()
    ordered = F.col(group).bitwiseXOR(F.lit(-(1 << 63)))
    told = F.lit(0)
    for s in starts:
        if s < len(first):
            told = told + (ordered >= F.lit(int(first[s]))).cast("int")
    placed = sized.withColumn(number, told).withColumn(part, F.pmod(F.xxhash64("doc_id", group), F.lit(PARTS)).cast("int"))
    per = placed.groupBy(number, part).agg(F.count("*").alias(count))
    per = per.select(
        F.col(number).alias(in_shard), F.col(part).alias(in_part),
        (F.sum(count).over(Window.partitionBy(number).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col(count)).alias(before),
    )  # n_shards x PARTS rows at most: a proven bound
    ranked = placed.withColumn(slot, F.row_number().over(Window.partitionBy(number, part).orderBy(group, "doc_id")).cast("long") - 1)
    out = ranked.join(F.broadcast(per), (F.col(number) == F.col(in_shard)) & (F.col(part) == F.col(in_part)))
    return out.select(*columns_of(docs), size, crc, number, (F.col(slot) + F.col(before)).alias(slot))


def op8_minimax_shards(spark, sf_dir):
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op8_minimax_shards": op8_minimax_shards}
