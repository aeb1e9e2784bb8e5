"""Sharding by minimax contiguous partition.

Texts are ordered by their digest; equal texts are one atomic group, so copies never part. The smallest capacity for which a
greedy pass fills no more than the wanted shards is found by binary search, and the order is cut where that pass cuts.

The order is never gathered. It is summed in cells that share the first digits of the digest; bounds on the capacity tell
which cells a cut can fall in, and only those are summed again one digit finer, until each is a single group. The driver
sees some thousand cell sums at a time, whatever the number of documents. The cuts are digests, so a row's shard follows from
its own text with no join. Within a shard, rows are numbered by (cell of doc_id, doc_id, digest): cells are counted first, and only
rows of one cell are ordered together.

Defined cases: a null text has no bytes (size 1) and is a group apart from the empty text; fewer groups than shards leave the
last shards empty; an empty table gives an empty result; rows equal in every respect get different slots; a text of any length is a group
that is never cut, and may alone set the capacity; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidlake.llm.common import staged

DIGITS = 3
NULL_DIGEST = "0" * 64


def digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit(NULL_DIGEST))


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def greedy(sizes: list[int], capacity: int) -> list[int]:
    """First item of each run, runs being as long as the capacity lets them (an item above it is a run of its own)."""
    starts, load = [], capacity + 1
    for i, size in enumerate(sizes):
        if load + size > capacity:
            starts.append(i)
            load = 0
        load += size
    return starts


def smallest_capacity(sizes: list[int], shards: int, low: int) -> int:
    """The least capacity from ``low`` with at most ``shards`` runs, none above it."""
    low, high = max(low, max(sizes, default=0)), max(low, sum(sizes))
    while low < high:
        middle = (low + high) // 2
        if len(greedy(sizes, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _doubtful(cells: list[tuple[str, int, bool]], shards: int) -> list[str]:
    """Cells of more than one group that a cut can fall in, for a capacity between the bounds."""
    sizes = [size for _, size, _ in cells]
    low = max(-(-sum(sizes) // shards), max((s for _, s, single in cells if single), default=0))
    high = smallest_capacity(sizes, shards, low)
    ends = list(accumulate(sizes))
    begins = [e - s for e, s in zip(ends, sizes, strict=True)]
    wanted, lowest, at = set(), 0, 0
    for k in range(1, shards):
        while at < len(cells) and ends[at] <= lowest + low:  # the least a run of at least ``low`` can reach
            at += 1
        if at == len(cells):
            break
        lowest = begins[at]
        j = at
        while j < len(cells) and begins[j] <= k * high:  # the most that k runs can hold
            if not cells[j][2]:
                wanted.add(cells[j][0])
            j += 1
    return sorted(wanted)


def shard_cuts(rows: DataFrame, shards: int) -> tuple[list[str], int, int]:
    """Digest prefixes at which shards 1, 2, ... begin; the capacity; the number of rows. rows: key, size."""

    def sums(df: DataFrame, digits: int) -> list[tuple[str, int, bool, int]]:
        cell = F.substring("key", 1, digits).alias("cell")
        got = df.groupBy(cell).agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single"), F.count("*").alias("n")).collect()
        return [(r.cell, r.size, r.single, r.n) for r in got]

    found = sums(rows, DIGITS)
    count, cells = sum(n for *_, n in found), sorted((c, s, one) for c, s, one, _ in found)
    for digits in range(DIGITS + 1, 65):
        if not (doubtful := _doubtful(cells, shards)):
            break
        finer = sums(rows.where(F.substring("key", 1, digits - 1).isin(doubtful)), digits)
        gone = set(doubtful)
        cells = sorted([c for c in cells if c[0] not in gone] + [(c, s, one) for c, s, one, _ in finer])
        # Cells above keep their shorter names: a prefix sorts before what it begins.
    sizes = [size for _, size, _ in cells]
    capacity = smallest_capacity(sizes, shards, -(-sum(sizes) // shards)) if cells else 0
    return [cells[i][0] for i in greedy(sizes, capacity)[1:]] if cells else [], capacity, count


def shard_documents(docs: DataFrame, shards: int = 16, slot_rows: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of documents."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = staged(docs.select("doc_id", byte_size(F.col("text")).alias("size"), crc.alias("text_crc32"), digest(F.col("text")).alias("key")))
    cuts, _, count = shard_cuts(rows, shards)
    reached = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    cells = max(16, count // (shards * slot_rows))
    rows = rows.withColumn("shard", reached.cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "key"), F.lit(cells)))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = staged(counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before")))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "key"))
    numbered = rows.withColumn("own", own).join(offsets, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
