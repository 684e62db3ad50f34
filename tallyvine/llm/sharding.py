"""Sharding by longest-processing-time scheduling (operator 10).

Groups of equal texts stay together. Sorted by size, they go to the least-loaded shard through a heap. Groups of
one size are interchangeable, so the driver schedules runs: it sees one row for each distinct size, and the heap
says how many groups of that size each shard takes. k distinct sizes need at least k * k / 2 bytes, so there are
at most sqrt(2 * bytes) of them, at any input: 245,000 for 30 GB even if no two documents were alike in size.
Which groups of a size go where follows from their number within the size. Every group is scheduled by itself, whatever its size.

Defined results: a null text has size 1; rows with a null id take part; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import read_table, utf8_sha256, whole_text, written

SHARDS = 16
#: Rows to number in one task, and numbering buckets per shard at least.
SLOT_ROWS, SLOT_BUCKETS = 65536, 64


def longest_first(runs: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int]]]:
    """(size, groups of that size for each shard) of runs (size, number of groups), largest size first.

    The same counts as giving the groups one by one to the least-loaded shard (ties by shard). While all loads are within
    one size of each other, each round of the heap gives every shard one group, so whole rounds are dealt at once."""
    heap = [(0, s) for s in range(shards)]
    for size, n in sorted(runs, reverse=True):
        taken = [0] * shards
        while n:
            if n >= shards and max(heap)[0] - heap[0][0] <= size:
                rounds, n = divmod(n, shards)
                heap = [(load + rounds * size, s) for load, s in heap]
                taken = [t + rounds for t in taken]
                continue
            load, s = heap[0]
            # alone at the bottom, a shard takes groups until it is level with the next one
            many = min(n, max(1, (min(heap[1:], default=(load + n * size, 0))[0] - load) // size))
            heapq.heapreplace(heap, (load + many * size, s))
            taken[s] += many
            n -= many
        yield size, taken


def numbered(rows: DataFrame, by: str, buckets: int, order: list[str]) -> DataFrame:
    """rows with their number (from 0) within a value of by, in the order of a hash bucket and of the columns of order; no task holds all rows of a value."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select(by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy(by, "bucket").orderBy(*order)
    placed = dealt.withColumn("at", F.row_number().over(within) - 1).join(offsets, [by, "bucket"])
    return placed.withColumn("number", (F.col("offset") + F.col("at")).cast("long")).drop("bucket", "at", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = whole_text()
    slim = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(utf8_sha256(text)).alias("digest"),
        ),
        "shard-sizes",
    )
    groups = written(slim.groupBy("digest").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("n")), "shard-groups")
    runs = groups.groupBy("load").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).toPandas()  # at most sqrt(2 * bytes) rows
    dealt = list(longest_first(zip(runs.load.tolist(), runs.groups.tolist(), strict=True), shards))
    schedule = spark.createDataFrame(
        pd.DataFrame({"load": [load for load, _ in dealt], "ends": [list(accumulate(taken)) for _, taken in dealt]}), "load long, ends array<long>"
    )
    buckets = max(1, -(-int(runs.groups.sum()) // SLOT_ROWS))
    homes = numbered(groups.select("digest", "load"), "load", buckets, ["digest"]).join(schedule, "load")
    number = F.col("number")
    homes = homes.select("digest", F.size(F.filter("ends", lambda end: end <= number)).alias("shard"))
    rows = int(runs.rows.sum())
    buckets = max(SLOT_BUCKETS, -(-rows // (shards * SLOT_ROWS)))
    placed = numbered(slim.join(homes, "digest"), "shard", buckets, ["doc_id", "digest"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("number").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
