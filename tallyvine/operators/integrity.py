"""Digests of named rows as a tree over ranges of names: what changed is found without reading what didn't.

A name's range is the beginning of its SHA-256 in hexadecimal digits, so ranges are even whatever the names are. A leaf is the digest of its
rows' names and digests in order, a node that of its children; the root, whose range is empty, stands for all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, about; children of a node.
LEAF, FAN = 256, 16


def depth_for(rows: int) -> int:
    """Digits of a leaf's range."""
    return max(1, math.ceil(math.log(max(1, rows / LEAF), FAN)))


def name_range(name: Column, depth: int) -> Column:
    return F.substr(F.sha2(name.cast("string"), 256), F.lit(1), F.lit(depth))


def digest_tree(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """range, digest, rows of every node, from rows (name, digest); the depth follows from the number of rows unless it is given."""
    depth = depth or depth_for(rows.count())
    each = F.struct(F.col("name").cast("string").alias("name"), F.col("digest"))
    listed = F.transform(F.array_sort(F.collect_list(each)), lambda x: F.concat_ws("\0", x["name"], x["digest"]))
    level = rows.groupBy(name_range(F.col("name"), depth).alias("range")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("rows"))
    levels = [level]
    for _ in range(depth):
        children = F.transform(F.array_sort(F.collect_list(F.struct("range", "digest"))), lambda x: F.concat(x["range"], F.lit(":"), x["digest"]))
        up = F.substr("range", F.lit(1), F.length("range") - 1).alias("range")
        level = level.groupBy(up).agg(F.sha2(F.array_join(children, "\n"), 256).alias("digest"), F.sum("rows").alias("rows"))
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def root(tree: DataFrame) -> str:
    """The digest of all rows; that of no rows is of an empty text."""
    found = tree.where("range = ''").select("digest").first()
    return found[0] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def changed_ranges(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """range of the leaves that differ between two trees of a depth: level by level, only below nodes that differ."""

    def at(tree: DataFrame, level: int, side: str) -> DataFrame:
        return tree.where(F.length("range") == level).select("range", F.col("digest").alias(side))

    open_ranges = None
    for level in range(depth + 1):
        both = [at(t, level, s) for t, s in ((old, "old"), (new, "new"))]
        if open_ranges is not None:
            both = [b.join(open_ranges, F.substr("range", F.lit(1), F.lit(level - 1)) == F.col("above"), "left_semi") for b in both]
        differ = both[0].join(both[1], "range", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("range")
        open_ranges = differ.withColumnRenamed("range", "above")
    return open_ranges.withColumnRenamed("above", "range")


def changed_rows(old: DataFrame, new: DataFrame, ranges: DataFrame, depth: int) -> DataFrame:
    """name, change (added, removed, differs) of the rows of these ranges; rows of others are left where they are."""
    both = [r.join(ranges, name_range(F.col("name"), depth) == F.col("range"), "left_semi").select("name", F.col("digest").alias(s)) for r, s in ((old, "old"), (new, "new"))]
    found = both[0].join(both[1], "name", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("differs")
    return found.select("name", change.alias("change"))
