"""Mixing sources to target weights by capped water-filling (operator 8).

The weights share a budget of words. A source whose share exceeds its cap (maximum epochs times
its size) is clamped there and the excess goes to the others by weight, until no share is above
its cap. Each source is then taken in whole repetitions and one seeded fractional repetition:
documents in the order of a seeded hash of their id up to the words still needed, found by
counting through two levels of hash buckets, plus the document that fills the last gap best.
The decision on a row needs only its hash and one row of parameters for its source.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
rows that share an id share their fate; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DOCUMENT_COLUMNS, partitions, read_table, whole_text, written

WEIGHTS = (3, 1, 2)
EPOCHS = 2
SHARE_PERCENT = 150
SEED = 20
#: Bits of the hash that each of the two counting levels takes.
LEVEL_BITS = 12
WIDE = "decimal(38,0)"


def words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def position(doc_id: str = "doc_id") -> Column:
    """Place of a document in its source's seeded order: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(doc_id)), 1)


def _level(n: int) -> Column:
    return F.shiftright(F.col("place"), 63 - n * LEVEL_BITS).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def weighted_sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, source_size, weight: weights repeat over the sources by code point, null last.

    The order is dealt out by ranges, so no task sees all sources."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = partitions(sized.sparkSession)
    dealt = written(
        sources.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    ranked = dealt.withColumn("at", F.row_number().over(within) - 1).join(offsets, "part")
    return written(
        ranked.select(
            "source", "source_size",
            F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("offset") + F.col("at"), F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        ),
        "mix-weights",
    )


def water_fill(sources: DataFrame, share_percent: int, epochs: int) -> DataFrame:
    """Adds target (double), whole repetitions and the words left for the fractional one.

    Each round is one aggregate over the sources; the arithmetic is exact until the last division."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget = share_percent * total  # in hundredths of words
    cap, weight = F.col("source_size").cast(WIDE) * epochs, F.col("weight").cast(WIDE)
    left, over, clamped = budget, sources.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0], 0
    while over:
        above = weight * F.lit(left).cast(WIDE) > cap * F.lit(100 * over).cast(WIDE)
        n, capped, open_weight = sources.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if n == clamped or not open_weight:
            break
        left, over, clamped = budget - 100 * int(capped), open_weight, n
    over = over or 1
    above = weight * F.lit(left).cast(WIDE) > cap * F.lit(100 * over).cast(WIDE)
    target = F.when(above, cap.cast("double")).otherwise((weight * F.lit(left).cast(WIDE)).cast("double") / F.lit(100.0 * over))
    shared = sources.withColumn("target", target)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    need = F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    counted = shared.withColumn("whole", F.least(whole, F.lit(epochs)).cast("long")).withColumn("need", need)
    full = (F.col("need") >= F.col("source_size")) & (F.col("whole") < epochs)  # a fraction that rounds up to all
    return counted.withColumn("whole", F.col("whole") + full.cast("long")).withColumn("need", F.when(full, 0).otherwise(F.col("need")))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, source_size, target, whole, cut, pick.

    A row of the source is repeated whole times, and once more if its place is below cut or equals pick."""
    sources = written(water_fill(weighted_sources(sized, weights), share_percent, epochs), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("s"))
    known = sources.select(F.col("source").alias("s"), "need")
    bounded = known
    rows = sized
    for level in (1, 2):
        cells = rows.withColumn("cell", _level(level)).groupBy("source", "cell").agg(F.sum("size").alias("size"))
        order = Window.partitionBy("source").orderBy("cell")
        upto = cells.withColumn("upto", F.sum("size").over(order)).join(bounded, same).where(F.col("upto") > F.col("need"))
        first = upto.groupBy("source").agg(F.min_by(F.struct("cell", (F.col("need") - F.col("upto") + F.col("size")).alias("need")), "cell").alias("edge"))
        bounded = written(first.select(F.col("source").alias("s"), F.col("edge.cell").alias("edge"), F.col("edge.need").alias("need")), f"mix-edge-{level}")
        rows = rows.join(bounded.select("s", "edge"), same & (_level(level) == F.col("edge"))).drop("s", "edge")
    places = rows.groupBy("source", "place").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("place")
    upto = places.withColumn("upto", F.sum("size").over(order)).join(bounded.select("s", "need"), same).where(F.col("upto") > F.col("need"))
    gaps = written(
        upto.groupBy("source").agg(F.min_by(F.struct("place", (F.col("need") - F.col("upto") + F.col("size")).alias("gap")), "place").alias("x"))
        .select(F.col("source").alias("s"), F.col("x.place").alias("cut"), F.col("x.gap").alias("gap")),
        "mix-cuts",
    )
    spare = sized.join(gaps, same).where(F.col("place") >= F.col("cut")).withColumn("miss", F.abs(F.col("size") - F.col("gap")))
    picks = (
        spare.groupBy("source").agg(F.min(F.struct("miss", "place", "gap")).alias("x"))
        .where(F.col("x.miss") < F.col("x.gap")).select(F.col("source").alias("p"), F.col("x.place").alias("pick"))
    )
    return written(
        sources.join(gaps, same, "left").drop("s").join(picks, F.col("source").eqNullSafe(F.col("p")), "left")
        .select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut"), "pick"),
        "mix-plan",
    )


def repetitions(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with source_size, target and times; plan is joined on the source (Spark broadcasts it if small)."""
    plan = plan.withColumnRenamed("source", "mix_source")
    extra = (F.col("mix_place") < F.col("cut")) | F.coalesce(F.col("mix_place") == F.col("pick"), F.lit(False))
    return (
        docs.withColumn("mix_place", position()).join(plan, F.col("source").eqNullSafe(F.col("mix_source")))
        .withColumn("times", (F.col("whole") + extra.cast("long")))
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words().alias("size"), position().alias("place")), "mix-sizes")


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of documents; others are left out, whatever their names."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    taken = repetitions(docs, mix_plan(sized_documents(docs))).where("times > 0")
    return taken.select(*DOCUMENT_COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(read_table(spark, sf_dir, "documents"))
    counted = repetitions(sized, mix_plan(sized))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
