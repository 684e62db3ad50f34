"""Late fusion of a ranking (query_id, rank, slug, score, image_name) with other evidence, and confidence in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import wordlists as fixed

DIGITS = 9


def log_softmax(ranked: DataFrame, logit: str = "logit", width: int = fixed.VERIFIED_WIDTH) -> DataFrame:
    """Adds log_p over the first width candidates of each query; null beyond."""
    head = F.when(F.col("rank") <= width, F.col(logit))
    each = Window.partitionBy("query_id")
    top = F.max(head).over(each)
    with_top = ranked.withColumn("_x", head - top)
    return with_top.withColumn("log_p", F.col("_x") - F.ln(F.sum(F.exp("_x")).over(each))).drop("_x")


def fuse_verifier(ranked: DataFrame, width: int = fixed.VERIFIED_WIDTH, weight: float = fixed.VERIFIER_WEIGHT) -> DataFrame:
    """Reorders the first width candidates by score + weight * log_p; the rest keep their order. Adds fused and new_rank.

    With fewer than two candidates the score stands as it is."""
    each = Window.partitionBy("query_id")
    alone = F.count(F.lit(1)).over(each) < 2
    fused = F.when(F.col("rank") <= width, F.when(alone, F.col("score")).otherwise(F.col("score") + weight * F.col("log_p")))
    out = ranked.withColumn("fused", fused)
    order = each.orderBy((F.col("rank") > width).cast("int"), F.desc(F.round("fused", DIGITS)), "rank")
    return out.withColumn("new_rank", F.row_number().over(order))


def fuse_lexical(ranked: DataFrame, lexical: DataFrame, weight: float = fixed.LEXICAL_WEIGHT, margin: float = fixed.UNCLEAR_MARGIN) -> DataFrame:
    """Reorders all candidates by score + weight * lexical score where the first two are closer than margin. Adds fused, used and new_rank.

    lexical: query_id, slug, lexical."""
    each = Window.partitionBy("query_id")
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(each)
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(each)
    used = F.coalesce(F.round(first - second, DIGITS) < margin, F.lit(False))
    joined = ranked.withColumn("used", used).join(lexical, ["query_id", "slug"], "left")
    fused = F.col("score") + F.when(F.col("used"), weight * F.coalesce("lexical", F.lit(0.0))).otherwise(0.0)
    out = joined.withColumn("fused", fused)
    order = each.orderBy(F.desc(F.when(F.col("used"), F.round("fused", DIGITS))), "rank")
    return out.withColumn("new_rank", F.row_number().over(order))


def confidence(fused: DataFrame, width: int = fixed.VERIFIED_WIDTH, temperature: float = fixed.TEMPERATURE) -> DataFrame:
    """Adds probability: the share of each of the first width candidates (by new_rank); null beyond."""
    each = Window.partitionBy("query_id")
    head = F.when(F.col("new_rank") <= width, F.col("fused"))
    rated = fused.withColumn("_e", F.exp((head - F.max(head).over(each)) / temperature))
    return rated.withColumn("probability", F.col("_e") / F.sum("_e").over(each)).drop("_e")


def answers(rated: DataFrame, kept: int = fixed.KEPT_WIDTH, shown: int = fixed.SHOWN_WIDTH, sure: float = fixed.CONFIDENT) -> DataFrame:
    """One row per query: slug, confidence, verdict, margin_to_second, visual_similarity, shared_reference, top5, alternatives."""
    rows = rated.where(F.col("new_rank") <= kept)

    def at(rank: int, column: str):
        return F.max(F.when(F.col("new_rank") == rank, F.col(column)))

    entry = F.struct("new_rank", "slug", "probability", F.col("fused").alias("score"))
    listed = F.array_sort(F.collect_list(F.when((F.col("new_rank") <= shown) & F.col("probability").isNotNull(), entry)))
    other = F.struct("new_rank", "slug", "score", "image_name")
    return rows.groupBy("query_id").agg(
        at(1, "slug").alias("slug"), at(1, "probability").alias("confidence"),
        F.when(at(1, "probability") >= sure, "confident").otherwise("check_alternatives").alias("verdict"),
        (at(1, "fused") - at(2, "fused")).alias("margin_to_second"), at(1, "score").alias("visual_similarity"),
        F.coalesce(at(1, "image_name") == at(2, "image_name"), F.lit(False)).alias("shared_reference"),
        F.transform(listed, lambda x: x.dropFields("new_rank")).alias("top5"),
        F.array_sort(F.collect_list(F.when(F.col("new_rank") > 1, other))).alias("alternatives"),
    )
