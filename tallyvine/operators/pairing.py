"""Food pairing: a small table of rules joined on a card's style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wordlists as fixed
from ..functions.cards import first_match, pairing_style, text


def known_dish(dish: str) -> str:
    if dish not in fixed.DISHES:
        raise ValueError(f"Unknown dish: {dish}")
    return dish


def rules(spark: SparkSession) -> DataFrame:
    """style, place, dish, reason: 21 rows, so they are always broadcast."""
    return F.broadcast(spark.createDataFrame(fixed.PAIRINGS, "style string, place int, dish string, reason string"))


def _with_evidence(reason, dish):
    """Adds what the description says of acidity or tannins."""
    said = F.lower(text("description"))
    acid = dish.isin("fish", "seafood") & F.contains(said, F.lit(fixed.ACIDITY_STEM))
    tannin = (dish == "red_meat") & F.contains(said, F.lit(fixed.TANNIN_STEM))
    return F.concat(reason, F.when(acid, fixed.ACIDITY_REASON).otherwise(""), F.when(tannin, fixed.TANNIN_REASON).otherwise(""))


def _dish_label(dish):
    return first_match([(dish == k, v) for k, v in fixed.DISHES.items()], dish)


def suggestions(cards: DataFrame) -> DataFrame:
    """slug, style, place, dish, label, reason: three dishes for each card."""
    styled = cards.withColumn("style", pairing_style()).join(rules(cards.sparkSession), "style")
    return styled.select("slug", "style", "place", "dish", _dish_label(F.col("dish")).alias("label"), _with_evidence(F.col("reason"), F.col("dish")).alias("reason"))


def dish_fit(cards: DataFrame, dish: str) -> DataFrame:
    """cards with style, place (null: not suggested), fit and reason for one dish."""
    known_dish(dish)
    chosen = rules(cards.sparkSession).where(F.col("dish") == dish).select(F.col("style").alias("_style"), "place", F.col("reason").alias("_reason"))
    joined = cards.withColumn("style", pairing_style()).join(F.broadcast(chosen), F.col("style") == F.col("_style"), "left")
    better = first_match([(F.col("style") == s, fixed.DISHES[d].lower()) for s, p, d, _ in fixed.PAIRINGS if p == 1], F.lit(""))
    reason = _with_evidence(F.coalesce("_reason", F.lit(fixed.UNSURE_REASON)), F.lit(dish))
    full = F.when(F.col("place").isNull(), F.concat(reason, F.lit(fixed.BETTER_DISH), better, F.lit("."))).otherwise(reason)
    fit = F.when(F.col("place") <= 2, fixed.FITS[0]).when(F.col("place") == 3, fixed.FITS[1]).otherwise(fixed.FITS[2])
    return joined.withColumn("fit", fit).withColumn("reason", full).drop("_style", "_reason")
