"""Boxes and sizes of the parts of an image that are encoded; the pixels themselves are an encoder's matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as fixed


def boxes(images: DataFrame, parts: list[tuple[float, float, float, float]]) -> DataFrame:
    """Images (name, width, height) by part: view_no, left, top, right, bottom in pixels, rounded half to even."""
    fractions = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("ltrb", p, strict=True)]) for p in parts])

    def pixel(fraction: str, size: str) -> Column:
        return F.bround(F.col(f"p.{fraction}") * F.col(size)).cast("int")

    each = images.select("name", "width", "height", F.posexplode(fractions).alias("view_no", "p"))
    return each.select(
        "name", "view_no", pixel("l", "width").alias("left"), pixel("t", "height").alias("top"), pixel("r", "width").alias("right"), pixel("b", "height").alias("bottom")
    )


def trimmed(images: DataFrame) -> DataFrame:
    """Images with the box (left, top, right, bottom) of what isn't white, kept whole if there is none or it is too small."""
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    use = F.coalesce(area >= fixed.REFERENCE_TRIM_SHARE * F.col("width") * F.col("height"), F.lit(False))
    return images.select("name", F.when(use, F.col("right") - F.col("left")).otherwise(F.col("width")).alias("width"), F.when(use, F.col("bottom") - F.col("top")).otherwise(F.col("height")).alias("height"))


def padded(parts: DataFrame, side: int = fixed.VIEW_SIDE) -> DataFrame:
    """Size of each part inside a square of the given side, its longer side filling it."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    scale = side / F.greatest(w, h)
    return parts.withColumn("inner_width", F.bround(w * scale).cast("int")).withColumn("inner_height", F.bround(h * scale).cast("int"))
