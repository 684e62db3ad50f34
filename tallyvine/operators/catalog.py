"""The catalog: unique cards, reference images and their cards, counts, audited fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cards import safe_filename
from .checks import require_none, violations

CARD_COLUMNS = ["slug", "name", "category", "color", "region", "grape", "description", "winery", "image_name", "reference_available"]


def card_variants(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: rows, different rows (up to two are told apart by least and greatest), conflict."""
    whole = F.struct(*columns)
    grouped = rows.groupBy(key).agg(F.count(F.lit(1)).alias("source_rows"), F.min(whole).alias("card"), F.max(whole).alias("other"))
    return grouped.withColumn("conflict", ~F.col("card").eqNullSafe(F.col("other"))).drop("other")


def unique_cards(rows: DataFrame, columns: list[str] | None = None, key: str = "slug") -> DataFrame:
    """One row per key; identical rows fall together, different ones are an error."""
    columns = columns or [c for c in CARD_COLUMNS if c != key]
    variants = card_variants(rows, key, columns)
    require_none(variants.where("conflict").select(F.col(key).cast("string").alias("key"), F.lit("rows differ").alias("rule")), "Conflicting cards")
    return variants.select(key, "card.*")


def reference_images(cards: DataFrame) -> DataFrame:
    """filename and the sorted slugs of the available cards that share it."""
    available = cards.where("reference_available")
    return available.groupBy(F.col("image_name").alias("filename")).agg(F.array_sort(F.collect_list("slug")).alias("slugs"))


def excluded_cards(cards: DataFrame) -> DataFrame:
    return cards.where("NOT reference_available").select("slug")


def manifest_counts(cards: DataFrame) -> DataFrame:
    """One row: unique, indexed and excluded cards, reference images, those shared by several cards."""
    images = cards.groupBy("image_name").agg(
        F.count_if("reference_available").alias("indexed"), F.count(F.lit(1)).alias("cards")
    )
    return images.agg(
        F.coalesce(F.sum("cards"), F.lit(0)).alias("unique_cards"),
        F.coalesce(F.sum("indexed"), F.lit(0)).alias("indexed_cards"),
        F.count_if(F.col("indexed") > 0).alias("reference_images"),
        F.count_if(F.col("indexed") > 1).alias("shared_reference_images"),
        F.coalesce(F.sum(F.col("cards") - F.col("indexed")), F.lit(0)).alias("excluded_cards"),
    )


def build_manifest(rows: DataFrame, image_digests: DataFrame) -> dict[str, DataFrame]:
    """cards, images (filename, sha256, slugs), excluded and counts; an available card's image must exist (filename, sha256)."""
    cards = unique_cards(rows)
    images = reference_images(cards).join(image_digests, "filename", "left")
    require_none(images.where("sha256 IS NULL").select(F.col("filename").alias("key"), F.lit("file is missing").alias("rule")), "Missing references")
    return {"cards": cards, "images": images, "excluded": excluded_cards(cards), "counts": manifest_counts(cards)}


def apply_fixes(cards: DataFrame, fixes: DataFrame) -> DataFrame:
    """cards with the image of each fix (slug, from_image, target_image) where its precondition holds."""
    patch = fixes.select("slug", "from_image", "target_image")
    joined = cards.join(patch, "slug", "left")
    hit = (F.col("image_name") == F.col("from_image")) & F.col("reference_available")
    return joined.withColumn("image_name", F.when(hit, F.col("target_image")).otherwise(F.col("image_name"))).select(*cards.columns)


def fix_violations(cards: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes of unknown or repeated slugs, from another image than the card's, or to an unsafe file name."""
    now = cards.select("slug", "image_name", F.col("reference_available").alias("available"))
    times = fixes.groupBy("slug").agg(F.count(F.lit(1)).alias("times"))
    joined = fixes.select("slug", "from_image", "target_image").join(times, "slug").join(now, "slug", "left")
    rules = {
        "unknown card": F.col("image_name").isNotNull(),
        "card is fixed twice": F.col("times") == 1,
        "source image differs": F.col("available") & (F.col("image_name") == F.col("from_image")),
        "target name is unsafe": safe_filename(F.col("target_image")),
    }
    return violations(joined, "slug", rules)


def baseline_violations(fixes: DataFrame, baseline_sha256: str, images: DataFrame, image_digests: DataFrame) -> DataFrame:
    """key, rule: fixes that were reviewed against another baseline, and images of the baseline whose file differs or is missing."""
    other = violations(fixes, "slug", {"baseline differs": F.col("baseline_manifest_sha256") == baseline_sha256})
    now = image_digests.select("filename", F.col("sha256").alias("seen"))
    return other.unionByName(violations(images.join(now, "filename", "left"), "filename", {"baseline image changed": F.col("seen") == F.col("sha256")}))


def corrected_catalog(
    cards: DataFrame, fixes: DataFrame, image_digests: DataFrame, baseline_sha256: str | None = None, baseline_images: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Apply fixes after checking all of them; target digests must match image_digests (filename, sha256).

    With the digest of the baseline manifest and its images, the baseline must be the one that the fixes name, its files unchanged."""
    if baseline_sha256 is not None:
        require_none(baseline_violations(fixes, baseline_sha256, baseline_images, image_digests), "Baseline")
    require_none(fix_violations(cards, fixes), "Fixes")
    targets = fixes.join(image_digests, fixes.target_image == image_digests.filename, "left")
    require_none(violations(targets, "slug", {"target differs": F.col("sha256") == F.col("target_sha256")}), "Fix targets")
    fixed = apply_fixes(cards, fixes)
    return {"cards": fixed, "images": reference_images(fixed).join(image_digests, "filename", "left"), "counts": manifest_counts(fixed)}


def stale_members(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Members (path, size, crc32) that are absent or differ, so must be copied."""
    return wanted.join(present.select("path", "size", "crc32"), ["path", "size", "crc32"], "left_anti")
