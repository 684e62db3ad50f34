"""Review of rankings: the report on candidates, the bundle of labels and reports that belong together, details, media."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import missing_keys, require_none, same_keys, violations

REPORT_COLUMNS = ["name", "winery", "category", "grape"]
DETAIL_COLUMNS = ["name", "winery", "category", "color", "region", "grape", "description"]
REPORT_WIDTH, BUNDLE_PHOTOS = 20, 100


def changed_references(images: DataFrame, present: DataFrame) -> DataFrame:
    """key, rule for the images (filename, sha256) that present (filename, sha256) lacks or has with other bytes."""
    now = present.select("filename", F.col("sha256").alias("seen"))
    return violations(images.join(now, "filename", "left"), "filename", {"reference changed": F.col("seen") == F.col("sha256")})


def review_report(ranked: DataFrame, cards: DataFrame, images: DataFrame, top_k: int = REPORT_WIDTH) -> DataFrame:
    """query_id, rank, slug, the card's name, winery, category and grape, score, reference_file, reference_sha256 of the best top_k.

    ranked: query_id, rank, slug, score, image_name; every slug must have a card and every file an image."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    best = ranked.where(F.col("rank") <= top_k).withColumnRenamed("image_name", "reference_file")
    digests = images.select(F.col("filename").alias("reference_file"), F.col("sha256").alias("reference_sha256"))
    return best.join(cards.select("slug", *REPORT_COLUMNS), "slug").join(digests, "reference_file").select(
        "query_id", "rank", "slug", *REPORT_COLUMNS, "score", "reference_file", "reference_sha256"
    )


def bundle_violations(
    labels: DataFrame, photos: DataFrame, visual: DataFrame, ocr: DataFrame, cards: DataFrame, images: DataFrame,
    expected: int = BUNDLE_PHOTOS, width: int = REPORT_WIDTH,
) -> DataFrame:
    """key, rule wherever labels, photos (name, sha256), visual (name, sha256, candidates: rank, slug, filename, in order) and ocr (name, sha256)
    don't belong together: other names, other bytes, slugs without a card, rankings of another width or order, files that aren't the card's or have no image."""
    named = labels.select(F.col("image_path").alias("name"), F.col("image_sha256").alias("labelled"), "slug", "status")
    count = named.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    found = [count.select(F.col("n").cast("string").alias("key"), F.lit("number of labels").alias("rule"))]
    for what, side in (("photo", photos), ("visual report", visual), ("reading", ocr)):
        differs = same_keys(named, side, "name").withColumn("rule", F.concat(F.lit(f"{what}: "), "rule"))
        both = named.join(side.select("name", "sha256"), "name")
        found += [differs, violations(both, "name", {f"{what}: other bytes": F.col("sha256") == F.col("labelled")})]
    found.append(missing_keys(named.where("slug IS NOT NULL AND slug <> ''"), cards, "slug", "slug", "no such card"))
    found.append(violations(visual, "name", {"number of candidates": F.size("candidates") == width}))
    each = visual.select("name", F.posexplode("candidates").alias("at", "c")).select("name", "at", "c.rank", "c.slug", "c.filename")
    known = cards.select("slug", F.col("image_name").alias("expected"), F.lit(True).alias("has_card"))
    files = images.select("filename", F.lit(True).alias("has_image")).distinct()
    rules = {
        "rank or slug of a candidate": (F.col("rank") == F.col("at") + 1) & F.col("has_card"),
        "file differs from the card's": ~F.coalesce("has_card", F.lit(False)) | (F.col("filename") == F.col("expected")),
        "file has no image": F.col("has_image"),
    }
    found.append(violations(each.join(known, "slug", "left").join(files, "filename", "left"), "name", rules))
    return reduce(DataFrame.unionByName, found)


def photo_bundle(labels: DataFrame, visual: DataFrame, ocr: DataFrame) -> DataFrame:
    """One row a photo: its label with the visual report's candidates and the lines that were read."""
    sides = visual.select(F.col("name").alias("image_path"), "candidates"), ocr.select(F.col("name").alias("image_path"), "lines")
    return labels.join(sides[0], "image_path").join(sides[1], "image_path").withColumnRenamed("image_path", "name")


def allowed_references(visual: DataFrame, labels: DataFrame, cards: DataFrame, images: DataFrame) -> DataFrame:
    """filename of every reference that may be shown: of candidates, and of verified cards, if there is an image."""
    shown = visual.select(F.explode("candidates").alias("c")).select("c.filename")
    verified = labels.join(cards, "slug").select(F.col("image_name").alias("filename"))
    return shown.union(verified).distinct().join(images.select("filename"), "filename", "left_semi")


def allowed_media(asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of asked (filename, ...) that are on the list."""
    return asked.join(allowed.select("filename"), "filename", "left_semi")


def review_detail(rows: DataFrame, cards: DataFrame, images: DataFrame) -> DataFrame:
    """review_rows (see evaluation) with the candidate's card and digest, and the verified card where there is one.

    name, rank, slug, score, gap_to_first, card (struct), reference_sha256, verified_card (struct or null)."""
    digests = images.select(F.col("filename").alias("image_name"), F.col("sha256").alias("reference_sha256"))
    card = cards.join(digests, "image_name", "left").select("slug", F.struct(*DETAIL_COLUMNS).alias("card"), "reference_sha256")
    verified = cards.select(F.col("slug").alias("verified_slug"), F.struct("slug", *DETAIL_COLUMNS, "image_name").alias("verified_card"))
    joined = rows.select("name", "rank", "slug", "score", "gap_to_first", "verified_slug").join(card, "slug").join(verified, "verified_slug", "left")
    return joined.select("name", "rank", "slug", "score", "gap_to_first", "card", "reference_sha256", "verified_card")


def reference_differences(images: DataFrame, wanted: DataFrame, present: DataFrame) -> DataFrame:
    """key, rule: why the manifest's images (filename, sha256) don't match the wanted names (filename) and the files there (filename, sha256).

    Empty if a catalog needs no preparation."""
    return same_keys(images, wanted, "filename").unionByName(changed_references(images, present))


def verify_prepared(images: DataFrame, wanted: DataFrame, present: DataFrame) -> None:
    """Raise ValueError unless everything is prepared; changes nothing."""
    require_none(reference_differences(images, wanted, present), "References")


def card_by_slug(cards: DataFrame, slug: str) -> DataFrame:
    """The card, a single row; an unknown slug raises KeyError."""
    found = cards.where(F.col("slug") == slug)
    if not found.take(1):
        raise KeyError(slug)
    return found


def health(cards: DataFrame) -> DataFrame:
    """status and the number of cards."""
    return cards.agg(F.count(F.lit(1)).alias("cards")).select(F.lit("ready").alias("status"), "cards")
