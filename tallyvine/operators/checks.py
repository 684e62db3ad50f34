"""Constraints as tables of violations: empty if all rows are in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["verified", "unknown", "ambiguous"]


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for each rule that a row breaks (a null test counts as broken)."""
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()])
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(broken)).alias("rule"))


def repeated(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("key")).count().where("count > 1").select("key", F.lit(rule).alias("rule"))


def require_none(found: DataFrame, what: str) -> None:
    """Raise ValueError if there is a violation; names up to three."""
    some = found.limit(3).collect()
    if some:
        raise ValueError(f"{what}: " + ", ".join(f"{r.key} ({r.rule})" for r in some))


def label_violations(labels: DataFrame) -> DataFrame:
    """Labels: image_path, image_sha256, status, slug, evidence."""
    named = F.coalesce(F.col("slug"), F.lit("")) != ""
    rules = {
        "name is empty": F.col("image_path") != "",
        "digest is not 64 hex digits": F.col("image_sha256").rlike("^[0-9a-f]{64}$"),
        "status is unknown": F.col("status").isin(STATUSES),
        "slug does not go with the status": named == (F.col("status") == "verified"),
        "evidence is missing": F.col("evidence") != "",
    }
    return violations(labels, "image_path", rules).unionByName(repeated(labels, "image_path", "name is repeated"))


def prediction_violations(predictions: DataFrame) -> DataFrame:
    """Predictions: image_path, predicted_slug, top5_slugs."""
    top = F.col("top5_slugs")
    rules = {
        "slug is empty": F.col("predicted_slug") != "",
        "top five has not one to five slugs": F.size(top).between(1, 5),
        "top five has an empty slug": F.forall(top, lambda x: x.isNotNull() & (x != "")),
        "first of the top five differs": F.get(top, F.lit(0)) == F.col("predicted_slug"),
    }
    return violations(predictions, "image_path", rules).unionByName(repeated(predictions, "image_path", "name is repeated"))


def missing_keys(wanted: DataFrame, have: DataFrame, key: str, other: str, rule: str) -> DataFrame:
    """key, rule for the keys of wanted that have lacks."""
    lacking = wanted.join(have.select(F.col(other).alias("_have")).distinct(), F.col(key) == F.col("_have"), "left_anti")
    return lacking.select(F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"))


def label_coverage(labels: DataFrame, photos: DataFrame, cards: DataFrame) -> DataFrame:
    """Labels without a photo, with another digest than the photo's, or with a slug that no card has."""
    checks = [
        missing_keys(labels, photos, "image_path", "name", "no such photo"),
        missing_keys(labels.where("status = 'verified'"), cards, "slug", "slug", "no such card"),
        labels.join(photos, labels.image_path == photos.name).where("image_sha256 <> sha256")
        .select(F.col("image_path").cast("string").alias("key"), F.lit("photo changed").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, checks)


def full_coverage(labels: DataFrame, photos: DataFrame, cards: DataFrame, expected: int) -> DataFrame:
    """label_coverage, photos without a label, and the number of labels if it isn't the expected one."""
    count = labels.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    wrong = count.select(F.col("n").cast("string").alias("key"), F.lit("number of labels").alias("rule"))
    return label_coverage(labels, photos, cards).unionByName(missing_keys(photos, labels, "name", "image_path", "no label")).unionByName(wrong)


def ranking_violations(ranked: DataFrame, cards: DataFrame, width: int) -> DataFrame:
    """Rankings (name, rank, slug, filename): each of width rows, ranks from 1 in order, filenames those of the cards."""
    per_name = ranked.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high")
    )
    shape = violations(per_name, "name", {"has another length": F.col("n") == width, "ranks have gaps": (F.col("ranks") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n"))})
    known = cards.select("slug", F.col("image_name").alias("expected"))
    return shape.unionByName(violations(ranked.join(known, "slug", "left"), "name", {"file differs from the card's": F.col("filename") == F.col("expected")}))


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(F.col(key).cast("string").alias("key")).distinct(), right.select(F.col(key).cast("string").alias("key")).distinct()
    return a.join(b, "key", "left_anti").withColumn("rule", F.lit("only left")).unionByName(b.join(a, "key", "left_anti").withColumn("rule", F.lit("only right")))
