"""Files in and out: every schema is fixed, and a file that doesn't keep to it is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cards import safe_filename, stripped
from ..operators.checks import label_violations, prediction_violations, require_none, same_keys, violations
from ..operators.integrity import changed_ranges, depth_for, digest_tree, root
from ..scratch import written
from . import objects
from .publish import data_folder, latest, publish

# Columns of the catalog file and the names they get.
CATALOG_COLUMNS = {
    "slug": "slug", "vine_name": "name", "category": "category", "color": "color", "region": "region", "grape_type": "grape",
    "desc": "description", "winery": "winery", "fname": "image_name", "is_valid_img": "reference_available",
}
LABEL_COLUMNS = ["image_path", "image_sha256", "status", "slug", "evidence"]
PREDICTION_SCHEMA = (
    "image_path string, image_sha256 string, predicted_slug string, top5_slugs array<string>, visual_similarity double, margin_to_second double, "
    "latency_ms long, ocr_used boolean, verifier_used boolean, confidence double, label_status string, verified_slug string"
)
CARD = "slug string, name string, category string, color string, region string, grape string, description string, winery string, image_name string, reference_available boolean"
MANIFEST_SCHEMA = (
    "schema_version int, source_csv_sha256 string, source_rows long, "
    f"cards array<struct<{', '.join(x.replace(' ', ':', 1) for x in CARD.split(', '))}>>, images array<struct<filename:string,sha256:string,slugs:array<string>>>, "
    "excluded_slugs array<string>, counts map<string,long>, source_manifest_sha256 string, reference_fixes_sha256 string"
)
FIXES_SCHEMA = (
    "schema_version int, baseline_manifest_sha256 string, "
    "fixes array<struct<slug:string,from_image:string,target_image:string,target_sha256:string,archive_member:string,evidence:string>>"
)
VISUAL = "struct<sha256:string,candidates:array<struct<rank:int,slug:string,filename:string,name:string,winery:string,score:double>>>"
READ_LINES = "struct<sha256:string,lines:array<struct<text:string,confidence:double>>>"
IMAGE_FILES = "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}"


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    return spark.read.csv(path, header=True, sep=sep, inferSchema=False).columns


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a catalog CSV (UTF-8, quoted newlines), one row per source row; further columns are ignored."""
    names = header(spark, path)
    if missing := sorted(set(CATALOG_COLUMNS) - set(names)):
        raise ValueError(f"Missing catalog columns: {missing}")
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST", nullValue="\0")
    rows = raw.select(*[F.coalesce(stripped(old), F.lit("")).alias(new) for old, new in CATALOG_COLUMNS.items()])
    valid = F.lower("reference_available")
    rules = {"file name is unsafe": safe_filename(F.col("image_name")), "slug is empty": F.col("slug") != "", "not true or false": valid.isin("true", "false")}
    require_none(violations(rows, "slug", rules), "Catalog")
    return rows.withColumn("reference_available", valid == "true")


def read_labels(spark: SparkSession, path: str | None) -> DataFrame:
    """Labels of a TSV with exactly the label columns; without a path there are none."""
    schema = ", ".join(f"{c} string" for c in LABEL_COLUMNS)
    if path is None:
        return spark.createDataFrame([], schema)
    if header(spark, path, "\t") != LABEL_COLUMNS:
        raise ValueError(f"Labels need the columns {LABEL_COLUMNS}")
    labels = spark.read.schema(schema).csv(path, header=True, sep="\t", mode="FAILFAST")
    require_none(label_violations(labels), "Labels")
    return labels


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions, one JSON object a line: the newest version that write_predictions published, or a plain file or folder."""
    rows = spark.read.schema(PREDICTION_SCHEMA).json(data_folder(spark, path), mode="FAILFAST")
    if not rows.take(1):
        raise ValueError("Predictions are empty")
    require_none(prediction_violations(rows), "Predictions")
    return rows


def _versioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    if [r[0] for r in found.select("schema_version").limit(2).collect()] != [1]:
        raise ValueError(f"{path} must hold one object of schema version 1")
    return found


# Fields of the elements of a manifest, of fixes and of their images, with the kinds that a value may have.
CARD_KINDS = {c: ("STRING",) for c in ("slug", "name", "category", "color", "region", "grape", "description", "winery", "image_name")} | {"reference_available": ("BOOLEAN",)}
IMAGE_KINDS = {"filename": ("STRING",), "sha256": ("STRING",), "slugs": ("ARRAY<STRING>",)}
FIX_KINDS = {c: ("STRING",) for c in ("slug", "from_image", "target_image", "target_sha256")}
HEX_FACT = '"{name}": "([0-9a-f]*)"'


def _elements(spark: SparkSession, path: str, mark: str, key: str, kinds: dict[str, tuple[str, ...]], fields: str) -> DataFrame:
    """Typed elements of one array; a field of the wrong kind is an error that names it."""
    found = objects.elements(spark, path, mark)
    require_none(objects.faults(found, key, kinds), path)
    return objects.typed(found, dict(f.strip().split(" ", 1) for f in fields.split(", ")))


def _version_one(spark: SparkSession, path: str) -> None:
    if objects.facts(spark, path, {"version": r'"schema_version": (\d+)'})["version"] != "1":
        raise ValueError(f"{path} must hold objects of schema version 1")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cards, images (filename, sha256, slugs) and excluded (slug) of a manifest. A file with an indent of two is read by many tasks."""
    if objects.in_layout(spark, path):
        _version_one(spark, path)
        cards_ = _elements(spark, path, "name", "slug", CARD_KINDS, CARD)
        images = _elements(spark, path, "filename", "filename", IMAGE_KINDS, "filename string, sha256 string, slugs array<string>")
        return cards_, images, objects.strings(spark, path, "excluded_slugs").withColumnRenamed("value", "slug")
    found = _versioned(spark, path, MANIFEST_SCHEMA)
    return found.select(F.inline("cards")), found.select(F.inline("images")), found.select(F.explode("excluded_slugs").alias("slug"))


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    if objects.in_layout(spark, path):
        _version_one(spark, path)
        base = objects.facts(spark, path, {"base": HEX_FACT.format(name="baseline_manifest_sha256")})["base"]
        fields = "slug string, from_image string, target_image string, target_sha256 string, archive_member string, evidence string"
        return _elements(spark, path, "from_image", "slug", FIX_KINDS, fields).select(F.lit(base).alias("baseline_manifest_sha256"), "*")
    return _versioned(spark, path, FIXES_SCHEMA).select("baseline_manifest_sha256", F.inline("fixes"))


def read_query_manifest(spark: SparkSession, path: str) -> DataFrame:
    """query_id, image_path of a TSV; both must be there, ids must be unique."""
    rows = spark.read.schema("query_id string, image_path string").csv(path, header=True, sep="\t", mode="FAILFAST")
    require_none(violations(rows, "query_id", {"id is missing": F.col("query_id") != "", "path is missing": F.col("image_path") != ""}), "Queries")
    require_none(rows.groupBy(F.col("query_id").alias("key")).count().where("count > 1").select("key", F.lit("id is repeated").alias("rule")), "Queries")
    return rows


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """name, content, length, sha256 of the image files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_FILES).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length", F.sha2("content", 256).alias("sha256"))


def upload_violations(images: DataFrame, most: int) -> DataFrame:
    return violations(images, "name", {"is empty": F.length("content") > 0, "is too large": F.length("content") <= most})


def read_review(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frozen review reports of a folder: visual (name, sha256, candidates in order) and ocr (name, sha256, lines), each one JSON object by name."""

    def by_name(file: str, value: str) -> DataFrame:
        split = objects.entries(spark, f"{path}/{file}")
        if split.take(1):
            return split.select("name", F.variant_get("v", "$", value).alias("v")).select("name", "v.*")
        whole = spark.read.text(f"{path}/{file}", wholetext=True)
        found = whole.select(F.from_json("value", f"map<string,{value}>", {"mode": "FAILFAST"}).alias("m"))
        return found.select(F.explode("m").alias("name", "v")).select("name", "v.*")

    return by_name("visual.json", VISUAL), by_name("ocr.json", READ_LINES)


def write_report(report: DataFrame, path: str) -> None:
    """A summary, score report or review report: JSON lines as a new version below path, seen as a whole or not at all."""
    publish(report.sparkSession, path, lambda folder: report.write.json(folder))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of a report."""
    return spark.read.schema(schema).json(data_folder(spark, path), mode="FAILFAST")


def write_manifest(parts: dict[str, DataFrame], path: str, source_rows: int, source_sha256: str) -> None:
    """The parts as a new version below path: a reader sees the old manifest or the new one."""

    def write(folder: str) -> None:
        for name, part in parts.items():
            part.write.json(f"{folder}/{name}")

    publish(parts["cards"].sparkSession, path, write, schema_version=1, source_rows=source_rows, source_csv_sha256=source_sha256)


def read_manifest_part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    head = latest(spark, path)
    if head is None or head.get("schema_version") != 1:
        raise ValueError(f"{path} holds no manifest of schema version 1")
    return spark.read.schema(schema).json(f"{head['folder']}/{name}", mode="FAILFAST")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions as a new version below path."""
    publish(predictions.sparkSession, path, lambda folder: predictions.write.json(folder))


def row_digests(gallery: DataFrame) -> DataFrame:
    """name, digest (SHA-256) of each row of an index."""
    return gallery.select(F.col("image_name").cast("string").alias("name"), F.sha2(F.to_json(F.struct("image_name", "slugs", "views")), 256).alias("digest"))


def write_index(gallery: DataFrame, path: str, manifest_sha256: str, preprocessing: str) -> None:
    """Gallery (image_name, slugs, views) as Parquet, and its tree of digests, as a new version below path that says of what and how it was made."""
    spark = gallery.sparkSession

    def write(folder: str) -> dict:
        gallery.write.parquet(f"{folder}/gallery")
        rows = spark.read.parquet(f"{folder}/gallery")
        depth = depth_for(rows.count())
        digest_tree(row_digests(rows), depth).write.parquet(f"{folder}/tree")
        return {"depth": depth, "index_sha256": root(spark.read.parquet(f"{folder}/tree"))}

    publish(spark, path, write, schema_version=1, manifest_sha256=manifest_sha256, preprocessing=preprocessing)


def read_index(spark: SparkSession, path: str, manifest_sha256: str, preprocessing: str, images: DataFrame | None = None) -> DataFrame:
    """The gallery, if it was made from this manifest in this way, is unchanged and has just the images (filename, slugs) of the manifest.

    Of a gallery that changed the error names the ranges of names that did (see integrity)."""
    facts = latest(spark, path)
    if facts is None or (facts.get("schema_version"), facts.get("manifest_sha256"), facts.get("preprocessing")) != (1, manifest_sha256, preprocessing):
        raise ValueError("The index is out of date")
    gallery = spark.read.parquet(f"{facts['folder']}/gallery")
    seen = written(digest_tree(row_digests(gallery), facts["depth"]), "index-tree")
    if root(seen) != facts["index_sha256"]:
        ranges = changed_ranges(spark.read.parquet(f"{facts['folder']}/tree"), seen, facts["depth"])
        raise ValueError(f"The index has changed in the ranges {sorted(r[0] for r in ranges.limit(20).collect())}")
    if images is not None:
        key = lambda rows, name: rows.select(F.to_json(F.struct(F.col(name).cast("string").alias("f"), F.array_sort("slugs").alias("s"))).alias("key"))
        require_none(same_keys(key(gallery, "image_name"), key(images, "filename"), "key"), "Index and manifest")
    return gallery
