"""Scores of predictions against labels, latency and class statistics, and views for reviewers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import written
from .checks import label_violations, missing_keys, prediction_violations, require_none, violations

BINS = [0.0, 0.7, 0.9]
#: Size of the sketch that brackets a percentile, how far to each side of it a bracket goes, and most values of a bracket.
SKETCH, MARGIN, IN_BRACKET = 1024, 0.01, 1_000_000
#: Steps of rank at which a sketch is asked for narrower brackets.
GRID = 200


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def judged(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with their prediction, top1_correct and top5_correct (null unless verified)."""
    joined = labels.join(predictions.drop("image_sha256"), "image_path")
    verified = F.col("status") == "verified"
    return joined.withColumn("top1_correct", F.when(verified, F.col("predicted_slug") == F.col("slug"))).withColumn(
        "top5_correct", F.when(verified, F.array_contains("top5_slugs", F.col("slug")))
    )


def accuracy(rows: DataFrame) -> DataFrame:
    """One row over judged rows."""
    verified = F.count_if(F.col("status") == "verified")
    one, five = F.count_if(F.col("top1_correct")), F.count_if(F.col("top5_correct"))
    return rows.agg(
        F.count(F.lit(1)).alias("labels"), verified.alias("verified_labels"), F.count_if(F.col("status") == "unknown").alias("unknown_labels"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous_labels"), one.alias("top1_correct"), five.alias("top5_correct"),
        share(one, verified).alias("top1_accuracy"), share(five, verified).alias("top5_accuracy"),
    )


def errors(rows: DataFrame) -> DataFrame:
    return rows.where("NOT top1_correct").select("image_path", F.col("slug").alias("verified_slug"), "predicted_slug")


def score(predictions: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accuracy and errors after all checks: shapes, coverage of the labels, unchanged photos."""
    digests = labels.select("image_path", "image_sha256").join(predictions.select("image_path", F.col("image_sha256").alias("seen")), "image_path")
    checks = [  # one pass over all
        label_violations(labels), prediction_violations(predictions), missing_keys(labels, predictions, "image_path", "image_path", "no prediction"),
        violations(digests, "image_path", {"photo differs": F.col("seen") == F.col("image_sha256")}),
    ]
    require_none(reduce(DataFrame.unionByName, checks), "Predictions and labels")
    rows = judged(predictions, labels)
    return accuracy(rows), errors(rows)


def same(by: list[str]) -> Column:
    """Equal groups of the sides l and r, nulls included."""
    return reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by])


def brackets(values: DataFrame, by: list[str], named: list[tuple[str, float]], margin: float, known: DataFrame | None = None) -> DataFrame:
    """For each group and percentile low and high values that should enclose it, by a KLL sketch of all values, or of those within known brackets."""

    if known is None:
        sketched = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.kll_sketch_agg_double("_v", SKETCH).alias("_s"))
        ends = [F.kll_sketch_get_quantile_double("_s", F.lit(min(1.0, max(0.0, p + d * margin)))).alias(f"_{s}_{n}") for n, p in named for s, d in (("low", -1), ("high", 1))]
        return sketched.select(*by, "_all", *ends)
    sides = [f"_{s}_{n}" for n, _ in named for s in ("low", "high")]
    met = values.alias("l").join(known.alias("r"), same(by)).select(*[F.col(f"l.{c}").alias(c) for c in by], "_v", "_all", *sides)
    within = {n: F.col("_v").between(F.col(f"_low_{n}"), F.col(f"_high_{n}")) for n, _ in named}
    sketched = met.groupBy(*by, "_all", *sides).agg(
        *[F.kll_sketch_agg_double(F.when(within[n], F.col("_v")), SKETCH).alias(f"_s_{n}") for n, _ in named],
        *[F.count_if(F.col("_v") < F.col(f"_low_{n}")).alias(f"_below_{n}") for n, _ in named], *[F.count_if(within[n]).alias(f"_within_{n}") for n, _ in named],
    )
    grid, ends = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), []  # a sketch is asked at fixed ranks
    for n, p in named:
        rank = (F.lit(p) * (F.col("_all") - 1) - F.col(f"_below_{n}")) / F.greatest(F.col(f"_within_{n}"), F.lit(1))
        values_at = F.kll_sketch_get_quantile_double(f"_s_{n}", grid)
        for s, at in (("low", F.floor((rank - margin) * GRID)), ("high", F.ceil((rank + margin) * GRID))):
            end = F.element_at(values_at, F.least(F.greatest(at, F.lit(0)), F.lit(GRID)).cast("int") + 1)
            ends.append(F.when(F.col(f"_within_{n}") > 0, end).otherwise(F.col(f"_{s}_{n}")).alias(f"_{s}_{n}"))
    return sketched.select(*by, "_all", *ends)


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each share: exact percentiles, linear between neighbours; groups without values are left out.

    A sketch of each group brackets every percentile in one pass (brackets that would hold more than IN_BRACKET values are
    narrowed by further sketches). One exact pass then counts the values within the brackets one by one and all others by the gap they lie in,
    so places are known without sorting a group. A bracket that turns out to miss its place is taken wider, up to all values."""
    if not by:
        return exact_percentiles(rows.withColumn("_group", F.lit(0)), ["_group"], value, shares).drop("_group")
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    named, margin = list(shares.items()), MARGIN
    found = written(brackets(values, by, named, margin), "percentile-brackets")  # a row for each group
    largest = found.agg(F.coalesce(F.max("_all"), F.lit(0))).first()[0]
    while 2 * margin * largest > IN_BRACKET:
        found = written(brackets(values, by, named, margin, found), "percentile-brackets")
        largest *= 2 * (margin + 1 / GRID)
    while True:
        result = written(_placed(values, by, named, found), "percentiles")
        if margin >= 1 or not result.where("_missed").take(1):
            return result.drop("_missed")
        margin = max(8 * margin, 0.05)
        found = written(brackets(values, by, named, min(margin, 1.0)), "percentile-brackets")


def _placed(values: DataFrame, by: list[str], named: list[tuple[str, float]], found: DataFrame) -> DataFrame:
    """The percentiles, and whether a bracket misses its place."""
    inside = reduce(Column.__or__, [F.col("_v").between(F.col(f"_low_{n}"), F.col(f"_high_{n}")) for n, _ in named])
    gap = reduce(Column.__add__, [(F.col("_v") >= F.col(f"_low_{n}")).cast("int") + (F.col("_v") > F.col(f"_high_{n}")).cast("int") for n, _ in named])
    met = values.alias("l").join(found.alias("r"), same(by))
    cells = met.select(*[F.col(f"l.{c}").alias(c) for c in by], "_all", gap.alias("_gap"), F.when(inside, F.col("_v")).alias("_v"))
    counted = cells.groupBy(*by, "_all", "_gap", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_gap", "_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_to", F.sum("_n").over(upto))
    picked, missed = [], []
    for name, share_ in named:
        at = F.col("_all").cast("double") * share_ - share_  # share x (n - 1), counted from zero
        low, high = F.floor(at + 1e-9), F.floor(at + 1e-9) + F.when(at - F.floor(at + 1e-9) > 1e-9, 1).otherwise(0)
        here = lambda k: F.max(F.when((F.col("_to") - F.col("_n") <= k) & (k < F.col("_to")), F.col("_v")))
        part = F.max(at - low)
        picked.append((here(low) + (here(high) - here(low)) * part).alias(name))
        missed.append(here(low).isNull() | here(high).isNull())
    return counted.groupBy(*by).agg(*picked, reduce(Column.__or__, missed).alias("_missed"))


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact p50 and p95 (linear between neighbours) and mean, rounded to whole numbers, half to even."""
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg(value)).cast("long").alias("mean"))
    exact = exact_percentiles(rows, by, value, {"p50": 0.5, "p95": 0.95})
    joined = whole.alias("l").join(exact.alias("r"), reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]), "left")
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in by], "n", *[F.bround(c).cast("long").alias(c) for c in ("p50", "p95")], "mean")


def evaluation_summary(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: images, accuracy over the labels, uses of the costly stages, latency."""
    known = labels.select("image_path", "status", F.col("slug").alias("verified_slug"))
    rows = predictions.join(known, "image_path", "left")
    verified = F.count_if(F.col("status") == "verified")
    one = F.count_if(F.col("predicted_slug") == F.col("verified_slug"))
    five = F.count_if(F.array_contains("top5_slugs", F.col("verified_slug")))
    return rows.agg(
        F.count(F.lit(1)).alias("images"), verified.alias("verified_labels"), F.count_if(F.col("status") == "unknown").alias("unknown_labels"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous_labels"), F.count_if("ocr_used").alias("ocr_invocations"),
        F.count_if("verifier_used").alias("verifier_invocations"), one.alias("top1_correct"), five.alias("top5_correct"),
        share(one, verified).alias("top1_accuracy"), share(five, verified).alias("top5_accuracy"),
        # whole milliseconds: few distinct values
        *[F.bround(F.percentile("latency_ms", F.lit(p / 100))).cast("long").alias(f"p{p}_latency_ms") for p in (50, 95)],
        F.bround(F.avg("latency_ms")).cast("long").alias("mean_latency_ms"),
    )


def class_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """class, support, precision, recall, f1 of each class that is true of a row."""
    true = rows.groupBy(F.col(truth).alias("class")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col(truth) == F.col(guess)).alias("hits"))
    guessed = rows.groupBy(F.col(guess).alias("class")).agg(F.count(F.lit(1)).alias("guesses"))
    joined = true.join(guessed, "class", "left").withColumn("guesses", F.coalesce("guesses", F.lit(0)))
    return joined.select(
        "class", "support", F.coalesce(share(F.col("hits"), F.col("guesses")), F.lit(0.0)).alias("precision"),
        (F.col("hits") / F.col("support")).alias("recall"), (2 * F.col("hits") / (F.col("support") + F.col("guesses"))).alias("f1"),
    )


def confidence_bins(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    low = F.when(F.col(confidence) >= BINS[2], BINS[2]).when(F.col(confidence) >= BINS[1], BINS[1]).otherwise(BINS[0])
    return rows.groupBy(low.alias("from_confidence")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(correct)).alias("correct"))


def review_rows(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked candidates (name, rank, slug, score) with the label's slug, the gap to the first and the verified rank."""
    each = Window.partitionBy("name")
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(each)
    labelled = ranked.join(labels.select(F.col("image_path").alias("name"), "status", F.col("slug").alias("verified_slug"), "evidence"), "name")
    return labelled.withColumn("gap_to_first", F.round(first - F.col("score"), 4)).withColumn(
        "verified_rank", F.min(F.when(F.col("slug") == F.col("verified_slug"), F.col("rank"))).over(each)
    )


def review_summary(rows: DataFrame) -> DataFrame:
    """One row per photo: top1, verified_rank, gap_first_second, spread."""
    return rows.groupBy("name", "status", "verified_slug", "evidence", "verified_rank").agg(
        F.min_by("slug", "rank").alias("top1"),
        F.round(F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score"))), 4).alias("gap_first_second"),
        F.round(F.max_by("score", F.struct(-F.col("rank"))) - F.max_by("score", "rank"), 4).alias("spread"),
    )


def folded(value: Column) -> Column:
    """Compared without regard to case, in any script: the full upper-case mapping makes ß and ss one, and both small sigmas (and a dotless i one with i).

    A collation without case finds equal texts too, but no substring across such an expansion."""
    return F.replace(F.upper(value), F.lit("\u0130"), F.lit("I\u0307"))


def review_list(summary: DataFrame, status: str = "all", query: str = "", names: list[str] = ("name", "evidence", "verified_slug", "top1")) -> DataFrame:
    """Photos of a status whose name, evidence or slugs contain the query, letters in either case."""
    if status not in ("all", "verified", "unknown", "ambiguous"):
        raise ValueError(f"Unknown status: {status}")
    rows = summary if status == "all" else summary.where(F.col("status") == status)
    wanted = query.strip()
    where = F.concat_ws(" ", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])
    return rows.where(F.contains(folded(where), folded(F.lit(wanted)))) if wanted else rows
