"""Similar cards and picks for stated wishes, one per winery.

features: slug, color, sparkling, sweetness (may be null), grapes (array), region, winery, description, available; see card_features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import wordlists as fixed
from ..functions.cards import any_stem, color_key, grape_set, is_sparkling, sweetness_level, text
from ..scratch import written
from .blocks import best_cards
from .pairing import dish_fit, known_dish
from .text import UNIT, best_notes, profile_vectors, shared_products, sum_units, text_similarity

MOST_ANALOGUES, ANALOGUES, PICKS = 8, 4, 3
#: Weights of what two cards have in common, in tenths.
GRAPES, SWEETNESS, REGION, TEXT = 30, 15, 7, 30
#: Postings that a base looks at in a block before its least score is known.
FIRST_POSTINGS = 64
LONG_DESCRIPTION, LENGTH_SCALE = 600, 1200


def card_features(cards: DataFrame) -> DataFrame:
    return cards.select(
        "slug", color_key().alias("color"), is_sparkling().alias("sparkling"), sweetness_level().alias("sweetness"),
        grape_set().alias("grapes"), text("region").alias("region"), text("winery").alias("winery"), text("description").alias("description"),
        F.coalesce(F.lower(F.col("reference_available").cast("string")) != "false", F.lit(True)).alias("available"),
    )


def reasons_or(default: str, *reasons: Column) -> Column:
    said = F.array_compact(F.array(*reasons))
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(default)))


def tenths(n: int) -> int:
    return n * UNIT // 10


def share_units(times: int, part: Column, whole: Column) -> Column:
    """times * part / whole in whole units, rounded down; 0 of nothing."""
    top = part.cast("long") * (times * UNIT)
    return F.when(whole > 0, ((top - top % whole) / whole).cast("long")).otherwise(F.lit(0).cast("long"))


def jaccard_units(times: int, a: Column, b: Column) -> Column:
    return share_units(times, F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def shown(units: Column) -> Column:
    """A score as it is shown: four digits."""
    return F.floor((units + UNIT // 20_000) / (UNIT // 10_000)) / 10_000


def one_per_winery(scored: DataFrame, by: list[str]) -> DataFrame:
    """The best row of each winery, and its place among them: unrounded score (units) first, then slug."""
    best = Window.partitionBy(*by, "winery").orderBy(F.desc("units"), "slug")
    place = Window.partitionBy(*by).orderBy(F.desc("units"), "slug")
    only = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return only.withColumn("place", F.row_number().over(place))


def static_units(base: str = "b_") -> Column:
    """What sweetness and region give, from columns of both cards; an unknown sweetness equals none."""
    sweet = F.coalesce(F.col("sweetness") == F.col(f"{base}sweetness"), F.lit(False))
    return sweet.cast("long") * tenths(SWEETNESS) + F.coalesce(F.col("region") == F.col(f"{base}region"), F.lit(False)).cast("long") * tenths(REGION)


def first_slugs(cards: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, firsts (slug, winery): of the first wineries by their smallest slug, that slug. Cards with nothing else in common can only come in this order."""
    wineries = cards.groupBy(*keys, "winery").agg(F.min("slug").alias("slug"))
    order = Window.partitionBy(*keys).orderBy("slug")
    few = wineries.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return few.groupBy(*keys).agg(F.collect_list(F.struct("slug", "winery")).alias("firsts"))


def scored_pairs(pairs: DataFrame, cards: DataFrame, adjective: str) -> DataFrame:
    """base, slug, winery, units, reasons of pairs (b_slug, slug), computed in full."""
    base = cards.select(*[F.col(c).alias(f"b_{c}") for c in cards.columns if c != "available"])
    both = pairs.join(cards, "slug").join(base, "b_slug").where(
        (F.col("winery") != F.col("b_winery")) & (F.col("slug") != F.col("b_slug")) & F.col("available") & (F.col("color") == F.col("b_color"))
        & (F.col("sparkling") == F.col("b_sparkling"))
    )
    both = both.withColumn("products", shared_products(F.col("b_vector"), F.col("vector")))
    both = both.withColumn("text", sum_units(F.col("products"))).withColumn("notes", best_notes(F.col("products"), 3, adjective))
    common = F.array_sort(F.array_intersect("grapes", "b_grapes"))
    same_sweetness, same_region = F.coalesce(F.col("sweetness") == F.col("b_sweetness"), F.lit(False)), F.col("region") == F.col("b_region")
    units = jaccard_units(GRAPES // 10, F.col("b_grapes"), F.col("grapes")) + static_units() + TEXT // 10 * F.col("text")
    reasons = reasons_or(
        fixed.SAME_STYLE,
        F.when(F.size(common) > 0, F.concat(F.lit(fixed.SAME_GRAPE), F.array_join(F.slice(common, 1, 2), ", "))),
        F.when(same_sweetness, F.concat(F.lit(fixed.ALSO), "sweetness")),
        F.when(same_region & (F.col("region") != ""), F.concat(F.lit(fixed.ALSO), "region")),
        F.when((F.col("text") > UNIT // 20) & (F.size("notes") > 0), F.concat(F.lit(fixed.SIMILAR_NOTES), F.array_join("notes", ", "))),
    )
    return both.select(F.col("b_slug").alias("base"), "slug", "winery", units.alias("units"), reasons.alias("reasons"))


def analogues(features: DataFrame, bases: DataFrame, profiles: DataFrame, limit: int = ANALOGUES, adjective: str = fixed.ADJECTIVE) -> DataFrame:
    """base, place, slug, score, reasons: the best available cards of the same colour and kind from other wineries, one per winery, exactly.

    bases: slug, a stated set. Cards that share neither grape nor term with a base score by sweetness and region alone, so the first
    slugs of a few wineries stand for all of them. The others are scored block by block (best_cards), where each
    task keeps the best of each base; no row is made for a pair or a shared term. Reasons are made for what may come among the best."""
    limit = max(1, min(limit, MOST_ANALOGUES))
    found = analogue_scores(features, bases, profiles, limit, adjective)
    best = one_per_winery(found, ["base"]).where(F.col("place") <= limit)
    return best.select("base", "place", "slug", shown(F.col("units")).alias("score"), "reasons")


def analogue_scores(features: DataFrame, bases: DataFrame, profiles: DataFrame, limit: int, adjective: str) -> DataFrame:
    """Scores and reasons of all pairs that may come among the best limit."""
    columns = ["slug", "color", "sparkling", "sweetness", "grapes", "region", "winery", "available"]
    none = F.array().cast("array<struct<term:string,weight:double>>")
    cards = features.select(*columns).join(profile_vectors(profiles), "slug", "left").withColumn("vector", F.coalesce("vector", none))
    cards = written(cards, "analogue-cards")
    offered = cards.where("available")
    chosen = cards.join(bases.select("slug").distinct(), "slug", "left_semi")
    base = chosen.select(F.col("slug").alias("b_slug"), F.col("sweetness").alias("b_sweetness"), F.col("region").alias("b_region"), F.col("winery").alias("b_winery"), "color", "sparkling")

    alike = None
    for same in (["sweetness", "region"], ["sweetness"], ["region"], []):
        keys = ["color", "sparkling", *same]
        firsts = first_slugs(offered, keys, limit + 1)
        renamed = base.select("b_slug", "b_winery", "color", "sparkling", *[F.col(f"b_{c}").alias(c) for c in same])
        units = tenths(SWEETNESS * ("sweetness" in same) + REGION * ("region" in same))
        rows = renamed.join(firsts, keys).select("b_slug", "b_winery", F.inline("firsts")).where("winery <> b_winery").select("b_slug", "slug", "winery", F.lit(units).alias("units"))
        alike = rows if alike is None else alike.unionByName(rows)
    alike = one_per_winery(alike, ["b_slug"]).where(F.col("place") <= limit).select("b_slug", "slug")
    worth = {"grapes": tenths(GRAPES), "sweetness": tenths(SWEETNESS), "region": tenths(REGION), "text": TEXT // 10}
    told = ["slug", "color", "sparkling", "winery", "sweetness", "region", "grapes", "vector"]
    sharing = best_cards(chosen.select(*told), offered.select(*told), ["color", "sparkling"], worth, UNIT, limit, FIRST_POSTINGS)
    sharing = one_per_winery(sharing, ["base"]).where(F.col("place") <= limit).select(F.col("base").alias("b_slug"), "slug")
    pairs = written(sharing.unionByName(alike).distinct(), "analogue-pairs")
    return scored_pairs(pairs, cards, adjective)


def check_wishes(dish: str | None, color: str | None, sweetness: str | None) -> None:
    if dish is not None:
        known_dish(dish)
    if color is not None and color not in fixed.COLOR_PHRASES:
        raise ValueError(f"Unknown colour: {color}")
    if sweetness is not None and sweetness not in fixed.SWEETNESS_WANTED:
        raise ValueError(f"Unknown sweetness: {sweetness}")


def sommelier(
    features: DataFrame, fits: DataFrame | None = None, dish: str | None = None, color: str | None = None, sweetness: str | None = None,
    like: str | None = None, profiles: DataFrame | None = None, limit: int = PICKS, offset: int = 0, stems: list[str] | None = None,
) -> DataFrame:
    """place, slug, score, reasons, total, note: available cards that meet the wishes, one per winery, in the order of their unrounded scores.

    A page without cards is one row that has total and note only.
    fits: slug, place of the dish for the card's style (see dish_fit); like: a slug, which needs profiles. If no card has the
    wished sweetness, all are shown without that wish and the note says so."""
    check_wishes(dish, color, sweetness)
    rows = features.where("available")
    if like is not None:
        rows = rows.where(F.col("slug") != like)
    if color == "sparkling":
        rows = rows.where("sparkling")
    elif color:
        rows = rows.where((F.col("color") == color) & ~F.col("sparkling"))
    level = F.coalesce("sweetness", F.when(~F.col("sparkling"), fixed.DRY))
    meets = F.coalesce(level.isin(fixed.SWEETNESS_WANTED[sweetness]), F.lit(False)) if sweetness else F.lit(True)
    rows = rows.withColumn("meets", meets)
    strict = not sweetness or bool(rows.agg(F.coalesce(F.max("meets"), F.lit(False))).first()[0])  # decides for the whole answer
    if strict:
        rows = rows.where("meets")
    reasons = [level if sweetness and strict else F.lit(None).cast("string")]
    units, strong = F.lit(0).cast("long"), F.lit(True)
    if dish:
        rows = rows.join(fits.select("slug", F.col("place").alias("dish_place")), "slug", "left")
        fit = F.when(F.col("dish_place") <= 2, 30).when(F.col("dish_place") == 3, 15).otherwise(0)  # in tenths
        mentions = any_stem(F.lower("description"), stems or fixed.DISH_STEMS[dish])
        label = fixed.DISHES[dish].lower()
        units, strong = units + (fit + 20 * mentions.cast("int")) * F.lit(tenths(1)), (fit >= 15) | mentions
        said = F.when(fit == 30, f"{label}: {fixed.FITS[0]}").when(fit == 15, f"{label}: {fixed.FITS[1]}")
        reasons.append(F.when(mentions, f"{fixed.TEXT_ADVISES}{label}").otherwise(said))
    if like:
        base = F.lit((features.where(F.col("slug") == like).select("grapes").first() or [[]])[0]).cast("array<string>")  # one card
        near = text_similarity(profiles.where(F.col("slug") == like), profiles).select("slug", F.col("units").alias("text"))
        rows = rows.join(near, "slug", "left")
        common = F.array_sort(F.array_intersect("grapes", base))
        units = units + 3 * F.coalesce("text", F.lit(0)) + jaccard_units(2, base, F.col("grapes"))
        reasons.append(F.when(F.size(common) > 0, F.concat(F.lit(fixed.SAME_GRAPE), F.array_join(F.slice(common, 1, 2), ", "))))
    units = units + share_units(1, F.least(F.length("description"), F.lit(LONG_DESCRIPTION)), F.lit(LENGTH_SCALE))
    scored = rows.select("slug", "winery", units.alias("units"), reasons_or(fixed.FITS_ANSWERS, *reasons).alias("reasons"), strong.alias("strong"))
    any_strong, total = scored.agg(F.coalesce(F.bool_or("strong"), F.lit(True)), F.countDistinct("winery")).first()
    notes = []
    if not strict and total:
        notes.append(fixed.NO_SUCH_SWEETNESS.format(color=fixed.COLOR_PHRASES.get(color, fixed.ANY_COLOR)))
    if dish and not any_strong:
        notes.append(fixed.NO_SUCH_DISH.format(dish=fixed.DISHES[dish].lower(), typical=fixed.TYPICAL[dish]))
    best = scored.groupBy("winery").agg(F.min(F.struct((-F.col("units")).alias("o"), "slug", "reasons")).alias("x")).select("x.*")
    cut = best.orderBy("o", "slug").limit(max(0, offset) + limit)  # a page of the answer
    place = Window.orderBy("o", "slug")
    paged = cut.withColumn("place", F.row_number().over(place)).where(F.col("place") > max(0, offset))
    said = F.lit(" ".join(notes) or None).cast("string")
    paged = paged.select("place", "slug", shown(-F.col("o")).alias("score"), "reasons")
    nothing = features.sparkSession.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in paged.dtypes])
    either = F.col("place").isNotNull() | (F.count("place").over(Window.partitionBy(F.lit(0))) == 0)  # of one page
    return paged.unionByName(nothing).withColumn("_shown", either).where("_shown").drop("_shown").withColumn("total", F.lit(total).cast("long")).withColumn("note", said)


def sommelier_for_cards(cards: DataFrame, dish: str | None = None, **wishes) -> DataFrame:
    """sommelier over cards, with the dish rules applied."""
    fits = dish_fit(cards, dish).select("slug", "place") if dish else None
    return sommelier(card_features(cards), fits, dish=dish, **wishes)
