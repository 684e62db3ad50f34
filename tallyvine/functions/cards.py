"""Attributes of a card as expressions over its columns.

A card has the string columns slug, name, category, color, region, grape, description, winery, image_name and the boolean
reference_available. Missing strings count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as fixed


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def stripped(name: str) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", "")


def first_match(cases: list[tuple[Column, str]], default: Column) -> Column:
    """The value of the first case that holds."""
    return F.coalesce(*[F.when(test, F.lit(value)) for test, value in cases], default)


def any_stem(where: Column, stems: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(where, F.lit(s)) for s in stems])


def color_key() -> Column:
    category = F.lower(text("category"))
    return first_match([(F.contains(category, F.lit(label)), key) for key, label in fixed.COLOR_LABELS], F.lit("white"))


def is_sparkling() -> Column:
    title = F.lower(F.concat_ws(" ", text("name"), text("slug"), text("image_name")))
    opening = F.lower(F.substring(text("description"), 1, fixed.OPENING_LENGTH))
    return title.rlike(fixed.SPARKLING_TITLE) | opening.rlike(fixed.SPARKLING_OPENING)


def sweetness_level() -> Column:
    """By whole words of the title, else by a phrase of the description, else null."""
    title = F.lower(F.concat_ws(" ", text("name"), F.replace(text("slug"), F.lit("-"), F.lit(" ")), F.replace(text("image_name"), F.lit("_"), F.lit(" "))))
    phrase = F.nullif(F.regexp_extract(F.lower(text("description")), fixed.SWEETNESS_PHRASE, 1), F.lit(""))
    return first_match([(title.rlike(pattern), level) for pattern, level in fixed.SWEETNESS_TITLE], phrase)


def stated_sweetness() -> Column:
    """As stated to a model: parts of words count, and the start of the description too."""
    where = F.lower(F.concat_ws(" ", text("name"), text("slug"), text("image_name"), F.substring(text("description"), 1, fixed.STATED_LENGTH)))
    return first_match([(F.contains(where, F.lit(part)), level) for part, level in fixed.STATED_SWEETNESS], F.lit(fixed.NOT_STATED))


def shown_sweetness() -> Column:
    """stated_sweetness, null where none is stated."""
    return F.nullif(stated_sweetness(), F.lit(fixed.NOT_STATED))


def pairing_style() -> Column:
    """By the title, then the category; the description is never read."""
    title, category = F.lower(F.concat_ws(" ", text("name"), text("slug"))), F.lower(text("category"))
    cases = [(any_stem(title, stems), style) for style, stems in fixed.STYLE_TITLE]
    cases += [(F.contains(category, F.lit(stem)), style) for style, stem in fixed.STYLE_CATEGORY]
    return first_match(cases, F.lit(fixed.DEFAULT_STYLE))


def grape_set() -> Column:
    parts = F.transform(F.split(text("grape"), ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def description_line() -> Column:
    """The line that describes a card to a model."""
    return F.concat(
        F.trim("name"), F.lit(" | винодельня: "), text("winery"), F.lit(" | "), text("category"), F.lit(" | сорт: "),
        text("grape"), F.lit(" | сладость: "), stated_sweetness(),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def safe_filename(name: Column) -> Column:
    """Not empty, no folder, no backslash, no zero byte, not a reference to a folder."""
    return F.coalesce((name != "") & ~name.rlike(r"[/\\\x00]") & ~name.isin(".", ".."), F.lit(False))


def latin(value: Column) -> Column:
    """Lower case in Latin letters: Cyrillic transliterated, marks of Latin letters dropped."""
    out = F.lower(value)
    for letter, sounds in fixed.LATIN_LONG.items():
        out = F.replace(out, F.lit(letter), F.lit(sounds))
    out = F.translate(out, *fixed.LATIN_PAIRS)
    return F.translate(out, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def label_token(value: Column) -> Column:
    """One comparison form for a line of a label: Latin letters and digits, c as k."""
    return F.replace(F.regexp_replace(latin(value), "[^a-z0-9]", ""), F.lit("c"), F.lit("k"))


def label_words(value: Column) -> Column:
    found = F.regexp_extract_all(latin(value), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(found, lambda w: F.replace(w, F.lit("c"), F.lit("k")))


def fragments() -> Column:
    """Forms under which a card may be named on a label: words, neighbouring words, whole fields."""

    def pairs(words: Column) -> Column:
        near = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
        return F.filter(near, lambda x: x.isNotNull())

    parts = []
    for field in ("name", "winery", "grape"):
        words = label_words(text(field))
        parts += [words, pairs(words), F.array(F.array_join(words, ""))]
    slug = F.transform(F.split(text("slug"), "-"), lambda w: F.replace(w, F.lit("c"), F.lit("k")))
    parts += [slug, pairs(slug)]
    telling = F.filter(F.flatten(F.array(*parts)), lambda x: (F.length(x) >= 4) & (~x.rlike("^[0-9]+$") | x.rlike(f"^{fixed.YEAR}$")))
    return F.array_sort(F.array_distinct(telling))


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)
