"""Term statistics of descriptions, sparse profiles, and lexical evidence from the lines of a label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import wordlists as fixed
from ..functions.cards import fragments, label_token, text
from ..functions.vectors import most_similar, similarity_ratio
from ..scratch import written
from .blocks import alike_pairs, best_terms, posted, similar_pairs, term_lists

TOP_TERMS, MOST_COMMON = 25, 0.15
DIGITS = 9
#: Letters of a token that may be evidence.
TOKEN_LETTERS = 4, 35
#: Scores are sums of whole units, so they are the same however Spark adds them up, and can be ordered by unrounded.
UNIT = 10**12
#: Postings of a term that one task takes; a term with more is dealt out in slices.
POSTINGS = 100_000


def term_counts(cards: DataFrame, word: str = fixed.TASTE_WORD, stop_words: list[str] = fixed.STOP_WORDS) -> DataFrame:
    """slug, term, tf, first_pos: words of the lower-cased description without stop words.

    Texts are dealt out by slug before they are taken apart: they are smaller than their words with places, which then need no shuffle."""
    dealt = cards.select("slug", text("description").alias("description")).repartition("slug")
    found = F.regexp_extract_all(F.lower("description"), F.lit(word), F.lit(0))
    words = dealt.select("slug", F.posexplode(found).alias("pos", "term"))
    if stop_words:
        words = words.where(~F.col("term").isin(stop_words))
    return words.groupBy("slug", "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def profiles(counts: DataFrame, n_cards: int, top: int = TOP_TERMS, most_common: float = MOST_COMMON) -> DataFrame:
    """slug, term, weight: the top terms by tf * ln((1 + n) / (1 + df)), scaled to length one.

    Terms of a single card, or of most_common of all cards and more, do not count; ties go to the term that comes first.
    Squares are added in whole units, so a weight is the same in any plan."""
    telling = document_frequencies(counts).where((F.col("df") > 1) & (F.col("df") < most_common * n_cards)).select("term", "df")
    raw = F.round(F.col("tf") * F.ln(F.lit(1.0 + n_cards) / (1 + F.col("df"))), DIGITS)
    order = Window.partitionBy("slug").orderBy(F.desc("raw"), "first_pos")
    best = counts.join(telling, "term").withColumn("raw", raw).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    squares = F.sum(F.floor(F.col("raw") * F.col("raw") * 1e9)).over(Window.partitionBy("slug"))
    length = F.sqrt(squares / 1e9)
    return best.select("slug", "term", (F.col("raw") / F.when(length > 0, length).otherwise(1.0)).alias("weight"))


def card_profiles(cards: DataFrame, n_cards: int, word: str = fixed.TASTE_WORD, stop_words: list[str] = fixed.STOP_WORDS, top: int = TOP_TERMS, most_common: float = MOST_COMMON) -> DataFrame:
    """profiles(term_counts(cards)), pack by pack.

    Texts stay where they are, and the terms of a card stay in one row. A pack of cards sends each of its terms once, with the number of its cards that
    have it, and gets the frequency in all cards back. Slugs that stand in several rows, or that are null, are counted row by row."""
    words = F.regexp_extract_all(F.lower("description"), F.lit(word), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda x: ~x.isin(stop_words))
    lists = written(term_lists(cards.select("slug", text("description").alias("description")).select("slug", words.alias("words"))), "term-lists")
    repeated = lists.groupBy("slug").count().where("slug IS NOT NULL AND count > 1")
    if repeated.limit(1).count() or cards.where("slug IS NULL").limit(1).count():
        return profiles(term_counts(cards, word, stop_words), n_cards, top, most_common)
    held = lists.where("slug IS NULL").select("pack", F.inline(F.arrays_zip("terms", "codes", "numbers"))).toDF("pack", "term", "code", "n")
    df = F.sum("n").over(Window.partitionBy("term"))
    telling = held.withColumn("df", df).where((F.col("df") > 1) & (F.col("df") < most_common * n_cards))
    return best_terms(telling.select("pack", "code", F.ln(F.lit(1.0 + n_cards) / (1 + F.col("df"))).alias("idf")), lists, top, DIGITS)


def product_units(a: Column, b: Column) -> Column:
    """The product of two weights in whole units."""
    return F.floor(a * b * float(UNIT))


def in_slices(rows: DataFrame, sizes: DataFrame, whole: bool) -> DataFrame:
    """rows (term, ...) with a slice: each row in one slice of its term, or, if whole, in all of them. sizes: term, slices of the terms that have several."""
    cut = rows.join(sizes, "term", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    if whole:
        return cut.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return cut.withColumn("slice", F.pmod(F.xxhash64("slug"), "slices").cast("int")).drop("slices")


def posting_slices(rows: DataFrame, most: int) -> DataFrame:
    """term, slices of the terms with more than most rows."""
    held = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return held.select("term", F.ceil(F.col("n") / most).cast("int").alias("slices"))


def shared_terms(base: DataFrame, others: DataFrame, most: int = POSTINGS) -> DataFrame:
    """base, slug, term, units (of the product) for terms that both profiles have (other than with itself); no task takes more than some most postings of a term."""
    sizes = posting_slices(others, most)
    left = in_slices(base.select(F.col("slug").alias("base"), "term", F.col("weight").alias("w")), sizes, True)
    met = left.join(in_slices(others, sizes, False), ["term", "slice"]).where("base <> slug")
    return met.select("base", "slug", "term", product_units(F.col("w"), F.col("weight")).alias("units"))


def text_similarity(base: DataFrame, others: DataFrame, notes: int = 3, adjective: str = fixed.ADJECTIVE) -> DataFrame:
    """base, slug, units (sum of products), text (the same as a number) and notes (best shared terms that are no adjectives) of the pairs that share a term.

    Vectors meet block by block (similar_pairs), so neither a shared term nor a pair is moved."""
    found = similar_pairs(written(profile_vectors(base), "base-vectors"), written(profile_vectors(others), "vectors"), UNIT, notes, lambda x: ~x.term.rlike(adjective))
    return found.withColumn("text", F.col("units") / float(UNIT))


def profile_vectors(weights: DataFrame) -> DataFrame:
    """slug, vector: the terms of a profile with their weights, in the order of terms."""
    return weights.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("vector"))


def shared_products(a: Column, b: Column) -> Column:
    """Of two vectors the shared terms, each with the units of its product."""
    other = F.map_from_entries(b)
    both = F.filter(a, lambda x: F.map_contains_key(other, x.term))
    return F.transform(both, lambda x: F.struct(product_units(x.weight, F.element_at(other, x.term)).alias("units"), x.term.alias("term")))


def sum_units(products: Column) -> Column:
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x.units)


def best_notes(products: Column, notes: int, adjective: str) -> Column:
    """The best shared terms that are no adjectives."""
    said = F.filter(products, lambda x: ~x.term.rlike(adjective))
    return F.transform(F.slice(F.array_sort(F.transform(said, lambda x: F.struct((-x.units).alias("o"), x.term.alias("term")))), 1, notes), lambda x: x.term)


def same_profiles(weights: DataFrame) -> DataFrame:
    """slug, profile: the smallest slug with just the same vector."""
    vectors = profile_vectors(weights).select("slug", F.sha2(F.to_json("vector"), 256).alias("digest"))
    return vectors.join(vectors.groupBy("digest").agg(F.min("slug").alias("profile")), "digest").select("slug", "profile")


def in_order(terms: DataFrame) -> DataFrame:
    """term, id: whole numbers from 0 in the order of df, then term."""
    sorted_ = written(terms.orderBy("df", "term").withColumn("at", F.monotonically_increasing_id()), "terms")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = dict(sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a number for each task
    before = [sum(sizes.get(q, 0) for q in range(p)) for p in range(max(sizes, default=0) + 1)]
    return sorted_.select("term", (F.get(F.array(*map(F.lit, before)), part.cast("int")) + place).cast("int").alias("id"))


def cosine_join(weights: DataFrame, at_least: float, most: int = 10_000) -> DataFrame:
    """a, b, units, text of all pairs of different profiles, each named by its smallest slug (see same_profiles), with a similarity of at_least.

    Terms stand in one order, rarest first. A vector has length one, so what its last terms can give to any other is at most
    their length: only the terms before that point, where the remaining length falls below at_least, are posted, each with the vector. Pairs meet at
    a posted term; where it is the first one that they share and its product with both remaining lengths can reach at_least, they are computed in full there
    (alike_pairs). A term with more than most postings is dealt out in slices, each pair of slices by itself."""
    names = same_profiles(weights)
    firsts = written(weights.join(names.where("slug = profile").select("slug"), "slug"), "first-profiles")
    ids = in_order(firsts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    vectors = written(firsts.join(ids, "term").groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("id", "weight"))).alias("vector")), "alike-vectors")
    slack = 1e-6  # weights are rounded, bounds are not
    postings = posted(vectors, at_least - slack)
    sizes = postings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("id", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    cut = postings.join(F.broadcast(sizes), "id", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))  # at most a row for each most postings
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("slug"), "slices").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    met = cut.select("id", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "slice", "slug", "vector")
    return alike_pairs(met, at_least, slack, UNIT).withColumn("text", F.col("units") / float(UNIT))


def card_fragments(cards: DataFrame) -> DataFrame:
    """slug, fragment of the available cards."""
    return cards.where("reference_available").select("slug", F.explode(fragments()).alias("fragment"))


def fragment_idf(parts: DataFrame, n_cards: int) -> DataFrame:
    return parts.groupBy("fragment").agg(F.count(F.lit(1)).alias("frequency")).withColumn("idf", F.ln(F.lit(n_cards + 1.0) / (F.col("frequency") + 1)))


def readable(lines: DataFrame) -> DataFrame:
    """Lines (query_id, line_no, text, confidence) that may be evidence, with their token."""
    token = F.col("token")
    number = token.rlike("^[0-9]+$") & ~token.rlike(f"^{fixed.YEAR}$")
    return lines.withColumn("token", label_token(text("text"))).where(
        (F.col("confidence") >= 0.5) & F.length(token).between(*TOKEN_LETTERS) & ~token.isin(fixed.LABEL_STOP_WORDS) & ~number
    )


def least_similarity(token: Column) -> Column:
    return F.when(F.length(token) <= 4, 98).when(F.length(token) <= 6, 93).otherwise(90)


def most_edits(token: Column) -> Column:
    """Of a word that is similar enough, no more letters are inserted or deleted: d of 100 * (1 - d / (n + m)), and m is at most n + d."""
    allowed = 1 - least_similarity(token) / 100
    return F.floor(2 * allowed * F.length(token) / (1 - allowed) + 1e-9).cast("int")


def piece_sizes() -> list[int]:
    """Lengths of the pieces of all tokens that may be evidence."""
    sizes = set()
    for n in range(TOKEN_LETTERS[0], TOKEN_LETTERS[1] + 1):
        allowed = 0.02 if n <= 4 else 0.07 if n <= 6 else 0.1
        k = int(2 * allowed * n / (1 - allowed) + 1e-9) + 1
        sizes |= {n * (i + 1) // k - n * i // k for i in range(k)}
    return sorted(sizes)


def near_fragments(tokens: DataFrame, fragments: DataFrame) -> DataFrame:
    """token, fragment, similarity of all pairs that are similar enough, from distinct tokens and distinct fragments.

    A token is cut into one piece more than edits are allowed, so one piece stands unchanged in a similar fragment, shifted by no more than
    the edits. Pieces meet the equal substrings of fragments in an equi-join; only pairs that share a piece at such places, and whose lengths allow it, are compared."""
    n, k = F.length("token"), most_edits(F.col("token")) + 1
    numbers = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    begin = lambda i: F.floor(F.col("n") * i / F.col("k")).cast("int")
    cut = tokens.select("token", n.alias("n"), k.alias("k")).select("token", "n", "k", numbers.alias("i"))
    cut = cut.select("token", "k", begin(F.col("i")).alias("at"), (begin(F.col("i") + 1) - begin(F.col("i"))).alias("size"))
    pieces = cut.select("token", "k", "at", "size", F.substr("token", F.col("at") + 1, F.col("size")).alias("piece"))
    sizes = fragments.select("fragment", F.explode(F.array(*map(F.lit, piece_sizes()))).alias("size")).where(F.length("fragment") >= F.col("size"))
    placed = sizes.select("fragment", "size", F.explode(F.sequence(F.lit(0), F.length("fragment") - F.col("size"))).alias("there"))
    grams = placed.select("fragment", "there", F.substr("fragment", F.col("there") + 1, F.col("size")).alias("piece"))
    shifted = F.abs(F.col("at") - F.col("there")) < F.col("k")
    possible = most_similar(F.col("token"), F.col("fragment")) >= least_similarity(F.col("token"))
    pairs = pieces.join(grams, "piece").where(shifted & possible).select("token", "fragment").distinct()
    return pairs.withColumn("similarity", similarity_ratio(F.col("token"), F.col("fragment"))).where(F.col("similarity") >= least_similarity(F.col("token")))


def lexical_scores(
    lines: DataFrame, candidates: DataFrame, parts: DataFrame, idf: DataFrame, best: int = 3, exact: bool = False, pools: DataFrame | None = None
) -> DataFrame:
    """query_id, slug, lexical: the sum of the best hits, confidence * idf * similarity / 100.

    candidates: query_id, slug; or, with pools (pool, slug), query_id and pool, for queries that share candidates: then no pair of a query and a candidate is
    formed that has no hit. A token's hit is its most similar fragment of the candidate (ties: the larger one), if similar enough. exact compares by
    equality in place of the ratio. Both are equi-joins: similar fragments are found once for all candidates (near_fragments), and what a query
    looks for meets what its pool has by pool and fragment."""
    if pools is None:
        pools = candidates.select(F.col("query_id").alias("pool"), "slug")
        candidates = candidates.select("query_id", F.col("query_id").alias("pool"))
    tokens = readable(lines)
    distinct = tokens.select("token").distinct()
    if exact:
        near = distinct.select("token", F.col("token").alias("fragment"), F.lit(100.0).alias("similarity"))
    else:
        near = near_fragments(distinct, parts.select("fragment").distinct())
    near = near.join(idf.select("fragment", "idf"), "fragment")
    wanted = tokens.select("query_id", "line_no", "confidence", "token").join(near, "token").join(candidates.select("query_id", "pool").distinct(), "query_id")
    held = parts.join(near.select("fragment").distinct(), "fragment").join(pools.select("pool", "slug"), "slug")
    pairs = wanted.drop("token").join(held, ["pool", "fragment"])
    top = pairs.groupBy("query_id", "slug", "line_no", "confidence").agg(F.max(F.struct("similarity", "fragment", "idf")).alias("x"))
    worth = F.col("confidence") * F.col("x.idf") * F.col("x.similarity") / 100
    listed = F.slice(F.sort_array(F.collect_list("worth"), asc=False), 1, best)
    return (
        top.withColumn("worth", worth)
        .groupBy("query_id", "slug").agg(F.aggregate(listed, F.lit(0.0), lambda s, x: s + x).alias("lexical"))
    )
