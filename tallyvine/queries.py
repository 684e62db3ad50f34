"""Every operator on the given tables, and the same rows in DuckDB's SQL.

The tables stand in for a catalog: a document is a card (its text the description and, by content, the image), a source a
winery, a language a region and a colour; labels say which cards have a usable image; embeddings are gallery and queries.
Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cards as card
from .functions import vectors
from .functions import wordlists as fixed
from .operators import catalog, checks, evaluation, integrity, pairing, recommend, rerank, retrieval, review, text
from .operators.blocks import overlaps
from .plans import predict as plans
from .plans import views
from .scratch import scratch_path, written
from .sources import files, objects

WORD = "[a-z]{4,}"
EVERY = 50
ENDING = "(ing|ed|er)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- views of the tables, and the same in SQL ----


def cards(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    color = F.when(F.col("lang") == "en", "Белое").when(F.col("lang") == "de", "Красное").when(F.col("lang") == "fr", "Розовое").otherwise("Оранжевое")
    taste = F.when(F.col("toxic") == 1, " брют").when(F.col("quality") == 1, " сухое").when(F.col("quality") == 0, " полусладкое").otherwise("")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("slug"), F.concat(F.lit("вино "), "source", taste).alias("name"),
        F.concat(color, F.lit(" вино")).alias("category"), F.col("lang").alias("color"), F.col("lang").alias("region"),
        F.array_join(F.slice(words, 1, 3), ", ").alias("grape"), F.col("text").alias("description"), F.col("source").alias("winery"),
        F.concat(F.md5(F.col("text").cast("binary")), F.lit(".png")).alias("image_name"), F.col("quality").isNotNull().alias("reference_available"),
    )


CARDS = """cards AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS slug,
    'вино ' || source || CASE WHEN toxic = 1 THEN ' брют' WHEN quality = 1 THEN ' сухое' WHEN quality = 0 THEN ' полусладкое' ELSE '' END AS name,
    CASE lang WHEN 'en' THEN 'Белое' WHEN 'de' THEN 'Красное' WHEN 'fr' THEN 'Розовое' ELSE 'Оранжевое' END || ' вино' AS category,
    lang AS color, lang AS region, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:3], ', ') AS grape, text AS description,
    source AS winery, md5(text) || '.png' AS image_name, quality IS NOT NULL AS reference_available
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

FEATURES = """features AS (
  SELECT slug, CASE WHEN contains(lower(category), 'красное') THEN 'red' WHEN contains(lower(category), 'белое') THEN 'white'
      WHEN contains(lower(category), 'розовое') THEN 'rose' WHEN contains(lower(category), 'оранжевое') THEN 'orange' ELSE 'white' END AS color,
    contains(name, 'брют') OR regexp_matches(lower(substr(description, 1, 250)), 'игрист|шампанск|петнат') OR
      regexp_matches(lower(name || ' ' || slug || ' ' || image_name), 'bryut|brut|igrist|pet-?nat|frizzante') AS sparkling,
    CASE WHEN contains(name, 'полуслад') THEN 'полусладкое' WHEN contains(name, 'сухое') THEN 'сухое' END AS sweetness,
    list_distinct(list_filter(list_transform(string_split(grape, ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS grapes,
    region, winery, description, reference_available AS available, name, category, image_name, grape
  FROM cards)"""

TERMS = f"""words AS (
  SELECT slug, unnest(regexp_extract_all(lower(description), '{WORD}')) AS term,
    generate_subscripts(regexp_extract_all(lower(description), '{WORD}'), 1) AS pos FROM cards
), counts AS (SELECT slug, term, count(*) AS tf, min(pos) AS first_pos FROM words GROUP BY slug, term
), frequencies AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences FROM counts GROUP BY term
), total AS (SELECT count(*) AS n FROM cards
), raws AS (
  SELECT c.slug, c.term, first_pos, round(tf * ln((1.0::DOUBLE + n) / (1 + df)), 9) AS raw FROM counts c JOIN frequencies f ON c.term = f.term CROSS JOIN total
  WHERE df > 1 AND df < CAST(0.15 AS DOUBLE) * n
), best AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY raw DESC, first_pos) AS place FROM raws QUALIFY place <= 25
), profiles AS (
  SELECT slug, term, raw / CASE WHEN length > 0 THEN length ELSE 1 END AS weight FROM (
    SELECT *, sqrt(CAST(sum(CAST(floor(raw * raw * 1e9::DOUBLE) AS BIGINT)) OVER (PARTITION BY slug) AS DOUBLE) / 1e9::DOUBLE) AS length FROM best))"""

SIMILAR = f"""shared AS (
  SELECT a.slug AS base, b.slug, a.term, CAST(floor(a.weight * b.weight * 1e12::DOUBLE) AS BIGINT) AS units FROM profiles a JOIN profiles b ON a.term = b.term AND a.slug <> b.slug
  WHERE CAST(a.slug AS BIGINT) % {EVERY} = 0
), alike AS (
  SELECT base, slug, CAST(sum(units) AS BIGINT) AS text,
    (list(term ORDER BY units DESC, term) FILTER (NOT regexp_matches(term, '{ENDING}')))[1:3] AS notes FROM shared GROUP BY base, slug)"""


def profile_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """cards and their term profiles; the number of cards is a count of the table. Profiles are used several times, so they are written once.

    Profiles need no labels, and texts stay where they are, unless a document has several labels and so several cards."""
    rows, docs, labels = cards(spark, sf), table(spark, sf, "documents"), table(spark, sf, "labels")
    single = not labels.groupBy("doc_id").count().where("count > 1").limit(1).count()
    told = docs.select(F.col("doc_id").cast("string").alias("slug"), F.col("text").alias("description")) if single else rows
    return rows, written(text.card_profiles(told, docs.count(), WORD, []), "term-profiles")


def base_slugs(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("slug").cast("long") % EVERY == 0).select("slug")


def gallery(spark: SparkSession, sf: str) -> DataFrame:
    """One image per vector; an even one has two slugs."""
    slugs = F.when(F.col("vec_id") % 2 == 0, F.array(2 * F.col("vec_id"), 2 * F.col("vec_id") + 1)).otherwise(F.array(2 * F.col("vec_id")))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_name"), F.array("embedding").alias("views"), "label", slugs.cast("array<string>").alias("slugs")
    )


def whole_queries(spark: SparkSession, sf: str) -> DataFrame:
    vecs = table(spark, sf, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return vecs.select(F.col("vec_id").alias("query_id"), F.array("embedding").alias("crops"), F.col("label").alias("query_label"))


UNITS = """doubles AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), units AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS embedding FROM doubles)"""

RANKED = f"""{UNITS}, scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, g.vec_id AS image_name, g.label, round(list_inner_product(q.embedding, g.embedding), 6) AS score
  FROM units q JOIN units g ON q.vec_id % {EVERY} = 0 AND q.vec_id <> g.vec_id
), images AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) AS image_rank FROM scored QUALIFY image_rank <= 20
), slugs AS (
  SELECT *, unnest(list_sort(CASE WHEN image_name % 2 = 0 THEN [CAST(2 * image_name AS VARCHAR), CAST(2 * image_name + 1 AS VARCHAR)]
    ELSE [CAST(2 * image_name AS VARCHAR)] END)) AS slug FROM images
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY image_rank, slug) AS rank FROM slugs QUALIFY rank <= 20)"""

FUSED = """logits AS (SELECT *, CASE WHEN label = query_label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS logit FROM ranked
), heads AS (SELECT *, CASE WHEN rank <= 7 THEN logit - max(CASE WHEN rank <= 7 THEN logit END) OVER (PARTITION BY query_id) END AS x FROM logits
), logs AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY query_id)) AS log_p FROM heads
), fused AS (SELECT *, CASE WHEN rank <= 7 THEN score + 0.02::DOUBLE * log_p END AS fused FROM logs
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(rank > 7 AS INT), round(fused, 9) DESC NULLS LAST, rank) AS new_rank FROM fused
), exps AS (SELECT *, CASE WHEN new_rank <= 7 THEN exp((fused - max(CASE WHEN new_rank <= 7 THEN fused END) OVER (PARTITION BY query_id)) / 0.02::DOUBLE) END AS e FROM placed
), rated AS (SELECT *, e / sum(e) OVER (PARTITION BY query_id) AS probability FROM exps)"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with both labels."""
    known = gallery(spark, sf).select("image_name", "label")
    found = plans.candidates(whole_queries(spark, sf), gallery(spark, sf))
    return found.join(known, "image_name").join(whole_queries(spark, sf).select("query_id", "query_label"), "query_id")


def with_logits(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf).withColumn("logit", F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0))


def rated(spark: SparkSession, sf: str) -> DataFrame:
    return rerank.confidence(rerank.fuse_verifier(rerank.log_softmax(with_logits(spark, sf))))


def photo_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A label for each query: a third is unknown, some are ambiguous, the verified slug is the right class (as text)."""
    q = table(spark, sf, "embeddings").where(F.col("vec_id") % EVERY == 0)
    n = F.floor(F.col("vec_id") / EVERY) % 5
    status = F.when(n == 3, "unknown").when(n == 4, "ambiguous").otherwise("verified")
    return q.select(
        F.col("vec_id").cast("string").alias("image_path"), F.sha2(F.col("vec_id").cast("string"), 256).alias("image_sha256"), status.alias("status"),
        F.when(status == "verified", F.col("label").cast("string")).alias("slug"), F.lit("label").alias("evidence"),
    )


PHOTO_LABELS = f"""photo_labels AS (
  SELECT CAST(vec_id AS VARCHAR) AS image_path, sha256(CAST(vec_id AS VARCHAR)) AS image_sha256,
    CASE (vec_id // {EVERY}) % 5 WHEN 3 THEN 'unknown' WHEN 4 THEN 'ambiguous' ELSE 'verified' END AS status,
    CASE WHEN (vec_id // {EVERY}) % 5 < 3 THEN CAST(label AS VARCHAR) END AS slug, 'label' AS evidence FROM embeddings WHERE vec_id % {EVERY} = 0)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The classes of the five nearest images as predicted slugs, and a latency; written, as several checks read them."""
    found = retrieval.search(whole_queries(spark, sf), gallery(spark, sf), 5)
    top = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x.label.cast("string"))
    rows = found.groupBy("query_id").agg(top.alias("top5_slugs"), F.max("score").alias("score"))
    guesses = rows.select(
        F.col("query_id").cast("string").alias("image_path"), F.sha2(F.col("query_id").cast("string"), 256).alias("image_sha256"),
        F.get("top5_slugs", F.lit(0)).alias("predicted_slug"), "top5_slugs", F.col("score").alias("confidence"),
        (F.col("query_id") % 97 + 100).alias("latency_ms"), (F.col("query_id") % 3 == 0).alias("ocr_used"), (F.col("query_id") % 4 == 0).alias("verifier_used"),
    )
    return written(guesses, "predictions")


PREDICTIONS = f"""{UNITS}, near AS (
  SELECT q.vec_id AS query_id, g.vec_id, g.label, round(list_inner_product(q.embedding, g.embedding), 6) AS score
  FROM units q JOIN units g ON q.vec_id % {EVERY} = 0 AND q.vec_id <> g.vec_id
), five AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near QUALIFY rank <= 5
), predictions AS (
  SELECT CAST(query_id AS VARCHAR) AS image_path, list(CAST(label AS VARCHAR) ORDER BY rank) AS top5_slugs, max(score) AS confidence,
    query_id % 97 + 100 AS latency_ms, query_id % 3 = 0 AS ocr_used, query_id % 4 = 0 AS verifier_used FROM five GROUP BY query_id
), judged AS (
  SELECT p.*, top5_slugs[1] AS predicted_slug, l.status, l.slug,
    CASE WHEN status = 'verified' THEN top5_slugs[1] = slug END AS top1_correct, CASE WHEN status = 'verified' THEN list_contains(top5_slugs, slug) END AS top5_correct
  FROM predictions p JOIN photo_labels l ON p.image_path = l.image_path)"""


def part_cards(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    return parts.select(
        F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_partkey")).alias("slug"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("winery"), F.col("p_type").alias("grape"), F.lit(True).alias("reference_available"), "p_partkey", "p_type", "p_size",
    )


PARTS = r"""part_cards AS (
  SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS slug, p_name AS name, p_brand AS winery, p_type AS grape, p_partkey, p_type, p_size FROM part
), fields AS (
  SELECT slug, unnest([name, winery, grape]) AS field FROM part_cards
), word_lists AS (
  SELECT slug, list_transform(regexp_extract_all(lower(field), '[a-z0-9]+'), lambda w: replace(w, 'c', 'k')) AS ws, true AS joined FROM fields
  UNION ALL SELECT slug, list_transform(string_split(slug, '-'), lambda w: replace(w, 'c', 'k')), false FROM part_cards
), raw_fragments AS (
  SELECT slug, unnest(ws) AS fragment FROM word_lists
  UNION ALL SELECT slug, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ws[i + 1])) FROM word_lists
  UNION ALL SELECT slug, array_to_string(ws, '') FROM word_lists WHERE joined
), fragments AS (
  SELECT DISTINCT slug, fragment FROM raw_fragments
  WHERE length(fragment) >= 4 AND (NOT regexp_full_match(fragment, '[0-9]+') OR regexp_full_match(fragment, '(19|20)[0-9]{2}'))
), idf AS (
  SELECT fragment, count(*) AS frequency, ln(((SELECT count(*) FROM part) + 1.0::DOUBLE) / (count(*) + 1)) AS idf FROM fragments GROUP BY fragment)"""


def label_lines(rows: DataFrame) -> DataFrame:
    """Two lines seen on every fiftieth part."""
    lines = F.array(
        F.struct(F.lit(1).alias("line_no"), F.col("name").alias("text"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit(2).alias("line_no"), F.col("winery").alias("text"), F.lit(0.75).alias("confidence")),
    )
    return rows.where(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("query_id"), F.inline(lines))


def label_pools(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of every fiftieth part are the parts of its type and size: query_id, pool and pool, slug."""
    pool = F.concat("p_type", F.lit("|"), "p_size").alias("pool")
    return rows.where(F.col("p_partkey") % EVERY == 0).select(F.col("p_partkey").alias("query_id"), pool), rows.select(pool, "slug")


def label_candidates(rows: DataFrame) -> DataFrame:
    """The pairs of label_pools: query_id, slug."""
    asked, pools = label_pools(rows)
    return asked.join(pools, "pool").select("query_id", "slug")


def label_scores(spark: SparkSession, sf: str, exact: bool) -> DataFrame:
    """Lexical scores of the label lines; fragments are used three times, so they are written once."""
    rows = part_cards(spark, sf)
    parts = written(text.card_fragments(rows), "fragments")
    idf = text.fragment_idf(parts, table(spark, sf, "part").count())
    asked, pools = label_pools(rows)
    return text.lexical_scores(label_lines(rows), asked, parts, idf, exact=exact, pools=pools).withColumn("lexical", F.round("lexical", 6))


# ---- queries ----

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS length,
  round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS first_number FROM embeddings"""
)
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(F.get(vectors.unit(F.col("embedding")), F.lit(0)), 6).alias("first_number"))


@query(f"WITH {RANKED} SELECT query_id, CAST(image_rank AS INT) AS rank, image_name, score FROM images WHERE image_rank <= 5")
def gallery_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.search(whole_queries(spark, sf), gallery(spark, sf), 5).select("query_id", "rank", "image_name", "score")


_CROP = "greatest(" + ", ".join(f"list_inner_product(q.v[{{c}}], g.v[{v}])" for v in range(1, 5)) + ")"


@query(
    f"""WITH cut AS (
  SELECT vec_id, [CAST(embedding[1:16] AS DOUBLE[]), CAST(embedding[17:32] AS DOUBLE[]), CAST(embedding[33:48] AS DOUBLE[]), CAST(embedding[49:64] AS DOUBLE[])] AS v FROM embeddings
), parts AS (SELECT vec_id, list_transform(v, lambda p: list_transform(p, lambda x: x / sqrt(list_inner_product(p, p)))) AS v FROM cut
), scored AS (SELECT q.vec_id AS query_id, g.vec_id AS image_name, round(({' + '.join(_CROP.format(c=c) for c in (1, 2, 3))}) / 3, 6) AS score
  FROM parts q JOIN parts g ON q.vec_id % {EVERY} = 0 AND q.vec_id <> g.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_name) AS INT) AS rank, image_name, score FROM scored QUALIFY rank <= 7"""
)
def multiview_search(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    rows = table(spark, sf, "embeddings")
    q = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.slice(parts, 1, 3).alias("crops"))
    return retrieval.search(q, rows.select(F.col("vec_id").alias("image_name"), parts.alias("views")), 7)


@query(f"WITH {RANKED} SELECT query_id, CAST(rank AS INT) AS rank, slug, score, image_name FROM ranked WHERE rank <= 5")
def slug_expansion_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.expand_slugs(retrieval.search(whole_queries(spark, sf), gallery(spark, sf), 5), 5)


@query(f"WITH {RANKED}, {FUSED} SELECT query_id, CAST(rank AS INT) AS rank, slug, round(log_p, 6) AS log_p, round(fused, 6) AS fused, CAST(new_rank AS INT) AS new_rank FROM placed")
def verifier_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = rerank.fuse_verifier(rerank.log_softmax(with_logits(spark, sf)))
    return rows.select("query_id", "rank", "slug", F.round("log_p", 6).alias("log_p"), F.round("fused", 6).alias("fused"), "new_rank")


@query(
    f"""WITH {RANKED}, used AS (SELECT *, round(max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY query_id) - max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY query_id), 9)
  < 0.015::DOUBLE AS used FROM ranked), f AS (SELECT *, score + CASE WHEN used AND label = query_label THEN 0.03::DOUBLE * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS fused FROM used)
SELECT query_id, slug, used, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN used THEN round(fused, 9) END DESC NULLS LAST, rank) AS INT) AS new_rank FROM f"""
)
def lexical_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranked(spark, sf)
    lexical = rows.where(F.col("label") == F.col("query_label")).select("query_id", "slug", F.lit(0.5).alias("lexical"))
    return rerank.fuse_lexical(rows, lexical).select("query_id", "slug", "used", F.round("fused", 6).alias("fused"), "new_rank")


@query(
    f"""WITH {RANKED}, {FUSED} SELECT query_id, max(CASE WHEN new_rank = 1 THEN slug END) AS slug, round(max(CASE WHEN new_rank = 1 THEN probability END), 6) AS confidence,
  CASE WHEN max(CASE WHEN new_rank = 1 THEN probability END) >= 0.7 THEN 'confident' ELSE 'check_alternatives' END AS verdict,
  round(max(CASE WHEN new_rank = 1 THEN fused END) - max(CASE WHEN new_rank = 2 THEN fused END), 6) AS margin_to_second,
  round(max(CASE WHEN new_rank = 1 THEN score END), 6) AS visual_similarity,
  array_to_string(list(slug ORDER BY new_rank) FILTER (new_rank <= 5), ',') AS top5 FROM rated GROUP BY query_id"""
)
def confidence_verdict(spark: SparkSession, sf: str) -> DataFrame:
    logits = with_logits(spark, sf).select("query_id", "slug", "logit")
    found = plans.predict(ranked(spark, sf), logits)
    top = F.array_join(F.transform("top5", lambda x: x.slug), ",")
    return found.select(
        "query_id", "slug", F.round("confidence", 6).alias("confidence"), "verdict", F.round("margin_to_second", 6).alias("margin_to_second"),
        F.round("visual_similarity", 6).alias("visual_similarity"), top.alias("top5"),
    )


@query(f"WITH {RANKED} SELECT query_id, max(CASE WHEN rank = 1 THEN image_name END) = max(CASE WHEN rank = 2 THEN image_name END) AS shared_reference FROM ranked GROUP BY query_id")
def shared_reference_flag(spark: SparkSession, sf: str) -> DataFrame:
    return plans.predict(ranked(spark, sf)).select("query_id", "shared_reference")


@query("SELECT md5(text) AS slug, count(*) AS source_rows, min((lang, n_chars)) <> max((lang, n_chars)) AS conflict FROM documents GROUP BY md5(text)")
def catalog_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("slug"), "lang", "n_chars")
    return catalog.card_variants(rows, "slug", ["lang", "n_chars"]).select("slug", "source_rows", "conflict")


@query("SELECT p_name AS slug, count(*) AS source_rows FROM part GROUP BY p_name HAVING min((p_brand, p_type)) <> max((p_brand, p_type))")
def catalog_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").withColumnRenamed("p_name", "slug")
    return catalog.card_variants(rows, "slug", ["p_brand", "p_type"]).where("conflict").select("slug", "source_rows")


@query(f"WITH {CARDS} SELECT image_name AS filename, array_to_string(list_sort(list(slug)), ',') AS slugs FROM cards WHERE reference_available GROUP BY image_name")
def manifest_images(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.reference_images(cards(spark, sf)).withColumn("slugs", F.array_join("slugs", ","))


_COUNTS = """SELECT CAST(sum(n) AS BIGINT) AS unique_cards, CAST(sum(i) AS BIGINT) AS indexed_cards, count(*) FILTER (i > 0) AS reference_images, count(*) FILTER (i > 1) AS shared_reference_images,
  CAST(sum(n - i) AS BIGINT) AS excluded_cards FROM (SELECT image_name, count(*) AS n, count(*) FILTER (reference_available) AS i FROM {cards} GROUP BY image_name)"""


@query(f"WITH {CARDS} {_COUNTS.format(cards='cards')}")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.manifest_counts(cards(spark, sf))


@query(f"WITH {CARDS} SELECT slug FROM cards WHERE NOT reference_available")
def excluded_cards(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.excluded_cards(cards(spark, sf))


def _fixes(rows: DataFrame) -> DataFrame:
    """A fix for every third card; those of unavailable cards break a precondition."""
    due = rows.where(F.col("slug").cast("long") % 3 == 0)
    return due.select("slug", F.col("image_name").alias("from_image"), F.concat(F.lit("fixed-"), F.col("winery"), F.lit(".png")).alias("target_image"))


_FIXED = """fixed AS (SELECT slug, CASE WHEN CAST(slug AS BIGINT) % 3 = 0 AND reference_available THEN 'fixed-' || winery || '.png' ELSE image_name END AS image_name, reference_available FROM cards)"""


@query(f"WITH {CARDS}, {_FIXED} SELECT slug, image_name FROM fixed")
def reference_fixes(spark: SparkSession, sf: str) -> DataFrame:
    rows = cards(spark, sf)
    return catalog.apply_fixes(rows, _fixes(rows)).select("slug", "image_name")


@query(f"WITH {CARDS}, {_FIXED} {_COUNTS.format(cards='fixed')}")
def fixed_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = cards(spark, sf)
    return catalog.manifest_counts(catalog.apply_fixes(rows, _fixes(rows)))


@query(f"WITH {CARDS} SELECT slug AS key, 'source image differs' AS rule FROM cards WHERE CAST(slug AS BIGINT) % 3 = 0 AND NOT reference_available")
def fix_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = cards(spark, sf)
    return catalog.fix_violations(rows, _fixes(rows))


@query(f"WITH {CARDS}, {TERMS} SELECT term, df, occurrences FROM frequencies")
def term_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return text.document_frequencies(text.term_counts(cards(spark, sf), WORD, []))


@query(f"WITH {CARDS}, {TERMS} SELECT slug, term, round(weight, 6) AS weight FROM profiles")
def tfidf_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile_tables(spark, sf)[1].select("slug", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {CARDS}, {TERMS}, {SIMILAR} SELECT base, slug, round(text / 1e12::DOUBLE, 6) AS text, coalesce(array_to_string(notes, ','), '') AS notes FROM alike")
def text_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows, weights = profile_tables(spark, sf)
    found = text.text_similarity(weights.join(base_slugs(rows), "slug"), weights, adjective=ENDING)
    return found.select("base", "slug", F.round("text", 6).alias("text"), F.array_join("notes", ",").alias("notes"))


ALIKE_TEXTS = 0.6


@query(
    f"""WITH {CARDS}, {TERMS}, vectors AS (SELECT slug, list((term, weight) ORDER BY term) AS vector FROM profiles GROUP BY slug
), named AS (SELECT slug, min(slug) OVER (PARTITION BY vector) AS profile FROM vectors), firsts AS (SELECT p.* FROM profiles p JOIN named n ON n.slug = p.slug AND n.profile = p.slug
), met AS (SELECT a.slug AS a, b.slug AS b, CAST(sum(CAST(floor(a.weight * b.weight * 1e12::DOUBLE) AS BIGINT)) AS BIGINT) AS units FROM firsts a JOIN firsts b ON a.term = b.term AND a.slug < b.slug GROUP BY a.slug, b.slug
) SELECT a, b, round(units / 1e12::DOUBLE, 6) AS text FROM met WHERE units >= {round(ALIKE_TEXTS * 10**12)}"""
)
def alike_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of different profiles that are alike."""
    return text.cosine_join(profile_tables(spark, sf)[1], ALIKE_TEXTS).select("a", "b", F.round("text", 6).alias("text"))


@query(
    f"""WITH {CARDS}, {TERMS}, vectors AS (SELECT slug, list((term, weight) ORDER BY term) AS vector FROM profiles GROUP BY slug)
SELECT slug, min(slug) OVER (PARTITION BY vector) AS profile FROM vectors"""
)
def same_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return text.same_profiles(profile_tables(spark, sf)[1])


@query(f"WITH {PARTS} SELECT slug, fragment FROM fragments")
def ocr_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return text.card_fragments(part_cards(spark, sf))


@query(f"WITH {PARTS} SELECT fragment, frequency, round(idf, 6) AS idf FROM idf")
def fragment_idf(spark: SparkSession, sf: str) -> DataFrame:
    rows = part_cards(spark, sf)
    return text.fragment_idf(text.card_fragments(rows), table(spark, sf, "part").count()).withColumn("idf", F.round("idf", 6))


_LINES = f"""lines AS (
  SELECT p_partkey AS query_id, 1 AS line_no, name AS line, 0.9::DOUBLE AS confidence FROM part_cards WHERE p_partkey % {EVERY} = 0
  UNION ALL SELECT p_partkey, 2, winery, 0.75::DOUBLE FROM part_cards WHERE p_partkey % {EVERY} = 0
), tokens AS (SELECT *, replace(regexp_replace(lower(line), '[^a-z0-9]', '', 'g'), 'c', 'k') AS token FROM lines
), pool AS (SELECT q.p_partkey AS query_id, c.slug FROM part_cards q JOIN part_cards c ON q.p_type = c.p_type AND q.p_size = c.p_size WHERE q.p_partkey % {EVERY} = 0
), hits AS (SELECT t.query_id, p.slug, confidence * i.idf AS worth FROM tokens t JOIN pool p ON t.query_id = p.query_id
  JOIN fragments f ON f.slug = p.slug AND f.fragment = t.token JOIN idf i ON i.fragment = f.fragment WHERE length(token) BETWEEN 4 AND 35)"""


@query(f"WITH {PARTS}, {_LINES} SELECT query_id, slug, round(list_sum(list_sort(list(worth), 'DESC')[1:3]), 6) AS lexical FROM hits GROUP BY query_id, slug")
def lexical_score_exact(spark: SparkSession, sf: str) -> DataFrame:
    return label_scores(spark, sf, exact=True)


_RATIOS = _LINES.split("), hits AS")[0] + """), compared AS (
  SELECT DISTINCT token, fragment, (1::BIGINT << length(token)) - 1 AS f FROM tokens t JOIN pool p ON t.query_id = p.query_id JOIN fragments g ON g.slug = p.slug WHERE length(token) BETWEEN 4 AND 35
), masked AS (
  SELECT token, fragment, f, list_transform(string_split(fragment, ''), lambda c: CAST(list_sum(list_transform(range(length(token)), lambda i: CASE WHEN token[i + 1] = c THEN 1::BIGINT << i ELSE 0::BIGINT END)) AS BIGINT)) AS ms FROM compared
), ratios AS (
  SELECT token, fragment, 200.0::DOUBLE * (length(token) - bit_count(list_reduce(list_concat([f], ms), lambda v, m: ((v + (v & m)) | (v - (v & m))) & f))) / (length(token) + length(fragment)) AS similarity FROM masked
), near AS (SELECT * FROM ratios WHERE similarity >= CASE WHEN length(token) <= 4 THEN 98 WHEN length(token) <= 6 THEN 93 ELSE 90 END
)"""  # the longest common subsequence letter by letter, a bit for each place of the token


@query(
    f"""WITH {PARTS}, {_RATIOS}, found AS (
  SELECT t.query_id, p.slug, t.line_no, confidence, n.fragment, n.similarity FROM tokens t JOIN near n ON n.token = t.token JOIN pool p ON p.query_id = t.query_id JOIN fragments g ON g.slug = p.slug AND g.fragment = n.fragment
  QUALIFY row_number() OVER (PARTITION BY t.query_id, p.slug, t.line_no ORDER BY n.similarity DESC, n.fragment DESC) = 1
), worths AS (SELECT query_id, slug, confidence * i.idf * similarity / 100 AS worth FROM found f JOIN idf i ON i.fragment = f.fragment)
SELECT query_id, slug, round(list_sum(list_sort(list(worth), 'DESC')[1:3]), 6) AS lexical FROM worths GROUP BY query_id, slug"""
)
def lexical_score_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return label_scores(spark, sf, exact=False)


@query(
    f"""WITH {CARDS}, {FEATURES} SELECT slug, color, sparkling, sweetness, array_to_string(list_sort(grapes), ',') AS grapes,
  CASE WHEN contains(name, 'полуслад') THEN 'полусладкое' WHEN contains(name, 'брют') THEN 'брют' WHEN contains(name, 'сух') THEN 'сухое'
    WHEN regexp_matches(lower(image_name || ' ' || substr(description, 1, 400)), 'bryut') THEN 'брют'
    WHEN regexp_matches(lower(substr(description, 1, 400)), 'suh') THEN 'сухое' ELSE 'не указана' END AS stated,
  CASE WHEN contains(name, 'полуслад') THEN 'off_dry' WHEN contains(name, 'брют') THEN 'sparkling' WHEN contains(lower(category), 'красн') THEN 'red'
    WHEN contains(lower(category), 'розов') THEN 'rose' WHEN contains(lower(category), 'оранж') THEN 'orange' ELSE 'white' END AS style FROM features"""
)
def card_attributes(spark: SparkSession, sf: str) -> DataFrame:
    rows = cards(spark, sf)
    return rows.select(
        "slug", card.color_key().alias("color"), card.is_sparkling().alias("sparkling"), card.sweetness_level().alias("sweetness"),
        F.array_join(F.array_sort(card.grape_set()), ",").alias("grapes"), card.stated_sweetness().alias("stated"), card.pairing_style().alias("style"),
    )


@query(
    f"""WITH {CARDS}, {FEATURES} SELECT a.slug AS base, b.slug, round(CASE WHEN len(list_distinct(list_concat(a.grapes, b.grapes))) > 0
  THEN len(list_intersect(a.grapes, b.grapes)) / CAST(len(list_distinct(list_concat(a.grapes, b.grapes))) AS DOUBLE) ELSE 0 END, 6) AS jaccard
FROM features a JOIN features b ON a.winery = b.winery AND a.slug <> b.slug WHERE CAST(a.slug AS BIGINT) % {EVERY} = 0"""
)
def grape_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(recommend.card_features(cards(spark, sf)).select("slug", "winery", "grapes"), "grapes")
    return overlaps(rows.where(F.col("slug").cast("long") % EVERY == 0), rows, ["winery"], 6)


def _shown_sql(units: str) -> str:
    """A score in units as it is shown."""
    return f"(({units} + 50000000) // 100000000) / 10000.0::DOUBLE"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_STYLED = """styled AS (SELECT slug, description, CASE WHEN contains(name, 'полуслад') THEN 'off_dry' WHEN contains(name, 'брют') THEN 'sparkling' WHEN contains(lower(category), 'красн') THEN 'red'
    WHEN contains(lower(category), 'розов') THEN 'rose' WHEN contains(lower(category), 'оранж') THEN 'orange' ELSE 'white' END AS style FROM cards)"""
_RULES = f"rules(style, place, dish, reason) AS (VALUES {_values(fixed.PAIRINGS)})"
_DISHES = f"dishes(dish, label) AS (VALUES {_values(list(fixed.DISHES.items()))})"


@query(
    f"""WITH {CARDS}, {_STYLED}, {_RULES}, {_DISHES} SELECT slug, s.style, place, r.dish, label, reason ||
  CASE WHEN r.dish IN ('fish', 'seafood') AND contains(lower(description), '{fixed.ACIDITY_STEM}') THEN '{fixed.ACIDITY_REASON}' ELSE '' END ||
  CASE WHEN r.dish = 'red_meat' AND contains(lower(description), '{fixed.TANNIN_STEM}') THEN '{fixed.TANNIN_REASON}' ELSE '' END AS reason
FROM styled s JOIN rules r ON s.style = r.style JOIN dishes d ON d.dish = r.dish"""
)
def pairing_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return pairing.suggestions(cards(spark, sf))


@query(
    f"""WITH {CARDS}, {_STYLED}, {_RULES}, {_DISHES} SELECT slug, s.style, coalesce(r.place, 0) AS place, CASE WHEN r.place <= 2 THEN '{fixed.FITS[0]}' WHEN r.place = 3 THEN '{fixed.FITS[1]}' ELSE '{fixed.FITS[2]}' END AS fit,
  coalesce(r.reason, '{fixed.UNSURE_REASON}') || CASE WHEN contains(lower(description), '{fixed.ACIDITY_STEM}') THEN '{fixed.ACIDITY_REASON}' ELSE '' END ||
  CASE WHEN r.place IS NULL THEN '{fixed.BETTER_DISH}' || lower(d.label) || '.' ELSE '' END AS reason
FROM styled s LEFT JOIN rules r ON s.style = r.style AND r.dish = 'fish' JOIN rules f ON f.style = s.style AND f.place = 1 JOIN dishes d ON d.dish = f.dish"""
)
def pairing_fit(spark: SparkSession, sf: str) -> DataFrame:
    found = pairing.dish_fit(cards(spark, sf), "fish")
    return found.select("slug", "style", F.coalesce("place", F.lit(0)).alias("place"), "fit", "reason")


_ANALOGUES = f"""pairs AS (
  SELECT a.slug AS base, b.slug, b.winery, list_sort(list_intersect(a.grapes, b.grapes)) AS common, len(list_distinct(list_concat(a.grapes, b.grapes))) AS u,
    coalesce(a.sweetness = b.sweetness, false) AS same_sweetness, b.sweetness, a.region = b.region AS same_region, b.region, coalesce(s.text, 0) AS text, s.notes
  FROM features a JOIN features b ON a.color = b.color AND a.sparkling = b.sparkling AND a.winery <> b.winery AND a.slug <> b.slug AND b.available
  LEFT JOIN alike s ON s.base = a.slug AND s.slug = b.slug WHERE CAST(a.slug AS BIGINT) % {EVERY} = 0
), scored AS (
  SELECT base, slug, winery, CASE WHEN u > 0 THEN 3000000000000 * len(common) // u ELSE 0 END + 1500000000000 * CAST(same_sweetness AS INT) + 700000000000 * CAST(same_region AS INT) + 3 * text AS units,
    list_filter([CASE WHEN len(common) > 0 THEN 'тот же сорт: ' || array_to_string(common[1:2], ', ') END, CASE WHEN same_sweetness THEN 'тоже ' || sweetness END,
      CASE WHEN same_region AND region <> '' THEN 'тоже ' || region END, CASE WHEN text > 50000000000 AND len(notes) > 0 THEN 'похожие ноты: ' || array_to_string(notes, ', ') END], lambda x: x IS NOT NULL) AS rs FROM pairs
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY base, winery ORDER BY units DESC, slug) = 1)"""


@query(
    f"""WITH {CARDS}, {FEATURES}, {TERMS.replace('best', 'best_terms')}, {SIMILAR}, {_ANALOGUES}
SELECT base, CAST(row_number() OVER (PARTITION BY base ORDER BY units DESC, slug) AS INT) AS place, slug, {_shown_sql("units")} AS score,
  CASE WHEN len(rs) > 0 THEN array_to_string(rs, '; ') ELSE 'тот же стиль вина' END AS reasons FROM best QUALIFY place <= 4"""
)
def analogues(spark: SparkSession, sf: str) -> DataFrame:
    rows, weights = profile_tables(spark, sf)
    found = recommend.analogues(recommend.card_features(rows), base_slugs(rows), weights, adjective=ENDING)
    return found.withColumn("reasons", F.array_join("reasons", "; "))


def _sommelier_sql(where: str, level_shown: bool, offset: int, note: str | None, dish: bool) -> str:
    level = "coalesce(f.sweetness, CASE WHEN NOT sparkling THEN 'сухое' END)"
    fit = "CASE WHEN r.place <= 2 THEN 30 WHEN r.place = 3 THEN 15 ELSE 0 END" if dish else "0"
    mention = "contains(lower(f.description), 'рыб')"
    score = f"({fit} + 20 * CAST({mention} AS INT)) * 100000000000" if dish else "0"
    label = fixed.DISHES["fish"].lower()
    reasons = [level if level_shown else "NULL"]
    if dish:
        reasons.append(f"CASE WHEN {mention} THEN 'описание советует: {label}' WHEN {fit} = 30 THEN '{label}: {fixed.FITS[0]}' WHEN {fit} = 15 THEN '{label}: {fixed.FITS[1]}' END")
    return f"""WITH {CARDS}, {FEATURES}, {_STYLED}, {_RULES}, chosen AS (
  SELECT f.slug, f.winery, {score} + 1000000000000 * least(length(f.description), 600) // 1200 AS units, list_filter([{', '.join(reasons)}], lambda x: x IS NOT NULL) AS rs
  FROM features f JOIN styled s ON f.slug = s.slug LEFT JOIN rules r ON r.style = s.style AND r.dish = 'fish' WHERE available AND {where.replace('LEVEL', level)}
), one AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY winery ORDER BY units DESC, slug) = 1)
SELECT CAST(row_number() OVER (ORDER BY units DESC, slug) AS INT) AS place, slug, {_shown_sql("units")} AS score, CASE WHEN len(rs) > 0 THEN array_to_string(rs, '; ') ELSE 'подходит под ваши ответы' END AS reasons,
  (SELECT count(*) FROM one) AS total, {f"'{note}'" if note else 'CAST(NULL AS VARCHAR)'} AS note FROM one QUALIFY place > {offset} AND place <= {offset + 3}"""


def _picks(found: DataFrame) -> DataFrame:
    return found.withColumn("reasons", F.array_join("reasons", "; "))


@query(_sommelier_sql("color = 'white' AND NOT sparkling AND LEVEL = 'сухое'", True, 0, None, True))
def sommelier(spark: SparkSession, sf: str) -> DataFrame:
    return _picks(recommend.sommelier_for_cards(cards(spark, sf), dish="fish", color="white", sweetness="dry"))


@query(_sommelier_sql("sparkling", False, 0, f"Вин с такой сладостью {fixed.COLOR_PHRASES['sparkling']} нет — показываю ближайшие без учёта сладости.", False))
def sommelier_relaxed(spark: SparkSession, sf: str) -> DataFrame:
    return _picks(recommend.sommelier_for_cards(cards(spark, sf), color="sparkling", sweetness="sweet"))


@query(_sommelier_sql("color = 'red' AND NOT sparkling", False, 3, None, False))
def sommelier_page2(spark: SparkSession, sf: str) -> DataFrame:
    return _picks(recommend.sommelier_for_cards(cards(spark, sf), color="red", offset=3))


@query(
    f"""WITH {CARDS}, {FEATURES} SELECT 0 AS place, CAST(NULL AS VARCHAR) AS slug, 0.0::DOUBLE AS score, CAST(NULL AS VARCHAR) AS reasons,
  count(DISTINCT winery) AS total, CAST(NULL AS VARCHAR) AS note FROM features WHERE available AND color = 'red' AND NOT sparkling"""
)
def sommelier_empty_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page beyond the last one still says how many there are."""
    return _picks(recommend.sommelier_for_cards(cards(spark, sf), color="red", offset=1_000_000)).fillna(0, ["place", "score"])


@query(
    f"""WITH {CARDS}, {FEATURES}, {TERMS.replace('best', 'best_terms')}, {SIMILAR}, liked AS (SELECT grapes AS g FROM features WHERE slug = '0'
), chosen AS (
  SELECT f.slug, winery, list_sort(list_intersect(grapes, g)) AS common, len(list_distinct(list_concat(grapes, g))) AS u, coalesce(a.text, 0) AS text, description
  FROM features f CROSS JOIN liked LEFT JOIN alike a ON a.base = '0' AND a.slug = f.slug WHERE available AND f.slug <> '0'
), scored AS (SELECT slug, winery, common,
  3 * text + CASE WHEN u > 0 THEN 2000000000000 * len(common) // u ELSE 0 END + 1000000000000 * least(length(description), 600) // 1200 AS units FROM chosen
), one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY winery ORDER BY units DESC, slug) = 1)
SELECT CAST(row_number() OVER (ORDER BY units DESC, slug) AS INT) AS place, slug, {_shown_sql("units")} AS score,
  CASE WHEN len(common) > 0 THEN 'тот же сорт: ' || array_to_string(common[1:2], ', ') ELSE 'подходит под ваши ответы' END AS reasons,
  (SELECT count(*) FROM one) AS total, CAST(NULL AS VARCHAR) AS note FROM one QUALIFY place <= 3"""
)
def sommelier_like(spark: SparkSession, sf: str) -> DataFrame:
    rows, weights = profile_tables(spark, sf)
    return _picks(recommend.sommelier(recommend.card_features(rows), like="0", profiles=weights))


_NO_DISH = f"Прямых рекомендаций к блюду «{fixed.DISHES['dessert'].lower()}» среди таких вин нет; к нему обычно берут {fixed.TYPICAL['dessert']}. Вот ближайшие по стилю."


@query(_sommelier_sql("color = 'red' AND NOT sparkling AND coalesce(f.sweetness, '') <> 'полусладкое'", False, 0, _NO_DISH, False))
def sommelier_no_dish(spark: SparkSession, sf: str) -> DataFrame:
    """No red wine that isn't sweet goes with dessert by the rules, and no text speaks of it: the answer says so."""
    rows = cards(spark, sf).where(~F.contains("name", F.lit("полуслад")))
    return _picks(recommend.sommelier_for_cards(rows, dish="dessert", color="red"))


@query(
    f"""WITH {CARDS}, {TERMS}, stop(term) AS (VALUES ('that'), ('this'), ('with'), ('from'))
SELECT slug, term, tf FROM counts WHERE term NOT IN (SELECT term FROM stop)"""
)
def term_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    return text.term_counts(cards(spark, sf), WORD, ["that", "this", "with", "from"]).select("slug", "term", "tf")


def _raw_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as they come: only every second has a slug, some have no evidence."""
    rows = table(spark, sf, "labels")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("toxic") == 1, "ambiguous").otherwise("unknown")
    return rows.select(
        F.col("doc_id").cast("string").alias("image_path"), F.sha2(F.col("doc_id").cast("string"), 256).alias("image_sha256"), status.alias("status"),
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("slug"), F.when(F.col("doc_id") % 7 > 0, "seen").alias("evidence"),
    )


_RAW_LABELS = """raw_labels AS (SELECT CAST(doc_id AS VARCHAR) AS image_path, CASE WHEN quality = 1 THEN 'verified' WHEN toxic = 1 THEN 'ambiguous' ELSE 'unknown' END AS status,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) END AS slug, CASE WHEN doc_id % 7 > 0 THEN 'seen' END AS evidence FROM labels)"""


@query(
    f"""WITH {_RAW_LABELS} SELECT image_path AS key, 'slug does not go with the status' AS rule FROM raw_labels WHERE (slug IS NOT NULL) <> (status = 'verified')
UNION ALL SELECT image_path, 'evidence is missing' FROM raw_labels WHERE evidence IS NULL"""
)
def label_violations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.label_violations(_raw_labels(spark, sf))


@query(
    f"""WITH {_RAW_LABELS} SELECT CAST(doc_id AS VARCHAR) AS key, 'no label' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CAST(count(*) AS VARCHAR), 'number of labels' FROM raw_labels HAVING count(*) <> 100
UNION ALL SELECT image_path, 'no such photo' FROM raw_labels WHERE CAST(image_path AS BIGINT) NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT slug, 'no such card' FROM raw_labels WHERE status = 'verified' AND slug IS NULL"""
)
def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    photos = docs.select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"))
    return checks.full_coverage(_raw_labels(spark, sf), photos, docs.select(F.col("doc_id").cast("string").alias("slug")), 100)


def _broken_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of which some lack a slug, hold six, an empty one or another first one."""
    n, top = F.floor(F.col("image_path").cast("long") / EVERY) % 5, F.col("top5_slugs")
    broken = F.when(n == 1, F.concat(top, F.array(F.lit("x")))).when(n == 2, F.concat(F.slice(top, 1, 4), F.array(F.lit(""))))
    return predictions(spark, sf).withColumn("top5_slugs", F.coalesce(broken.when(n == 3, F.array().cast("array<string>")), top)).withColumn(
        "predicted_slug", F.when(n == 4, "other").otherwise(F.col("predicted_slug"))
    )


@query(
    f"""WITH {PHOTO_LABELS}, {PREDICTIONS}, n AS (SELECT image_path AS key, (CAST(image_path AS BIGINT) // {EVERY}) % 5 AS n FROM judged)
SELECT key, 'top five has not one to five slugs' AS rule FROM n WHERE n IN (1, 3) UNION ALL SELECT key, 'top five has an empty slug' FROM n WHERE n = 2
UNION ALL SELECT key, 'first of the top five differs' FROM n WHERE n IN (3, 4)"""
)
def prediction_violations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.prediction_violations(_broken_predictions(spark, sf))


@query(
    f"""WITH {RANKED} SELECT query_id AS key, 'file differs from the card''s' AS rule FROM ranked WHERE (2 * image_name) % 7 = 0"""
)
def ranking_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranked(spark, sf).select(F.col("query_id").alias("name"), "rank", "slug", F.col("image_name").cast("string").alias("filename"))
    known = gallery(spark, sf).select(F.explode("slugs").alias("slug"), F.when((2 * F.col("image_name")) % 7 > 0, F.col("image_name").cast("string")).alias("image_name"))
    return checks.ranking_violations(rows, known, 20).withColumn("key", F.col("key").cast("long"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS key, 'only left' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'only right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def key_differences(spark: SparkSession, sf: str) -> DataFrame:
    return checks.same_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


_ACCURACY = """count(*) FILTER (status = 'verified') AS verified_labels, count(*) FILTER (status = 'unknown') AS unknown_labels, count(*) FILTER (status = 'ambiguous') AS ambiguous_labels,
  count(*) FILTER (top1_correct) AS top1_correct, count(*) FILTER (top5_correct) AS top5_correct"""
_SHARES = """round(count(*) FILTER (top1_correct) / CAST(count(*) FILTER (status = 'verified') AS DOUBLE), 6) AS top1_accuracy,
  round(count(*) FILTER (top5_correct) / CAST(count(*) FILTER (status = 'verified') AS DOUBLE), 6) AS top5_accuracy"""


@query(f"WITH {PHOTO_LABELS}, {PREDICTIONS} SELECT count(*) AS labels, {_ACCURACY}, {_SHARES} FROM judged")
def score_top1_top5(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = evaluation.score(predictions(spark, sf), photo_labels(spark, sf))
    return found.withColumn("top1_accuracy", F.round("top1_accuracy", 6)).withColumn("top5_accuracy", F.round("top5_accuracy", 6))


@query(f"WITH {PHOTO_LABELS}, {PREDICTIONS} SELECT image_path, slug AS verified_slug, predicted_slug FROM judged WHERE NOT top1_correct")
def score_errors(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score(predictions(spark, sf), photo_labels(spark, sf))[1]


@query(
    f"""WITH {PHOTO_LABELS}, {PREDICTIONS} SELECT count(*) AS images, {_ACCURACY}, count(*) FILTER (ocr_used) AS ocr_invocations, count(*) FILTER (verifier_used) AS verifier_invocations, {_SHARES},
  CAST(round_even(quantile_cont(latency_ms, 0.5), 0) AS BIGINT) AS p50_latency_ms, CAST(round_even(quantile_cont(latency_ms, 0.95), 0) AS BIGINT) AS p95_latency_ms,
  CAST(round_even(avg(latency_ms), 0) AS BIGINT) AS mean_latency_ms FROM judged"""
)
def evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.evaluation_summary(predictions(spark, sf), photo_labels(spark, sf))
    return found.withColumn("top1_accuracy", F.round("top1_accuracy", 6)).withColumn("top5_accuracy", F.round("top5_accuracy", 6))


@query(
    """SELECT event_type, count(*) AS n, CAST(round_even(quantile_cont(value, 0.5), 0) AS BIGINT) AS p50, CAST(round_even(quantile_cont(value, 0.95), 0) AS BIGINT) AS p95,
  CAST(round_even(avg(value), 0) AS BIGINT) AS mean FROM events GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.latency(table(spark, sf, "events"), ["event_type"], "value")


_CLASSES = """pairs AS (SELECT q.label AS truth, five.label AS guess FROM five JOIN embeddings q ON q.vec_id = five.query_id WHERE rank = 1
), classes AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = guess) AS hits FROM pairs GROUP BY truth
), guesses AS (SELECT guess AS class, count(*) AS guesses FROM pairs GROUP BY guess)"""


@query(
    f"""WITH {PHOTO_LABELS}, {PREDICTIONS}, {_CLASSES} SELECT c.class, support, round(CASE WHEN coalesce(guesses, 0) > 0 THEN hits / CAST(guesses AS DOUBLE) ELSE 0 END, 6) AS precision,
  round(hits / CAST(support AS DOUBLE), 6) AS recall, round(2.0::DOUBLE * hits / (support + coalesce(guesses, 0)), 6) AS f1 FROM classes c LEFT JOIN guesses g ON c.class = g.class"""
)
def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.search(whole_queries(spark, sf), gallery(spark, sf), 1).join(whole_queries(spark, sf).select("query_id", "query_label"), "query_id")
    scores = evaluation.class_scores(found, "query_label", "label")
    return scores.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {PHOTO_LABELS}, {PREDICTIONS} SELECT CASE WHEN confidence >= 0.9 THEN 0.9::DOUBLE WHEN confidence >= 0.7 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS from_confidence,
  count(*) AS n, count(*) FILTER (top1_correct) AS correct FROM judged WHERE status = 'verified' GROUP BY 1"""
)
def confidence_bins(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.judged(predictions(spark, sf), photo_labels(spark, sf)).where("status = 'verified'")
    return evaluation.confidence_bins(rows, "confidence", "top1_correct")


@query(f"WITH {_RAW_LABELS} SELECT status, count(*) AS n FROM raw_labels GROUP BY status")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_labels(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _review(spark: SparkSession, sf: str) -> DataFrame:
    """Rankings by slug, with the label's slug being the third candidate's where that exists."""
    rows = ranked(spark, sf).select(F.col("query_id").cast("string").alias("name"), "rank", "slug", "score")
    third = rows.where("rank = 3").select(F.col("name").alias("image_path"), "slug")
    labels = photo_labels(spark, sf).drop("slug").join(third, "image_path", "left").withColumn("slug", F.when(F.col("status") == "verified", F.col("slug")))
    return evaluation.review_rows(rows, labels)


_REVIEW = """review AS (
  SELECT CAST(r.query_id AS VARCHAR) AS name, r.rank, r.slug, r.score, l.status, CASE WHEN l.status = 'verified' THEN t.slug END AS verified_slug, evidence
  FROM ranked r JOIN photo_labels l ON l.image_path = CAST(r.query_id AS VARCHAR) LEFT JOIN ranked t ON t.query_id = r.query_id AND t.rank = 3
), summary AS (
  SELECT name, status, verified_slug, max(CASE WHEN slug = verified_slug THEN rank END) AS verified_rank, max(CASE WHEN rank = 1 THEN slug END) AS top1,
    round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 4) AS gap_first_second,
    round(arg_min(score, rank) - arg_max(score, rank), 4) AS spread FROM review GROUP BY name, status, verified_slug)"""


@query(f"WITH {RANKED}, {PHOTO_LABELS}, {_REVIEW} SELECT name, status, verified_slug, CAST(coalesce(verified_rank, 0) AS INT) AS verified_rank, top1, gap_first_second, spread FROM summary")
def review_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.review_summary(_review(spark, sf)).drop("evidence").withColumn("verified_rank", F.coalesce("verified_rank", F.lit(0)))


@query(
    f"""WITH {RANKED}, {PHOTO_LABELS}, {_REVIEW} SELECT name, rank, slug, round(max(CASE WHEN rank = 1 THEN score END) OVER (PARTITION BY name) - score, 4) AS gap_to_first FROM review"""
)
def review_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _review(spark, sf).select("name", F.col("rank").cast("long").alias("rank"), "slug", "gap_to_first")


@query(f"WITH {RANKED}, {PHOTO_LABELS}, {_REVIEW} SELECT name, top1 FROM summary WHERE status = 'verified' AND contains(lower(name || ' label ' || coalesce(verified_slug, '') || ' ' || top1), '1')")
def review_list(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.review_list(evaluation.review_summary(_review(spark, sf)), "verified", "1").select("name", "top1")


@query(
    f"""WITH {RANKED} SELECT d.vec_id AS query_id, r.slug FROM embeddings d LEFT JOIN ranked r ON r.query_id = d.vec_id AND r.rank = 1 WHERE d.vec_id % 10 = 0"""
)
def organizer_run(spark: SparkSession, sf: str) -> DataFrame:
    manifest = table(spark, sf, "embeddings").where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("query_id"))
    return plans.run_manifest(manifest, plans.predict(plans.candidates(whole_queries(spark, sf), gallery(spark, sf))))


@query("SELECT CAST(page_id AS VARCHAR) AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages WHERE page_id % 3 > 0")
def incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    data = F.col("html").cast("binary")
    wanted = pages.select(F.col("page_id").cast("string").alias("path"), F.octet_length("html").cast("long").alias("size"), F.crc32(data).alias("crc32"), "page_id")
    present = wanted.where("page_id % 3 <> 1").withColumn("crc32", F.when(F.col("page_id") % 3 == 2, F.col("crc32") + 1).otherwise(F.col("crc32")))
    return catalog.stale_members(wanted, present).select("path", "size")


@query(
    "WITH p(view_no, l, t, r, b) AS (VALUES "
    + ", ".join(f"({i}, {', '.join(f'{x}::DOUBLE' for x in p)})" for i, p in enumerate(fixed.QUERY_VIEWS))
    + """) SELECT CAST(p_partkey AS VARCHAR) AS name, view_no, CAST(round_even(l * (p_size * 10), 0) AS INT) AS "left", CAST(round_even(t * 480, 0) AS INT) AS top,
  CAST(round_even(r * (p_size * 10), 0) AS INT) AS "right", CAST(round_even(b * 480, 0) AS INT) AS bottom FROM part, p"""
)
def image_boxes(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") * 10).alias("width"), F.lit(480).alias("height"))
    return views.boxes(images, fixed.QUERY_VIEWS)


# ---- review, integrity, lookups ----


def review_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A card for each slug of the gallery, with its image."""
    return gallery(spark, sf).select(F.explode("slugs").alias("slug"), "label", F.col("image_name").cast("string").alias("image_name")).select(
        "slug", F.concat(F.lit("card "), "slug").alias("name"), F.concat(F.lit("winery "), F.col("label").cast("string")).alias("winery"),
        F.concat(F.lit("kind "), (F.col("label") % 3).cast("string")).alias("category"), F.lit("red").alias("color"), F.lit("north").alias("region"),
        F.concat(F.lit("grape "), (F.col("label") % 7).cast("string")).alias("grape"), F.lit("text").alias("description"), "image_name",
    )


def review_images(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("vec_id").cast("string")
    return table(spark, sf, "embeddings").select(name.alias("filename"), F.sha2(name, 256).alias("sha256"))


@query(
    f"""WITH {RANKED} SELECT query_id, CAST(rank AS INT) AS rank, slug, 'card ' || slug AS name, 'winery ' || label AS winery, 'kind ' || (label % 3) AS category, 'grape ' || (label % 7) AS grape,
  score, CAST(image_name AS VARCHAR) AS reference_file, sha256(CAST(image_name AS VARCHAR)) AS reference_sha256 FROM ranked WHERE rank <= 10"""
)
def review_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = plans.candidates(whole_queries(spark, sf), gallery(spark, sf)).withColumn("image_name", F.col("image_name").cast("string"))
    return review.review_report(rows, review_cards(spark, sf), review_images(spark, sf), 10)


def _bundle(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Labels, photos, visual reports and readings, by the number of the query with a fault in some."""
    labels = photo_labels(spark, sf).drop("slug").withColumn("slug", F.when(F.col("status") == "verified", F.col("image_path")))
    n = F.floor(F.col("name").cast("long") / EVERY)
    side = labels.select(F.col("image_path").alias("name"), F.col("image_sha256").alias("sha256"))
    photos = side.where(n % 5 != 3)
    ranks = ranked(spark, sf).select(F.col("query_id").cast("string").alias("name"), "rank", "slug", F.col("image_name").cast("string").alias("filename"))
    order = F.array_sort(F.collect_list(F.struct("rank", "slug", "filename")))
    visual = ranks.groupBy("name").agg(F.slice(order, 1, 20).alias("candidates")).withColumn("n", n)
    visual = visual.withColumn("candidates", F.when(F.col("n") % 4 == 1, F.slice("candidates", 1, 19)).otherwise(F.col("candidates")))
    visual = visual.join(side, "name").withColumn("sha256", F.when(F.col("n") % 3 == 2, "other").otherwise(F.col("sha256"))).select("name", "sha256", "candidates")
    ocr = side.where(n % 6 != 4).withColumn("lines", F.array(F.struct(F.lit("line").alias("text"), F.lit(0.9).alias("confidence"))))
    return labels, photos, visual, ocr


@query(
    f"""WITH {RANKED}, q AS (SELECT CAST(vec_id AS VARCHAR) AS key, vec_id // {EVERY} AS n FROM embeddings WHERE vec_id % {EVERY} = 0)
SELECT CAST(count(*) AS VARCHAR) AS key, 'number of labels' AS rule FROM q HAVING count(*) <> 100
UNION ALL SELECT key, 'photo: only left' FROM q WHERE n % 5 = 3 UNION ALL SELECT key, 'reading: only left' FROM q WHERE n % 6 = 4
UNION ALL SELECT key, 'visual report: other bytes' FROM q WHERE n % 3 = 2 UNION ALL SELECT key, 'number of candidates' FROM q WHERE n % 4 = 1
UNION ALL SELECT key, 'no such card' FROM q WHERE n % 5 < 3 AND CAST(key AS BIGINT) NOT IN (
  SELECT unnest(CASE WHEN vec_id % 2 = 0 THEN [2 * vec_id, 2 * vec_id + 1] ELSE [2 * vec_id] END) FROM embeddings)
UNION ALL SELECT CAST(query_id AS VARCHAR), 'file has no image' FROM ranked WHERE image_name % 9 = 0 AND NOT (rank = 20 AND (query_id // {EVERY}) % 4 = 1)"""
)
def bundle_violations(spark: SparkSession, sf: str) -> DataFrame:
    images = review_images(spark, sf).where(F.col("filename").cast("long") % 9 != 0)
    return review.bundle_violations(*_bundle(spark, sf), review_cards(spark, sf), images)


@query(
    f"""WITH {RANKED}, shown AS (SELECT image_name FROM ranked WHERE NOT (rank = 20 AND (query_id // {EVERY}) % 4 = 1)
  UNION SELECT g.vec_id FROM embeddings q JOIN embeddings g ON q.vec_id % {EVERY} = 0 AND (q.vec_id // {EVERY}) % 5 < 3 AND (q.vec_id = 2 * g.vec_id OR (g.vec_id % 2 = 0 AND q.vec_id = 2 * g.vec_id + 1)))
SELECT CAST(vec_id AS VARCHAR) AS filename FROM embeddings WHERE vec_id % 3 > 0 AND vec_id IN (SELECT image_name FROM shown WHERE image_name % 9 > 0)"""
)
def allowed_media(spark: SparkSession, sf: str) -> DataFrame:
    labels, _, visual, _ = _bundle(spark, sf)
    images = review_images(spark, sf).where(F.col("filename").cast("long") % 9 != 0)
    asked = review_images(spark, sf).where(F.col("filename").cast("long") % 3 != 0).select("filename")
    return review.allowed_media(asked, review.allowed_references(visual, labels, review_cards(spark, sf), images))


@query(
    f"""WITH {RANKED}, {PHOTO_LABELS}, {_REVIEW} SELECT v.name, v.rank, v.slug, round(max(CASE WHEN v.rank = 1 THEN v.score END) OVER (PARTITION BY v.name) - v.score, 4) AS gap_to_first,
  'card ' || v.slug || ', winery ' || r.label || ', kind ' || (r.label % 3) || ', red, north, grape ' || (r.label % 7) || ', text' AS card,
  sha256(CAST(r.image_name AS VARCHAR)) AS reference_sha256, 'card ' || v.verified_slug AS verified FROM review v JOIN ranked r ON CAST(r.query_id AS VARCHAR) = v.name AND r.rank = v.rank"""
)
def review_detail_cards(spark: SparkSession, sf: str) -> DataFrame:
    found = review.review_detail(_review(spark, sf), review_cards(spark, sf), review_images(spark, sf))
    card_line = F.concat_ws(", ", *[F.col(f"card.{c}") for c in review.DETAIL_COLUMNS])
    return found.select(
        "name", F.col("rank").cast("long").alias("rank"), "slug", "gap_to_first", card_line.alias("card"), "reference_sha256", F.col("verified_card.name").alias("verified")
    )


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS key, 'only right' AS rule FROM documents WHERE doc_id % 7 = 3
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'reference changed' FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 5 IN (1, 2)"""
)
def reference_differences(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest that lacks every seventh file, against files of which some have changed and some are gone."""
    name = F.col("doc_id").cast("string")
    files = table(spark, sf, "documents").select("doc_id", name.alias("filename"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    manifest = files.where("doc_id % 7 <> 3").select("filename", "sha256")
    present = files.where("doc_id % 5 <> 1").withColumn("sha256", F.when(F.col("doc_id") % 5 == 2, "changed").otherwise(F.col("sha256")))
    return review.reference_differences(manifest, files.select("filename"), present.select("filename", "sha256"))


@query(
    f"""WITH {CARDS} SELECT slug AS key, 'baseline differs' AS rule FROM cards WHERE CAST(slug AS BIGINT) % 6 = 0
UNION ALL SELECT DISTINCT image_name, 'baseline image changed' FROM cards WHERE reference_available AND substr(image_name, 1, 1) = 'a'"""
)
def baseline_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = cards(spark, sf)
    fixes = _fixes(rows).withColumn("baseline_manifest_sha256", F.when(F.col("slug").cast("long") % 6 == 0, "old").otherwise(F.lit("now")))
    images = catalog.reference_images(rows).select("filename", F.sha2("filename", 256).alias("sha256"))
    present = images.withColumn("sha256", F.when(F.col("filename").startswith("a"), "changed").otherwise(F.col("sha256")))
    return catalog.baseline_violations(fixes, "now", images, present)


@query(f"WITH {CARDS} SELECT slug, name, winery, category FROM cards WHERE slug = '7'")
def card_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return review.card_by_slug(cards(spark, sf), "7").select("slug", "name", "winery", "category")


@query("SELECT 'ready' AS status, count(*) AS cards FROM documents")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return review.health(cards(spark, sf))


@query(
    f"""WITH {CARDS}, s AS (SELECT slug, name, winery, category, grape, CASE WHEN contains(name, 'полуслад') THEN 'полусладкое' WHEN contains(name, 'брют') THEN 'брют' WHEN contains(name, 'сух') THEN 'сухое'
  WHEN regexp_matches(lower(image_name || ' ' || substr(description, 1, 400)), 'bryut') THEN 'брют' WHEN regexp_matches(lower(substr(description, 1, 400)), 'suh') THEN 'сухое' END AS shown FROM cards)
SELECT slug, shown, trim(name) || ' | винодельня: ' || winery || ' | ' || category || ' | сорт: ' || grape || ' | сладость: ' || coalesce(shown, '{fixed.NOT_STATED}') AS line FROM s"""
)
def card_lines(spark: SparkSession, sf: str) -> DataFrame:
    return cards(spark, sf).select("slug", card.shown_sweetness().alias("shown"), card.description_line().alias("line"))


# ---- files: what is written from the tables is read back ----


@query(
    f"""WITH {CARDS} SELECT slug, name, category, color, region, grape, winery, image_name, reference_available,
  md5(regexp_replace(description, '^\\s+|\\s+$', '', 'g')) AS description FROM cards"""
)
def catalog_file(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = scratch_path(spark, "catalog-file"), cards(spark, sf)
    named = rows.select(*[F.col(new).cast("string").alias(old) for old, new in files.CATALOG_COLUMNS.items()], F.lit("ignored").alias("more"))
    named.write.csv(path, header=True, quoteAll=True, escape='"')
    return files.read_catalog(spark, path).withColumn("description", F.md5(F.col("description").cast("binary")))


@query(f"WITH {PHOTO_LABELS} SELECT image_path, image_sha256, status, slug, evidence FROM photo_labels")
def label_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "label-file")
    photo_labels(spark, sf).select(*files.LABEL_COLUMNS).write.csv(path, header=True, sep="\t")
    return files.read_labels(spark, path)


@query(f"WITH {PHOTO_LABELS}, {PREDICTIONS} SELECT image_path, predicted_slug, array_to_string(top5_slugs, ',') AS top5, latency_ms, ocr_used FROM judged")
def prediction_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prediction-file")
    files.write_predictions(predictions(spark, sf), path)
    return files.read_predictions(spark, path).select("image_path", "predicted_slug", F.array_join("top5_slugs", ",").alias("top5"), "latency_ms", "ocr_used")


@query(f"WITH {CARDS} SELECT image_name AS filename, array_to_string(list_sort(list(slug)), ',') AS slugs, sha256(image_name) AS sha256 FROM cards WHERE reference_available GROUP BY image_name")
def manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest is built from the cards and the digests of their images, written, and its images read back."""
    path, rows = scratch_path(spark, "manifest-file"), cards(spark, sf)
    digests = rows.select(F.col("image_name").alias("filename"), F.sha2("image_name", 256).alias("sha256")).distinct()
    files.write_manifest(catalog.build_manifest(rows, digests), path, 0, "source")
    found = files.read_manifest_part(spark, path, "images", "filename string, sha256 string, slugs array<string>")
    return found.select("filename", F.array_join("slugs", ",").alias("slugs"), "sha256")


@query(f"WITH {PHOTO_LABELS}, {PREDICTIONS} SELECT count(*) AS labels, {_ACCURACY}, {_SHARES} FROM judged")
def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The score report, published twice, and its newest version read back."""
    path, found = scratch_path(spark, "report-file"), score_top1_top5(spark, sf)
    files.write_report(found.limit(0), path)
    files.write_report(found, path)
    return files.read_report(spark, path, ", ".join(f"{n} {t}" for n, t in found.dtypes))


@query(
    f"""WITH {RANKED} SELECT query_id, CAST(rank AS INT) AS rank, slug, 'card ' || slug AS name, score, sha256(CAST(image_name AS VARCHAR)) AS reference_sha256 FROM ranked WHERE rank <= 10"""
)
def review_report_file(spark: SparkSession, sf: str) -> DataFrame:
    path, found = scratch_path(spark, "review-file"), review_report(spark, sf)
    files.write_report(found, path)
    back = files.read_report(spark, path, ", ".join(f"{n} {t}" for n, t in found.dtypes))
    return back.select("query_id", "rank", "slug", "name", "score", "reference_sha256")


@query(f"WITH {CARDS} SELECT slug, name, winery, image_name, reference_available FROM cards")
def manifest_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Cards written as JSON objects with an indent of two and read back by many tasks."""
    path, rows = scratch_path(spark, "manifest-objects"), cards(spark, sf)
    objects.write_objects(rows.select(*files.CARD_KINDS), path, "cards", {"schema_version": 1, "source_rows": 0})
    return files.read_manifest(spark, path)[0].select("slug", "name", "winery", "image_name", "reference_available")


@query(f"WITH {CARDS} SELECT slug, 'ab12' AS baseline_manifest_sha256, image_name AS from_image, 'fixed-' || winery || '.png' AS target_image FROM cards WHERE CAST(slug AS BIGINT) % 3 = 0")
def fixes_objects(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "fixes-objects")
    due = _fixes(cards(spark, sf)).withColumn("target_sha256", F.sha2("target_image", 256))
    objects.write_objects(due, path, "fixes", {"baseline_manifest_sha256": "ab12", "schema_version": 1})
    return files.read_fixes(spark, path).select("slug", "baseline_manifest_sha256", "from_image", "target_image")


def _page_digests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Digests of pages as they were kept and as they are: some changed, some are new, some gone."""
    n, digest = F.col("page_id"), F.sha2("html", 256)
    pages = table(spark, sf, "pages").select(n.cast("string").alias("name"), digest.alias("digest"), n.alias("n"))
    kept = pages.where("n % 101 <> 7").drop("n")
    now = pages.where("n % 101 <> 8").withColumn("digest", F.when(F.col("n") % 101 == 9, F.lit("other")).otherwise(F.col("digest"))).drop("n")
    return kept, now


@query(
    """SELECT CAST(page_id AS VARCHAR) AS name, CASE page_id % 101 WHEN 7 THEN 'added' WHEN 8 THEN 'removed' ELSE 'differs' END AS change
FROM pages WHERE page_id % 101 BETWEEN 7 AND 9"""
)
def changed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """What changed is found by two trees of digests, and only rows of ranges that differ are compared."""
    kept, now = _page_digests(spark, sf)
    depth = integrity.depth_for(table(spark, sf, "pages").count())
    trees = [written(integrity.digest_tree(x, depth), "page-tree") for x in (kept, now)]
    return integrity.changed_rows(kept, now, integrity.changed_ranges(*trees, depth), depth)


@query(
    """WITH named AS (SELECT CAST(page_id AS VARCHAR) AS name, sha256(html) AS digest, substr(sha256(CAST(page_id AS VARCHAR)), 1, 1) AS range FROM pages
), leaves AS (SELECT range, sha256(string_agg(name || chr(0) || digest, chr(10) ORDER BY name)) AS digest, count(*) AS n FROM named GROUP BY range)
SELECT range, digest, n AS rows FROM leaves UNION ALL SELECT '', sha256(string_agg(range || ':' || digest, chr(10) ORDER BY range)), CAST(sum(n) AS BIGINT) FROM leaves"""
)
def page_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of one digit: 16 leaves and the root."""
    rows = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("name"), F.sha2("html", 256).alias("digest"))
    return integrity.digest_tree(rows, 1)


@query(
    """SELECT vec_id AS image_name, CASE WHEN vec_id % 2 = 0 THEN (2 * vec_id) || ',' || (2 * vec_id + 1) ELSE CAST(2 * vec_id AS VARCHAR) END AS slugs,
  round(CAST(embedding[1] AS DOUBLE), 6) AS first_number FROM embeddings"""
)
def index_file(spark: SparkSession, sf: str) -> DataFrame:
    path, rows = scratch_path(spark, "index-file"), gallery(spark, sf).select("image_name", "slugs", "views")
    files.write_index(rows, path, "manifest", "views-1")
    found = files.read_index(spark, path, "manifest", "views-1", rows.select(F.col("image_name").cast("string").alias("filename"), "slugs"))
    first = F.get(F.get("views", F.lit(0)), F.lit(0)).cast("double")
    return found.select("image_name", F.array_join("slugs", ",").alias("slugs"), F.round(first, 6).alias("first_number"))


@query("SELECT CAST(vec_id AS VARCHAR) AS query_id, 'photos/' || vec_id || '.webp' AS image_path FROM embeddings WHERE vec_id % 10 = 0")
def query_manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    path, name = scratch_path(spark, "query-file"), F.col("vec_id").cast("string")
    rows = table(spark, sf, "embeddings").where("vec_id % 10 = 0").select(name.alias("query_id"), F.concat(F.lit("photos/"), name, F.lit(".webp")).alias("image_path"))
    rows.write.csv(path, header=True, sep="\t")
    return files.read_query_manifest(spark, path)
