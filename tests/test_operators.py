"""Operators and files on small tables of their own: what they give, and what they reject."""

import json

import pytest
from pyspark.sql import functions as F

from tallyvine.functions import cards as card
from tallyvine.functions import vectors
from tallyvine.operators import blocks, catalog, checks, evaluation, integrity, pairing, recommend, rerank, retrieval, review, text
from tallyvine.plans import predict, views
from tallyvine.sources import files, objects, publish
from tallyvine.streaming import runs

CARD = files.CARD


def cards(spark, *rows):
    base = {"slug": "s", "name": "", "category": "", "color": "", "region": "", "grape": "", "description": "", "winery": "", "image_name": "", "reference_available": True}
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in CARD.split(", ")) for r in rows], CARD)


def one(frame, *columns):
    return [tuple(r) if len(columns) != 1 else r[0] for r in frame.select(*columns).collect()]


# ---- texts and attributes ----


def test_attributes(spark):
    rows = cards(
        spark, {"slug": "a-polusuhoe", "category": "Красное вино"}, {"slug": "b", "name": "Вино Сухое", "category": "Игристое розовое"},
        {"slug": "bryut-c"}, {"slug": "d", "description": "Это полусладкое белое для ужина"}, {"slug": "e", "name": "Несухоевино", "description": "Лёгкое игристое вино"},
        {"slug": "f-p-sl", "category": "Оранжевое"},
    )
    assert one(rows, card.color_key()) == ["red", "rose", "white", "white", "white", "orange"]
    assert one(rows, card.is_sparkling()) == [False, False, True, False, True, False]
    assert one(rows, card.sweetness_level()) == ["полусухое", "сухое", None, "полусладкое", None, "полусладкое"]
    assert one(rows, card.stated_sweetness()) == ["полусухое", "сухое", "брют", "полусладкое", "сухое", "не указана"]
    assert one(rows, card.pairing_style()) == ["red", "rose", "sparkling", "white", "white", "orange"]


def test_grapes_and_jaccard(spark):
    rows = cards(spark, {"grape": " Мерло, каберне ,,мерло"}, {"grape": ""})
    assert one(rows, card.grape_set()) == [["мерло", "каберне"], []]
    assert one(rows, card.jaccard(card.grape_set(), F.array(F.lit("мерло")))) == [0.5, 0.0]
    assert one(rows, card.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == [0.0, 0.0]


def test_label_forms(spark):
    rows = cards(spark, {"slug": "muscat-2019-x", "name": "Мускат Café 12345", "winery": "Дом", "grape": "мускат"})
    assert one(rows, card.label_token(F.lit("MUS CAT №1"))) == ["muskat1"]
    found = set(one(rows, card.fragments())[0])
    assert {"muskat", "kafe", "muskatkafe", "2019", "muskat2019"} <= found and "12345" not in found and "dom" not in found


def test_safe_filename(spark):
    names = spark.createDataFrame([("a.png",), ("../a",), ("",), ("a\\b",), (None,), ("..",), ("a\0",)], "n string")
    assert one(names, card.safe_filename(F.col("n"))) == [True] + [False] * 6


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert one(rows, vectors.unit(F.col("v"))) == [[0.6, 0.8]]
    bad = spark.createDataFrame([([0.0, 0.0],), ([float("nan"), 1.0],), ([],), (None,)], "v array<double>")
    assert one(bad, vectors.usable(F.col("v"))) == [False] * 4
    with pytest.raises(Exception, match="zero or not finite"):
        bad.select(vectors.unit(F.col("v"))).collect()


def test_indel_ratio():
    assert vectors.indel_ratio("abcd", "abcd") == 100 and vectors.indel_ratio("", "") == 100 and vectors.indel_ratio("ab", "cd") == 0
    assert vectors.indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


# ---- catalog ----


def test_manifest(spark):
    same = {"slug": "a", "image_name": "1.png"}
    rows = cards(spark, same, same, {"slug": "b", "image_name": "1.png"}, {"slug": "c", "image_name": "2.png", "reference_available": False})
    digests = spark.createDataFrame([("1.png", "f" * 64)], "filename string, sha256 string")
    parts = catalog.build_manifest(rows, digests)
    assert sorted(one(parts["cards"], "slug")) == ["a", "b", "c"] and one(parts["excluded"], "slug") == ["c"]
    assert one(parts["images"], "filename", "slugs") == [("1.png", ["a", "b"])]
    assert tuple(parts["counts"].first()) == (3, 2, 1, 1, 1)
    with pytest.raises(ValueError, match="Conflicting"):
        catalog.unique_cards(rows.unionByName(cards(spark, {"slug": "a", "name": "other", "image_name": "1.png"})))
    with pytest.raises(ValueError, match="missing"):
        catalog.build_manifest(rows, digests.limit(0))


def test_fixes(spark):
    rows = cards(spark, {"slug": "a", "image_name": "1.png"}, {"slug": "b", "image_name": "1.png"})
    schema = "slug string, from_image string, target_image string, target_sha256 string"
    digests = spark.createDataFrame([("1.png", "0"), ("new.png", "1")], "filename string, sha256 string")
    good = spark.createDataFrame([("b", "1.png", "new.png", "1")], schema)
    parts = catalog.corrected_catalog(rows, good, digests)
    assert sorted(one(parts["cards"], "slug", "image_name")) == [("a", "1.png"), ("b", "new.png")]
    assert tuple(parts["counts"].first()) == (2, 2, 2, 0, 0)
    for bad in [("x", "1.png", "new.png", "1"), ("b", "2.png", "new.png", "1"), ("b", "1.png", "../new.png", "1"), ("b", "1.png", "new.png", "2")]:
        with pytest.raises(ValueError, match="Fix"):
            catalog.corrected_catalog(rows, spark.createDataFrame([bad], schema), digests)


# ---- retrieval and fusion ----


def tiny(spark):
    gallery = [("r1", [[1.0, 0.0], [0.0, 1.0]], ["b", "a"]), ("r2", [[0.3, 0.4], [4.0, 3.0]], ["c"])]
    queries = spark.createDataFrame([("q", [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])], "query_id string, crops array<array<double>>")
    return queries, spark.createDataFrame(gallery, "image_name string, views array<array<double>>, slugs array<string>")


def test_search_takes_the_best_view_of_each_crop(spark):
    queries, gallery = tiny(spark)
    assert one(retrieval.search(queries, gallery, 2).orderBy("rank"), "image_name", "score") == [("r1", 1.0), ("r2", 0.8)]
    found = predict.candidates(queries, gallery, 2).orderBy("rank")
    assert one(found, "slug", "score") == [("a", 1.0), ("b", 1.0)]
    assert retrieval.search(queries.limit(0), gallery, 2).count() == 0 and retrieval.search(queries, gallery.limit(0), 2).count() == 0


def ranking(spark, scores):
    rows = [("q", i, f"s{i}", x, f"i{i}") for i, x in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "query_id string, rank int, slug string, score double, image_name string")


@pytest.mark.parametrize(("scores", "p", "first"), [([0.9, 0.89], [0.1, 0.9], "s2"), ([0.9, 0.83], [0.4, 0.6], "s1"), ([0.9], [1.0], "s1")])
def test_verifier_overturns_small_gaps(spark, scores, p, first):
    rows = ranking(spark, scores).join(spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(p, 1)], "slug string, p double"), "slug").withColumn("log_p", F.ln("p"))
    assert one(rerank.fuse_verifier(rows).where("new_rank = 1"), "slug") == [first]


def test_verifier_leaves_the_tail(spark):
    rows = ranking(spark, [0.9 - 0.01 * i for i in range(9)]).withColumn("logit", F.col("rank") * 10.0)
    fused = rerank.fuse_verifier(rerank.log_softmax(rows)).orderBy("new_rank")
    assert one(fused, "slug") == ["s7", "s6", "s5", "s4", "s3", "s2", "s1", "s8", "s9"]


def test_answers(spark):
    found = predict.predict(ranking(spark, [0.9, 0.8, 0.7])).first()
    assert found.slug == "s1" and found.verdict == "confident" and found.confidence > 0.99 and found.margin_to_second == pytest.approx(0.1)
    assert [x.slug for x in found.top5] == ["s1", "s2", "s3"] and [x.slug for x in found.alternatives] == ["s2", "s3"] and not found.shared_reference
    alone = predict.predict(ranking(spark, [0.9])).first()
    assert alone.margin_to_second is None and alone.confidence == 1.0


def test_lexical_evidence_decides_only_close_calls(spark):
    rows = cards(spark, {"slug": "s1", "name": "riesling"}, {"slug": "s2", "name": "muscat"}, {"slug": "s3", "name": "riesling"})
    lines = spark.createDataFrame([("q", 1, "MUS CAT", 0.9), ("q", 2, "wine", 0.9), ("q", 3, "muscat", 0.2)], "query_id string, line_no int, text string, confidence double")
    parts = text.card_fragments(rows)
    idf = text.fragment_idf(parts, 3)
    for scores, first in (([0.9, 0.89], "s2"), ([0.9, 0.8], "s1")):
        ranked = ranking(spark, scores)
        lexical = text.lexical_scores(lines, ranked, parts, idf)
        assert one(lexical, "slug") == ["s2"]
        assert one(rerank.fuse_lexical(ranked, lexical).where("new_rank = 1"), "slug") == [first]
        assert predict.predict(ranked, lexical=lexical).first().slug == first


def plain_ratio(a, b):
    """By the table of common subsequences."""
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return 200 * row[-1] / (len(a) + len(b))


def test_fuzzy_lexical_scores_against_plain_ones(spark):
    from tallyvine import queries

    found = {(r.query_id, r.slug): r.lexical for r in queries.lexical_score_fuzzy(spark, "/root/testdata/sf0.001").collect()}
    rows = queries.part_cards(spark, "/root/testdata/sf0.001")
    parts, n = {}, rows.count()
    for slug, fragment in one(text.card_fragments(rows), "slug", "fragment"):
        parts.setdefault(slug, []).append(fragment)
    holders = {}
    for slug, fragments in parts.items():
        for f in fragments:
            holders[f] = holders.get(f, 0) + 1
    tokens = {}
    for q, no, token, confidence in one(text.readable(queries.label_lines(rows)), "query_id", "line_no", "token", "confidence"):
        tokens.setdefault(q, []).append((token, confidence))
    import math

    expected = {}
    for q, slug in set(one(queries.label_candidates(rows), "query_id", "slug")):
        worth = []
        for token, confidence in tokens.get(q, []):
            similarity, fragment = max(((plain_ratio(token, f), f) for f in parts[slug]), default=(0, ""))
            if similarity >= (98 if len(token) <= 4 else 93 if len(token) <= 6 else 90):
                worth.append(confidence * math.log((n + 1) / (holders[fragment] + 1)) * similarity / 100)
        if worth:
            expected[q, slug] = sum(sorted(worth, reverse=True)[:3])
    assert found.keys() == expected.keys() and found
    assert all(found[k] == pytest.approx(expected[k], abs=1e-5) for k in found)


def most_joined(df):
    """Rows of the join that makes the most of them as df is collected."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        here = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([here, *(walk(node.children().apply(i)) for i in range(node.children().size()))])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["lexical_score_exact", "lexical_score_fuzzy"])
def test_lexical_scores_form_no_pairs_without_a_hit(spark, tmp_path, name):
    from tallyvine import queries

    n, words = 2000, [3 * a + 3 * b for a in "aeiouybdgp" for b in "xmstz"]
    parts = [(i, words[i % 50], f"Brand#{i % 25}", "SMALL", 7) for i in range(n)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    hits = {(q, slug) for q, slug in one(found, "query_id", "slug")}
    alike = {(q, f"{parts[i][1]}-{i}".replace(" ", "-")) for q in range(0, n, 50) for i in range(n) if parts[q][1] == parts[i][1] or parts[q][2] == parts[i][2]}
    assert alike and alike <= hits
    assert most_joined(found) < n * n // 50 // 4  # of all pairs of a query and a candidate


def test_near_fragments_against_all_pairs(spark):
    """Every pair that is similar enough shares a piece."""
    import random

    rng = random.Random(12)
    fragments = {"".join(rng.choices("abk1", k=rng.randint(4, 36))) for _ in range(120)} | {"aaaa", "aaaaaaa", "aaaaaaaa"}
    tokens = {"aaaa", "aaaaa", "aaaaaaaa"}
    for f in list(fragments):
        t = list(f)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t))
            rng.choice([lambda: t.insert(at, "b"), lambda: t.__setitem__(at, "k"), lambda: t.pop(at) if len(t) > 4 else None])()
        if 4 <= len(t) <= 35:
            tokens.add("".join(t))
    due = {}
    for t in tokens:
        for f in fragments:
            ratio = plain_ratio(t, f)
            if ratio >= (98 if len(t) <= 4 else 93 if len(t) <= 6 else 90):
                due[t, f] = ratio
    found = text.near_fragments(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(f,) for f in fragments], "fragment string"))
    assert len(due) > 60 and {(t, f): s for t, f, s in one(found, "token", "fragment", "similarity")} == pytest.approx(due)


def test_ratios_of_many_pairs():
    import random

    rng = random.Random(2)
    words = ["".join(rng.choices("abвß😀", k=rng.randint(0, 40))) for _ in range(80)] + ["", "a" * 63, "ab" * 200]
    pairs = [(a, b) for a in words for b in rng.sample(words, 12) if min(len(a), len(b)) <= 63]
    got = vectors.indel_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([vectors.indel_ratio(a, b) for a, b in pairs])


@pytest.mark.parametrize("block,asked", [(10**9, 10**9), (600, 10**9), (600, 400), (10**9, 400)])
def test_search_in_blocks_with_ties(spark, monkeypatch, block, asked):
    """Blocks give what one pass gives, whether the queries come to the gallery or both are dealt out; ties go to the smaller name, a query never finds itself."""
    import math
    import random

    rng = random.Random(1)
    vecs = [(i, [[float(rng.choice([-2, -1, 1, 2])) for _ in range(3)] for _ in range(2)]) for i in range(60)]
    gallery = spark.createDataFrame([(i, v, [f"s{i}"], None) for i, v in vecs], "image_name long, views array<array<double>>, slugs array<string>, extra string").repartition(3)
    queries = spark.createDataFrame(vecs[:20], "query_id long, crops array<array<double>>")
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", block)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", asked)
    monkeypatch.setattr(retrieval, "PIVOTS", 12)
    found = one(retrieval.search(queries, gallery, 5).orderBy("query_id", "rank"), "query_id", "image_name", "score")
    unit = {i: [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in vs] for i, vs in vecs}
    expected = []
    for q, _ in vecs[:20]:
        scores = [(-round(sum(max(sum(a * b for a, b in zip(c, v)) for v in views) for c in unit[q]) / 2, 6), g) for g, views in unit.items() if g != q]
        expected += [(q, g, -s) for s, g in sorted(scores)[:5]]
    assert found == expected
    kept = retrieval.search(queries, gallery, 5).first()
    assert kept.slugs == [f"s{kept.image_name}"] and kept.extra is None


def test_search_skips_groups_of_images_and_loses_nothing(spark, monkeypatch):
    """Clustered vectors: most groups cannot reach what a query has; the answers are those of all pairs."""
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 2, 16))
    views = np.repeat(centres, 40, axis=0) + 0.05 * rng.normal(size=(480, 2, 16))
    gallery = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(views)], "image_name long, views array<array<double>>").repartition(2)
    queries = gallery.where("image_name % 20 = 0").select(F.col("image_name").alias("query_id"), F.col("views").alias("crops"))
    monkeypatch.setattr(retrieval, "PIVOTS", 100)
    unit = views / np.linalg.norm(views, axis=2, keepdims=True)
    scores = np.round(retrieval.mean_of_best(unit, unit), 6)
    np.fill_diagonal(scores, -9)
    expected = {(q, int(g)) for q in range(0, 480, 20) for g in np.lexsort((np.arange(480), -scores[q]))[:4]}
    for asked in (10**9, 2000):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", asked)
        counters = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        assert set(one(retrieval.search(queries, gallery, 4, counters), "query_id", "image_name")) == expected
        assert counters[1].value > 0.5 * counters[0].value > 0


@pytest.mark.parametrize("crops,views,k", [([[0.0, 0.0]], [[1.0, 0.0]], 1), ([[1.0, 0.0]], [[float("nan"), 0.0]], 1), ([[1.0]], [[1.0, 0.0]], 1), ([[1.0, 0.0]], [[1.0, 0.0]], 0), ([[1.0, float("inf")]], [[1.0, 0.0]], 1)])
def test_search_refuses_what_it_cannot_compare(spark, crops, views, k):
    gallery = spark.createDataFrame([("r", views)], "image_name string, views array<array<double>>")
    queries = spark.createDataFrame([("q", crops)], "query_id string, crops array<array<double>>")
    with pytest.raises(Exception, match="dimensions differ|not zero|must be positive"):
        retrieval.search(queries, gallery, k).collect()


# ---- recommendations ----


def shelf(spark):
    rows = [
        {"slug": "base", "name": "сухое", "category": "Белое", "grape": "рислинг", "winery": "w1", "region": "юг", "description": "персик лимон мёд " * 3},
        {"slug": "near", "name": "сухое", "category": "Белое", "grape": "рислинг", "winery": "w2", "region": "юг", "description": "персик лимон"},
        {"slug": "near2", "category": "Белое", "grape": "рислинг", "winery": "w2", "region": "юг", "description": "персик"},
        {"slug": "same-winery", "category": "Белое", "grape": "рислинг", "winery": "w1"}, {"slug": "red", "category": "Красное", "grape": "рислинг", "winery": "w3", "description": "танин к мясу"},
        {"slug": "gone", "category": "Белое", "grape": "рислинг", "winery": "w4", "reference_available": False}, {"slug": "bryut", "category": "Белое", "winery": "w5", "description": "к рыбе"},
    ] + [{"slug": f"f{i}", "category": "Белое", "winery": f"x{i}", "description": "слово " * i} for i in range(12)]
    return cards(spark, *rows)


def test_analogues(spark):
    rows = shelf(spark)
    weights = text.profiles(text.term_counts(rows), rows.count())
    bases = spark.createDataFrame([("base",)], "slug string")
    found = recommend.analogues(recommend.card_features(rows), bases, weights, 20).orderBy("place").collect()
    assert found[0].slug == "near" and len(found) == 8 and {"near2", "same-winery", "red", "gone", "bryut", "base"}.isdisjoint(r.slug for r in found)
    assert found[0].reasons[:3] == ["тот же сорт: рислинг", "тоже сухое", "тоже юг"] and found[-1].reasons == ["тот же стиль вина"]


def made_shelf(spark, seed, n, wineries=7):
    """Cards with few grapes and words, so that many tie, and some that share nothing."""
    import random

    rng = random.Random(seed)
    grapes, words = [f"g{i}" for i in range(6)], [f"слово{c}" for c in "абвгдежзик"]
    rows = []
    for i in range(n):
        rows.append(
            {
                "slug": f"c{i:03d}", "name": rng.choice(["сухое", "брют", "полусладкое", ""]), "category": rng.choice(["Белое", "Красное"]), "winery": f"w{rng.randrange(wineries)}",
                "grape": ", ".join(rng.sample(grapes, rng.randint(0, 3))), "region": rng.choice(["юг", "север", ""]),
                "description": " ".join(rng.choices(words, k=rng.randint(0, 6))), "reference_available": rng.random() < 0.8,
            }
        )
    return cards(spark, *rows)


def all_pairs(features, vectors, base):
    """Every comparable card with its score, by plain arithmetic in whole units."""
    mine, unit = features[base], text.UNIT
    out = []
    for slug, c in features.items():
        if slug == base or c.winery == mine.winery or c.color != mine.color or c.sparkling != mine.sparkling or not c.available:
            continue
        a, b = set(mine.grapes), set(c.grapes)
        score = 3 * unit * len(a & b) // len(a | b) if a | b else 0
        score += unit * 15 // 10 * (mine.sweetness is not None and mine.sweetness == c.sweetness) + unit * 7 // 10 * (mine.region == c.region)
        score += 3 * sum(int(w * vectors.get(slug, {})[t] * unit) for t, w in vectors.get(base, {}).items() if t in vectors.get(slug, {}))
        out.append((-score, slug, c.winery))
    best, seen = [], set()
    for score, slug, winery in sorted(out):
        if winery not in seen:
            seen.add(winery)
            best.append((slug, -score))
    return best


@pytest.mark.parametrize("seed,first,limit", [(1, 1, 4), (2, 20, 4), (3, 5, 8), (4, 10**9, 2)])
def test_analogues_against_all_pairs(spark, monkeypatch, seed, first, limit):
    monkeypatch.setattr(recommend, "FIRST_POSTINGS", first)
    rows = made_shelf(spark, seed, 90)
    weights = text.profiles(text.term_counts(rows), rows.count(), most_common=0.9).cache()
    features = {r.slug: r for r in recommend.card_features(rows).collect()}
    vectors = {}
    for slug, term, weight in one(weights, "slug", "term", "weight"):
        vectors.setdefault(slug, {})[term] = weight
    bases = spark.createDataFrame([(f"c{i:03d}",) for i in range(0, 90, 4)], "slug string")
    found = {}
    for r in recommend.analogues(recommend.card_features(rows), bases, weights, limit).orderBy("base", "place").collect():
        found.setdefault(r.base, []).append((r.slug, r.score))
    for base in (f"c{i:03d}" for i in range(0, 90, 4)):
        due = all_pairs(features, vectors, base)[:limit]
        assert found.get(base, []) == [(slug, (score + 50_000_000) // 100_000_000 / 10_000) for slug, score in due]


def test_analogues_move_only_what_may_come_first(spark, monkeypatch):
    """Cards that all share a grape and words: pairs are scored where they meet, whatever the blocks."""
    rows = cards(spark, *[{"slug": f"c{i:03d}", "category": "Белое", "winery": f"w{i % 9}", "grape": "рислинг", "description": f"мёд груша сорт{i // 3}"} for i in range(150)])
    weights = text.profiles(text.term_counts(rows), rows.count(), most_common=2.0).cache()
    bases = spark.createDataFrame([(f"c{i:03d}",) for i in range(0, 150, 10)], "slug string")
    found, written, sizes = [], recommend.written, []
    monkeypatch.setattr(recommend, "written", lambda df, name: (sizes.append(df.count()) if name == "analogue-pairs" else None, written(df, name))[1])
    for n in (10**6, 4):
        monkeypatch.setattr(blocks, "BASES", n)
        monkeypatch.setattr(blocks, "PART", n)
        found.append(sorted(one(recommend.analogues(recommend.card_features(rows), bases, weights, 4), "base", "place", "slug", "score")))
    assert len(found[0]) == 15 * 4 and found[0] == found[1]
    assert max(sizes) <= 15 * 2 * 4


@pytest.mark.parametrize("n", [10**6, 7])
def test_similar_texts_move_no_pairs(spark, monkeypatch, n):
    monkeypatch.setattr(blocks, "BASES", n)
    monkeypatch.setattr(blocks, "PART", n)
    rows = made_shelf(spark, 9, 120)
    weights = text.profiles(text.term_counts(rows), rows.count(), most_common=0.9).cache()
    base = weights.where("slug < 'c040'")
    due, adjective = {}, "(а|е)$"
    for b, slug, term, units in one(text.shared_terms(base, weights), "base", "slug", "term", "units"):
        due.setdefault((b, slug), []).append((-units, term))
    found = text.text_similarity(base, weights, 2, adjective)
    got = {(r.base, r.slug): (r.units, list(r.notes)) for r in found.collect()}
    plain = {pair: (-sum(u for u, _ in terms), [t for _, t in sorted(terms) if t[-1] not in "ае"][:2]) for pair, terms in due.items()}
    assert len(plain) > 1000 and got == plain
    assert most_joined(found) == 0


@pytest.mark.parametrize("more", [[], [{"slug": "c003", "description": "слово слово словоа"}], [{"slug": None, "description": "словоа словоб"}]])
def test_profiles_by_packs(spark, monkeypatch, more):
    """As from a row for each term of a card; each term of a pack is sent once."""
    monkeypatch.setattr(text, "written", lambda df, name: sent.setdefault(name, df.cache()))
    sent, rows = {}, made_shelf(spark, 5, 200).unionByName(cards(spark, {"slug": "empty"}, {"slug": "none", "description": None}, *more)).cache()
    n = rows.count()
    found = text.card_profiles(rows, n, "[а-я]{4,}", ["словог"], 4, 0.9)
    due = text.profiles(text.term_counts(rows, "[а-я]{4,}", ["словог"]), n, 4, 0.9)
    key = lambda r: (r[0] or "", r[1])
    got, plain = (sorted(one(x, "slug", "term", "weight"), key=key) for x in (found, due))
    assert len(plain) > 300 and [x[:2] for x in got] == [x[:2] for x in plain] and [x[2] for x in got] == pytest.approx([x[2] for x in plain], abs=1e-12)
    packs = sent["term-lists"].where("slug IS NULL AND size(terms) > 0")
    assert packs.agg(F.sum(F.size("terms"))).first()[0] < 30 * packs.count()


@pytest.mark.parametrize("n", [10**6, 7])
def test_overlaps_are_made_where_they_are_given(spark, monkeypatch, n):
    monkeypatch.setattr(blocks, "BASES", n)
    monkeypatch.setattr(blocks, "PART", n)
    rows = made_shelf(spark, 3, 90).select("slug", "winery", card.grape_set().alias("grapes"))
    rows = rows.unionByName(spark.createDataFrame([("c000", "w0", []), ("many", "w0", [f"g{i}" for i in range(128)]), ("x", None, ["g1"])], rows.schema)).cache()
    base = rows.where("slug < 'c030' OR slug = 'many'")
    due = sorted(
        (b.slug, r.slug, int(len(set(b.grapes) & set(r.grapes)) / (len(set(b.grapes) | set(r.grapes)) or 1) * 1e6 + 0.5) / 1e6)
        for b in base.collect() for r in rows.collect() if b.winery == r.winery is not None and b.slug != r.slug
    )
    found = blocks.overlaps(base, rows, ["winery"], 6)
    assert any(x[2] == 0.007813 for x in due) and sorted(one(found, "base", "slug", "jaccard")) == due
    assert most_joined(found) == 0


def test_order_is_by_the_unrounded_score(spark):
    """Scores that tie at four digits, planted so that the smaller slug has the smaller one."""
    base = {"category": "Белое", "region": "x", "winery": "w"}
    rows = [{**base, "slug": s, "winery": f"w{s}", "description": "а" * n} for s, n in (("a", 599), ("b", 600), ("c", 598), ("d", 600))]
    found = recommend.sommelier_for_cards(cards(spark, *rows)).orderBy("place").collect()
    assert [r.slug for r in found] == ["b", "d", "a"]
    scored = spark.createDataFrame([("x", "p", "w1", 3_100_010_000_000), ("x", "q", "w2", 3_100_040_000_000), ("x", "r", "w2", 3_100_040_000_000)], "base string, slug string, winery string, units long")
    assert one(recommend.one_per_winery(scored, ["base"]).orderBy("place"), "slug") == ["q", "p"]
    shown = scored.select(recommend.shown(F.col("units")).alias("s")).distinct().collect()
    assert [r.s for r in shown] == [3.1]


def test_a_page_beyond_the_last_keeps_total_and_note(spark):
    rows = shelf(spark)
    page = recommend.sommelier_for_cards(rows, color="sparkling", sweetness="sweet", offset=30).collect()
    assert [(r.place, r.slug, r.total) for r in page] == [(None, None, 1)] and "без учёта сладости" in page[0].note
    none = recommend.sommelier_for_cards(rows, color="rose", sweetness="sweet").collect()
    assert [(r.slug, r.total, r.note) for r in none] == [(None, 0, None)]


@pytest.mark.parametrize("at_least,most", [(0.3, 10**6), (0.6, 3), (0.9, 1)])
def test_cosine_join_against_all_pairs(spark, at_least, most):
    rows = made_shelf(spark, 7, 120)
    weights = text.profiles(text.term_counts(rows), rows.count(), most_common=0.9).cache()
    vectors, names = {}, {}
    for slug, term, weight in one(weights, "slug", "term", "weight"):
        vectors.setdefault(slug, {})[term] = weight
    for slug in sorted(vectors):
        names.setdefault(tuple(sorted(vectors[slug].items())), slug)
    assert dict(one(text.same_profiles(weights), "slug", "profile")) == {s: names[tuple(sorted(v.items()))] for s, v in vectors.items()}
    firsts, due = sorted(names.values()), set()
    for i, a in enumerate(firsts):
        for b in firsts[i + 1 :]:
            units = sum(int(w * vectors[b][t] * text.UNIT) for t, w in vectors[a].items() if t in vectors[b])
            if units >= at_least * text.UNIT:
                due.add((a, b, units))
    assert due and set(one(text.cosine_join(weights, at_least, most), "a", "b", "units")) == due


def test_cosine_join_moves_no_pairs(spark):
    rows = made_shelf(spark, 11, 300)
    weights = text.profiles(text.term_counts(rows), rows.count(), most_common=0.9).cache()
    for most in (10**6, 20):
        found = text.cosine_join(weights, 0.3, most)
        pairs = one(found, "a", "b")
        assert len(pairs) == len(set(pairs)) > 8 * weights.count()
        assert most_joined(found) <= 2 * weights.count()


def test_shared_terms_in_slices(spark):
    rows = made_shelf(spark, 8, 80)
    weights = text.profiles(text.term_counts(rows), rows.count(), most_common=0.9).cache()
    whole = sorted(one(text.shared_terms(weights, weights), "base", "slug", "term", "units"))
    assert whole and whole == sorted(one(text.shared_terms(weights, weights, 2), "base", "slug", "term", "units"))


def test_sommelier(spark):
    rows = shelf(spark)
    found = recommend.sommelier_for_cards(rows, dish="fish", color="white").collect()
    assert len(found) == 3 and found[0].total == 14 and found[0].note is None
    relaxed = recommend.sommelier_for_cards(rows, color="sparkling", sweetness="sweet").collect()
    assert [r.slug for r in relaxed] == ["bryut"] and "без учёта сладости" in relaxed[0].note and "среди игристых" in relaxed[0].note
    weak = recommend.sommelier_for_cards(rows, dish="fish", color="red").collect()
    assert [r.slug for r in weak] == ["red"] and weak[0].note.startswith("Прямых рекомендаций")
    first, second = (recommend.sommelier_for_cards(rows, color="white", offset=o).collect() for o in (0, 3))
    assert [r.place for r in second] == [4, 5, 6] and not {r.slug for r in first} & {r.slug for r in second}
    for wrong in ({"dish": "soup"}, {"color": "blue"}, {"sweetness": "salty"}):
        with pytest.raises(ValueError, match="Unknown"):
            recommend.sommelier_for_cards(rows, **wrong)


def test_pairings(spark):
    rows = cards(spark, {"slug": "r", "category": "Красное", "description": "Мягкие танины"}, {"slug": "s", "name": "Полусладкое", "description": "сладкое", "category": "Белое"})
    found = {(r.slug, r.dish): r.reason for r in pairing.suggestions(rows).collect()}
    assert found["r", "red_meat"].endswith("поддерживают мясное блюдо.") and ("s", "spicy") in found and len(found) == 6
    fish = {r.slug: r for r in pairing.dish_fit(rows, "fish").collect()}
    assert fish["r"].fit == "сочетание зависит от блюда" and fish["r"].reason.endswith("красное мясо.")
    with pytest.raises(ValueError, match="soup"):
        pairing.dish_fit(rows, "soup")


# ---- labels, predictions, evaluation ----

LABELS = "image_path string, image_sha256 string, status string, slug string, evidence string"


def labels(spark, *rows):
    return spark.createDataFrame([(n, n[0] * 64, status, slug, evidence) for n, status, slug, evidence in rows], LABELS)


def predictions(spark, *rows):
    return spark.createDataFrame([(n, n[0] * 64, top[0], top, 100 * i, True, False) for i, (n, top) in enumerate(rows, 1)], "image_path string, image_sha256 string, predicted_slug string, top5_slugs array<string>, latency_ms long, ocr_used boolean, verifier_used boolean")


def test_label_rules(spark):
    good = labels(spark, ("a", "verified", "x", "seen"), ("b", "unknown", None, "seen"))
    checks.require_none(checks.label_violations(good), "Labels")
    for bad in [("c", "unknown", "x", "seen"), ("c", "verified", None, "seen"), ("c", "maybe", None, "seen"), ("c", "unknown", None, None), ("a", "unknown", None, "again"), ("z", "unknown", None, "seen")]:
        with pytest.raises(ValueError, match="Labels"):
            checks.require_none(checks.label_violations(good.unionByName(labels(spark, bad))), "Labels")


def test_score(spark):
    known = labels(spark, ("a", "verified", "x", "seen"), ("b", "unknown", None, "seen"))
    guesses = predictions(spark, ("a", ["y", "x"]), ("b", ["x"]), ("c", ["x"]))
    found, wrong = evaluation.score(guesses, known)
    assert (found.first().top1_correct, found.first().top5_correct, found.first().top1_accuracy) == (0, 1, 0.0)
    assert [tuple(r) for r in wrong.collect()] == [("a", "x", "y")]
    with pytest.raises(ValueError, match="no prediction"):
        evaluation.score(guesses.where("image_path <> 'b'"), known)
    with pytest.raises(ValueError, match="differs"):
        evaluation.score(guesses.withColumn("image_sha256", F.lit("e" * 64)), known)
    with pytest.raises(ValueError, match="repeated"):
        evaluation.score(guesses.unionByName(guesses), known)
    with pytest.raises(ValueError, match="first of the top five"):
        evaluation.score(guesses.withColumn("predicted_slug", F.lit("other")), known)
    summary = evaluation.evaluation_summary(guesses, known).first()
    assert (summary.images, summary.ocr_invocations, summary.p50_latency_ms, summary.p95_latency_ms, summary.mean_latency_ms) == (3, 3, 200, 290, 200)
    assert evaluation.accuracy(evaluation.judged(guesses, known.where("status = 'unknown'"))).first().top1_accuracy is None


@pytest.mark.parametrize("margin,most", [(0.01, 10**6), (0.0, 10**6), (0.05, 30)])
def test_exact_percentiles(spark, monkeypatch, margin, most):
    """Also where brackets miss their place and are taken wider, and where they are narrowed."""
    import random

    monkeypatch.setattr(evaluation, "MARGIN", margin)
    monkeypatch.setattr(evaluation, "IN_BRACKET", most)
    monkeypatch.setattr(evaluation, "SKETCH", 16)

    import numpy as np

    rng = random.Random(3)
    values = {"a": [rng.gauss(0, 100) for _ in range(700)], "b": [float(rng.randint(0, 3)) for _ in range(400)], "c": [5.0], "d": [1.0, 2.0], None: [rng.random() for _ in range(101)]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    found = {r.g: r for r in evaluation.exact_percentiles(rows, ["g"], "v", {"low": 0.05, "mid": 0.5, "high": 0.95, "top": 1.0}).collect()}
    assert found.keys() == values.keys()
    for g, vs in values.items():
        assert [found[g].low, found[g].mid, found[g].high, found[g].top] == pytest.approx([float(np.percentile(vs, p)) for p in (5, 50, 95, 100)])
    whole = evaluation.exact_percentiles(rows.where("g = 'a'"), [], "v", {"mid": 0.5}).collect()
    assert [r.mid for r in whole] == pytest.approx([float(np.percentile(values["a"], 50))])
    assert {r.g: r.n for r in evaluation.latency(rows, ["g"], "v").collect()}["e"] == 1


def test_review(spark):
    scores = [0.84 - 0.001 * i for i in range(20)]
    ranked = spark.createDataFrame([("a", i, f"s{i}", x) for i, x in enumerate(scores, 1)], "name string, rank int, slug string, score double")
    rows = evaluation.review_rows(ranked, labels(spark, ("a", "verified", "s3", "Seen")))
    summary = evaluation.review_summary(rows)
    assert tuple(summary.select("verified_rank", "gap_first_second", "spread", "top1").first()) == (3, 0.001, 0.019, "s1")
    assert one(rows.where("rank = 3"), "gap_to_first") == [0.002]
    assert evaluation.review_list(summary, "verified", " SEEN ").count() == 1 and evaluation.review_list(summary, "unknown").count() == 0
    with pytest.raises(ValueError, match="status"):
        evaluation.review_list(summary, "other")
    known = spark.createDataFrame([(f"s{i}", f"s{i}.png") for i in range(1, 21)], "slug string, image_name string")
    whole = ranked.withColumn("filename", F.concat("slug", F.lit(".png")))
    assert checks.ranking_violations(whole, known, 20).count() == 0
    assert one(checks.ranking_violations(whole.where("rank <> 4"), known, 20), "rule") == ["has another length", "ranks have gaps"]


# ---- files ----

HEADER = "category,color,desc,fname,grape_type,is_valid_img,region,slug,vine_name,winery"


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(f'﻿{HEADER}\nБелое,,"two\nlines ""quoted""",1.png,, TRUE,,a, Name ,w\nБелое,,,2.png,,false,,b,,w\n', encoding="utf-8")
    rows = {r.slug: r for r in files.read_catalog(spark, str(path)).collect()}
    assert rows["a"].description == 'two\nlines "quoted"' and rows["a"].name == "Name" and rows["a"].reference_available and not rows["b"].reference_available
    for line, what in (("x,,,../1.png,,true,,a,,w", "unsafe"), ("x,,,1.png,,yes,,a,,w", "true or false"), ("x,,,1.png,,true,,,,w", "empty")):
        path.write_text(f"{HEADER}\n{line}\n", encoding="utf-8")
        with pytest.raises(ValueError, match=what):
            files.read_catalog(spark, str(path))
    path.write_text("slug,fname\na,b\n")
    with pytest.raises(ValueError, match="Missing catalog columns"):
        files.read_catalog(spark, str(path))


def test_label_and_query_files(spark, tmp_path):
    path = tmp_path / "l.tsv"
    path.write_text("image_path\timage_sha256\tstatus\tslug\tevidence\na\t" + "a" * 64 + "\tverified\tx\tseen\nb\t" + "b" * 64 + "\tunknown\t\tseen\n")
    assert sorted(one(files.read_labels(spark, str(path)), "image_path")) == ["a", "b"] and files.read_labels(spark, None).count() == 0
    path.write_text("image_path\tstatus\na\tb\n")
    with pytest.raises(ValueError, match="columns"):
        files.read_labels(spark, str(path))
    path.write_text("query_id\timage_path\n1\ta\n1\tb\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_query_manifest(spark, str(path))


def test_json_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "source_rows": 1, "cards": [{"slug": "a", "reference_available": True}], "images": [{"filename": "1.png", "sha256": "0", "slugs": ["a"]}], "excluded_slugs": ["z"], "counts": {"unique_cards": 1}}, indent=1))
    found, images, gone = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert (one(found, "slug"), one(images, "slugs"), one(gone, "slug")) == (["a"], [["a"]], ["z"])
    (tmp_path / "m.json").write_text('{"schema_version": 2}')
    with pytest.raises(ValueError, match="version"):
        files.read_manifest(spark, str(tmp_path / "m.json"))
    rows = predictions(spark, ("a", ["y", "x"]))
    files.write_predictions(rows, str(tmp_path / "p"))
    assert one(files.read_predictions(spark, str(tmp_path / "p")), "top5_slugs") == [["y", "x"]]
    (tmp_path / "f.json").write_text(json.dumps({"schema_version": 1, "baseline_manifest_sha256": "0", "fixes": [{"slug": "a", "from_image": "1", "target_image": "2", "target_sha256": "3"}]}))
    assert one(files.read_fixes(spark, str(tmp_path / "f.json")), "slug", "target_image") == [("a", "2")]


def test_index_and_images(spark, tmp_path):
    _, gallery = tiny(spark)
    files.write_index(gallery, str(tmp_path / "i"), "m1", "v1")
    assert files.read_index(spark, str(tmp_path / "i"), "m1", "v1").count() == 2
    with pytest.raises(ValueError, match="out of date"):
        files.read_index(spark, str(tmp_path / "i"), "m2", "v1")
    (tmp_path / "x").mkdir()
    for name, data in (("a.png", b"1"), ("b.JPG", b"2" * 20), ("c.txt", b"3")):
        (tmp_path / "x" / name).write_bytes(data)
    images = files.read_images(spark, str(tmp_path / "x"))
    assert sorted(one(images, "name")) == ["a.png", "b.JPG"]
    assert one(files.upload_violations(images, 10), "key", "rule") == [("b.JPG", "is too large")]


def test_index_knows_its_rows_and_its_manifest(spark, tmp_path):
    _, gallery = tiny(spark)
    path = str(tmp_path / "i")
    files.write_index(gallery, path, "m1", "v1")
    images = spark.createDataFrame([("r1", ["a", "b"]), ("r2", ["c"])], "filename string, slugs array<string>")
    assert files.read_index(spark, path, "m1", "v1", images).count() == 2
    with pytest.raises(ValueError, match="Index and manifest"):
        files.read_index(spark, path, "m1", "v1", images.limit(1))
    first = next((tmp_path / "i").glob("data-*")) / "gallery"
    gallery.limit(1).write.mode("overwrite").parquet(str(first))
    with pytest.raises(ValueError, match="changed"):
        files.read_index(spark, path, "m1", "v1")
    files.write_index(gallery, path, "m2", "v1")  # a new folder; the facts name it last
    assert files.read_index(spark, path, "m2", "v1").count() == 2


def odd_card(i):
    fields = {c: f'{c} {i} "quoted" \\ {{}} }}\n    {{\n  "x": ]' for c in files.CARD_KINDS if c != "reference_available"}
    return fields | {"slug": f"s{i}", "reference_available": i % 2 == 0}


def test_manifest_is_split_at_its_elements(spark, tmp_path):
    """The same rows as read whole, whatever stands in the strings, and in more than one task."""
    found = [odd_card(i) for i in range(400)]
    images = [{"filename": f"{i}.png", "sha256": "0" * 64, "slugs": [f"s{i}", "x, ]"]} for i in range(50)]
    whole = {"cards": found, "counts": {"unique_cards": 400}, "excluded_slugs": ["z", 'q"],'], "images": images, "schema_version": 1, "source_rows": 400}
    (tmp_path / "two.json").write_text(json.dumps(whole, ensure_ascii=False, indent=2))
    (tmp_path / "one.json").write_text(json.dumps(whole, ensure_ascii=False, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split, one_task = (files.read_manifest(spark, str(tmp_path / f"{n}.json")) for n in ("two", "one"))
        assert split[0].rdd.getNumPartitions() > 5 and one_task[0].rdd.getNumPartitions() == 1
        for a, b in zip(split, one_task, strict=True):
            assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())) and a.count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_faults_of_a_manifest_are_named(spark, tmp_path):
    wrong = odd_card(1) | {"winery": 7}
    short = {k: v for k, v in odd_card(2).items() if k != "region"}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"cards": [odd_card(0), wrong, short], "images": [], "schema_version": 1}, indent=2))
    with pytest.raises(ValueError, match="winery is BIGINT|region is missing"):
        files.read_manifest(spark, str(path))
    path.write_text(json.dumps({"cards": [odd_card(0)], "schema_version": 3}, indent=2))
    with pytest.raises(ValueError, match="version"):
        files.read_manifest(spark, str(path))


def test_objects_and_reports_by_name(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", "a", "b", "c", None) for i in range(20)], "slug string, from_image string, target_image string, target_sha256 string, evidence string")
    objects.write_objects(rows.repartition(3), str(tmp_path / "f"), "fixes", {"baseline_manifest_sha256": "0a", "schema_version": 1})
    for file in (tmp_path / "f").glob("part-*"):
        assert json.loads(file.read_text())["schema_version"] == 1
    found = files.read_fixes(spark, str(tmp_path / "f")).collect()
    assert sorted(r.slug for r in found) == sorted(f"s{i}" for i in range(20)) and {r.baseline_manifest_sha256 for r in found} == {"0a"}
    visual = {f'n"{i}"': {"sha256": str(i), "candidates": [{"rank": 1, "slug": "s", "filename": "f", "name": "}\n  }", "winery": "w", "score": 0.5}]} for i in range(9)}
    ocr = {n: {"sha256": "x", "lines": [{"text": "t", "confidence": 0.5}]} for n in visual}
    for indent in (2, None):
        for name, data in (("visual.json", visual), ("ocr.json", ocr)):
            (tmp_path / name).write_text(json.dumps(data, indent=indent))
        seen, lines = files.read_review(spark, str(tmp_path))
        assert {r["name"]: r.candidates[0]["name"] for r in seen.collect()} == {n: "}\n  }" for n in visual}
        assert sorted(one(lines, "name")) == sorted(visual)


@pytest.mark.parametrize("step", ["data", "put", "move_if_absent", "numbers"])
def test_readers_see_the_old_or_the_new(spark, tmp_path, monkeypatch, step):
    """A writer that stops between any two steps leaves the version before it; the next one publishes."""
    path, rows = str(tmp_path / "p"), predictions(spark, ("a", ["y", "x"]))
    seen = lambda: one(files.read_predictions(spark, path), "image_path")
    files.write_predictions(rows, path)

    def stop(*_args, **_more):
        raise RuntimeError("stopped")

    other = predictions(spark, ("b", ["y", "x"]))
    with monkeypatch.context() as patched:
        if step == "data":
            with pytest.raises(RuntimeError):
                publish.publish(spark, path, lambda folder: (other.write.json(folder), stop()))
        else:
            patched.setattr(publish, step, stop)
            with pytest.raises(RuntimeError):
                files.write_predictions(other, path)
    assert seen() == ["a"] and publish.numbers(spark, path) == [1]
    files.write_predictions(other, path)
    assert seen() == ["b"] and publish.numbers(spark, path) == [1, 2]


def test_two_writers_get_two_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    files.write_report(spark.range(1), path)
    monkeypatch.setattr(publish, "numbers", lambda *_: [])  # one that doesn't know of the other
    files.write_report(spark.range(2), path)
    monkeypatch.undo()
    assert publish.numbers(spark, path) == [1, 2] and files.read_report(spark, path, "id long").count() == 2
    assert publish.latest(spark, str(tmp_path / "none")) is None


def test_digest_trees_find_what_changed(spark, monkeypatch):
    monkeypatch.setattr(integrity, "LEAF", 4)
    rows = spark.range(3000).select(F.concat(F.lit("n"), "id").alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    other = rows.where("id <> 17").withColumn("digest", F.when(F.col("id") == 5, F.lit("x")).otherwise(F.col("digest"))).unionByName(spark.createDataFrame([("new", "d", -1)], rows.schema))
    depth = integrity.depth_for(3000)
    old, new = integrity.digest_tree(rows.drop("id"), depth).cache(), integrity.digest_tree(other.drop("id"), depth).cache()
    assert depth == 3 and integrity.root(old) != integrity.root(new)
    ranges = integrity.changed_ranges(old, new, depth)
    assert {len(r) for r in one(ranges, "range")} == {3} and ranges.count() <= 3
    assert sorted(one(integrity.changed_rows(rows, other, ranges, depth), "name", "change")) == [("n17", "removed"), ("n5", "differs"), ("new", "added")]
    assert integrity.changed_ranges(old, old, depth).count() == 0
    nothing = integrity.digest_tree(rows.drop("id").limit(0))
    assert integrity.root(nothing) == integrity.root(nothing.limit(0)) and integrity.changed_ranges(nothing, nothing, 1).count() == 0


@pytest.mark.parametrize("word,other", [("Straße", "STRASSE"), ("ΟΔΟΣ", "οδος"), ("ΟΔΟΣ", "οδοσ"), ("Игристое", "ИГРИСТОЕ"), ("İzmir", "i̇zmir"), ("naïve", "NAÏVE"), ("ﬁn", "FIN"), ("abc", "abd"), ("и", "й")])
def test_lists_are_searched_without_regard_to_case(spark, word, other):
    rows = spark.createDataFrame([("verified", f"x {word} y", None, None, None)], "status string, name string, evidence string, verified_slug string, top1 string")
    wanted = other.casefold() in f"x {word} y".casefold()
    assert (evaluation.review_list(rows, "verified", other).count() == 1) == wanted


def test_manifest_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = cards(spark, {"slug": "a"})
    files.write_manifest({"cards": rows}, path, 1, "x")
    files.write_manifest({"cards": rows.unionByName(cards(spark, {"slug": "b"}))}, path, 2, "y")
    assert sorted(one(files.read_manifest_part(spark, path, "cards", CARD), "slug")) == ["a", "b"]
    with pytest.raises(Exception):
        files.read_manifest_part(spark, str(tmp_path / "none"), "cards", CARD)


# ---- review ----


def bundle(spark, tmp_path, **changes):
    """A review of two photos, read from files; changes replace parts of it."""
    sha = {n: n * 64 for n in "ab"}
    ranked = [{"rank": k + 1, "slug": f"s{k}", "filename": f"f{k}.png", "name": "", "winery": "", "score": 1.0 - k} for k in range(3)]
    visual = {n: {"sha256": sha[n], "candidates": ranked} for n in "ab"} | changes.get("visual", {})
    ocr = {n: {"sha256": sha[n], "lines": [{"text": "x", "confidence": 0.5}]} for n in "ab"} | changes.get("ocr", {})
    (tmp_path / "visual.json").write_text(json.dumps(visual))
    (tmp_path / "ocr.json").write_text(json.dumps(ocr))
    labels = [("a", sha["a"], "verified", "s1", "seen"), ("b", sha["b"], "unknown", None, "blurred")]
    labels = spark.createDataFrame(changes.get("labels", labels), "image_path string, image_sha256 string, status string, slug string, evidence string")
    photos = spark.createDataFrame(changes.get("photos", list(sha.items())), "name string, sha256 string")
    rows = cards(spark, *[{"slug": f"s{k}", "image_name": f"f{k}.png"} for k in range(3)])
    images = spark.createDataFrame([(f"f{k}.png", str(k)) for k in range(changes.get("images", 3))], "filename string, sha256 string")
    return labels, photos, *files.read_review(spark, str(tmp_path)), rows, images


def test_review_bundle(spark, tmp_path):
    good = bundle(spark, tmp_path)
    assert review.bundle_violations(*good, expected=2, width=3).count() == 0
    whole = review.photo_bundle(good[0], good[2], good[3]).orderBy("name").collect()
    assert [(r.name, len(r.candidates), r.lines[0].text) for r in whole] == [("a", 3, "x"), ("b", 3, "x")]
    assert sorted(one(review.allowed_references(good[2], good[0], good[4], good[5]), "filename")) == ["f0.png", "f1.png", "f2.png"]
    asked = spark.createDataFrame([("f1.png",), ("../etc/passwd",), ("f9.png",)], "filename string")
    assert one(review.allowed_media(asked, good[5]), "filename") == ["f1.png"]
    late = [{"rank": 1, "slug": "s0", "filename": "f0.png"}, {"rank": 3, "slug": "s1", "filename": "f1.png"}, {"rank": 3, "slug": "s2", "filename": "f1.png"}]
    for changes, rules in [
        ({"photos": [("a", "a" * 64)]}, {"photo: only left"}), ({"photos": [("a", "a" * 64), ("b", "c")]}, {"photo: other bytes"}),
        ({"ocr": {"c": {"sha256": "", "lines": []}}}, {"reading: only right"}), ({"images": 2}, {"file has no image"}),
        ({"visual": {"a": {"sha256": "a" * 64, "candidates": late}}}, {"rank or slug of a candidate", "file differs from the card's"}),
        ({"visual": {"a": {"sha256": "a" * 64, "candidates": late[:1]}}}, {"number of candidates"}),
        ({"labels": [("a", "a" * 64, "verified", "zz", "e"), ("b", "b" * 64, "unknown", None, "e")]}, {"no such card"}),
        ({"labels": [("a", "a" * 64, "verified", "s1", "e")]}, {"number of labels", "photo: only right", "visual report: only right", "reading: only right"}),
    ]:
        assert {r.rule for r in review.bundle_violations(*bundle(spark, tmp_path, **changes), expected=2, width=3).collect()} == rules


def test_review_report_and_detail(spark, tmp_path):
    rows = cards(spark, *[{"slug": f"s{k}", "name": f"n{k}", "image_name": f"i{k}"} for k in (1, 2)])
    images = spark.createDataFrame([("i1", "h1"), ("i2", "h2")], "filename string, sha256 string")
    report = review.review_report(ranking(spark, [0.9, 0.8]), rows, images, 1)
    assert one(report, "rank", "slug", "name", "reference_file", "reference_sha256") == [(1, "s1", "n1", "i1", "h1")]
    with pytest.raises(ValueError, match="top_k"):
        review.review_report(ranking(spark, [0.9]), rows, images, 0)
    files.write_report(report, str(tmp_path / "r"))
    assert files.read_report(spark, str(tmp_path / "r"), "slug string").first().slug == "s1"
    labels = spark.createDataFrame([("q", "x", "verified", "s2", "e")], "image_path string, image_sha256 string, status string, slug string, evidence string")
    ranked = ranking(spark, [0.9, 0.8]).withColumnRenamed("query_id", "name").select("name", "rank", "slug", "score")
    detail = review.review_detail(evaluation.review_rows(ranked, labels), rows, images).orderBy("rank").collect()
    assert [(r.rank, r.gap_to_first, r.card.name, r.reference_sha256, r.verified_card.name) for r in detail] == [(1, 0.0, "n1", "h1", "n2"), (2, 0.1, "n2", "h2", "n2")]


def test_lookups_and_preparation(spark):
    rows = cards(spark, {"slug": "a", "name": "x"}, {"slug": "b"})
    assert one(review.card_by_slug(rows, "a"), "name") == ["x"] and tuple(review.health(rows).first()) == ("ready", 2)
    with pytest.raises(KeyError):
        review.card_by_slug(rows, "zz")
    images = spark.createDataFrame([("1.png", "0")], "filename string, sha256 string")
    review.verify_prepared(images, images.select("filename"), images)
    for present in (images.limit(0), images.withColumn("sha256", F.lit("9"))):
        with pytest.raises(ValueError, match="References"):
            review.verify_prepared(images, images.select("filename"), present)
    fixes = spark.createDataFrame([("a", "", "new.png", "1", "old")], "slug string, from_image string, target_image string, target_sha256 string, baseline_manifest_sha256 string")
    for known, shown in (("new", images), ("old", images.withColumn("sha256", F.lit("9")))):
        with pytest.raises(ValueError, match="Baseline"):
            catalog.corrected_catalog(rows, fixes, shown, known, images)


def test_views(spark):
    image = spark.createDataFrame([("a", 100, 51)], "name string, width int, height int")
    assert [tuple(r)[2:] for r in views.boxes(image, [(0.0, 0.5, 0.25, 1.0)]).collect()] == [(0, 26, 25, 51)]
    box = image.selectExpr("*", "0 AS left", "0 AS top", "10 AS right", "10 AS bottom")
    assert tuple(views.trimmed(box).first()) == ("a", 100, 51)
    assert tuple(views.padded(views.boxes(image, [(0.0, 0.0, 1.0, 1.0)])).select("inner_width", "inner_height").first()) == (384, 196)


def test_stream_answers_once(spark, tmp_path):
    queries, gallery = tiny(spark)
    queries.write.parquet(str(tmp_path / "q"))
    for _ in range(2):
        runs.stream_answers(spark, str(tmp_path / "q"), "query_id string, crops array<array<double>>", gallery, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert one(spark.read.parquet(str(tmp_path / "out")), "query_id", "slug") == [("q", "a")]
