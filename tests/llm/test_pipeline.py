"""The pipeline's rows against plain versions of its stages, and plain versions of the trained models."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tallyvine.llm import common, quality, toxicity

from .test_operators import SCHEMA, awkward, words

BAD = ["vilex", "gromul", "hatzen"]


def plain_mix(sizes):
    """Targets of the sources by water-filling, as op8 states it."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    clamped, level = set(), 0.0
    while len(clamped) < len(sizes):
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in clamped)
        level = left / sum(w for s, w in weight.items() if s not in clamped)
        above = {s for s in sizes if s not in clamped and weight[s] * level > 2 * sizes[s]}
        if not above:
            break
        clamped |= above
    return {s: 2 * sizes[s] if s in clamped else weight[s] * level for s in sizes}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(9), tmp_path_factory.mktemp("pipeline")
    items = [" ".join(words(14, 7000 + k)) for k in range(6)]
    texts = []
    for i in range(480):
        own = words(60, i)
        if i % 4 == 0:
            for k in (5, 20, 21, 22, 23, 24, 40):
                own[k] = rng.choice(BAD)
        texts.append(" ".join(own))
    clean = [t for i, t in enumerate(texts) if i % 4]
    texts += [clean[k] for k in range(12)]  # exact copies
    for k in range(20, 32):  # near copies
        changed = clean[k].split()
        changed[30] = "anders"
        texts.append(" ".join(changed))
    texts += [" ".join(words(30, 800 + k)) + " " + items[k] + " " + " ".join(words(30, 900 + k)) for k in range(6)]
    texts += ["", None]
    sources = rng.choices(["a", "b", "ü", None], [6, 2, 1, 1], k=len(texts))
    rows = [(i, t, "en", s, len(t or ""), "x", 1, "y") for i, (t, s) in enumerate(zip(texts, sources))]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 == 0), 1) for i in range(480)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts, sources, items


def test_pipeline_against_plain_stages(spark, tables):
    folder, texts, sources, items = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    toxic = {i for i, t in enumerate(texts) if any(w in (t or "").split() for w in BAD)}
    left = [i for i in range(len(texts)) if i not in toxic]
    grams = {i: {tuple((texts[i] or "").split()[k : k + 5]) for k in range(len((texts[i] or "").split()) - 4)} for i in left}
    top = {i: i for i in left}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in left:
        for j in left:
            if j < i and ((texts[i] or "") == (texts[j] or "") or grams[i] and grams[j] and len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    left = [i for i in left if find(i) == i]
    left = [i for i in left if not any(item in (texts[i] or "") for item in items)]
    sizes = Counter()
    for i in left:
        sizes[sources[i]] += len((texts[i] or "").split())
    targets, taken = plain_mix(sizes), Counter()
    times = Counter(r.doc_id for r in rows)
    assert set(times) <= set(left) and max(times.values()) <= 2
    for i in left:
        taken[sources[i]] += times[i] * len((texts[i] or "").split())
    assert all(abs(taken[s] - targets[s]) <= 62 for s in sizes)  # one document
    home, slots = {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and home.setdefault(texts[r.doc_id] or "", r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.shard) for r in again.collect()) == sorted((r.doc_id, r.shard) for r in rows)


def test_stages_return_documents(spark, tables):
    folder, texts, *_ = tables
    docs = common.read_table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == common.DOCUMENT_COLUMNS and docs.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


# ---- models against plain versions ----


def test_ftrl_against_a_plain_version():
    """Per-coordinate updates with dictionaries, as the algorithm is published."""
    rng, model = random.Random(4), quality.Ftrl()
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(400):
        x = {i: rng.random() for i in rng.sample(range(50), rng.randint(1, 8))}
        label = int(sum(i % 2 for i in x) * 2 > len(x))
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
        old = {i: weight(i) for i in x}
        for i, v in x.items():
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * old[i]
            n[i] += g * g
        model.learn(np.array(list(x)), np.array(list(x.values())), label)
    found = model.weights(np.arange(50))
    assert found == pytest.approx([weight(i) for i in range(50)]) and np.abs(found).max() > 0.1


def test_log_odds_against_a_plain_version():
    rng = random.Random(2)
    counts = pd.DataFrame({"token": [f"t{i}" for i in range(60)], "toxic": [rng.randint(0, 40) for _ in range(60)], "clean": [rng.randint(0, 40) for _ in range(60)]})
    n_toxic, n_clean = 900, 2100
    expected = {}
    for token, y, x in counts.itertuples(index=False):
        prior = toxicity.PRIOR * (y + x)
        a0 = toxicity.PRIOR * (n_toxic + n_clean)
        a, b = y + prior, x + prior
        odds = math.log(a / (n_toxic + a0 - a)) - math.log(b / (n_clean + a0 - b))
        sure = abs(odds) - toxicity.ERRORS * math.sqrt(1 / a + 1 / b) if a and b else 0
        if sure > 0:
            expected[token] = math.copysign(sure, odds)
    some = counts[counts.toxic + counts.clean > 0]
    assert toxicity.log_odds(some, n_toxic, n_clean) == pytest.approx(expected) and len(expected) > 5


def test_calibration_against_a_plain_version(spark, tables):
    """Drift, location and curve of a trained model from the texts themselves."""
    folder, texts, *_ = tables
    docs, labels = common.read_table(spark, folder, "documents"), common.read_table(spark, folder, "labels")
    model = toxicity.train(docs, labels)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    used = {}  # of equal texts the smallest id
    for i in range(480):
        if fold(i) != 0:
            used.setdefault(texts[i], i)
    ids = spark.createDataFrame([(i,) for i in used.values()], "doc_id long")
    fitting = {r.doc_id for r in ids.where(f"pmod(xxhash64('curve', doc_id), {toxicity.CALIBRATION}) = 0").collect()}
    toxic, clean, uses = Counter(), Counter(), Counter()
    for text, i in used.items():
        if i not in fitting:
            found = set(toxicity.WORD.findall(text))
            (toxic if i % 4 == 0 else clean).update({t for w in found for t in toxicity.tokens_of(w)})  # texts, not uses
            if i % 4:
                uses.update(toxicity.WORD.findall(text))
    frequent = [t for t in {*toxic, *clean} if toxic[t] + clean[t] >= toxicity.LEAST_COUNT]
    table = pd.DataFrame({"token": frequent, "toxic": [toxic[t] for t in frequent], "clean": [clean[t] for t in frequent]})
    assert model.scores == pytest.approx(toxicity.log_odds(table, sum(toxic.values()), sum(clean.values())))
    plain_words = [t for t in frequent if not t.endswith("*")]
    gain = sum(uses[t] * (math.exp(model.words[t]) - 1) for t in plain_words) / max(sum(uses[t] for t in plain_words), 1)
    assert model.drift == pytest.approx(max(toxicity.LEAST_DRIFT, math.log1p(max(0.0, gain))))
    held = [(i, *model.segments(texts[i])) for i in fitting]
    best = [max((s for *_, s in found), default=0.0) - math.log(n) for i, found, n in held if i % 4]
    assert model.log_k == pytest.approx(sum(best) / len(best) - 0.5772156649)
    x = [sum(max(0.0, s - model.log_k - math.log(n)) for *_, s in found) for _, found, n in held]
    y = [float(i % 4 == 0) for i, *_ in held]
    p = [model.probability(v) for v in x]
    # at the optimum the slopes of the penalised likelihood are zero
    assert sum(b - a for a, b in zip(p, y)) == pytest.approx(0, abs=0.05)
    assert sum(v * (b - a) for v, a, b in zip(x, p, y)) == pytest.approx(0.01 * model.slope, abs=0.05)


# ---- values of awkward rows ----


def test_awkward_values(spark):
    """Null ids, repeated rows and empty texts: the values, not only the number of rows."""
    from tallyvine.llm import decontaminate, mixing, pii, sharding

    docs = awkward(spark)
    plain = [(r.doc_id, r.text or "", r.source) for r in docs.collect()]
    weights = np.zeros((1 << quality.BITS) + 1, np.float32)
    weights[1 << quality.BITS] = 1.0
    assert sorted(((r.doc_id or -1, r.score) for r in quality.score_documents(docs, weights).collect())) == sorted((i or -1, pytest.approx(quality.logistic(1.0))) for i, *_ in plain)
    model = toxicity.ToxicityModel({"one": 9.0}, bias=-1.0, slope=2.0)
    scores = sorted((r.doc_id or -1, round(r.score, 9), len(r.passages)) for r in toxicity.score_documents(docs, model).collect())
    assert scores == sorted((i or -1, round(model.probability(toxicity.document_evidence(model, t)[0]), 9), len(toxicity.document_evidence(model, t)[1])) for i, t, _ in plain)
    assert sum(s > 0.5 for _, s, _ in scores) == 4  # the rows with the word, each by itself
    said = sorted((r.doc_id or -1, r.spans) for r in pii.find_mentions(docs, pii.Potentials()).collect())
    assert said == sorted((i or -1, "") for i, *_ in plain)
    sized = mixing.sized_documents(docs)
    mixed = mixing.repetitions(sized, mixing.mix_plan(sized)).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in mixed) == Counter((i, len(t.split()), s) for i, t, s in plain)
    sizes = Counter()
    for _, t, s in plain:
        sizes[s] += len(t.split())
    targets = plain_mix(sizes)
    assert all(r.target == pytest.approx(targets[r.source]) and r.source_size == sizes[r.source] for r in mixed)
    shards = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in shards) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, _ in plain)
    benchmark = spark.createDataFrame([(7, "other text here"), (8, None), (9, "")], "item_id long, text string")
    hits = decontaminate.contaminated(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.start, r.end) for r in hits] == [(6, 7, 0, 0, 15)]
    assert Counter(r.doc_id for r in decontaminate.keep_uncontaminated(docs, benchmark).collect())[6] == 1
