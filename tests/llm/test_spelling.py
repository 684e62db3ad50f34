"""Spelling variants, against every pair of words compared letter by letter."""

import random
import re
import zlib
from collections import Counter

from tallyvine.llm import spelling
from tests.llm.test_operators import SCHEMA, awkward, documents


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def test_one_edit():
    rng = random.Random(8)
    words = ["".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(150)]
    assert all(spelling.one_edit(a, b) == one_edit(a, b) for a in words for b in words)


def plain(rows):
    """All rows of documents (doc_id, text)."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    if len(words) < 1500:
        near = {w: [v for v in words if one_edit(w, v)] for w in words}
    else:  # by what is left when a letter goes, as all pairs are too many
        left = {}
        for w in words:
            for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
                left.setdefault(x, []).append(w)
        near = {w: {v for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for v in left[x] if one_edit(w, v)} for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    root = {}
    for w in words:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted((w, form[w] or "", root[w], words[w], len(near[w]), words.get(form[w], 0)) for w in words)


def found(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


def test_groups_against_all_pairs(spark):
    rng = random.Random(3)
    stems = ["aaaaaaa", "aaaaaaaa", "abababab", "ababababa", "straße", "garçonnière", "ÀÉÎõüýÿ", "résumése", "international", "Internatoinal", "settlement", "settlemant"]
    texts = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abeé") + w[at:], w[:at] + rng.choice("abeé") + w[at + 1 :]])
            words.append(w)
        texts.append((" " if i % 2 else "-1_").join(words))
    texts += ["wordform " * 300, "wordforn " * 25, "wordfoÿn " * 3, "wordfobn", None, "", "中wordform文", "wordfobn"]
    assert found(spelling.spelling_groups(documents(spark, texts).repartition(5))) == plain(enumerate(texts))


def test_scan_over_batches(spark, monkeypatch):
    """Ranges whose rows come in several batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = [f"variant{a}s variants{b}" for a in "abcdefgh" for b in "abcdefgh"]
        assert found(spelling.spelling_groups(documents(spark, texts))) == plain(enumerate(texts))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_long_words_and_awkward_rows(spark):
    x, texts = "xyz" * 500, []
    for a, b in ((x, x[:-1] + "q"), ("a" * 900, "a" * 901)):
        texts += [a, a, b, b]
    assert found(spelling.spelling_groups(documents(spark, texts))) == plain(enumerate(texts))
    longer = spelling.spelling_groups(documents(spark, [f"{y}{'xyz' * 40_000}" for y in "pqpqpq"])).collect()
    assert all(r.n_near == len(longer) - 1 for r in longer if len(r.word) == 120_001)
    table = awkward(spark)
    assert found(spelling.spelling_groups(table)) == plain([(r.doc_id, r.text) for r in table.collect()])
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ranges_of_equal_letters_meet_once():
    key, of, kind = spelling.ranges([b"aaaaaaaa", b"aaaaaaa", b"aaaabaaa"])
    order = key.argsort(kind="stable")
    i, j = spelling.meetings(key[order], kind[order])
    pairs = Counter(tuple(sorted((int(of[order][x]), int(of[order][y])))) for x, y in zip(i, j, strict=True))
    assert pairs == {(0, 1): 1, (0, 2): 1, (1, 2): 1}
