"""The n-gram join, against all pairs of documents."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from tallyvine.llm import ngram_join
from tests.llm.test_operators import SCHEMA, awkward, corpus, documents, words


def grams(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def plain(rows):
    sets = [grams(t) for _, t in rows]
    top = list(range(len(rows)))

    def head(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                top[head(i)] = head(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(head(i), []).append(d)
    least = lambda x: min((d for d in x if d is not None), default=None)
    return sorted(((d, len(sets[i]), least(ids[head(i)])) for i, (d, _) in enumerate(rows)), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def families(seed):
    """Texts that share paragraphs, edited copies at every distance, and few-word texts."""
    rng = random.Random(seed)
    paragraphs = [" ".join(words(rng.randint(12, 40), seed * 100 + i)) for i in range(8)]
    texts = []
    for i in range(70):
        parts = rng.sample(paragraphs, rng.randint(1, 4))
        ws = " ".join(parts).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
        texts.append(("  " if i % 9 == 0 else " ").join(ws).upper() if i % 5 == 0 else " ".join(ws))
    return texts + ["one two", "One  Two", "one two three four five six", "one two three four five seven", "", None, "a a a a a a a a a a", "a a a a a a a"]


@pytest.mark.parametrize("seed,members", [(1, 2048), (2, 4), (3, 2), (4, 7)])
def test_components_against_all_pairs(spark, monkeypatch, seed, members):
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "BANDS", 6 if seed != 3 else 1)
    texts = families(seed) + corpus(seed, 30)
    assert found(ngram_join.ngram_components(documents(spark, texts).repartition(3))) == plain(list(enumerate(texts)))


def test_awkward(spark):
    table = awkward(spark)
    assert found(ngram_join.ngram_components(table)) == plain([(r.doc_id, r.text) for r in table.collect()])
    assert ngram_join.ngram_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert found(ngram_join.ngram_components(documents(spark, ["", None, " \n"]))) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]


def some_sets(seed, n):
    """Sets around a few centres, with sizes and overlaps near the bound."""
    rng = np.random.default_rng(seed)
    centres = [rng.integers(0, 2**64, 120, dtype=np.uint64) for _ in range(3)]
    out = []
    for _ in range(n):
        c = centres[rng.integers(3)]
        own = rng.integers(0, 2**64, int(rng.integers(0, 30)), dtype=np.uint64)
        out.append(np.unique(np.concatenate((rng.choice(c, int(rng.integers(80, 121)), replace=False), own))))
    return out


@pytest.mark.parametrize("bits", [256, 4096])
def test_trees_lose_no_pair_and_prune_some(bits):
    sets = some_sets(bits, 150)
    size, part = np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = ngram_join.SignatureTree(sets, size, part, bits)
    i, j = ngram_join.traverse(tree)
    got = {tuple(sorted((int(tree.order[a]), int(tree.order[b])))) for a, b in zip(i, j, strict=True)}
    due = {(a, b) for b in range(len(sets)) for a in range(b) if ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    assert due and due <= got and len(got) == len(i) and len(got) < len(sets) * (len(sets) - 1) // 2
    left, right = (ngram_join.SignatureTree(sets[s], size[s], part[s], bits) for s in (slice(0, 40), slice(40, None)))
    i, j = ngram_join.traverse(left, right)
    got = {(int(left.order[a]), 40 + int(right.order[b])) for a, b in zip(i, j, strict=True)}
    assert {p for p in due if p[0] < 40 <= p[1]} <= got


def test_links_join_what_is_apart_once():
    sets = some_sets(9, 60)
    rows = pd.DataFrame({"team": 1, "side": 0, "node": range(60), "reach": [len(s) for s in sets], "part": range(60), "shingles": [s.tobytes() for s in sets]})
    links = ngram_join.tree_links(pd.concat([rows, rows.assign(team=2)]))
    top = list(range(60))
    for a, b in links.itertuples(index=False):
        assert ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])) and top[a] != top[b]
        top = [top[a] if x == top[b] else x for x in top]
    for a in range(60):
        for b in range(a):
            assert top[a] == top[b] or not ngram_join.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
