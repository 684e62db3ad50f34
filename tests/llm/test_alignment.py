"""Alignment of two tokenizers, against a plain version of every row."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tallyvine.llm import alignment
from tests.llm.test_operators import awkward, corpus, documents


def plain(texts):
    """The rows of texts, token by token with the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    v = alignment.Vocabulary.of(alignment.TOKENIZERS)
    first = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.A_FILE}")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.B_FILE}")
    links, groups, sizes = [], [], []
    for text in texts:
        a, b = first.encode(f" {text or ''}", add_special_tokens=False).ids, second.encode(text or "")
        whole = f" {text or ''}".encode()
        if not text or b"".join(v.a_bytes[i] for i in a) != whole or b"".join(v.b_bytes[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, table in ((a, v.a_bytes), (b, v.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at := at + len(table[i]), i))
            spans.append(out)
        links.append([(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(a) < 3000 else None)
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        said, i, j = [], 0, 0
        for cut in cuts:
            left, right = [], []
            while i < len(a) and spans[0][i][1] <= cut:
                left.append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= cut:
                right.append(str(b[j]))
                j += 1
            said.append(",".join(left) + "|" + ",".join(right))
        groups.append((len(cuts), hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""))
        sizes.append((len(a), len(b)))
    held = Counter(p for pairs in links for p in set(pairs))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [
        (*n, g, len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs), h)
        for n, pairs, (g, h) in zip(sizes, links, groups, strict=True)
    ]


ODD = ["", None, " ", "a  b\tc\nd ", "<|endoftext|> hi <s> </s>", "ß∂ünï 😀 　x", "one", "one", "x" * 400, "\n" * 1500, "ﬁ ½ é", "▁a ▁ b", "中文。测试"]


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_rows_against_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    monkeypatch.setattr(alignment, "PART_PAIRS", 100)
    monkeypatch.setattr(alignment, "SLICE_BITS", 6)
    monkeypatch.setattr(alignment, "FAN", 2)
    texts = ODD + corpus(n=20) + ["the quick brown fox jumps over internationalisation " * k for k in range(5)]
    rows = sorted(alignment.align(documents(spark, texts).repartition(5)).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[1:] for r in rows] == plain(texts)


def test_awkward(spark):
    rows = alignment.align(awkward(spark)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in awkward(spark).collect())
    assert len({(r.n_a, r.count_sum, r.groups_sha256) for r in rows if r.doc_id in (4, 5)}) == 1
    assert all(r.n_a == r.n_links == 0 and r.groups_sha256 == "" for r in rows if r.doc_id in (1, 2))
    assert alignment.align(documents(spark, [])).collect() == []
    assert [tuple(r)[1:] for r in alignment.align(documents(spark, ["", None])).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_both_encoders_of_the_first_tokenizer_agree():
    v = alignment.Vocabulary.of(alignment.TOKENIZERS)
    for text in [t or "" for t in ODD] + corpus(n=8):
        assert v._ranked.encode_ordinary(f" {text}") == v._plain.encode(f" {text}", add_special_tokens=False).ids
    assert len(v.encode_a(" " * 300_000)) > 0


def test_numbers_are_minimal_and_perfect():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64))
    parts = 7
    part = alignment._scaled(alignment._spread(keys, 0), parts)
    rows = []
    for p in range(parts):
        sizes, bits, order = alignment.placed(keys[part == p])
        rows.append((p, sizes, np.packbits(bits, bitorder="little").tobytes(), order.tobytes()))
    numbers = alignment.PairNumbers(parts, rows)
    assert sorted(numbers.of(keys).tolist()) == list(range(len(keys)))
    assert (numbers.keys[numbers.of(keys)] == keys).all()
    assert (numbers.of(np.setdiff1d(rng.integers(0, 1 << 48, 5_000, dtype=np.uint64), keys)) == -1).all()
    some = alignment.PairNumbers(parts, rows[:3])
    assert ((some.of(keys) >= 0) == (part < 3)).all()
