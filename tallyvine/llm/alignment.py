"""Which tokens of two tokenizers stand for the same bytes, and how often (operator 13).

First pass: every text is encoded by both tokenizers and the ids are kept; byte offsets at which both end a token cut the
text into groups, and each stretch between two neighbouring ends is one link of an A token and a B token. Each task adds up,
pair by pair, how many of its documents hold the pair linked. The distinct pairs get a minimal perfect hash: they are dealt
to parts by a hash, and each part is placed level by level, a pair taking the bit that no other one of its level wants, so
the rank of its bit is its number. Tasks turn their sums into dense vectors indexed by that number, which are added up in a
tree, slice by slice, FAN at a time. Second pass: the documents are aligned again from their ids and look up each link's count by
its number, where the pair that the number belongs to is compared first.

A number of at most BLOCK_PAIRS pairs is looked up at once, in some 100 MB of a task; more pairs are taken block by block, and the parts
of each document's sums are added. There can be no more pairs than the product of both vocabularies, and parts, vectors and slices grow with the pairs, not with the documents.

Defined results: texts that are null or empty, or whose joined tokens of A or B aren't the bytes of the text with a space before it, have no tokens: zeros
and an empty groups_sha256. Every row is a document of its own, also with a null or repeated id; no text is cut; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_planes, partitions, read_table, to_planes, whole_text, written

#: Where the vocabulary files are, on every machine, and their names.
TOKENIZERS, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how tokenizer A cuts a text into pieces before it merges bytes.
A_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of white space that the faster of two encoders of A has no stack for.
LONG_SPACE = re.compile(r"\s{1000}")
#: Bytes of text aligned at a time; sums that a task keeps apart before it adds them.
PIECE, KEPT = 1 << 20, 1 << 21
#: A pair is a << PAIR_BITS | b. Pairs of a part and of a block; numbers of a slice; vectors added at once.
PAIR_BITS, PART_PAIRS, BLOCK_PAIRS = 32, 1 << 16, 1 << 23
SLICE_BITS, FAN = 16, 16
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


class Vocabulary:
    """Both tokenizers, with the bytes of each token. Made in the tasks from files; the same ids as the tokenizers themselves."""

    _known: dict[str, Vocabulary] = {}

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = Path(folder) / A_FILE
        entries = json.loads(path.read_text())
        shown = [b for first, last in ("!~", "¡¬", "®ÿ") for b in range(ord(first), ord(last) + 1)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"] for t in entries["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in entries["model"]["vocab"].items() if t not in special}
        self._ranked = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._plain = Tokenizer.from_file(str(path))
        self._plain.encode_special_tokens = True
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / B_FILE))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        n = self._pieces.vocab_size()
        piece = lambda i: bytes([int(self._pieces.id_to_piece(i)[3:-1], 16)]) if self._pieces.is_byte(i) else self._pieces.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [b"" if self._pieces.is_control(i) or self._pieces.is_unknown(i) else piece(i) for i in range(n)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), n)
        self.shown = np.array([f"{i}{s}".encode() for s in ",|;" for i in range(most)], object)  # an id and what follows it
        self.most = most

    @classmethod
    def of(cls, folder: str) -> Vocabulary:
        if folder not in cls._known:
            cls._known[folder] = cls(folder)
        return cls._known[folder]

    def encode_a(self, text: str) -> list[int]:
        if LONG_SPACE.search(text):
            return self._plain.encode(text, add_special_tokens=False).ids
        return self._ranked.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of each text by A and B; none of either if their bytes aren't the text's."""
        out = []
        for text, b in zip(texts, self._pieces.encode(texts, num_threads=1), strict=True):
            a, whole = self.encode_a(f" {text}"), f" {text}".encode()
            same = text and b"".join(map(self.b_bytes.__getitem__, b)) == whole and b"".join(map(self.a_bytes.__getitem__, a)) == whole
            out.append((a, b) if same else ([], []))
        return out


class Aligned:
    """The links of some documents, whose ids stand one after another; na, nb: tokens of each document."""

    def __init__(self, vocabulary: Vocabulary, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
        self.vocabulary, self.a, self.b = vocabulary, a, b
        a_ends, b_ends = np.cumsum(vocabulary.a_sizes[a]), np.cumsum(vocabulary.b_sizes[b])
        flags = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, np.uint8)
        flags[a_ends] = 1
        flags[b_ends] |= 2
        ends = np.flatnonzero(flags)
        self.of_a, self.of_b, self.both = ((flags[ends] & m) == m for m in (1, 2, 3))
        self.a_at, self.b_at, self.group = (np.cumsum(x) - x for x in (self.of_a, self.of_b, self.both))
        self.keys = a[self.a_at].astype(np.uint64) << np.uint64(PAIR_BITS) | b[self.b_at].astype(np.uint64)
        last = np.concatenate((np.zeros(1, np.int64), np.cumsum(na)))
        self.begin = np.concatenate((np.zeros(1, np.int64), np.searchsorted(ends, a_ends[last[1:] - 1], side="right"))) if len(a) else np.zeros(len(na) + 1, np.int64)
        self.begin[1:] = np.maximum.accumulate(np.where(na > 0, self.begin[1:], 0))
        self.n_links = np.diff(self.begin)
        self.n_groups = np.where(na > 0, na + nb - self.n_links, 0)
        self.tokens = np.concatenate((np.zeros(1, np.int64), np.cumsum(na + nb)))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, each with the number of documents that hold it."""
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        order = np.lexsort((doc, self.keys))
        keys, doc = self.keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        found, at = np.unique(keys[new], return_index=True)
        return found, np.diff(at, append=int(new.sum())).astype(np.uint64)

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups, written out."""
        group_a, group_b = self.group[self.of_a], self.group[self.of_b]
        closes_a, closes_b = self.both[self.of_a], self.both[self.of_b]
        first_b = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(closes_b) + 1))  # of each group
        after_a = np.flatnonzero(closes_a) + 1
        shown = np.empty(len(self.a) + len(self.b), np.int64)
        shown[np.arange(len(self.a)) + first_b[group_a]] = self.a + self.vocabulary.most * closes_a
        shown[np.arange(len(self.b)) + after_a[group_b]] = self.b + 2 * self.vocabulary.most * closes_b
        said = self.vocabulary.shown[shown].tolist()
        spans = zip(self.tokens[:-1].tolist(), self.tokens[1:].tolist(), strict=True)
        return [hashlib.sha256(b"".join(said[x:y])[:-1]).hexdigest() if x < y else "" for x, y in spans]


def _pieces(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of about PIECE bytes."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        out.append((at, stop))
        at = stop
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.uint64)


def encoded(docs: DataFrame, folder: str) -> DataFrame:
    """row (unique), doc_id, a, b (n and m ids) of each document, and rows of keys, held: n pairs of a task's documents and in how many each is linked."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, row, sums = Vocabulary.of(folder), TaskContext.get().partitionId() << 40, []
        kinds = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("keys", pa.binary()), ("held", pa.binary()), ("n", pa.int64()), ("m", pa.int64())])

        def flush() -> pa.RecordBatch:
            keys, held = _added(sums)
            steps = np.diff(keys, prepend=np.uint64(0))
            sums.clear()
            return pa.RecordBatch.from_pylist([{"keys": to_planes(steps), "held": to_planes(held), "n": len(keys)}], kinds)

        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("text")), np.int64) + 1
            for x, y in _pieces(sizes):
                some = batch.slice(x, y - x)
                texts = some.column("text").to_pylist()
                number = {t: i for i, t in enumerate(dict.fromkeys(texts))}
                ids = [tuple(np.array(i, np.int64) for i in pair) for pair in vocabulary.encode(list(number))]
                found = [ids[number[t]] for t in texts]
                a, b = ([p[i] for p in found] for i in (0, 1))
                aligned = Aligned(vocabulary, np.concatenate(a), np.concatenate(b), np.array(list(map(len, a))), np.array(list(map(len, b))))
                if len(aligned.keys):
                    sums.append(aligned.distinct())
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": np.arange(row, row + len(a)), "doc_id": some.column("doc_id"), "a": [to_planes(i) for i in a], "b": [to_planes(i) for i in b],
                        "keys": [None] * len(a), "held": [None] * len(a), "n": list(map(len, a)), "m": list(map(len, b)),
                    }, kinds,
                )
                row += len(a)
                if sum(len(k) for k, _ in sums) > KEPT:
                    first = _added(sums)
                    sums[:] = [first]
                    if len(first[0]) > KEPT // 2:
                        yield flush()
        if sums:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(encode, "row long, doc_id long, a binary, b binary, keys binary, held binary, n long, m long")


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    """32 bits of each pair, other ones at each level."""
    x = (keys ^ (keys >> np.uint64(29)) ^ np.uint64(level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * MIX[0]
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    return x >> np.uint64(32)


def _scaled(spread: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    return (spread * np.asarray(sizes).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def placed(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after another, and the pairs in the order of their numbers: every distinct pair has one bit of its own."""
    sizes, bits, order, level = [], [], [], 1
    while len(keys):
        size = 2 * len(keys) + 8
        at = _scaled(_spread(keys, level), size)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        order.append(keys[mine][np.argsort(at[mine])])
        sizes.append(size)
        bits.append(alone)
        keys, level = keys[~mine], level + 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(order) if order else keys


class PairNumbers:
    """A minimal perfect hash of the pairs of some parts, with the pairs by their numbers."""

    def __init__(self, parts: int, rows: list[tuple[int, list[int], bytes, bytes]]):
        """rows: part, sizes of its levels, bits, pairs by number."""
        self.parts, levels = parts, max([len(s) for _, s, _, _ in rows], default=0)
        self.size, self.base = np.zeros((parts, levels), np.int64), np.zeros((parts, levels), np.int64)
        at, bits, keys = 0, [], []
        for part, sizes, packed, pairs in rows:
            self.size[part, : len(sizes)] = sizes
            self.base[part, : len(sizes)] = at + np.cumsum([0, *sizes[:-1]])
            bits.append(np.frombuffer(packed, np.uint8))
            at += 8 * len(packed)
            keys.append(np.frombuffer(pairs, np.uint64))
        self.bits = np.concatenate([np.empty(0, np.uint8), *bits])
        self.rank = (np.cumsum(np.bitwise_count(self.bits), dtype=np.int64) - np.bitwise_count(self.bits)).astype(np.uint32)  # ones before each byte
        self.keys = np.concatenate([np.empty(0, np.uint64), *keys])

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 for pairs of other parts or none."""
        out = np.full(len(keys), -1, np.int64)
        left, part = np.arange(len(keys)), _scaled(_spread(keys, 0), self.parts)
        for level in range(self.size.shape[1]):
            size = self.size[part, level]
            left, part = left[size > 0], part[size > 0]
            at = self.base[part, level] + _scaled(_spread(keys[left], level + 1), size[size > 0])
            byte, bit = self.bits[at >> 3], (at & 7).astype(np.uint8)
            hit = (byte >> bit & 1) == 1
            out[left[hit]] = self.rank[at[hit] >> 3] + np.bitwise_count(byte[hit] & ((np.uint8(1) << bit[hit]) - np.uint8(1)))
            left, part = left[~hit], part[~hit]
        held = out >= 0
        held[held] = self.keys[out[held]] == keys[held]  # verified
        return np.where(held, out, -1)


def pair_parts(messages: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """part, sizes, bits, pairs: the placed distinct pairs of every part; and the number of parts."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for planes, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"key": np.cumsum(from_planes(planes, n), dtype=np.uint64).astype(np.int64)})

    distinct = written(messages.select("keys", "n").mapInArrow(told, "key long").distinct(), "align-pairs")
    parts = max(1, -(-distinct.count() // PART_PAIRS))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch.key.to_numpy()
            yield pd.DataFrame({"key": keys, "part": _scaled(_spread(keys.astype(np.uint64), 0), parts)})

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, order = placed(np.sort(rows.key.to_numpy().astype(np.uint64)))
        return pd.DataFrame({"part": rows.part[:1], "sizes": [sizes], "bits": [np.packbits(bits, bitorder="little").tobytes()], "pairs": [order.tobytes()]})

    rows = distinct.mapInPandas(numbered, "key long, part int").repartition(max(1, min(parts, tasks)), "part")
    return written(rows.groupBy("part").applyInPandas(built, "part int, sizes array<long>, bits binary, pairs binary"), "align-parts"), parts


def pair_counts(messages: DataFrame, numbers: PairNumbers) -> np.ndarray:
    """In how many documents each pair of numbers is linked: dense vectors of the tasks, added up in a tree."""
    shared, n = messages.sparkSession.sparkContext.broadcast(numbers), len(numbers.keys)
    width = 1 << SLICE_BITS

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense, node = np.zeros(n, np.uint64), TaskContext.get().partitionId()
        for batch in batches:
            for keys, held, k in zip(batch["keys"], batch.held, batch.n, strict=True):
                at = shared.value.of(np.cumsum(from_planes(keys, k), dtype=np.uint64))
                dense[at[at >= 0]] += from_planes(held, k)[at >= 0]
        if dense.any():
            yield pd.DataFrame([(node, i, to_planes(dense[i << SLICE_BITS :][:width])) for i in range(-(-n // width))], columns=["node", "slice", "sums"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows.slice.iloc[0])
        total = sum(from_planes(x, min(width, n - (i << SLICE_BITS))) for x in rows.sums)
        return pd.DataFrame({"node": [int(rows.node.iloc[0]) // FAN], "slice": [i], "sums": [to_planes(total)]})

    schema = "node long, slice long, sums binary"
    sums = messages.select("keys", "held", "n")
    level, most = sums.mapInPandas(vectors, schema), sums.rdd.getNumPartitions()
    while most > 1:
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("up"), "slice").applyInPandas(summed, schema)
        most = -(-most // FAN)
    out = np.zeros(n, np.uint64)
    for row in level.toLocalIterator():  # one vector is left
        out[row.slice << SLICE_BITS :][:width] += from_planes(row.sums, min(width, n - (row.slice << SLICE_BITS)))
    return out


def align(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    tokens = written(encoded(docs, folder), "align-tokens")
    messages, texts = tokens.where("row IS NULL"), tokens.where("row IS NOT NULL").select("row", "doc_id", "a", "b", "n", "m")
    table, parts = pair_parts(messages, partitions(spark))
    sizes = sorted((r.part, r.n) for r in table.select("part", (F.octet_length("pairs") / 8).cast("long").alias("n")).collect())  # one number for 65,536 pairs
    blocks, full = [[]], 0
    for part, n in sizes:
        if blocks[-1] and full + n > BLOCK_PAIRS:
            blocks.append([])
            full = 0
        blocks[-1].append(part)
        full += n

    counted, best = [], np.zeros(1 << 16, np.uint64)
    for i, block in enumerate(blocks):  # one, unless there are more than BLOCK_PAIRS pairs
        rows = [] if not block else table.where(F.col("part").between(block[0], block[-1])).orderBy("part").collect()  # at most BLOCK_PAIRS pairs
        numbers = PairNumbers(parts, [(r.part, r.sizes, r.bits, r.pairs) for r in rows])
        counts = pair_counts(messages, numbers)
        first = (numbers.keys >> np.uint64(PAIR_BITS)).astype(np.int64)
        if len(first) and first.max() >= len(best):
            best = np.concatenate((best, np.zeros(int(first.max()) + 1 - len(best), np.uint64)))
        np.maximum.at(best, first, counts)
        counted.append((spark.sparkContext.broadcast(numbers), spark.sparkContext.broadcast(counts), i))
    top = spark.sparkContext.broadcast(best)  # one number for an id of A
    found = None
    for numbers, counts, i in counted:
        some = texts.mapInPandas(_looker(numbers, counts, top, folder, i == 0), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
        found = some if found is None else found.unionByName(some)
    if len(counted) > 1:
        sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    return found.drop("row")


def _looker(numbers, counts, top, folder: str, told: bool):
    """Aligns documents again and looks up the counts of their links; told: with what doesn't depend on the block of pairs."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary.of(folder)
        for batch in batches:
            a_sizes, b_sizes = batch.n.to_numpy(np.int64), batch.m.to_numpy(np.int64)
            for x, y in _pieces(4 * a_sizes + 1):
                some = batch.iloc[x:y]
                a = [from_planes(p, n).astype(np.int64) for p, n in zip(some.a, a_sizes[x:y].tolist(), strict=True)]
                b = [from_planes(p, n).astype(np.int64) for p, n in zip(some.b, b_sizes[x:y].tolist(), strict=True)]
                na, nb = a_sizes[x:y], b_sizes[x:y]
                aligned = Aligned(vocabulary, np.concatenate(a), np.concatenate(b), na, nb)
                at = numbers.value.of(aligned.keys)
                count = np.where(at >= 0, counts.value[at] if len(counts.value) else 0, 0).astype(np.uint64)
                is_best = (at >= 0) & (count == top.value[(aligned.keys >> np.uint64(PAIR_BITS)).astype(np.int64)])
                total = lambda v: np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(v.astype(np.int64))))[aligned.begin])
                zero = np.zeros(y - x, np.int64)
                yield pd.DataFrame(
                    {
                        "row": some.row.to_numpy(), "doc_id": some.doc_id.astype("Int64").to_numpy(), "n_a": na if told else zero, "n_b": nb if told else zero,
                        "n_groups": aligned.n_groups if told else zero, "n_links": aligned.n_links if told else zero, "n_best": total(is_best), "count_sum": total(count),
                        "groups_sha256": aligned.digests() if told else "",
                    }
                )

    return look


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"))
