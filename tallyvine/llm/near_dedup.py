"""Near-duplicate classes by improved consistent weighted sampling (operator 6).

A text is the weighted set of its five-word shingles, each weighing its count times its inverse document
frequency. Frequencies cover all documents: packs of texts send fingerprints of their distinct shingles to the parts of
the range, where they are added up, and get the sums back. Fingerprints have so many bits, more for more text, that fewer than one
shingle in 10,000 shares its own with another one, at any size. Each text gets ROWS x BANDS consistent weighted samples (Ioffe's
construction) over the weights, and as many over the plain set (each distinct shingle weighing one); texts that agree in all rows of a band meet in a bucket.
The samples see a weight's logarithm in steps of 1/LEVELS, similarities are those of the weights themselves.

Within a bucket the most central member leads; every other member is verified against it by weighted Jaccard
similarity (a plain Jaccard similarity of the threshold also links, so that weights cannot part texts that differ in few, rare words).
One minus either similarity is a metric, so a member that is not similar to the leader can only
be similar to members at a comparable distance from it; and what of a text no other open text holds bounds its similarity to all of them.
Pairs that neither rules out and whose ends are in different components go into a second round. Hence every pair of a bucket that reaches the threshold is verified or has both ends in one component, without emitting
all pairs of similar groups. Links become classes by propagating the smallest label.

Texts stay in the packs, which are dealt out by pack once: frequencies, signatures and the texts to compare come to them or are read off them in place.

Defined results: a null text is the empty string; equal texts are always in one class; texts of one
to four words are one shingle; texts without words link only to equal ones; every row is a document of its own, also with
a null or repeated id; a class has the smallest id in it, null if it has none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, ROW_BITS, from_planes, packed_rows, partitions, read_table, to_planes, unpacked, written, written_in_buckets

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
#: Bytes of text in a pack, and in a bucket of packs; bytes of text whose fingerprints one task adds up.
PACK_BYTES, BUCKET_BYTES, PART_BYTES = 8_000_000, 8_000_000, 24_000_000
#: Entries of the table of random variates; a shingle and a sample choose one by hashing. Steps of the logarithm of a weight.
TABLE_BITS, LEVELS = 16, 16
SEED = 11
#: Matrix cells, and bytes of text, worked on at a time.
CELLS, PIECE = 1 << 16, 1 << 20
#: What is no word in lower-case texts besides ASCII.
OTHER = re.compile(r"[^\w\x00-\x7f]")
WORDLIKE = np.array([i >= 128 or chr(i).isalnum() or i == 95 for i in range(256)])
#: Rows of the small tables of the rounds that one task takes.
ROWS_A_TASK = 100_000
PAIRS = "leader long, member long, sim double, plain double"
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BASE = 0x5851F42D4C957F2D
SYMBOLS = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class Powers:
    """Powers of the base of word hashes, and of its inverse, as far as needed."""

    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return cls.up[:n], cls.down


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # whole words of about PIECE bytes
        stop = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, side="right")))
        low, high = int(starts[at]), int(stops[stop - 1])
        up, down = Powers.of(max(high - low, PIECE))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(SYMBOLS[data[low:high]] * up[: high - low], out=sums[1:])
        begin, end = starts[at:stop] - low, stops[at:stop] - low
        out[at:stop] = (sums[end] - sums[begin]) * down[begin]
        at = stop
    return _mixed(out)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after another and sorted within it; their counts; where each text's begin (and the end)."""
    return encoded_sets([(low if (low := t.lower()).isascii() else OTHER.sub(" ", low)).encode("utf-8", "surrogatepass") for t in texts], WORDLIKE)


def encoded_sets(encoded: list[bytes], wordlike: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets of encoded texts, whose words are runs of the bytes that wordlike marks (the line feed is none)."""
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
    flags = np.zeros(len(data) + 1, np.int8)
    flags[:-1] = wordlike[data]
    edges = np.flatnonzero(np.diff(flags, prepend=np.int8(0)))
    starts, stops = edges[0::2], edges[1::2]
    single = word_hashes(data, starts, stops)
    last = np.searchsorted(starts, ends)  # of each text, where its words end
    first = np.concatenate(([0], last[:-1])) if len(last) else last
    width = np.minimum(last - first, WORDS)
    number = np.where(width > 0, last - first - width + 1, 0)
    begin = np.concatenate(([0], np.cumsum(number)))
    every = np.zeros(max(0, len(single) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        every = _mixed(every + single[i : i + len(every)]) * ODD
    within = np.repeat(first - begin[:-1], number) + np.arange(begin[-1])
    found = every[np.minimum(within, len(every) - 1)] if len(every) else np.zeros(begin[-1], np.uint64)
    for k in np.flatnonzero((width > 0) & (width < WORDS)).tolist():  # a text of few words is one shingle
        x = np.zeros(1, np.uint64)
        for i in range(first[k], last[k]):
            x = _mixed(x + single[i]) * ODD
        found[begin[k]] = x[0]
    found = _mixed(found)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[begin[:-1][number > 0]] = True
    at = np.flatnonzero(new)
    return found[at], np.diff(at, append=len(found)), np.searchsorted(at, begin)


def fingerprint_bits(text_bytes: int) -> int:
    """Some 20,000 fingerprints for each shingle that so much text can hold."""
    return min(64, max(36, int(text_bytes).bit_length() + 12))


def fingerprints(shingles: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and the place in them of each shingle."""
    return np.unique(shingles >> np.uint64(64 - bits), return_inverse=True)


def part_of(prints: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Rises with the fingerprint."""
    return ((prints >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def exact_frequencies(packs: DataFrame, bits: int, parts: int, sets: Callable[[list[str]], tuple[np.ndarray, ...]] = shingle_sets) -> DataFrame:
    """batch, part, n, df: in how many documents each fingerprint of a pack occurs, in the order of the fingerprints (planes of bytes)."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for batch, blob in zip(rows.batch, rows.blob, strict=True):
                texts, _, copies = distinct_of(unpacked(blob).column("text").to_pylist())
                found, _, begin = sets(texts)
                prints, at = fingerprints(found, bits)
                held = np.bincount(at, np.repeat(copies, np.diff(begin)), len(prints))
                part, starts = np.unique(part_of(prints, bits, parts), return_index=True)
                out = []
                for p, a, b in zip(part.tolist(), starts.tolist(), [*starts[1:].tolist(), len(prints)][: len(part)], strict=True):
                    steps = np.diff(prints[a:b], prepend=np.uint64(0))
                    out.append((batch, p, b - a, int(prints[a]), to_planes(steps[1:]), to_planes(held[a:b])))
                if out:
                    yield pd.DataFrame(out, columns=["batch", "part", "n", "least", "steps", "held"])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows.n.tolist()
        prints = np.concatenate([np.cumsum(np.append(np.uint64(x), from_planes(s, n - 1)), dtype=np.uint64) for n, x, s in zip(sizes, rows.least, rows.steps, strict=True)])
        held = np.concatenate([from_planes(h, n) for n, h in zip(sizes, rows.held, strict=True)])
        found, at = np.unique(prints, return_inverse=True)
        df = np.bincount(at, held, len(found)).astype(np.uint64)[at]
        return pd.DataFrame({"batch": rows.batch, "part": rows.part, "n": rows.n, "df": [to_planes(x) for x in np.split(df, np.cumsum(sizes)[:-1])]})

    sent = packs.mapInPandas(asked, "batch long, part long, n long, least long, steps binary, held binary")
    return sent.groupBy("part").applyInPandas(summed, "batch long, part long, n long, df binary")


def distinct_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct texts (null is empty) in order of appearance; which of them each text is; copies of each."""
    number: dict[str, int] = {}
    of = np.fromiter((number.setdefault(t or "", len(number)) for t in texts), np.int64, len(texts))
    return list(number), of, np.bincount(of, minlength=len(number))


def answered(answers: pd.DataFrame) -> np.ndarray:
    """The frequencies of a pack's fingerprints."""
    answers = answers.sort_values("part")
    return np.concatenate([np.empty(0, np.uint64), *(from_planes(x, n) for x, n in zip(answers.df, answers.n, strict=True))])


def document_frequencies(docs: DataFrame) -> tuple[int, dict[int, int]]:
    """Number of documents and the document frequency of every shingle, for tables that fit in memory."""
    packs, n, bits, parts = text_packs(docs, ["doc_id", "text"])
    replies = dict(iter(exact_frequencies(packs, bits, parts).toPandas().groupby("batch")))
    sums: dict[int, int] = {}
    for r in packs.collect():
        found, _, _ = shingle_sets(distinct_of(unpacked(r.blob).column("text").to_pylist())[0])
        if len(found):
            sums |= dict(zip(found.tolist(), answered(replies[r.batch])[fingerprints(found, bits)[1]].tolist(), strict=True))
    return n, sums


def text_packs(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, int, int, int]:
    """The packs of all rows, number of rows, bits of a fingerprint and number of its parts."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    least = partitions(docs.sparkSession)
    packs = written_in_buckets(packed_rows(docs, columns, PACK_BYTES), "near-packs", "batch", max(least, -(-size // BUCKET_BYTES)))
    return packs, n, fingerprint_bits(size), max(least, -(-size // PART_BYTES))


class Sampler:
    """Consistent weighted samples of weighted sets; equal for equal input in any process."""

    def __init__(self, n_docs: int, frequencies: dict[int, int] | None = None):
        self.n_docs, self.frequencies = n_docs, frequencies or {}
        rng = np.random.default_rng(SEED)
        size = 1 << TABLE_BITS
        r, log_c, b = rng.gamma(2.0, 1.0, size), np.log(rng.gamma(2.0, 1.0, size)), rng.random(size)
        self.r, self.b = r.astype(np.float32), b.astype(np.float32)
        self.inverse, self.q = (1 / r).astype(np.float32), (log_c - r + r * b).astype(np.float32)
        self.odd = (rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.level_rows: dict[int, int] = {}
        self.table = np.empty((0, size), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"level_rows": {}, "table": self.table[:0]}

    def weights(self, counts: np.ndarray, df: np.ndarray) -> np.ndarray:
        return counts * np.log1p(self.n_docs / (1.0 + df))

    def sets(self, texts: list[str], df: list[bytes] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Shingles and weights of each text. df: frequencies of the shingles of each text, as planes; without it those the sampler was given."""
        found, counts, begin = shingle_sets(texts)
        sizes = np.diff(begin).tolist()
        if df is None:
            held = np.array([self.frequencies[x] for x in found.tolist()], np.int64)
        else:
            held = np.concatenate([np.empty(0, np.uint64), *(from_planes(x, n) for x, n in zip(df, sizes, strict=True))])
        w = self.weights(counts, held)
        return [(found[a:b], w[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]

    def _rows_of(self, levels: np.ndarray) -> np.ndarray:
        """Of each level its row in the table of sample values of the entries; rows are made when first needed."""
        low = min(0, int(levels.min(initial=0)))
        values = np.union1d(np.flatnonzero(np.bincount(levels - low)) + low, [0])
        new = [v for v in values.tolist() if v not in self.level_rows]
        if new:
            log_w = (np.array(new, np.float32) / LEVELS)[:, None]
            self.table = np.concatenate((self.table, self.q - self.r * np.floor(log_w * self.inverse + self.b)))
            self.level_rows |= {v: len(self.level_rows) + i for i, v in enumerate(new)}
        rows = np.zeros(int(values[-1]) - low + 1, np.int64)
        rows[values - low] = [self.level_rows[v] for v in values.tolist()]
        return rows[levels - low]

    def _winners(self, short: np.ndarray, base: np.ndarray, held: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some of the samples at a time: the entries and places of the least value over the weights, and places of that over the plain set."""
        flat, even = self.table.ravel(), self.table[self.level_rows[0]]
        step = max(1, len(held[0]) // len(short))
        for k in range(0, len(self.odd), step):
            odd = self.odd[k : k + step, None]
            product, at, value = (x[: odd.size * len(short)].reshape(odd.size, -1) for x in held)
            np.multiply(short, odd, out=product)
            np.right_shift(product, np.uint32(32 - TABLE_BITS), out=product)
            at[:] = product
            plain = even.take(at, out=value, mode="clip").argmin(axis=1)
            at += base
            best = flat.take(at, out=value, mode="clip").argmin(axis=1)
            yield product[np.arange(odd.size), best], best, plain

    def bands(self, found: np.ndarray, weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of each text (see shingle_sets) one key for each band over the weights, then over the plain set, a row each; zeros for empty sets."""
        levels = np.rint(np.log(weights) * LEVELS).astype(np.int64)
        base, short = self._rows_of(levels) << TABLE_BITS, (found >> np.uint64(32)).astype(np.uint32)
        sizes, n = np.diff(begin), len(self.odd)
        cells = max(CELLS, int(sizes.max(initial=0)))
        held = (np.empty(cells, np.uint32), np.empty(cells, np.int64), np.empty(cells, np.float32))
        entry, best, plain = (np.zeros((len(sizes), n), np.int64) for _ in range(3))
        for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            if a < b:
                e, w, p = zip(*self._winners(short[a:b], base[a:b], held), strict=True)
                entry[i], best[i], plain[i] = np.concatenate(e), np.concatenate(w) + a, np.concatenate(p) + a
        some = sizes > 0
        entry, best, plain = entry[some], best[some], plain[some]
        t = np.floor((levels[best] / LEVELS).astype(np.float32) * self.inverse[entry] + self.b[entry])
        rows = np.concatenate((_mixed(found[best] + t.astype(np.int64).astype(np.uint64) * ODD), _mixed(found[plain])), axis=1).reshape(-1, 2 * BANDS, ROWS)
        keys = np.repeat(np.arange(2 * BANDS, dtype=np.uint64)[None] * MIX, len(rows), axis=0)
        for i in range(ROWS):
            keys = _mixed(keys + rows[:, :, i]) * ODD
        out = np.zeros((len(sizes), 2 * BANDS), np.int64)
        out[some] = keys.view(np.int64)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity; 0 if either set is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    place = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    i = np.flatnonzero(b[0][place] == a[0])
    shared = float(np.minimum(a[1][i], b[1][place[i]]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared), len(i) / (len(a[0]) + len(b[0]) - len(i))


def signatures(packs: DataFrame, frequencies: DataFrame, sampler: Sampler, bits: int) -> DataFrame:
    """node (number of the row), doc_id, digest, bands (empty for texts without words) and df (of its shingles) of each row; of equal texts in a pack one has the last two."""
    shared = packs.sparkSession.sparkContext.broadcast(sampler)  # fixed size: tables of variates

    def signed(_key, pack: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out, df = [], answered(answers)
        for batch, blob in zip(pack.batch.tolist(), pack.blob, strict=True):
            rows = unpacked(blob)
            texts, of, _ = distinct_of(rows.column("text").to_pylist())
            found, counts, begin = shingle_sets(texts)
            held = df[fingerprints(found, bits)[1]]
            keys = shared.value.bands(found, shared.value.weights(counts, held), begin)
            digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            told = np.zeros(len(texts), bool)
            for row, (doc_id, k) in enumerate(zip(rows.column("doc_id").to_pylist(), of.tolist(), strict=True)):
                bands = planes = None
                if not told[k]:
                    a, b = begin[k : k + 2]
                    bands, planes, told[k] = keys[k] if a < b else keys[k, :0], to_planes(held[a:b]), True
                out.append((batch << ROW_BITS | row, doc_id, digests[k], bands, planes))
        out = pd.DataFrame(out, columns=["node", "doc_id", "digest", "bands", "df"])
        return out.astype({"doc_id": "Int64"})

    schema = "node long, doc_id long, digest binary, bands array<long>, df binary"
    return packs.groupBy("batch").cogroup(frequencies.groupBy("batch")).applyInPandas(signed, schema)


def texts_of(packs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id (the node), text, df of each of nodes (node, df), read off the packs."""

    def read(packs: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("node")
        rows = asked.column("node").to_numpy().astype(np.int64) & ((1 << ROW_BITS) - 1)
        text = pa.concat_tables(unpacked(blob.as_buffer()).select(["text"]).take(rows) for blob in packs.column("blob")).column("text")
        return pa.table({"doc_id": asked.column("node"), "text": pc.fill_null(text, ""), "df": asked.column("df")})

    of_pack = nodes.select(F.shiftright("node", ROW_BITS).alias("batch"), "node", "df").groupBy("batch")
    return packs.groupBy("batch").cogroup(of_pack).applyInArrow(read, "doc_id long, text string, df binary")


def verified_pairs(pairs: DataFrame, texts: DataFrame, sampler: Sampler) -> DataFrame:
    """leader, member, sim, plain for each pair. texts: doc_id, text, df. Every text of a pair travels once or twice."""
    shared = pairs.sparkSession.sparkContext.broadcast(sampler)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaders = batch.drop_duplicates("leader")
            members = batch.drop_duplicates("member")
            of_leader = dict(zip(leaders.leader, shared.value.sets(leaders.leader_text.tolist(), leaders.leader_df.tolist()), strict=True))
            of_member = dict(zip(members.member, shared.value.sets(members.member_text.tolist(), members.member_df.tolist()), strict=True))
            sims = [similarity(of_leader[a], of_member[b]) for a, b in zip(batch.leader, batch.member, strict=True)]
            yield pd.DataFrame({"leader": batch.leader, "member": batch.member, "sim": [s for s, _ in sims], "plain": [p for _, p in sims]})

    of = lambda who: texts.select(F.col("doc_id").alias(who), F.col("text").alias(f"{who}_text"), F.col("df").alias(f"{who}_df"))
    both = of("member").join(pairs, "member").join(of("leader"), "leader")
    return both.mapInPandas(compared, PAIRS)


def own_mass(ids: DataFrame, texts: DataFrame, sampler: Sampler) -> DataFrame:
    """doc_id, mass, n (of its shingles), own, own_n (of those that no other one of ids holds) for each of ids."""
    shared = ids.sparkSession.sparkContext.broadcast(sampler)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shared.value.sets(batch.text.tolist(), None if batch.df.isna().all() else batch.df.tolist())
            if sets:
                counts = [len(f) for f, _ in sets]
                found, mass = np.concatenate([f for f, _ in sets]).view(np.int64), np.concatenate([w for _, w in sets])
                yield pd.DataFrame({"doc_id": np.repeat(batch.doc_id.to_numpy(), counts), "shingle": found, "mass": mass})

    df = F.col("df") if "df" in texts.columns else F.lit(None).cast("binary").alias("df")
    rows = texts.join(ids, "doc_id").select("doc_id", "text", df).mapInPandas(weighed, "doc_id long, shingle long, mass double")
    rows = written(rows, "near-shingles")
    whole = rows.groupBy("doc_id").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n"))
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("doc_id").alias("doc_id"), F.min("mass").alias("mass"))
    own = held.where("holders = 1").groupBy("doc_id").agg(F.sum("mass").alias("own"), F.count(F.lit(1)).alias("own_n"))
    return whole.join(own, "doc_id", "left").fillna(0, ["own", "own_n"])


def bucket_links(
    buckets: DataFrame, verify: Callable[[DataFrame], DataFrame], bounds: Callable[[DataFrame], DataFrame] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """Links (leader, member) within buckets (key, doc_id).

    First every member against its bucket's leader, the most central one: its buckets hold the most rows, so a text with few changes
    leads its copies. Then each member that missed its leader against those of other components that neither a leader nor their
    bounds (doc_id, mass, n, own, own_n: what no other open text holds) rule out."""
    reach = 1 - threshold
    hit = (F.col("sim") >= threshold) | (F.col("plain") >= threshold)
    few = max(12, min(partitions(buckets.sparkSession), buckets.count() // ROWS_A_TASK))

    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df.coalesce(few), name)

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("leader"), F.greatest(x, y).alias("member")]

    # tables joined on a key that a third of all rows may hold are written first, so that a large key is split between tasks
    sizes = kept(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
    central = buckets.join(sizes, "key").groupBy("doc_id").agg(F.sum("n").alias("weight"))
    first = F.max(F.struct("weight", (-F.col("doc_id")).alias("o")))
    led = kept(buckets.join(central, "doc_id").groupBy("key").agg(first.alias("x")).select("key", (-F.col("x.o")).alias("lead")), "near-led")
    # from here on the members of all buckets of one leader stand together: more pairs, each of them once
    asked = kept(buckets.join(led, "key").where("doc_id <> lead").select("lead", F.col("doc_id").alias("other"), *pair("doc_id", "lead")).distinct(), "near-asked")
    known = written(verify(asked.select("leader", "member").distinct()), "near-sims")
    near = known.where(hit).select("leader", "member")
    missed = known.where(~hit)
    if not missed.take(1):
        return near
    # one that misses its leader stays open; one that hits it only as far out as a miss could be similar to it
    edge = kept(asked.join(missed, ["leader", "member"]).groupBy("lead").agg(F.max("sim").alias("sim_miss"), F.max("plain").alias("plain_miss")), "near-edge")
    stays = ~hit | (F.col("sim") <= F.col("sim_miss") + reach) | (F.col("plain") <= F.col("plain_miss") + reach)
    left = asked.join(edge, "lead").join(known, ["leader", "member"]).where(stays).select("lead", "other", (~hit).alias("miss"))
    parts = components(near, few).select(F.col("doc_id").alias("other"), F.col("class_id").alias("part"))
    rows = kept(left.join(parts, "other", "left").select("lead", "other", F.coalesce("part", "other").alias("part"), "miss"), "near-open")
    possible = F.lit(True)
    if bounds is not None:
        limits = kept(bounds(rows.select(F.col("other").alias("doc_id")).distinct()), "near-bounds")
        rows = kept(rows.join(limits.withColumnRenamed("doc_id", "other"), "other"), "near-open")
        least = lambda whole, own: F.least(F.col(whole) - F.col(own), F.col(f"c_{whole}") - F.col(f"c_{own}")) >= threshold / (1 + threshold) * (F.col(whole) + F.col(f"c_{whole}")) - 1e-6
        possible = least("mass", "own") | least("n", "own_n")
    misses = rows.where("miss")
    misses = misses.select(*[F.col(c).alias(f"c_{c}") for c in misses.columns])
    same = F.col("lead") == F.col("c_lead")
    once = ~F.col("miss") | (F.col("other") < F.col("c_other"))
    due = rows.join(misses, same & (F.col("part") != F.col("c_part")) & once & possible).select(*pair("other", "c_other")).distinct()
    due = kept(due.join(known.select("leader", "member"), ["leader", "member"], "left_anti"), "near-due")
    if not due.take(1):
        return near
    return near.unionByName(written(verify(due), "near-sims").where(hit).select("leader", "member"))


def components(links: DataFrame, few: int | None = None) -> DataFrame:
    """doc_id, class_id (smallest id of the component) of every linked document."""
    few = few or partitions(links.sparkSession)
    both = written(
        links.select(F.col("leader").alias("a"), F.col("member").alias("b"))
        .unionByName(links.select(F.col("member").alias("a"), F.col("leader").alias("b"))).distinct().coalesce(few),
        "near-links",
    )
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).coalesce(few), "near-labels")
    while True:
        around = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        stepped = labels.join(around, "a").select("a", F.least("label", "seen").alias("up"), F.col("label").alias("was"))
        above = labels.select(F.col("a").alias("up"), F.col("label").alias("top"))
        jumped = written(stepped.join(above, "up").select("a", F.least("up", "top").alias("label"), "was").coalesce(few), "near-labels")
        labels = jumped.select("a", "label")
        if not jumped.where("label < was").take(1):
            return labels.select(F.col("a").alias("doc_id"), F.col("label").alias("class_id"))


def _classes(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The packs with the given columns; node, doc_id, class_id, keeper (node of the row that stays for the class) of every row."""
    packs, n, bits, parts = text_packs(docs, columns)
    sampler = Sampler(n)
    signed = written(signatures(packs, written(exact_frequencies(packs, bits, parts), "near-frequencies"), sampler, bits), "near-signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))
    firsts = written(
        signed.groupBy("digest").agg(least.alias("x"), F.max("bands").alias("bands")).select("digest", "x.doc_id", "x.node", "bands"), "near-firsts"
    )  # fmt: skip  equal texts have equal bands
    buckets = firsts.select(F.explode("bands").alias("key"), F.col("node").alias("doc_id")).distinct()
    shared = written(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "near-keys")
    met = written(buckets.join(shared, "key"), "near-buckets")
    involved = firsts.select("digest", F.col("node").alias("first")).join(met.select(F.col("doc_id").alias("first")).distinct(), "first").select("digest")
    wanted = signed.where("df IS NOT NULL").join(involved, "digest").groupBy("digest").agg(F.min(F.struct("node", "df")).alias("x"))
    placed = written(texts_of(packs, wanted.select("x.node", "x.df")), "near-texts-read")
    named = wanted.select("digest", F.col("x.node").alias("doc_id")).join(firsts.select("digest", "node"), "digest")
    texts = written(placed.join(named, "doc_id").select(F.col("node").alias("doc_id"), "text", "df"), "near-texts")
    links = bucket_links(met, lambda pairs: verified_pairs(pairs, texts, sampler), lambda ids: own_mass(ids, texts, sampler))
    parts_of = components(links).withColumnRenamed("doc_id", "node")
    linked = firsts.select("digest", "doc_id", "node").join(parts_of, "node", "left").withColumn("part", F.coalesce("class_id", "node"))
    linked = written(linked.select("digest", "doc_id", "node", "part"), "near-linked")
    heads = linked.groupBy("part").agg(least.alias("x")).select("part", F.col("x.doc_id").alias("class_id"), F.col("x.node").alias("keeper"))
    heads = written(linked.select("digest", "part").join(heads, "part").select("digest", "class_id", "keeper"), "near-heads")
    return packs, signed.select("node", "doc_id", "digest").join(heads, "digest").select("node", "doc_id", "class_id", "keeper")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id for every row; equal class_id means the same class of near-duplicates."""
    return _classes(docs, ["doc_id", "text"])[1].select("doc_id", "class_id")


def keep_firsts(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest id (rows without an id last), with the columns of documents."""
    packs, classes = _classes(docs, DOCUMENT_COLUMNS)
    kept = classes.where("node = keeper").select(F.shiftright("node", ROW_BITS).alias("batch"), "node")

    def read(packs: pa.Table, asked: pa.Table) -> pa.Table:
        rows = np.sort(asked.column("node").to_numpy().astype(np.int64)) & ((1 << ROW_BITS) - 1)
        return pa.concat_tables(unpacked(blob.as_buffer()).take(rows) for blob in packs.column("blob"))

    schema = docs.select(*DOCUMENT_COLUMNS).schema
    return packs.groupBy("batch").cogroup(kept.groupBy("batch")).applyInArrow(read, schema)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))


#: The same rows by all pairs of texts that share a shingle, for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS node, count(*) AS copies FROM documents GROUP BY coalesce(text, '')),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
words AS (SELECT node, copies, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM texts),
grams AS (SELECT node, copies, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS gram FROM words WHERE len(ws) > 0),
counted AS (SELECT node, copies, gram, count(*) AS c FROM grams GROUP BY node, copies, gram),
frequencies AS (SELECT gram, sum(copies) AS df, count(*) AS holders FROM counted GROUP BY gram),
weighted AS (SELECT node, gram, c * ln(1 + n / (1 + df)) AS w, holders FROM counted JOIN frequencies USING (gram), total),
whole AS (SELECT node, sum(w) AS mass, count(*) AS size FROM weighted GROUP BY node),
shared AS (SELECT a.node AS a, b.node AS b, sum(least(a.w, b.w)) AS mass, count(*) AS size
  FROM weighted a JOIN weighted b ON a.gram = b.gram AND a.node < b.node AND a.holders > 1 GROUP BY a.node, b.node),
links AS (SELECT a, b FROM shared s JOIN whole x ON x.node = a JOIN whole y ON y.node = b
  WHERE s.mass >= 0.8 * (x.mass + y.mass - s.mass) OR s.size >= 0.8 * (x.size + y.size - s.size)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
classes AS (SELECT node, least(node, coalesce(min(b), node)) AS class_id FROM texts LEFT JOIN reached ON a = node GROUP BY node)
SELECT d.doc_id, c.class_id FROM documents d JOIN texts t ON t.text = coalesce(d.text, '') JOIN classes c ON c.node = t.node
"""
