"""Substring deduplication by merging shard Burrows-Wheeler transforms (operator 3).

A byte is removed if a WIDTH-byte string that covers it also starts in a document with a smaller id.

Strings of WIDTH bytes are dealt out by content: the smallest hash among the SEED-byte strings in one is its
minimizer, and a run of neighbouring strings with one minimizer travels as a single segment. In steps:

1. Documents are packed (PACK_BYTES of text), in a scratch table that is dealt out by pack once; a pack is worked on in parts of
   PART_BYTES, longer documents in overlapping pieces.
2. Each pack sends the minimizers it holds; the task that owns a minimizer answers which ones several documents hold, and which are
   crowded: held by too many distinct segments, as at the edges of a passage that very many documents share. The strings of a
   crowded minimizer travel one by one instead, each dealt by its whole content, which spreads them evenly. What way a string takes
   follows from the string and that answer alone, so equal strings always meet.
3. Each pack sends its distinct segments with shared minimizers. The owning task forms shards of them, one Burrows-Wheeler transform
   each, and merges the transforms by iterative interleave refinement (Holt and McMillan), STEP symbols a round: the
   interleave is only ever stably re-dealt by the symbols before each row, suffixes of different shards are never
   compared. (Segments that cannot share a string with another one, by the bytes beside their minimizer, are left out.) The round in which two neighbours part bounds their common prefix; rows that stay together for WIDTH
   symbols are a repeated interval, and its smallest document id goes back to the packs that lack it.
4. Each pack marks the covered bytes and reports on its documents.

Equal segments meet within a part, so groups of copies shrink before any shuffle. Strings count as equal if two 64-bit keys of
their bytes agree; otherwise the result is exact, whatever the packs, parts, shards, buckets and the bound for crowded minimizers.

Defined results: a null text is the empty string; a null id counts as larger than all others; rows that share an id do not
remove from one another; texts of fewer than WIDTH bytes keep all; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed_rows, partitions, read_table, unpacked, written, written_in_buckets

WIDTH, SEED = 50, 16
#: Bytes of text in a pack, in a bucket of packs, and worked on at a time.
PACK_BYTES, BUCKET_BYTES, PART_BYTES = 8_000_000, 8_000_000, 2_000_000
#: Bytes of text for each bucket of minimizers, and of segments.
MINIMIZER_BUCKET, SEGMENT_BUCKET = 16 << 20, 4 << 20
#: Distinct segments of one minimizer above which its strings travel one by one.
CROWDED = 50_000
SHARDS = 8
#: Symbols by which a round refines the interleave; WIDTH is a multiple.
STEP = 10
NO_ID = np.iinfo(np.int64).max
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
LOW = np.uint64((1 << 63) - 1)
END = 0xFF  # in no UTF-8 text


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes, int64 or uint64 and so on, with their types and sizes, compressed."""
    head = np.array([x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    return zstandard.compress(np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, np.dtype(chr(kind)), size, at))
        at += out[-1].nbytes
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED-byte string at each position."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    return _mixed(words[:-8] * ODD + words[8:] * MIX) & LOW


class Pack:
    """The documents of a pack: ids (null as NO_ID), bytes, and their order by id."""

    def __init__(self, blob: bytes):
        rows = unpacked(blob)
        self.doc_ids = rows.column("doc_id").to_pylist()
        self.ids = np.array([NO_ID if i is None else i for i in self.doc_ids], np.int64)
        text = pa.concat_arrays(pc.fill_null(rows.column("text"), "").cast(pa.large_binary()).chunks or [pa.array([], pa.large_binary())])
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        self.data = np.frombuffer(text.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
        self.begin, self.end = offsets[:-1], offsets[1:]
        self.order = np.argsort(self.ids, kind="stable")

    def parts(self, part_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Documents by id, a part at a time: row and first byte of each piece, and its length. Every string of WIDTH bytes starts in one piece."""
        held, size = [], 0
        for row in self.order.tolist():
            a, b = int(self.begin[row]), int(self.end[row])
            for start in range(a, max(a + 1, b - WIDTH + 1), part_bytes):
                length = min(b - start, part_bytes + WIDTH - 1)
                if held and size + length > part_bytes:
                    yield tuple(np.array(x, np.int64) for x in zip(*held, strict=True))
                    held, size = [], 0
                held.append((row, start, length))
                size += length
        if held:
            yield tuple(np.array(x, np.int64) for x in zip(*held, strict=True))


class Segments:
    """Runs of WIDTH-byte strings with one minimizer in the pieces of a part, in order of id.

    start, count (strings in the run), minimizer, row (of the document in its pack). With a table of the shared minimizers and which
    of them are crowded, only runs of these are held, those of a crowded one split into their strings, with the hash of the string in place of the
    minimizer; and each run's class of equal runs: of (class), first (of each class the first run, which has its smallest id).
    """

    def __init__(self, pack: Pack, part: tuple[np.ndarray, np.ndarray, np.ndarray], shared: np.ndarray | None = None, crowded: np.ndarray | None = None):
        rows, first_byte, lengths = part
        self.data = data = np.concatenate([pack.data[a : a + n] for a, n in zip(first_byte.tolist(), lengths.tolist(), strict=True)])
        self.ends = ends = np.cumsum(lengths)
        n = len(data) - WIDTH + 1
        self.start = self.count = self.row = self.of = self.first = np.empty(0, np.int64)
        self.minimizer = np.empty(0, np.uint64)
        if n <= 0:
            return
        least = seed_hashes(data)
        reach, need = 1, WIDTH - SEED + 1
        while reach < need:
            step = min(reach, need - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        fits = lengths >= WIDTH
        marks = np.zeros(n + 1, np.int8)
        np.add.at(marks, (ends - lengths)[fits], 1)
        np.add.at(marks, (ends - WIDTH + 1)[fits], -1)
        valid = np.cumsum(marks, dtype=np.int8).astype(bool)  # a string of one piece starts here
        if crowded is not None and len(crowded):
            alone = np.isin(least, crowded) & valid[:n]
            a, _ = content_keys(data, at := np.flatnonzero(alone), np.full(len(at), WIDTH))
            least[at] = a | ~LOW
        else:
            alone = np.zeros(n, bool)
        changed = np.ones(n, bool)
        changed[1:] = (least[1:] != least[:-1]) | ~valid[: n - 1] | alone[1:] | alone[:-1]
        # the first string of each piece begins a run, whatever stands before it
        piece = np.zeros(n, bool)
        piece[(ends - lengths)[fits]] = True
        begins = np.flatnonzero((changed | piece) & valid[:n])
        stops = np.flatnonzero((valid[:n] & ~valid[1:]) | np.append(changed[1:] | piece[1:], False) & valid[:n]) + 1
        minimizer = least[begins]
        if shared is not None:
            kept = np.isin(minimizer, shared) | (minimizer > LOW)
            begins, stops, minimizer = begins[kept], stops[kept], minimizer[kept]
        self.start, self.count, self.minimizer = begins, stops - begins, minimizer
        self.row = rows[np.searchsorted(ends, begins, side="right")]
        if shared is not None and len(begins):
            a, b = content_keys(data, self.start, self.count + WIDTH - 1)
            order = np.lexsort((b, a))
            new = np.ones(len(order), bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            # classes in the order of their first runs
            self.first = np.sort(order[new])
            by_run = np.empty(len(order), np.int64)
            by_run[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            self.of = np.searchsorted(self.first, order[by_run])


def content_keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each substring's bytes and length (differences of weighted prefix sums)."""
    keys = []
    for base, seed in ((0x5851F42D4C957F2D, 1), (0x2545F4914F6CDD1D, 2)):
        inverse = np.uint64(pow(base, -1, 1 << 64))
        symbols = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        powers = np.full(len(data), base, np.uint64)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(symbols[data] * powers, out=sums[1:])
        powers = np.full(len(data), inverse, np.uint64)
        powers[:1] = 1
        np.multiply.accumulate(powers, out=powers)
        keys.append(_mixed((sums[start + length] - sums[start]) * powers[start] + length.astype(np.uint64) * ODD))
    return keys[0], keys[1]


def bucket_of(minimizer: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(minimizer * ODD) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    edges = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(buckets[part[0]]), part


def send_minimizers(buckets: int, part_bytes: int):
    """Of each pack, its minimizers: whether several documents hold each, and about how many distinct segments."""

    def send(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in rows:
            for batch, blob in zip(table.batch, table.blob, strict=True):
                pack_, found = Pack(blob), []
                for part in pack_.parts(part_bytes):
                    s = Segments(pack_, part)
                    sketch = _mixed(s.minimizer + (s.data[s.start].astype(np.uint64) << np.uint64(8)) + s.data[s.start + s.count + WIDTH - 2] + (s.count.astype(np.uint64) << np.uint64(16)))
                    _, once = np.unique(sketch, return_index=True)
                    held, at = np.unique(s.minimizer, return_inverse=True)
                    low, high = np.full(len(held), NO_ID), np.full(len(held), -1)
                    np.minimum.at(low, at, s.row)
                    np.maximum.at(high, at, s.row)
                    found.append((held, low, high, np.bincount(at[once], minlength=len(held))))
                if not found:
                    continue
                every, low, high, distinct = (np.concatenate(x) for x in zip(*found, strict=True))
                held, at = np.unique(every, return_inverse=True)
                least, most = np.full(len(held), NO_ID), np.full(len(held), -1)
                np.minimum.at(least, at, low)
                np.maximum.at(most, at, high)
                several, distinct = least < most, np.minimum(np.bincount(at, distinct, len(held)), 65535).astype(np.uint16)
                out = [(b, batch, pack(held[i], several[i], distinct[i])) for b, i in _by_bucket(bucket_of(held, buckets))]
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "batch", "payload"])

    return send


def answer_minimizers(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """For each pack, of its minimizers in this bucket the shared ones, and whether each is crowded: has more than most segments."""
    parts = [unpack(p) for p in rows.payload]
    held = np.concatenate([p[0] for p in parts])
    values, index, holders = np.unique(held, return_inverse=True, return_counts=True)
    several = np.bincount(index, np.concatenate([p[1] for p in parts]), len(values)) > 0
    distinct = np.bincount(index, np.concatenate([p[2] for p in parts]), len(values))
    shared, crowded = ((holders > 1) | several)[index], (distinct > most)[index]
    ends = np.cumsum([len(p[0]) for p in parts])[:-1]
    out = [pack(h[s], c[s]) for h, s, c in zip(np.split(held, ends), np.split(shared, ends), np.split(crowded, ends), strict=True)]
    return pd.DataFrame({"batch": rows.batch, "bucket": rows.bucket, "payload": out})


def _shared(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shared minimizers of a pack and the crowded ones among them."""
    told = [unpack(p) for p in answers.payload]
    shared = np.concatenate([np.empty(0, np.uint64), *(t[0] for t in told)])
    crowded = np.concatenate([np.empty(0, bool), *(t[1] for t in told)])
    return shared[~crowded], shared[crowded]


def send_segments(buckets: int, part_bytes: int):
    def send(_key, batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        shared, crowded = _shared(answers)
        for number, blob in zip(batch.batch, batch.blob, strict=True):
            pack_, base, sent = Pack(blob), 0, []
            for part in pack_.parts(part_bytes):
                s = Segments(pack_, part, shared, crowded)
                r = s.first
                length = s.count[r] + WIDTH - 1
                sent.append((np.arange(base, base + len(r)), s.minimizer[r], pack_.ids[s.row[r]], length, s.data[ranges(s.start[r], length)]))
                base += len(r)
            if base:
                numbers, minimizer, ids, length, data = (np.concatenate(x) for x in zip(*sent, strict=True))
                start = np.cumsum(length) - length
                for b, i in _by_bucket(bucket_of(minimizer, buckets)):
                    out.append((b, number, pack(numbers[i], minimizer[i], ids[i], length[i], data[ranges(start[i], length[i])])))
        return pd.DataFrame(out, columns=["bucket", "batch", "payload"])

    return send


def transform(text: np.ndarray) -> np.ndarray:
    """Rotations of text in the order of their first WIDTH symbols (or more), by doubling."""
    n = len(text)
    wrapped = np.concatenate((text, np.resize(text, 8)))
    rank = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wrapped, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(rank, kind="stable")
    width = 8
    while True:
        sorted_ = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        if width >= WIDTH:
            return order
        rank = dense * n + np.roll(dense, -width)
        order = np.argsort(rank, kind="stable")
        width *= 2


def merge_transforms(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the concatenation of the shard texts in merged order, and the repeated interval of each row.

    Each shard's rows stay in their own order throughout; only the interleave, which shard comes next, is refined.
    """
    sizes = np.array([len(t) for t in texts])
    offsets = np.cumsum(sizes) - sizes
    orders = [transform(t) for t in texts]
    rows = np.concatenate([o + a for o, a in zip(orders, offsets, strict=True)])
    # the symbols before each row: STEP of them at a time, as dense codes over all shards
    words = np.concatenate([np.stack([np.roll(t, STEP - i)[o] for i in range(STEP)], axis=1) for t, o in zip(texts, orders, strict=True)])
    wide = np.zeros((len(rows), 16), np.uint8)
    wide[:, :STEP] = words
    halves = wide.view(">u8").astype(np.uint64)
    high = np.unique(halves[:, 0], return_inverse=True)[1]
    low = np.unique(halves[:, 1], return_inverse=True)[1]
    before = np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)[1].astype(np.int32)
    coarse, fine = (before >> 16).astype(np.uint16), (before & 0xFFFF).astype(np.uint16)
    shard = np.repeat(np.arange(len(texts), dtype=np.uint8), sizes)
    interval = np.zeros(len(rows), np.int32)
    at = np.arange(len(rows))  # which shard row stands at each place of the interleave
    for _ in range(WIDTH // STEP):
        dealt = np.argsort(fine[at], kind="stable")
        if coarse.any():
            dealt = dealt[np.argsort(coarse[at][dealt], kind="stable")]
        symbols, parts = before[at][dealt], interval[dealt]
        shard = shard[dealt]
        parted = np.zeros(len(rows), np.int32)
        parted[1:] = (symbols[1:] != symbols[:-1]) | (parts[1:] != parts[:-1])
        interval = np.cumsum(parted, dtype=np.int32)
        at = np.empty(len(rows), np.int64)
        at[np.argsort(shard, kind="stable")] = np.arange(len(rows))
    return rows[at], interval


def answer_segments(rows: pd.DataFrame) -> pd.DataFrame:
    """For each pack and class of segments: runs of strings of which a document with a smaller id than the class's holds a copy."""
    parts = [unpack(p) for p in rows.payload]
    batch = np.repeat(rows.batch.to_numpy(), [len(p[0]) for p in parts])
    number, minimizer, doc, length = (np.concatenate([p[i] for p in parts]) for i in range(4))
    data = np.concatenate([p[4] for p in parts])
    start = np.cumsum(length) - length
    a, b = content_keys(data, start, length)
    order = np.lexsort((doc, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    text_of = np.empty(len(order), np.int64)
    text_of[order] = np.cumsum(new) - 1
    first = order[new]  # of each distinct segment the copy with the smallest id
    least = doc[first]
    _, group, alone = np.unique(minimizer[first], return_inverse=True, return_counts=True)
    many = alone[group] > 1  # other segments with this minimizer exist, so parts of them may be equal
    several = np.flatnonzero(many)
    many[several] = _may_share(data, start[first[several]], length[first[several]], minimizer[first[several]])
    # (segment, from, to, smallest id) for each run of strings; a segment alone has one run
    strings = length[first] - WIDTH + 1
    runs = [np.stack([x[~many] for x in (np.arange(len(first)), np.zeros(len(first), np.int64), strings, least)])]
    if many.any():
        runs.append(_interval_runs(data, start[first[many]], length[first[many]], least[many], np.flatnonzero(many)))
    text, low, high, smallest = np.concatenate(runs, axis=1)
    by_text = np.argsort(text, kind="stable")
    text, low, high, smallest = text[by_text], low[by_text], high[by_text], smallest[by_text]
    begin, end = np.searchsorted(text, text_of, "left"), np.searchsorted(text, text_of, "right")
    which = ranges(begin, end - begin)
    holder = np.repeat(np.arange(len(doc)), end - begin)
    useful = smallest[which] < doc[holder]
    which, holder = which[useful], holder[useful]
    order = np.argsort(batch[holder], kind="stable")
    which, holder = which[order], holder[order]
    owners, cuts = np.unique(batch[holder], return_index=True)
    out = []
    for owner, w, h in zip(owners, np.split(which, cuts)[1:], np.split(holder, cuts)[1:], strict=True):
        out.append((int(owner), pack(number[h], low[w], high[w], smallest[w])))
    return pd.DataFrame(out, columns=["batch", "payload"])


def _may_share(data: np.ndarray, start: np.ndarray, length: np.ndarray, minimizer: np.ndarray) -> np.ndarray:
    """Whether a segment can share a string of WIDTH bytes with another one of its minimizer.

    Such a string reaches at least half of WIDTH - SEED bytes beyond the minimizer on one side, so another segment must agree
    with this one in those bytes, at some place where the minimizer stands."""
    out = np.zeros(len(start), bool)
    if not len(start):
        return out
    text = data[ranges(start, length)]
    end = np.cumsum(length)
    owner = np.repeat(np.arange(len(start)), length)[: len(text) - SEED + 1]
    at = np.flatnonzero(seed_hashes(text) == (minimizer & LOW)[owner])
    owner = owner[at]
    half = (WIDTH - SEED + 1) // 2
    for low, high in ((half, SEED), (0, SEED + half)):
        fits = (at - low >= (end - length)[owner]) & (at + high <= end[owner])
        key, _ = content_keys(text, at[fits] - low, np.full(int(fits.sum()), low + high))
        who = owner[fits]
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        same = np.flatnonzero((key[1:] == key[:-1]) & (who[1:] != who[:-1]))
        meets = np.zeros(len(key), bool)
        meets[same] = meets[same + 1] = True
        # all holders of a key that several segments hold
        groups = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) if len(key) else np.empty(0, int)
        out[who[np.isin(groups, np.unique(groups[meets]))]] = True
    return out


def _interval_runs(data: np.ndarray, start: np.ndarray, length: np.ndarray, least: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Merge the shards' transforms and read the smallest id of each repeated interval off the merged rows."""
    dealt = np.arange(len(start)) * SHARDS // max(len(start), 1)
    texts, owners, offsets = [], [], []
    for s in range(SHARDS):
        mine = np.flatnonzero(dealt == s)
        if len(mine):
            each = length[mine] + 1
            text = np.full(int(each.sum()), END, np.uint8)
            at = np.cumsum(each) - each
            text[ranges(at, length[mine])] = data[ranges(start[mine], length[mine])]
            texts.append(text)
            owners.append(np.repeat(mine, each))
            offsets.append(np.arange(len(text)) - np.repeat(at, each))
    owner, offset = np.concatenate(owners), np.concatenate(offsets)
    rows, interval = merge_transforms(texts)
    owner, offset = owner[rows], offset[rows]
    whole = offset <= length[owner] - WIDTH
    owner, offset, interval = owner[whole], offset[whole], interval[whole]
    edges = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1])))
    smallest = np.repeat(np.minimum.reduceat(least[owner], edges), np.diff(np.append(edges, len(owner))))
    order = np.lexsort((offset, owner))
    owner, offset, smallest = owner[order], offset[order], smallest[order]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (smallest[1:] != smallest[:-1])))
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], len(owner)) - 1
    return np.stack([names[owner[edges]], offset[edges], offset[ends] + 1, smallest[edges]])


def mark_repeats(part_bytes: int):
    """The report on a pack's documents. found: rows of answer_segments for it."""

    def mark(_key, batch: pd.DataFrame, answers: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        shared, crowded = _shared(answers)
        number, low, high, smallest = (np.concatenate(x) for x in zip(*[unpack(p) for p in found.payload], strict=True)) if len(found) else [np.empty(0, np.int64)] * 4
        by_number = np.argsort(number, kind="stable")
        number, low, high, smallest = number[by_number], low[by_number], high[by_number], smallest[by_number]
        for blob in batch.blob:
            pack_, base = Pack(blob), 0
            gone = np.zeros(len(pack_.data), bool)
            for part in pack_.parts(part_bytes):
                s = Segments(pack_, part, shared, crowded)
                marks = np.zeros(len(s.data) + 1, np.int64)
                doc = pack_.ids[s.row]
                local = doc > doc[s.first][s.of] if len(doc) else np.empty(0, bool)
                np.add.at(marks, s.start[local], 1)
                np.add.at(marks, (s.start + s.count + WIDTH - 1)[local], -1)
                told = slice(*np.searchsorted(number, [base, base + len(s.first)]))
                by_class = np.argsort(s.of, kind="stable")
                of = s.of[by_class]
                begin, end = np.searchsorted(of, number[told] - base, "left"), np.searchsorted(of, number[told] - base, "right")
                run, r = by_class[ranges(begin, end - begin)], np.repeat(np.arange(told.start, told.stop), end - begin)
                later = doc[run] > smallest[r]
                run, r = run[later], r[later]
                np.add.at(marks, s.start[run] + low[r], 1)
                np.add.at(marks, s.start[run] + high[r] + WIDTH - 1, -1)
                covered, at = np.cumsum(marks)[: len(s.data)] > 0, 0
                for start, length in zip(part[1].tolist(), part[2].tolist(), strict=True):  # pieces of a document overlap
                    gone[start : start + length] |= covered[at : at + length]
                    at += length
                base += len(s.first)
            for i, a, b in zip(pack_.doc_ids, pack_.begin.tolist(), pack_.end.tolist(), strict=True):
                mask, text = gone[a:b], pack_.data[a:b]
                removed = int(mask.sum())
                spans = int((mask[1:] & ~mask[:-1]).sum()) + bool(removed and mask[0])
                kept = text[~mask] if removed else text
                out.append((i, b - a, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return mark


def remove_repeats(docs: DataFrame, crowded: int = CROWDED, pack_bytes: int = PACK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packs = written_in_buckets(packed_rows(rows, ["doc_id", "text"], pack_bytes), "repeat-packs", "batch", max(partitions(docs.sparkSession), -(-total // BUCKET_BYTES)))
    few, many = max(1, -(-total // MINIMIZER_BUCKET)), max(1, -(-total // SEGMENT_BUCKET))
    payload = "bucket long, batch long, payload binary"
    sent = packs.mapInPandas(send_minimizers(few, part_bytes), payload)
    answer = lambda rows: answer_minimizers(rows, crowded)
    answers = written(sent.groupBy("bucket").applyInPandas(answer, "batch long, bucket long, payload binary"), "repeat-minimizers")
    segments = packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(send_segments(many, part_bytes), payload)
    found = written(segments.groupBy("bucket").applyInPandas(answer_segments, "batch long, payload binary"), "repeat-intervals")
    mark = mark_repeats(part_bytes)

    def joined(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return mark(key, left, right[right.bucket >= 0], right[right.bucket < 0])

    both = answers.unionByName(found.withColumn("bucket", F.lit(-1).cast("long")))
    report = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return packs.groupBy("batch").cogroup(both.groupBy("batch")).applyInPandas(joined, report)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


#: The same rows by every string's first document: spans are runs of repeated strings' starts at most WIDTH apart.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS data FROM documents),
s AS (SELECT doc_id, unnest(range(1, CAST(octet_length(data) - 48 AS BIGINT))) AS p, data FROM t WHERE octet_length(data) >= 50),
g AS (SELECT doc_id, p, md5_number(array_slice(data, p, p + 49)) AS h FROM s),
m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
d AS (SELECT g.doc_id, g.p FROM g JOIN m ON g.h = m.h WHERE g.doc_id > m.first),
e AS (SELECT *, CASE WHEN p > lag(p) OVER w + 50 OR lag(p) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS stops FROM runs GROUP BY doc_id),
x AS (SELECT t.doc_id, data, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, list_concat([1::BIGINT], coalesce(stops, [])) AS low,
  list_concat(coalesce(starts, []), [octet_length(data) + 1]) AS high FROM t LEFT JOIN k ON t.doc_id = k.doc_id)
SELECT doc_id, CAST(octet_length(data) AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(low) + 1), lambda i: hex(array_slice(data, low[i], high[i] - 1))), ''))) AS kept_sha256 FROM x
"""
