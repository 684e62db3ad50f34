"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification (operator 1).

Texts are compared in lower case with runs of blanks as one space. An item of n characters occurs in a
document if a passage is within EDITS x n edits of it. Windows of an item's size begin at every word start and, as passages may
stand within unspaced text, wherever the q-grams that begin a run of the item's q-grams say that the item would begin. They are
first thinned by the q-gram lemma, which loses none within that distance. The others, and
the items, go through WALKS random-walk embeddings (Chakraborty, Goldenberg and Koucky), under which a small edit distance
becomes a small Hamming distance; hash tables that each sample a few places of a walk propose pairs. The number of tables follows
from the target recall: the mean miss over many copies of the items with the largest allowed number of seeded edits, by all walks
together. Where MOST_TABLES of them don't reach it (short items with many edits), every item that shares enough q-grams with a window is
proposed instead, which is exact. Proposed pairs are verified by the exact edit distance (bit-parallel, free ends in the document).

An item longer than MAX_WINDOW is cut in equal parts of at most that size: one of them has at most its share of the edits, so each part is searched, and the whole item verified.
The items are taken in blocks of about BLOCK_ITEMS items and BLOCK_CHARS characters, so what is broadcast has a bound; each block is searched in one
pass over the documents, and with several blocks its broadcast is released before the next one's.

Defined results: null and empty texts match nothing, null and empty items neither; items of fewer than Q characters match verbatim, as whole words; equal items are each reported;
repeated rows are each reported; rows with a null id are reported with a null id; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, read_table, whole_text, written

#: Edits per character of an item.
EDITS = 0.08
Q = 8
RECALL = 0.985
#: Embeddings; places that a table may sample; most tables of a walk; seeded copies that size them.
WALKS, SAMPLES, MOST_TABLES, COPIES = 4, (4, 3), 40, 48
#: Lengths of items that share windows differ by this factor at most.
CLASS_RATIO = 1.11
BLOCK_ITEMS, BLOCK_CHARS, MAX_WINDOW = 20_000, 16_000_000, 4_000
SEED = 5
#: Characters and windows worked on at a time.
CHUNK_CHARS, CHUNK_WINDOWS = 1 << 22, 2048
GRAM_BITS = 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each character (others than ASCII share bytes), and whether it is part of a word."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 127)
    return ((points * 31) ^ (points >> 8)).astype(np.uint8), WORDLIKE[low] | (points > 127)


WORDLIKE = np.array([chr(i).isalnum() for i in range(128)])


def gram_slots(code: np.ndarray) -> np.ndarray:
    """Slot of the q-gram at each position."""
    if len(code) < Q:
        return np.empty(0, np.int64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(code, Q)).view(np.uint64).ravel()
    return ((grams * ODD) >> np.uint64(64 - GRAM_BITS)).astype(np.int32)


def allowed(n: int) -> int:
    return int(EDITS * n)


def needed(n: int, edits: int) -> int:
    """q-grams that a passage within so many edits shares with an item of n characters."""
    return max(1, n - Q + 1 - edits * Q)


def edit_distance(item: str, passage: str) -> tuple[int, int]:
    """Least edits of item against any part of passage, and where such a part ends (Myers, as integers of item's length)."""
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    up, down, score, best, end = full, 0, len(item), len(item), 0
    for at, c in enumerate(passage, 1):
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        above, below = down | (~(x | up) & full), up & x
        score += bool(above & top) - bool(below & top)
        above, below = (above << 1) & full, (below << 1) & full
        y = eq | down
        up, down = below | (~(y | above) & full), above & y
        if score < best:
            best, end = score, at
    return best, end


def matches(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in x and place in sorted_ of each pair of equal values."""
    low = np.searchsorted(sorted_, x, "left")
    some = np.flatnonzero(sorted_[np.minimum(low, len(sorted_) - 1)] == x)
    low = low[some]
    number = np.searchsorted(sorted_, x[some], "right") - low
    ends = np.cumsum(number)
    return np.repeat(some, number), np.repeat(low - ends + number, number) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class LengthClass:
    """Items, or parts of long ones, of similar length; all windows have the length of the shortest."""

    n: int
    edits: int  # that the longest may have
    items: list[int]
    offsets: list[int]  # where the part begins in its item
    slots: np.ndarray = None  # q-grams of the parts, sorted, with the part and the place in it
    owner: np.ndarray = None
    place: np.ndarray = None
    sampled: list[np.ndarray] = None  # by walk: places of each table; none: the class is searched by q-grams alone
    tables: list[tuple[np.ndarray, np.ndarray]] = None  # keys of the parts, sorted, and the parts

    @property
    def needed(self) -> int:
        return needed(self.n, self.edits)

    @property
    def span(self) -> int:
        """q-grams of a passage within the edits, at most."""
        return max(1, self.n - Q + 1 + self.edits)

    def postings(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in slots, and in the q-grams of the parts, of each pair of equal ones."""
        return matches(self.slots, slots)


class ItemIndex:
    """Search structure over a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        usable = [(i, t) for i, t in ((i, normalised(t)) for i, t in items) if t]
        self.items = [(i, t) for i, t in usable if len(t) >= Q]
        self.short: dict[str, list[int]] = defaultdict(list)
        for i, t in usable:
            if len(t) < Q:
                self.short[t].append(i)
        parts = []
        for k, (_, t) in enumerate(self.items):
            m = -(-len(t) // MAX_WINDOW)
            cuts = [len(t) * j // m for j in range(m + 1)]
            parts += [(b - a, k, a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.classes: list[LengthClass] = []
        for n, k, offset in sorted(parts):
            if not self.classes or n > self.classes[-1].n * CLASS_RATIO:  # at most 62 classes
                self.classes.append(LengthClass(n, 0, [], []))
            c = self.classes[-1]
            c.items.append(k)
            c.offsets.append(offset)
            c.edits = max(c.edits, allowed(n))
        self.codes = [codes(t)[0] for _, t in self.items]
        self.item_grams = [np.unique(gram_slots(c)) for c in self.codes]
        self.grams = np.zeros(1 << GRAM_BITS, np.uint64)  # a bit for each class
        rng = np.random.default_rng(SEED)
        self.bits = rng.integers(0, 2, (2 * max((c.n for c in self.classes), default=1), WALKS * 256), dtype=np.uint8)  # by step; walk and character
        for number, c in enumerate(self.classes):
            heads = [self.codes[k][o : o + c.n] for k, o in zip(c.items, c.offsets, strict=True)]
            grams = [gram_slots(h) for h in heads]
            slots, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(slots, kind="stable")
            c.slots, c.owner, c.place = slots[order], owner[order], place[order]
            self.grams[c.slots] |= np.uint64(1 << number)
            samples, tables = self._tables_for(c, heads, rng)
            if tables:
                c.sampled = [np.sort(rng.integers(0, 2 * c.n, (tables, samples)), axis=1) for _ in range(WALKS)]
                c.tables = [(np.sort(keys), np.argsort(keys, kind="stable")) for keys in self._keys(c, np.stack(heads))]
        self.known = self.grams != 0

    def _tables_for(self, c: LengthClass, heads: list[np.ndarray], rng: np.random.Generator) -> tuple[int, int]:
        """Places of a table and tables of a walk by which copies with the largest allowed number of edits are missed as rarely as RECALL
        asks; no tables if MOST_TABLES of them don't do."""
        copies = np.zeros((2 * COPIES, c.n), np.uint8)
        for i in range(COPIES):
            head = heads[int(rng.integers(0, len(heads)))]
            other = bytearray(head.tobytes())
            for _ in range(c.edits):
                at, kind = int(rng.integers(0, max(1, len(other)))), int(rng.integers(0, 3))
                if kind == 0 and other:
                    other[at] = (other[at] + int(rng.integers(1, 256))) % 256
                elif kind == 1 and other:
                    del other[at]
                else:
                    other.insert(at, int(rng.integers(97, 123)))
            after = heads[int(rng.integers(0, len(heads)))].tobytes()  # what follows a passage that lost characters
            copies[2 * i], copies[2 * i + 1] = head, np.frombuffer((bytes(other) + after)[: c.n], np.uint8)
        walks = self._walks(copies, c.n)
        agree = (walks[:, :, 0::2] == walks[:, :, 1::2]).mean(axis=1)
        for samples in SAMPLES:
            miss = np.clip(1 - agree**samples, 0, 1)
            for tables in range(1, MOST_TABLES + 1):
                if float((miss**tables).prod(axis=0).mean()) <= 1 - RECALL:
                    return samples, tables
        return 0, 0

    def _walks(self, windows: np.ndarray, n: int) -> np.ndarray:
        """The embeddings: 2n characters for each window (walk by step by window)."""
        m = len(windows)
        flat = np.zeros((m, n + 1), np.uint8)
        flat[:, :n] = windows
        flat = flat.ravel()
        at = np.tile(np.arange(m) * (n + 1), WALKS)
        last, of_walk = at + n, np.repeat(np.arange(WALKS) * 256, m)
        out = np.empty((2 * n, WALKS * m), np.uint8)
        for j in range(2 * n):
            c = flat.take(at)
            out[j] = c
            at += self.bits[j].take(of_walk + c)
            np.minimum(at, last, out=at)
        return out.reshape(2 * n, WALKS, m).swapaxes(0, 1)

    def _keys(self, c: LengthClass, windows: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of the windows in each table of a class."""
        for walk, tables in zip(self._walks(windows, c.n), c.sampled, strict=True):
            for sampled in tables:
                key = np.zeros(len(windows), np.int64)
                for j in sampled:
                    key = (key << 8) | walk[j]
                yield key

    def candidates(self, c: LengthClass, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and parts that the tables propose to compare."""
        pairs = [np.empty(0, np.int64)]
        for (known, parts), keys in zip(c.tables, self._keys(c, windows), strict=True):
            window, place = matches(known, keys)
            pairs.append(window * len(c.items) + parts[place])
        return np.divmod(np.unique(np.concatenate(pairs)), len(c.items))

    def by_grams(self, c: LengthClass, starts: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and parts that share enough q-grams."""
        window, part = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, at in enumerate(starts.tolist()):
            which, pair = c.postings(slots[at : at + c.span])
            once = np.unique(which * len(c.items) + c.owner[pair])
            found = np.flatnonzero(np.bincount(once % len(c.items), minlength=len(c.items)) >= c.needed)
            window.append(np.full(len(found), i))
            part.append(found)
        return np.concatenate(window), np.concatenate(part)

    def shares_grams(self, k: int, slots: np.ndarray) -> bool:
        """Whether a passage with these q-grams can be within the allowed edits of item k (repeats count as often as they occur)."""
        grams, n = self.item_grams[k], len(self.items[k][1])
        place = np.minimum(np.searchsorted(grams, slots), len(grams) - 1)
        return int((grams[place] == slots).sum()) >= needed(n, allowed(n))

    def windows(self, wordlike: np.ndarray, slots: np.ndarray) -> Iterator[tuple[LengthClass, np.ndarray]]:
        """(class, starts) of the windows that the q-gram lemma leaves in a text."""
        word = wordlike.copy()
        word[1:] &= ~wordlike[:-1]
        word = np.flatnonzero(word)
        held = np.flatnonzero(self.known[slots])
        of_class = self.grams[slots[held]]
        for bit, c in enumerate(self.classes):
            at, m = held[(of_class >> np.uint64(bit)) & np.uint64(1) > 0], c.needed
            close = np.flatnonzero(at[m - 1 :] - at[: max(0, len(at) - m + 1)] < c.span)  # enough q-grams within the span of a passage
            if not len(close):
                continue
            low, high = np.maximum(at[close + m - 1] - c.span + 1, 0), at[close]  # both rise
            new = np.concatenate(([True], low[1:] > high[:-1] + 1))
            low, high = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]

            def inside(x: np.ndarray, more: int = 0, low=low, high=high) -> np.ndarray:
                i = np.searchsorted(low, x, "right") - 1
                return x[(i >= 0) & (x <= high[i] + more)]

            # a run of the class's q-grams begins here: where would the item begin?
            first = inside(at[np.diff(at, prepend=-2) != 1], c.span)
            which, pair = c.postings(slots[first])
            begin, end = np.searchsorted(word, low, "left"), np.searchsorted(word, high, "right")
            words = word[np.repeat(begin - np.cumsum(end - begin) + end - begin, end - begin) + np.arange(int((end - begin).sum()))]
            yield c, np.union1d(words, inside(first[which] - c.place[pair]))

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of a best passage of every item that occurs in each of the normalised texts."""
        found = self._short_items(texts) if self.short else []
        if not self.classes:
            return found
        code, wordlike = codes("\n".join(texts))
        slots = gram_slots(code)
        ends = np.cumsum([len(t) + 1 for t in texts])
        padded = np.concatenate((code, np.zeros(self.classes[-1].n, np.uint8)))
        waiting: dict[int, tuple[LengthClass, list[np.ndarray]]] = {}
        for c, good in self.windows(wordlike, slots):
            waiting.setdefault(c.n, (c, []))[1].append(good)
        proposed = [np.empty((3, 0), np.int64)]  # text, item, and where it would begin in the joined texts
        items_of = {c.n: (np.array(c.items), np.array(c.offsets)) for c, _ in waiting.values()}
        for c, parts in waiting.values():
            where, (items, offsets) = np.concatenate(parts), items_of[c.n]
            for j in range(0, len(where), CHUNK_WINDOWS):
                at = where[j : j + CHUNK_WINDOWS]
                window, part = self.by_grams(c, at, slots) if c.tables is None else self.candidates(c, padded[at[:, None] + np.arange(c.n)])
                proposed.append(np.stack((np.searchsorted(ends, at, side="right")[window], items[part], at[window] - offsets[part])))
        doc, item, begin = np.concatenate(proposed, axis=1)
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
            if a < b:
                d, k = int(doc[a]), int(item[a])
                first = int(ends[d - 1]) if d else 0
                if best := self._verified(texts[d], k, begin[a:b] - first, slots[first : first + max(0, len(texts[d]) - Q + 1)]):
                    found.append((d, self.items[k][0], *best))
        return sorted(found)

    def _verified(self, text: str, k: int, begins: np.ndarray, slots: np.ndarray) -> tuple[int, int, int] | None:
        """Edits, start and end of the best passage of item k among those that begin near the given places, if it is within the allowed edits."""
        item = self.items[k][1]
        n, most, best = len(item), allowed(len(item)), None
        if (at := text.find(item)) >= 0:
            return 0, at, at + n
        for group in np.split(begins, np.flatnonzero(np.diff(begins) > n) + 1):
            low, high = max(0, int(group[0]) - most), min(len(text), int(group[-1]) + n + most)
            if high > low and self.shares_grams(k, slots[low : max(low, high - Q + 1)]):
                edits, end = edit_distance(item, text[low:high])
                if edits <= most and (best is None or edits < best[0]):
                    best = (edits, max(0, low + end - n), low + end)
        return best

    def _short_items(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        found, widths = [], {t.count(" ") + 1 for t in self.short}
        for d, text in enumerate(texts):
            tokens = text.split(" ")
            for width in widths:
                for t in {" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)} & self.short.keys():
                    at = f" {text} ".index(f" {t} ")
                    found += [(d, i, 0, at, at + len(t)) for i in self.short[t]]
        return found


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Parts of about CHUNK_CHARS characters; a longer text is a part by itself."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK_CHARS:
            yield first, texts[first:i]
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, texts[first:]


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items, at most about BLOCK_ITEMS and BLOCK_CHARS at a time, and whether this is the last block."""
    usable = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, chars = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for b in range(blocks):
        part = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()], b == blocks - 1


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end (in the normalised text, end exclusive) of every occurrence found."""
    schema = "doc_id long, item_id long, edits int, start long, end long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for items, last in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))

        def searched(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = [normalised(t) for t in batch.text]
                hits = [(first + d, *x) for first, part in _chunks(texts) for d, *x in shared.value.search(part)]
                out = pd.DataFrame(hits, columns=["at", "item_id", "edits", "start", "end"])
                out.insert(0, "doc_id", batch.doc_id.to_numpy()[out["at"].to_numpy(dtype=int)])
                yield out.drop(columns="at")

        part = rows.mapInPandas(searched, schema)
        if not last:
            part = written(part, "contaminated")
            shared.destroy()
        found = found.unionByName(part)
    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item occurs, with the columns of documents."""
    kept = docs.select(*DOCUMENT_COLUMNS)
    for items, last in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))

        def clean(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = [normalised(t or "") for t in batch.text]
                bad = {first + d for first, part in _chunks(texts) for d, *_ in shared.value.search(part)}
                yield batch[[i not in bad for i in range(len(batch))]]

        kept = kept.mapInPandas(clean, kept.schema)
        if not last:
            kept = written(kept, "uncontaminated")
            shared.destroy()
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
