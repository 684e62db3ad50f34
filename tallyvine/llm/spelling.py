"""Spelling variants by permuterm rotations (operator 12).

Words are runs of Latin letters, counted over all documents; one run in SPOIL of each document loses a letter. A word
is marked with a terminator and rotated: each rotation stands for a prefix range as a whole (the words that hold one letter more, at its end) and without its last
letter (the words that have another letter there, or none), so the rotations of two words with one replaced, inserted or deleted letter share a range that skips the edited letter.
All ranges are sorted and scanned group by group. A range can hold no more words than there are letters, and one, so no
group grows with the input; of several equal letters in a row only the first counts as the one inserted, so each pair of neighbours is emitted once.
A range is sorted by its first HEAD letters and then by a fingerprint of all of it, so a row has the same few bytes for
words of any length; neighbours are verified by their distance.

Each word's form is its most frequent neighbour if that is FORM_TIMES as frequent; forms are followed to the last by doubling the steps.

Defined results: null and empty texts have no words; whole texts count; a null id stands as an empty text before the
colon; rows with equal ids and texts all count; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read_table, whole_text, written

SHORTEST, LEAST_COUNT, FORM_TIMES, SPOIL = 7, 2, 10, 31
#: Runs that can make a word; in Latin-1, with A-Z lowered and all letters beyond it as a question mark.
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % SHORTEST)
#: Words that a task counts before it hands them on; letters of words rotated at a time; ranges sorted by one task.
KEPT, LETTERS, ROWS_A_TASK = 500_000, 1 << 18, 1_000_000
#: Letters by which ranges are sorted first, the rest of the key being a fingerprint.
HEAD = 3
WHOLE, FIRST, LATER = 0, 1, 2
BASE = 0x5851F42D4C957F2D
SYMBOLS = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64)


def words_of(doc_id: int | None, text: str) -> Counter[bytes]:
    """The words of a text, in Latin-1."""
    before, found = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in Counter(RUN.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
        if h % SPOIL == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= SHORTEST:
            found[run] += n
    return found


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter, in time linear in their length."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    low, high = 0, min(len(a), len(b))  # the first place where they differ
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    skip_a, skip_b = int(len(a) >= len(b)), int(len(b) >= len(a))
    return a[low + skip_a :] == b[low + skip_b :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words that occur LEAST_COUNT times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in held], "n": list(held.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for word, n in words_of(doc_id.as_py(), text.as_py()).items():
                    held[word] += n
                if len(held) >= KEPT:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def ranges(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, place of the word, kind of every range: WHOLE rotations, and those that skip a letter, which is the FIRST of equal ones or a LATER one.

    A marked word is written twice over, so every range is a window of it."""
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(w + b"\0" + w + b"\0" for w in words), np.uint8)
    begin = np.cumsum(2 * sizes + 2) - 2 * sizes - 2
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SYMBOLS[data] * _powers(BASE, len(data)), out=sums[1:])
    down = _powers(pow(BASE, -1, 1 << 64), len(data))
    of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place of each letter in its word
    letter = begin[of] + at
    starts = np.concatenate((letter, begin + sizes, letter + 1))
    lengths = np.concatenate((sizes[of] + 1, sizes + 1, sizes[of]))
    prints = (sums[starts + lengths] - sums[starts]) * down[starts]
    prints ^= prints >> np.uint64(32)
    prints *= np.uint64(0xD6E8FEB86659FD93)
    head = np.zeros(len(starts), np.uint64)
    for i in range(HEAD):
        head = head << np.uint64(8) | data[starts + i]
    key = head << np.uint64(64 - 8 * HEAD) | prints >> np.uint64(8 * HEAD)
    later = (at > 0) & (data[letter] == data[np.maximum(letter - 1, 0)])
    kind = np.concatenate((np.full(len(of) + len(words), WHOLE), np.where(later, LATER, FIRST)))
    return key, np.concatenate((of, np.arange(len(words)), of)), kind


def meetings(key: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of sorted ranges whose words are neighbours: both skip a letter, or one is whole and the other skips the first of equal letters."""
    i, step, found = np.arange(max(0, len(key) - 1)), 1, []
    while len(i):
        i = i[key[i] == key[i + step]]
        low, high = np.minimum(kind[i], kind[i + step]), np.maximum(kind[i], kind[i + step])
        met = i[(low > WHOLE) | (high == FIRST)]
        found.append((met, met + step))
        step += 1
        i = i[i + step < len(key)]
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (i, i)


def neighbours(words: DataFrame) -> DataFrame:
    """a, b (wid) of the words (wid, word) that share a range."""

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            encoded, wid, at = [w.encode("latin-1") for w in batch.word], batch.wid.to_numpy(), 0
            ends = np.cumsum([len(w) for w in encoded])
            while at < len(encoded):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, side="right")))
                key, of, kind = ranges(encoded[at:stop])
                for i in range(0, len(key), ROWS_A_TASK):
                    some = slice(i, i + ROWS_A_TASK)
                    yield pd.DataFrame({"key": key[some].view(np.int64), "wid": wid[at:stop][of[some]], "kind": kind[some]})
                at = stop

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            key = rows.key.to_numpy()
            cut = len(key)  # the last group may go on in the next batch
            while cut and key[cut - 1] == key[-1]:
                cut -= 1
            kept = rows.iloc[cut:]
            yield paired(rows.iloc[:cut])
        if kept is not None:
            yield paired(kept)

    def paired(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = meetings(rows.key.to_numpy(), rows.kind.to_numpy())
        wid = rows.wid.to_numpy()
        return pd.DataFrame({"a": np.minimum(wid[i], wid[j]), "b": np.maximum(wid[i], wid[j])})

    letters = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    parts = max(partitions(words.sparkSession), -(-2 * letters // ROWS_A_TASK))
    rows = words.mapInPandas(rotate, "key long, wid long, kind byte").repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInPandas(scan, "a long, b long")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    verified = F.pandas_udf(lambda x, y: pd.Series([one_edit(a, b) for a, b in zip(x, y, strict=True)], dtype=bool), "boolean")
    words = written(word_counts(docs).withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    of = lambda who: words.select(F.col("wid").alias(who), F.col("word").alias(f"{who}_word"), F.col("n").alias(f"{who}_n"))
    pairs = neighbours(words.select("wid", "word")).join(of("a"), "a").join(of("b"), "b").where(verified("a_word", "b_word"))
    side = lambda x, y: F.struct(F.col(x).alias("wid"), F.struct((-F.col(f"{y}_n")).alias("o"), F.col(f"{y}_word").alias("word"), F.col(y).alias("wid")).alias("other"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("x.*")
    best = both.groupBy("wid").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    joined = words.join(best, "wid", "left")
    rows = joined.withColumn("best", F.when(-F.col("best.o") >= FORM_TIMES * F.col("n"), F.col("best")))
    rows = written(rows.select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best"), "spelling-best")
    up = written(rows.where("best IS NOT NULL").select("wid", F.col("best.wid").alias("up"), F.col("best.word").alias("root")), "spelling-forms")
    while True:  # forms grow tenfold in count, so chains are short
        above = up.select(F.col("wid").alias("up"), F.col("up").alias("top"), F.col("root").alias("top_root"))
        stepped = up.join(above, "up", "left").select("wid", F.coalesce("top", "up").alias("up"), F.coalesce("top_root", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        stepped = written(stepped, "spelling-roots")
        up = stepped.drop("moved")
        if not stepped.where("moved").take(1):
            break
    return rows.join(up.select("wid", "root"), "wid", "left").select(
        "word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.o")).alias("form_n")
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents"))


#: The same rows by the strings that words leave when they lose a letter; CRC-32 bit by bit: a byte is mixed in, then eight steps.
ORACLE_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
), steps AS (
  SELECT run, n, flatten(list_transform(range(1, length(x), 2), lambda k: [16 * (instr('0123456789ABCDEF', x[k]) - 1) + instr('0123456789ABCDEF', x[k + 1]) - 1, -1, -1, -1, -1, -1, -1, -1, -1])) AS s FROM counted
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], s), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM steps
), kept AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed
), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), losses AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM cut
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM losses a JOIN losses b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM losses l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM losses l JOIN words w ON l.rest = w.word
), best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word
), first AS (SELECT n.word, min(other) AS other FROM near n JOIN best b ON b.word = n.word AND n.other_n = b.most GROUP BY n.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN f.other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN first f ON f.word = w.word
), climbed(word, up) AS (SELECT word, form FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM climbed c JOIN formed f ON f.word = c.up WHERE f.form IS NOT NULL
), roots AS (SELECT c.word, c.up FROM climbed c JOIN formed f ON f.word = c.up WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(r.up, f.word) AS root, f.n, f.n_near, f.form_n FROM formed f LEFT JOIN roots r ON r.word = f.word
"""
