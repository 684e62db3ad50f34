"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL (operator 2).

Words are runs of letters and digits or runs of marks, in lower case; single words and pairs are hashed
into 2^BITS slots; all pairs of equal words share one. A text is its slot counts, scaled to length one. Training takes a bounded set of labelled
rows, deals them to REPLICAS tasks that each run follow-the-regularised-leader (proximal) updates over them,
and averages the weights. A score is the logistic function of a sparse dot product.

Defined results: null and empty texts get the bias alone; rows with a null id are scored and not held out unless their
empty id falls into the fold; repeated rows get equal scores; without labels every score is 0.5; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_labels, id_remainder, read_table, training_texts, whole_text

BITS = 18
LABEL_BOUND = 20_000
REPLICAS, EPOCHS = 4, 5
ALPHA, BETA, L1, L2 = 1.0, 0.1, 0.01, 0.1
FOLDS, HELD_OUT = 3, 1
WORD = re.compile(r"\w+|[^\w\s]+")
PAIR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word, remembered for up to 200,000 words at a time."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return found


def features(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; slot 2^BITS is the bias."""
    words = WORD.findall(text.lower())
    single = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    pairs = np.where(single[:-1] == single[1:], PAIR, (single[:-1] * PAIR + single[1:]) * PAIR)
    slots = np.concatenate(((single * PAIR) >> np.uint64(64 - BITS), pairs >> np.uint64(64 - BITS))).astype(np.int64)
    slots, counts = np.unique(slots, return_counts=True)
    values = counts / max(1.0, math.sqrt(float(counts @ counts)))
    return np.append(slots, 1 << BITS), np.append(values, 1.0)


class Ftrl:
    """Follow the (proximally) regularised leader, one sparse example at a time."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = (logistic(float(w @ values)) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _replica(texts: pd.DataFrame) -> pd.DataFrame:
    hashes, model = WordHashes(), Ftrl()
    texts = texts.sort_values("doc_id")
    rows = [(features(t, hashes), y) for t, y in zip(texts.text, texts.label, strict=True)]
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            (slots, values), label = rows[k]
            model.learn(slots, values, label)
    return pd.DataFrame({"rows": [len(rows)], "weights": [model.weights().astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> np.ndarray:
    """Weights of all slots and the bias."""
    texts = training_texts(docs, bounded_labels(labels, "quality", FOLDS, HELD_OUT, bound))
    dealt = texts.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(REPLICAS)).alias("replica"))
    parts = dealt.applyInPandas(_replica, "rows long, weights binary").collect()  # REPLICAS rows of fixed size
    used = [(r.rows, np.frombuffer(r.weights, np.float32)) for r in parts]
    if not used:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.average([w for _, w in used], axis=0, weights=[n for n, _ in used]).astype(np.float32)


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, w = WordHashes(), shared.value
        for batch in batches:
            found = []
            for text in batch.text:
                slots, values = features(text, hashes)
                found.append(logistic(float(w[slots] @ values)))
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": found})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(scored, "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
