"""Toxic passages as maximum-scoring segments of token log-odds (operator 7).

Training (on a bounded set of labelled rows): in how many toxic and clean texts each word, and each beginning of
PREFIXES letters, occurs gives log-odds with an informative Dirichlet prior, of which the part that ERRORS standard
errors support counts; a word's score is its own or that of its best beginning. A drift per token makes the
expected exponential of a score one under the clean counts, so scores are in nats and segment maxima follow an
extreme-value (Gumbel) law. Every occurrence counts; one that follows the same word closely counts in part. Its location and the final logistic curve are fitted on labelled texts that gave no counts.
Scoring: one linear scan finds all maximal scoring segments (Ruzzo and Tompa); a passage is significant if its E-value is
below one; the evidence of a document, the sum of -ln(E) over its significant passages, becomes a probability by the curve.

Defined results: null and empty texts have no passage and get the curve's value there; rows with a
null id count as held out; repeated rows get equal scores; without usable labels of both classes every score is that of the
only class (0 without any); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, bounded_labels, id_remainder, read_table, training_texts, whole_text

#: Most labelled rows that training uses; least number of texts a token must occur in.
LABEL_BOUND = 20_000
LEAST_COUNT = 5
#: Total weight of the Dirichlet prior as a share of all counts; standard errors that a score must clear.
PRIOR = 0.005
ERRORS = 3.0
LEAST_DRIFT = 0.005
#: Lengths of the beginnings of words that have scores of their own.
PREFIXES = (4, 5, 6, 7)
#: A word that was used d words before counts 1 - REPEAT x exp(-d / REACH) of its score.
REPEAT, REACH = 0.9, 100.0
#: One labelled text in CALIBRATION fits the curve instead of the counts.
CALIBRATION = 4
FOLDS, HELD_OUT = 5, 0
WORD = re.compile(r"\w+")
EULER = 0.5772156649


def tokens_of(word: str) -> list[str]:
    """The word and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


class WordScores(dict):
    """Score of each word, remembered for up to 200,000 words at a time."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        best = max((self.scores.get(t, 0.0) for t in tokens_of(word)), default=0.0)
        found = self[word] = best if best > 0 else self.scores.get(word, 0.0)
        return found

    def __reduce__(self):
        return WordScores, (self.scores,)


@dataclass
class ToxicityModel:
    scores: dict[str, float] = field(default_factory=dict)
    drift: float = LEAST_DRIFT
    log_k: float = 0.0
    bias: float = -30.0
    slope: float = 0.0

    def __post_init__(self) -> None:
        self.words = WordScores(self.scores)

    def segments(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal scoring segments (first word, last word, score) of a text and its number of words."""
        words = WORD.findall(text.lower())
        gains = np.fromiter(map(self.words.__getitem__, words), float, len(words)) - self.drift
        hits = np.flatnonzero(gains > 0).tolist()
        last: dict[str, int] = {}
        for i in hits:
            if (before := last.get(words[i])) is not None:
                gains[i] *= 1 - REPEAT * math.exp((before - i) / REACH)
            last[words[i]] = i
        if not hits:
            return [], len(words)
        return maximal_segments(hits, np.concatenate(([0.0], np.cumsum(gains)))), len(words)

    def evidence(self, score: float, n: int) -> float:
        """-ln of the expected number of segments that score as high in a clean text of n words."""
        return score - self.log_k - math.log(max(n, 1))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * evidence))))


def maximal_segments(hits: list[int], sums: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time; only tokens with a positive score can begin or end one.

    sums[i] is the score of the first i tokens."""
    kept: list[list] = []  # first token, end, sum before, sum after, link to the nearest earlier one with a smaller sum before
    for i in hits:
        now = [i, i + 1, sums[i], sums[i + 1]]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= now[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= now[3]:
                break
            now = [kept[j][0], now[1], kept[j][2], now[3]]
            del kept[j:]
            j -= 1
        kept.append([*now, j])
    return [(a, b - 1, float(after - before)) for a, b, before, after, _ in kept]


def _token_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many texts of each class a token occurs, and how often a word is used in clean ones."""
    toxic, clean, uses = Counter(), Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.text, batch.label, strict=True):
            words = Counter(WORD.findall(text.lower()))
            (toxic if label else clean).update({t for w in words for t in tokens_of(w)})
            if not label:
                uses.update(words)
    if tokens := [*{**toxic, **clean}]:
        yield pd.DataFrame({"token": tokens, "toxic": [toxic[t] for t in tokens], "clean": [clean[t] for t in tokens], "uses": [uses[t] for t in tokens]})


def log_odds(counts: pd.DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log-odds with a Dirichlet prior that follows the pooled counts, drawn towards zero by ERRORS standard errors."""
    total = PRIOR * (n_toxic + n_clean)
    prior = PRIOR * (counts.toxic + counts.clean)
    a, b = counts.toxic + prior, counts.clean + prior
    delta = np.log(a / (n_toxic + total - a)) - np.log(b / (n_clean + total - b))
    error = np.sqrt(1 / a + 1 / b)
    sure = np.sign(delta) * np.maximum(0, np.abs(delta) - ERRORS * error)
    return {t: float(s) for t, s in zip(counts.token, sure, strict=True) if s != 0}


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope of a logistic curve, by damped Newton steps with a weak pull of the slope to zero."""
    bias, slope = math.log((y.sum() + 1) / ((1 - y).sum() + 1)), 0.0
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * x, -30, 30)))
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve(design.T @ (design * w[:, None]) + np.diag([1e-6, 1e-2]), design.T @ (y - p) - [0, 1e-2 * slope])
        bias, slope = bias + float(np.clip(step[0], -2, 2)), slope + float(np.clip(step[1], -2, 2))
    return bias, max(0.0, slope)


def train(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> ToxicityModel:
    texts = training_texts(docs, bounded_labels(labels, "toxic", FOLDS, HELD_OUT, bound))
    texts = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label")).repartition(16)  # copies count once
    n, ones = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not ones or ones == n:
        return ToxicityModel(bias=30.0 if ones else -30.0)
    fitting = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(CALIBRATION)) == 0
    counts = (
        texts.where(~fitting).mapInPandas(_token_counts, "token string, toxic long, clean long, uses long")
        .groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("uses").alias("uses"))
    )
    n_toxic, n_clean = (int(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    frequent = counts.where(F.col("toxic") + F.col("clean") >= LEAST_COUNT).toPandas()  # bounded by LABEL_BOUND texts
    model = ToxicityModel(log_odds(frequent, n_toxic, n_clean))
    clean = frequent[~frequent.token.str.endswith("*")]
    gain = sum(n * (math.exp(model.words[t]) - 1) for t, n in zip(clean.token, clean.uses, strict=True)) / max(int(clean.uses.sum()), 1)
    model.drift = max(LEAST_DRIFT, math.log1p(max(0.0, gain)))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.segments(t) for t in batch.text]
            yield pd.DataFrame({"label": batch.label, "scores": [[s for *_, s in x] for x, _ in found], "n": [m for _, m in found]})

    held = texts.where(fitting).mapInPandas(measured, "label int, scores array<double>, n long").toPandas()
    some = held[(held.label == 0) & (held.n > 0)]
    if len(some):
        best = np.array([max(x, default=0.0) for x in some.scores])
        model.log_k = float(np.mean(best - np.log(some.n)) - EULER)
    x = [sum(max(0.0, model.evidence(s, n)) for s in scores) for scores, n in zip(held.scores, held.n, strict=True)]
    if len(held):
        model.bias, model.slope = fit_curve(np.array(x), held.label.to_numpy(float))
    return model


def document_evidence(model: ToxicityModel, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed evidence of the significant passages, and those as (first word, last word, evidence)."""
    segments, n = model.segments(text)
    passages = [(a, b, e) for a, b, s in segments if (e := model.evidence(s, n)) > 0]
    return sum(e for *_, e in passages), passages


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and the significant passages (code points, end exclusive) of every row."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score, spans = [], []
            for text in batch.text:
                x, passages = document_evidence(model, text)
                score.append(model.probability(x))
                at = [m.span() for m in WORD.finditer(text)] if passages else []
                spans.append([{"start": at[a][0], "end": at[b][1], "evidence": e} for a, b, e in passages if b < len(at)])
            yield pd.DataFrame({"doc_id": batch.doc_id, "score": score, "passages": spans})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(scored, "doc_id long, score double, passages array<struct<start:int,end:int,evidence:double>>")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents whose score is below one half, with the columns of documents."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[model.probability(document_evidence(model, t or "")[0]) < 0.5 for t in batch.text]]

    rows = docs.select(*DOCUMENT_COLUMNS)
    return rows.mapInPandas(kept, rows.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages",
    )
