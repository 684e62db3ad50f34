"""From query vectors to answers: search, fusion, confidence, answer; and runs over a manifest of queries.

Models are inputs: query vectors, log-probabilities (or logits) of a verifier and lines of a label come as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as fixed
from ..operators.rerank import answers, confidence, fuse_lexical, fuse_verifier, log_softmax
from ..operators.retrieval import expand_slugs, search


def candidates(queries: DataFrame, gallery: DataFrame, width: int = fixed.SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, slug, score, image_name. An image has at least one slug, so width images suffice."""
    return expand_slugs(search(queries, gallery, width), width)


def predict(ranked: DataFrame, logits: DataFrame | None = None, lexical: DataFrame | None = None) -> DataFrame:
    """Answers from candidates: fused with a verifier (query_id, slug, logit) if there is one, else with lexical scores if there are."""
    if logits is not None:
        fused = fuse_verifier(log_softmax(ranked.join(logits, ["query_id", "slug"], "left").fillna(0.0, ["logit"])))
    elif lexical is not None:
        fused = fuse_lexical(ranked, lexical)
    else:
        fused = ranked.withColumn("fused", F.col("score")).withColumn("new_rank", F.col("rank"))
    return answers(confidence(fused))


def run_manifest(manifest: DataFrame, predicted: DataFrame) -> DataFrame:
    """query_id, slug for every row of the manifest; null where there is no answer."""
    return manifest.select("query_id").join(predicted.select("query_id", "slug"), "query_id", "left")
