"""Answers for queries as they arrive: each micro-batch goes through the same plan and is appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.predict import candidates, predict


def stream_answers(spark: SparkSession, queries_path: str, schema: str, gallery: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Answers (query_id, slug, confidence, verdict) for Parquet files of queries (query_id, crops) at queries_path, below out.

    A batch that is repeated after a failure overwrites its own folder, so answers appear once."""

    def answer(batch: DataFrame, number: int) -> None:
        found = predict(candidates(batch, gallery)).select("query_id", "slug", "confidence", "verdict")
        found.withColumn("answered", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).parquet(queries_path)
    return source.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
