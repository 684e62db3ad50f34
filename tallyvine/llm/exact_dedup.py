"""Exact deduplication as a stateful stream (operator 9, DataFrame operations only).

The documents table is read as a stream. Its state, kept by the RocksDB provider on disk and
without expiry, holds for each digest the smallest id seen, the locator of that row (a hash of its file and
the row's place in it) and the number of rows. A later run with the same ledger folder reads
only files it has not seen. The state is then read back as a table, each digest that was hit
more than once is checked over full bytes, and every document gets the row that stays.

Defined results: a null text is the empty string; rows with a null id come after all others in
their group; of repeated rows (same id and text) exactly the one at the smallest locator is kept;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, utf8_sha256, whole_text, written

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The many small stores of a stream would each reserve megabytes of disk ahead.
RESERVE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
#: A store is closed with its task. Left open, those of run after run add up in native memory until maintenance finds them.
UNLOAD = "spark.sql.streaming.stateStore.unloadOnCommit"
SHUFFLE = "spark.sql.shuffle.partitions"

#: Digests of 32 bytes that may be sent to all tasks.
FEW_HITS = 250_000

#: Runs of blanks that differ from one space; what they match becomes one space.
UNEVEN_BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    """The text with each run of blanks as one space (null: empty)."""
    return F.regexp_replace(whole_text(text), UNEVEN_BLANKS, " ")


def _place() -> Column:
    """Orders the rows of a group: id first, null ids last, then the locator."""
    return F.struct(
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("doc_id"),
        F.xxhash64(F.col("_metadata.file_path")).alias("file_key"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def ingest(spark: SparkSession, path: str, ledger: str, max_bytes_per_trigger: str | None = None) -> None:
    """Bring the ledger up to date with the Parquet files at path. Safe to repeat after a failure.

    max_bytes_per_trigger bounds a micro-batch (a whole number as text; units are refused); by default one batch takes all new files.
    """
    session = spark.newSession()  # with settings of its own, but as many stores as the caller's session has partitions
    session.conf.set(PROVIDER, ROCKSDB)
    session.conf.set(RESERVE, "false")
    session.conf.set(UNLOAD, "true")
    session.conf.set(SHUFFLE, spark.conf.get(SHUFFLE))
    reader = session.readStream.schema(spark.read.parquet(path).schema)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    path = path.rstrip("/")
    itself = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be a folder or a single file
    rows = reader.parquet(itself).select(F.unhex(utf8_sha256(normalised())).alias("digest"), _place().alias("place"))
    state = rows.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", ledger).trigger(availableNow=True).start()
    query.awaitTermination()


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The state as a table: digest, keep_id, file_key, row_index, group_size."""
    state = spark.read.format("statestore").load(ledger)
    first, n = state.schema["value"].dataType.names
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.{first}.doc_id").alias("keep_id"),
        F.col(f"value.{first}.file_key").alias("file_key"),
        F.col(f"value.{first}.row_index").alias("row_index"),
        F.col(f"value.{n}").alias("group_size"),
    )


def byte_conflicts(docs: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Digests under which the full bytes of rows differ. Equal texts meet before the shuffle.

    hits: the digests that more than one row has; only their texts are compared. Up to FEW_HITS of them are sent to the tasks, so that no other text moves."""
    texts = docs.select(F.unhex(utf8_sha256(normalised())).alias("digest"), normalised().alias("norm"))
    if hits is not None:
        texts = texts.join(F.broadcast(hits) if hits.count() <= FEW_HITS else hits, "digest", "left_semi")
    distinct = texts.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    return distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1").select("digest")


def deduplicate(spark: SparkSession, path: str, ledger: str | None = None) -> DataFrame:
    """One row per document at path: doc_id, keep_id, group_size, kept, text_sha256, file_key, row_index of the kept row."""
    ledger = ledger or scratch_path(spark, "dedup-ledger")
    docs = spark.read.parquet(path)
    if not docs.take(1):
        empty = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string, file_key long, row_index long"
        return spark.createDataFrame([], empty)
    ingest(spark, path, ledger)
    classes = read_ledger(spark, ledger)
    rows = docs.select(
        "doc_id", F.unhex(utf8_sha256(normalised())).alias("digest"), normalised().alias("norm"), _place().alias("place")
    )
    conflicts = byte_conflicts(docs, written(classes.where("group_size > 1").select("digest"), "dedup-hits"))
    clean = rows.drop("norm").join(classes, "digest", "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("place.file_key") == F.col("file_key")) & (F.col("place.row_index") == F.col("row_index"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "file_key",
        "row_index",
    )
    if not conflicts.take(1):
        return clean
    apart = rows.join(conflicts, "digest", "left_semi")
    firsts = apart.groupBy("digest", "norm").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("group_size"))
    resolved = apart.join(firsts, ["digest", "norm"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("first") == F.col("place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("first.file_key").alias("file_key"),
        F.col("first.row_index").alias("row_index"),
    )
    settled = clean.join(conflicts.select(F.lower(F.hex("digest")).alias("text_sha256")), "text_sha256", "left_anti")
    return settled.unionByName(resolved)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
