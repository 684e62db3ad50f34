"""Shared helpers: table access, scratch tables in the shared folder, packed rows, small integers as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path, written

#: Columns of the documents table, which every pipeline stage but the last returns.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows of a pack, as a power of two and as a bound; most buckets of a scratch table.
ROW_BITS, ROWS_A_BATCH, MOST_BUCKETS = 16, 1 << 16, 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_in_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like written, dealt out by key: grouping by it, or joining on it, moves only the other side."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"scratch_{uuid.uuid4().hex}"
    df.write.bucketBy(max(1, min(buckets, MOST_BUCKETS)), key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved while the catalog knows the table; the files are not the catalog's
    spark.sql(f"DROP TABLE {table}")
    return found


def packed_rows(docs: DataFrame, columns: list[str], text_bytes: int) -> DataFrame:
    """batch, blob: the rows, in packs of about text_bytes of text and ROWS_A_BATCH rows at most, each an Arrow stream.

    batch << ROW_BITS | place in the pack is a number of the row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal k, held, size, rows
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            found = pa.RecordBatch.from_pydict({"batch": pa.array([part << 24 | k], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
            k, held, size, rows = k + 1, [], 0, 0
            return found

        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64) + 1
            ends, at = np.cumsum(sizes), 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + text_bytes - size, side="right")))
                if held and stop == at + 1 and size + int(sizes[at]) > text_bytes:
                    yield flush()
                    continue
                stop = min(stop, at + ROWS_A_BATCH - rows)
                held.append(batch.slice(at, stop - at))
                size, rows, at = size + int(ends[stop - 1]) - before, rows + stop - at, stop
                if size >= text_bytes or rows >= ROWS_A_BATCH:
                    yield flush()
        if held:
            yield flush()

    return docs.select(*columns).mapInArrow(pack, "batch long, blob binary")


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def to_planes(x: np.ndarray) -> bytes:
    """Whole numbers from zero on as planes of bytes, as many as the largest needs: small ones compress well."""
    x = np.ascontiguousarray(x, np.uint64)
    k = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def from_planes(blob: bytes, n: int) -> np.ndarray:
    k = len(blob) // n if n else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(blob, np.uint8).reshape(k, n).T
    return out.view(np.uint64).ravel()


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def utf8_sha256(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus: the fold of a document."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_labels(labels: DataFrame, column: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """doc_id, label of the labelled rows outside the held-out fold: all, or about bound of them by a hash of the id.

    A doc_id that is labelled more than once counts once, with its largest label.
    """
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder("doc_id", modulus) != held_out))
    n = usable.count()
    if n > bound:
        usable = usable.where(F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1_000_000)) < int(1e6 * bound / n))
    return usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, text of the documents in a bounded set of labels (see bounded_labels), as a scratch table."""
    few = written(labels, "labels-used")
    joined = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(few), "doc_id")
    return written(joined.select("doc_id", "label", "text"), "training-texts")
