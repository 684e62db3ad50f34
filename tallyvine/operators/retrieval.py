"""Exact retrieval: every query against every gallery image, best view per crop, mean over crops.

Vectors are scaled to length one first; a vector that is empty, zero or not finite, or of another width, is an error.

Images are pruned exactly. Some images, chosen by hash, serve as pivots: they give each query a score that k images reach, and
every image belongs to the pivot next to it. By the triangle inequality of angles no image of such a group is nearer to a crop than
the crop's angle to the pivot, less the largest angle of the group's own views; a group none of whose images can reach a query's
score is skipped for that query. One block of queries of at most QUERY_BYTES is sent to the gallery, which stays where it is;
more queries meet the groups they can't skip in a shuffle, in blocks of at most BLOCK_BYTES. A task keeps its own best k of
each query before these are put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..scratch import written

#: Bytes of the vectors (as doubles) of a block of images and of queries; scores worked on at a time.
BLOCK_BYTES, QUERY_BYTES, CELLS = 64_000_000, 64_000_000, 1 << 21
#: Most pivots, a sample of the gallery by a hash of the names, and their bytes.
PIVOTS, PIVOT_BYTES = 256, 16_000_000
#: Scores closer than this count as equal, and then names decide.
DIGITS = 6
#: What rounding and arithmetic may add to a bound.
SLACK = 2e-6


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length one along the last axis."""
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    if not vectors.shape[-1] or not np.isfinite(length).all() or (length == 0).any():
        raise ValueError("Vectors must be finite and not zero")
    return vectors / length


def vectors_of(column: pa.ChunkedArray | pa.Array, number: int, width: int) -> np.ndarray:
    """Rows x vectors x numbers of a column of arrays of so many vectors, scaled to length one."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    vectors = flat.flatten()
    numbers = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float)
    sizes = [np.asarray(pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in (flat, vectors)]
    if flat.null_count or vectors.null_count or (sizes[0] != number).any() or (sizes[1] != width).any():
        raise ValueError("Query and gallery feature dimensions differ")
    return unit_rows(numbers.reshape(-1, number, width))


def mean_of_best(crops: np.ndarray, views: np.ndarray) -> np.ndarray:
    """Queries x images: the best view of each crop, the mean over crops."""
    scores = np.zeros((len(crops), len(views)))
    for c in range(crops.shape[1]):
        scores += np.stack([crops[:, c] @ views[:, v].T for v in range(views.shape[1])]).max(axis=0)
    return scores / crops.shape[1]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the unit vectors in the last axis, pair by pair."""
    return np.arccos(np.clip((a * b).sum(axis=-1), -1, 1))


def most_possible(crops: np.ndarray, pivot: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each query no image whose views are within radius of the pivot's has a larger score."""
    apart = np.arccos(np.clip(crops @ pivot.T, -1, 1))  # queries x crops x views
    return np.cos(np.maximum(apart - radius, 0)).max(axis=2).mean(axis=1) + SLACK


def nearest(views: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot next to each image, view by view."""
    return (views.reshape(len(views), -1) @ pivots.reshape(len(pivots), -1).T).argmax(axis=1)


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row: score first, then the smaller name; infinite ones never count."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((scores >= least) & np.isfinite(scores))
    else:
        row, column = np.nonzero(np.isfinite(scores))
    order = np.lexsort((names[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], column[kept]


class Asked:
    """Queries with the score that each has reached, and their best images in one task."""

    def __init__(self, ids: np.ndarray, crops: np.ndarray, reached: np.ndarray, k: int):
        self.ids, self.crops, self.reached, self.k, self.found = ids, crops, reached.copy(), k, []

    def compare(self, images: pd.DataFrame, views: np.ndarray, pivots: np.ndarray) -> tuple[int, int]:
        """Images (image_name and what comes along) by groups; returns the pairs of groups and queries, and how many were skipped."""
        names, group = images["image_name"].to_numpy(), nearest(views, pivots)
        place = images["image_name"].rank(method="first").to_numpy()
        pairs = skipped = 0
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            some = views[mine]
            radius = angles(some, pivots[g]).max(axis=0)
            asked = np.flatnonzero(most_possible(self.crops, pivots[g], radius) >= self.reached)
            pairs, skipped = pairs + len(self.ids), skipped + len(self.ids) - len(asked)
            step = max(1, CELLS // len(mine))
            for at in range(0, len(asked), step):
                q = asked[at : at + step]
                scores = np.round(mean_of_best(self.crops[q], some), DIGITS)
                scores[self.ids[q, None] == names[None, mine]] = -np.inf
                row, column = _best(scores, place[mine], self.k)
                full = np.bincount(row, minlength=len(q)) == self.k
                last = np.cumsum(np.bincount(row, minlength=len(q)))[full] - 1
                self.reached[q[full]] = np.maximum(self.reached[q[full]], scores[row, column][last])
                self.found.append(images.iloc[mine[column]].assign(_query=q[row], score=scores[row, column]))
            if sum(map(len, self.found)) > 4 * self.k * len(self.ids) + CELLS:
                self.found = [self.best()]
        return pairs, skipped

    def best(self) -> pd.DataFrame:
        rows = pd.concat(self.found)
        rows = rows[rows["score"].to_numpy() >= self.reached[rows["_query"].to_numpy()]]
        return rows.sort_values(["_query", "score", "image_name"], ascending=[True, False, True]).groupby("_query").head(self.k)

    def rows(self, columns: list[str]) -> Iterator[pd.DataFrame]:
        if self.found:
            out = self.best()
            yield out.assign(query_id=self.ids[out["_query"].to_numpy()])[columns]


def _shape(rows: DataFrame, column: str) -> tuple[int, int]:
    """Vectors of the first row and numbers of its first vector; every other row is held against them where it is read. Nothing for no rows."""
    first = rows.select(column).first()
    if first is None:
        return 0, 0
    vectors = first[0] or []
    if not vectors or not vectors[0]:
        raise ValueError("Query and gallery feature dimensions differ")
    return len(vectors), len(vectors[0])


def _reached(crops: np.ndarray, ids: np.ndarray, pivots: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k of the pivots reach; none if they are too few."""
    scores = np.round(mean_of_best(crops, pivots), DIGITS)
    scores[ids[:, None] == names[None, :]] = -np.inf
    return np.full(len(ids), -np.inf) if scores.shape[1] < k else -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def search(queries: DataFrame, gallery: DataFrame, k: int, counters: tuple | None = None) -> DataFrame:
    """query_id, rank, image_name, score, extra columns of the gallery.

    queries: query_id, crops (array of vectors); gallery: image_name, views (array of vectors), and what should come along.
    Score is the mean over crops of the best view's product. Ties go to the smaller image_name. A query never finds the
    image that has its own id as name. counters: two accumulators, for pairs of a query and a group of images, and for those skipped."""
    if k < 1:
        raise ValueError("k must be positive")
    spark = gallery.sparkSession
    along = [c for c in gallery.columns if c not in ("image_name", "views")]
    kinds = dict(gallery.dtypes)
    columns = ["query_id", "image_name", "score", *along]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, image_name {kinds['image_name']}, score double" + "".join(f", {c} {kinds[c]}" for c in along)
    n_queries, (n_crops, width), (n_views, gallery_width) = queries.count(), _shape(queries, "crops"), _shape(gallery, "views")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "image_name")
    result = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "image_name", "score", *along)
    if not n_queries or not n_views:
        return result(spark.createDataFrame([], schema))
    if width != gallery_width:
        raise ValueError("Query and gallery feature dimensions differ")

    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * n_views * width)))
    chosen = gallery.select("image_name", "views", F.xxhash64("image_name").alias("_h")).orderBy("_h", "image_name").limit(most).drop("_h").toArrow()
    pivot_names, pivots = chosen.column("image_name").to_pandas().to_numpy(), vectors_of(chosen.column("views"), n_views, width)

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def count(pairs: tuple[int, int]) -> None:
        for counter, n in zip(counters or (), pairs, strict=False):
            counter.add(n)

    if 8 * n_queries * n_crops * width <= QUERY_BYTES:  # one block
        rows = queries.select("query_id", "crops").toArrow()
        ids, crops = rows.column("query_id").to_pandas().to_numpy(), vectors_of(rows.column("crops"), n_crops, width)
        shared = spark.sparkContext.broadcast((ids, crops, _reached(crops, ids, pivots, pivot_names, k), pivots))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, crops, reached, pivots = shared.value
            asked = Asked(ids, crops, reached, k)
            for batch in batches:
                step = max(1, BLOCK_BYTES // (8 * n_views * width))
                for at in range(0, len(batch), step):
                    some = batch.slice(at, step)
                    count(asked.compare(some.select(["image_name", *along]).to_pandas(), vectors_of(some.column("views"), n_views, width), pivots))
            for out in asked.rows(columns):
                yield pa.RecordBatch.from_pandas(out, arrow, preserve_index=False)

        return result(gallery.select("image_name", "views", *along).mapInArrow(scan, schema))
    return result(_shuffled(queries.select("query_id", "crops"), gallery, k, (pivots, pivot_names), (n_queries, n_crops, n_views, width), schema, arrow, columns, count))


def _shuffled(queries: DataFrame, gallery: DataFrame, k: int, chosen: tuple, shape: tuple, schema: str, arrow: pa.Schema, columns: list[str], count) -> DataFrame:
    """search for more than one block of queries: queries go to the groups of images that they can't skip."""
    n_queries, n_crops, n_views, width = shape
    spark, along = gallery.sparkSession, columns[3:]
    pivots = spark.sparkContext.broadcast(chosen)
    kinds = dict(gallery.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = vectors_of(batch.column("views"), n_views, width)
            group = nearest(views, pivots.value[0])
            apart = angles(views, pivots.value[0][group])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(group, pa.int32()), pa.array(list(apart), pa.list_(pa.float64()))], names=[*batch.schema.names, "group", "apart"]
            )

    images = ["image_name", "views", *along]
    fields = ", ".join(f"{c} {kinds[c]}" for c in images)
    placed = written(gallery.select(*images).mapInArrow(place, f"{fields}, group int, apart array<double>"), "search-gallery")
    facts = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.get("apart", F.lit(v))).alias(f"r{v}") for v in range(n_views)]).collect()  # one row a pivot
    in_block = max(1, BLOCK_BYTES // (8 * n_views * width))
    cuts = {r.group: -(-r.n // in_block) for r in facts}
    radii = spark.sparkContext.broadcast({r.group: np.array([r[f"r{v}"] for v in range(n_views)]) for r in facts})
    parts = max(1, -(-8 * n_queries * n_crops * width // QUERY_BYTES))
    kind = dict(queries.dtypes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crops, ids = vectors_of(batch.column("crops"), n_crops, width), batch.column("query_id").to_pandas().to_numpy()
            reached, rows = _reached(crops, ids, *pivots.value, k), []
            for group, radius in radii.value.items():
                asked = np.flatnonzero(most_possible(crops, pivots.value[0][group], radius) >= reached)
                count((len(ids), len(ids) - len(asked)))
                if len(asked):
                    some = batch.take(pa.array(asked))
                    rows.append(pa.RecordBatch.from_arrays([*some.columns, pa.array(reached[asked]), pa.array(np.full(len(asked), group), pa.int32())], names=["query_id", "crops", "reached", "group"]))
            yield from rows

    asked = queries.mapInArrow(route, f"query_id {kind['query_id']}, crops {kind['crops']}, reached double, group int")
    salts = spark.createDataFrame([(g, n) for g, n in cuts.items()], "group int, cuts int")  # one row a pivot
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), "search-queries")
    wanted = asked.select("group", "part").distinct()
    cut: Column = F.pmod(F.xxhash64("image_name"), F.col("cuts")).cast("int")
    left = placed.drop("apart").join(F.broadcast(salts), "group").withColumn("cut", cut).join(wanted, "group").select(*images, "group", "cut", "part")
    every = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")
    right = asked.join(F.broadcast(salts), "group").select("query_id", "crops", "reached", "group", every, F.col("part").alias("part"))
    right = right.toDF(*(f"q_{c}" for c in right.columns))  # names of its own: both sides come from the same table

    def best(images: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(images) or not len(wanted):
            return arrow.empty_table()
        ids = wanted.column("q_query_id").to_pandas().to_numpy()
        asked = Asked(ids, vectors_of(wanted.column("q_crops"), n_crops, width), wanted.column("q_reached").to_numpy(), k)
        asked.compare(images.select(["image_name", *along]).to_pandas(), vectors_of(images.column("views"), n_views, width), pivots.value[0])
        return pa.concat_tables([arrow.empty_table(), *(pa.Table.from_pandas(out, arrow, preserve_index=False) for out in asked.rows(columns))])

    keys = ["group", "cut", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(best, schema)


def expand_slugs(ranked: DataFrame, k: int) -> DataFrame:
    """One row per slug of each ranked image, cut to k slugs: the cut may fall within an image's slugs."""
    rows = ranked.select("query_id", F.col("rank").alias("image_rank"), "image_name", "score", F.posexplode(F.array_sort("slugs")).alias("pos", "slug"))
    order = Window.partitionBy("query_id").orderBy("image_rank", "pos")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "slug", "score", "image_name")
