"""Approximate nearest neighbours by collision counting over sorted projections (operator 2).

Every random direction projects all vectors onto a line; a block of vectors keeps, for each direction, its
projections in ascending order. A query looks at the window of radius w around its own projection in every
array (query-centred buckets). A vector that falls into the windows of enough directions, the collision
threshold, is a candidate and is verified on the original vectors in double precision. If too few
candidates come, the radius is multiplied (virtual rehashing: no array is built anew).

All vectors are indexed, block after block, so a block's memory is bounded. Queries are stated rows; they
go out in chunks of bounded number, and each block returns a query's k nearest of its own, which one
aggregate merges.

Defined results. Null and zero vectors, and such with null or non-finite components, take no part, nor do
rows without vec_id. Vectors of another length than the query's are never its neighbours. Ties go to the
smaller vec_id; repeated rows count each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Vectors of one block, and queries that are broadcast at once.
BLOCK = 1 << 15
CHUNK = 1 << 13
#: Candidates for each neighbour asked for.
WANTED = 150


class SortedProjections:
    """The index of one block of vectors of equal length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: int = 128, share: float = 0.6, seed: int = 11):
        self.ids, self.vectors = ids, vectors
        rng = np.random.default_rng(seed)
        self.lines = rng.normal(size=(directions, vectors.shape[1]))
        self.threshold = int(np.ceil(share * directions))
        projected = vectors @ self.lines.T
        order = np.argsort(projected, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.uint16 if len(ids) <= 1 << 16 else np.int32))
        sorted_values = np.take_along_axis(projected, order, 0).T
        # All arrays behind each other, shifted apart, so that one search finds the windows of all directions.
        span = float(np.abs(sorted_values).max(initial=0.0))
        self.shift = np.arange(directions) * (4 * span + 1)
        self.span = span
        self.flat = (sorted_values + self.shift[:, None]).ravel()
        self.width = 0.05 * float(np.std(projected)) or 1e-9
        #: Radius at which a search starts; it follows the radii that earlier queries needed.
        self.start = self.width

    def search(self, query_id: int, query: np.ndarray, k: int, wanted: int, factor: float = 1.3):
        """(score, vec_id) of the k nearest found, verified; wanted: candidates beyond the threshold at which windows stop growing."""
        n = len(self.ids)
        # A window beyond the values of its own array must not reach into the next one.
        at = np.clip(self.lines @ query, -1.5 * self.span, 1.5 * self.span)
        far = self.lines @ query
        wanted = min(n, wanted)
        radius, rounds = self.start, 0
        counts = np.zeros(n, np.int64)
        edges = np.arange(len(at)) * n
        low = high = np.searchsorted(self.flat, at + self.shift) - edges
        while True:
            rounds += 1
            a = np.searchsorted(self.flat, np.maximum(far - radius, -1.75 * self.span) + self.shift, "left") - edges
            b = np.searchsorted(self.flat, np.minimum(far + radius, 1.75 * self.span) + self.shift, "right") - edges
            a, b = np.minimum(np.clip(a, 0, n), low), np.maximum(np.clip(b, 0, n), high)
            # Only what the larger windows add is counted; each array holds a vector once.
            added = [part for order, p, q, r, s in zip(self.order, a, low, high, b, strict=True) for part in (order[p:q], order[r:s]) if len(part)]
            if added:
                counts += np.bincount(np.concatenate(added), minlength=n)
            low, high = a, b
            found = np.flatnonzero(counts >= self.threshold)
            if len(found) >= wanted or int((high - low).min()) == n:
                break
            radius *= factor
        # A little less than was needed, so that later queries neither start too wide nor widen for long.
        self.start = max(self.width, radius / factor**2)
        found = found[self.ids[found] != query_id]
        score = np.sqrt(((self.vectors[found] - query) ** 2).sum(1))
        best = np.lexsort((self.ids[found], score))[:k]
        return score[best], self.ids[found][best]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the rows that take part."""
    clean = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return clean.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0))


def _searcher(shared, k: int, wanted: int):
    def run(batches):
        queries = shared.value
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def search(d):
            ids = np.concatenate([h[0] for h in held[d]])
            index = SortedProjections(ids, np.concatenate([h[1] for h in held[d]]))
            own = queries[d]
            rows = [(q, s, i) for q, v in zip(*own, strict=True) for s, i in zip(*index.search(q, v, k, wanted), strict=True)]
            held[d], size[d] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([float(r[1]) for r in rows], pa.float64()), pa.array([int(r[2]) for r in rows], pa.int64())], names=["query_id", "score", "vec_id"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths):
                if int(d) in queries:
                    mine = np.flatnonzero(lengths == d)
                    held.setdefault(int(d), []).append((ids[mine], values[starts[mine][:, None] + np.arange(d)]))
                    size[int(d)] = size.get(int(d), 0) + len(mine)
                    if size[int(d)] >= BLOCK:
                        yield search(int(d))
        for d in [d for d, n in size.items() if n]:
            yield search(d)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, wanted: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of rows for each of queries; both are usable().

    wanted: candidates that each block verifies at least; it goes with k, not with the number of rows.
    """
    wanted = wanted or WANTED * k
    spark = rows.sparkSession
    asked = written(queries, "queries")
    chunks = -(-asked.count() // CHUNK)
    found = None
    for c in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect()  # about CHUNK vectors
        by: dict[int, tuple[list, list]] = {}
        for q, v in {(r[0], tuple(r[1])): None for r in part}:
            ids, vectors = by.setdefault(len(v), ([], []))
            ids.append(q)
            vectors.append(np.array(v))
        local = rows.mapInArrow(_searcher(spark.sparkContext.broadcast(by), k, wanted), "query_id long, score double, vec_id long")
        found = local if found is None else found.unionByName(local)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    merged = written(found, "nearest").groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter("vec_id % 100 = 0"))


QUERIES = {"op2_neighbours": op2_neighbours}
ORACLES: dict[str, str] = {}
