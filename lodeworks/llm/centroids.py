"""Centroid clustering over integer vectors: exact rounds of nearest centroids and floored means.

Vectors are packed in blocks once, in a written table. A block's squared distances are |x|^2 - 2 x.c + |c|^2, a matrix product
in float64. Where no component of a vector or centroid is above `bound`, all sums on the way are whole numbers up to 2^53, so
nothing is rounded and ties are true ties; whatever is larger is computed in Python's integers. Sums and counts of clusters
meet by treeAggregate, so the driver only sees k x dimension numbers however many blocks there are.

Vectors are used if they have the asked number of components, none of them null, NaN or infinite; repeated rows count as often
as they stand there. First centroids are the vectors whose ids hash least; of rows with one id (a null id counts as an empty
one) the smaller vector comes first. With fewer than k vectors there are as many centroids. No vectors give no rows.
Distances beyond 2^63 - 1 are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from lodeworks.llm.scratch import settled
from lodeworks.llm.textkit import tidy

BLOCK = 2048
LONGEST = 2**63 - 1


def bound(dimension: int) -> int:
    """Components up to here keep every sum of an expanded distance at 2^53 or less: 4 d b^2 <= 2^53."""
    return math.isqrt(2**51 // dimension)


def whole(x: float, scale: int) -> int:
    """floor(scale * x) without rounding, for any finite double."""
    top, bottom = float(x).as_integer_ratio()
    return top * scale // bottom


class Sums(NamedTuple):
    """Of each cluster: rows, sums of components and of distances; Python integers, as large as they get."""

    count: list[int]
    total: list[list[int]]
    distance: list[int]

    def plus(self, other: Sums) -> Sums:
        add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
        return Sums(add(self.count, other.count), list(map(add, self.total, other.total)), add(self.distance, other.distance))


class Centroids:
    """The centroids of a round and the distances to them."""

    def __init__(self, rows: list[list[int]]):
        self.rows, self.dimension = rows, len(rows[0])
        limit = bound(self.dimension)
        self.small = [k for k, c in enumerate(rows) if max(map(abs, c)) <= limit]
        self.large = sorted(set(range(len(rows))) - set(self.small))
        self.table = np.array([rows[k] for k in self.small], np.float64).reshape(-1, self.dimension)
        self.square = (self.table**2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of rows whose components are within the bound; the smaller number wins ties."""
        if not self.large:
            far = (x**2).sum(axis=1)[:, None] - 2 * (x @ self.table.T) + self.square
            best = far.argmin(axis=1)
            return best, far[np.arange(len(x)), best].astype(np.int64)
        return self.nearest_exact(x.astype(np.int64).astype(object))

    def nearest_exact(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows of Python integers of any size."""
        far = np.empty((len(x), len(self.rows)), object)
        for k, c in enumerate(self.rows):
            far[:, k] = ((x - np.array(c, object)) ** 2).sum(axis=1)
        best = np.array([min(range(len(self.rows)), key=row.__getitem__) for row in far.tolist()], np.int64)
        return best, far[np.arange(len(x)), best]

    def sums(self, x: np.ndarray, exact: bool) -> Sums:
        n = len(self.rows)
        best, far = self.nearest_exact(x) if exact else self.nearest(x)
        if exact or far.dtype == object:
            empty = Sums([0] * n, [[0] * self.dimension for _ in range(n)], [0] * n)
            for row, k, d in zip(x.tolist(), best.tolist(), far.tolist(), strict=True):
                empty.count[k] += 1
                empty.total[k] = [a + int(b) for a, b in zip(empty.total[k], row, strict=True)]
                empty.distance[k] += d
            return empty
        mine = np.zeros((n, len(x)))
        mine[best, np.arange(len(x))] = 1
        total = (mine @ x).astype(np.int64)  # a block's sums stay below 2^53: 2048 rows of components up to 2^25.5
        high, low = mine @ (far >> 26), mine @ (far & (2**26 - 1))
        return Sums(mine.sum(axis=1).astype(int).tolist(), total.tolist(), [(int(a) << 26) + int(b) for a, b in zip(high, low, strict=True)])

    def moved(self, sums: Sums) -> Centroids:
        return Centroids([[t // n for t in total] if n else old for old, n, total in zip(self.rows, sums.count, sums.total, strict=True)])

    def sha256(self, k: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[k])).encode()).hexdigest()


def usable(vectors: DataFrame, dimension: int, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter((F.size("v") == dimension) & ~bad)


def blocks_of(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """rows(id, v) packed: ids, and either int32 rows or, beyond the bound, rows of decimal integers."""
    limit = min(bound(dimension), 2**31 - 1)

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column(0)
                x = part.column(1).flatten().to_numpy().reshape(-1, dimension)
                with np.errstate(over="ignore"):
                    scaled = np.floor(x * scale)
                fits = (np.abs(scaled) <= limit).all(axis=1)
                if fits.any():
                    yield _block(ids.filter(pa.array(fits)), scaled[fits].astype("<i4").tobytes(), [])
                if not fits.all():
                    large = [",".join(str(whole(c, scale)) for c in row) for row in x[~fits].tolist()]
                    yield _block(ids.filter(pa.array(~fits)), b"", large)

    return rows.mapInArrow(pack, "ids array<long>, x binary, large array<string>")


def _block(ids: pa.Array, x: bytes, large: list[str]) -> pa.RecordBatch:
    columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x], pa.binary()), pa.array([large], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["ids", "x", "large"])


def _rows_of(x: bytes, large: list[str], dimension: int) -> tuple[np.ndarray, bool]:
    if large:
        return np.array([[int(c) for c in row.split(",")] for row in large], object), True
    return np.frombuffer(x, "<i4").reshape(-1, dimension).astype(np.float64), False


class Clusters(NamedTuple):
    blocks: DataFrame
    centroids: Centroids | None
    inertia: list[int]  # of each cluster

    def assigned(self) -> DataFrame:
        """(id, cluster, distance) of every vector."""
        centroids = self.centroids

        @tidy
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x, large in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    rows, exact = _rows_of(x, large, centroids.dimension)
                    best, far = centroids.nearest_exact(rows) if exact else centroids.nearest(rows)
                    far = [d if d <= LONGEST else None for d in far.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

        if centroids is None:
            return self.blocks.select(F.explode("ids").alias("id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return self.blocks.mapInArrow(work, "id long, cluster int, distance long")

    def described(self) -> DataFrame:
        """(cluster, cluster_inertia, inertia, centroid_sha256): k rows."""
        fit = lambda x: x if x <= LONGEST else None
        rows = [(k, fit(d), fit(sum(self.inertia)), self.centroids.sha256(k)) for k, d in enumerate(self.inertia)]
        return self.blocks.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dimension: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Clusters:
    """Each round assigns every vector to its nearest centroid and moves centroids to floored means; empty ones stay.

    scale has to be a power of two: products with it are exact.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale has to be a power of two")
    rows = usable(vectors, dimension, id_col, vector_col)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = [r.v for r in rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]
    blocks = settled(blocks_of(rows, dimension, scale), "blocks")
    if not first:
        return Clusters(blocks, None, [])
    packed = blocks.select("x", "large").rdd
    now = Centroids([[whole(c, scale) for c in v] for v in first])
    for _ in range(rounds):
        now = now.moved(_summed(packed, now))
    return Clusters(blocks, now, _summed(packed, now).distance)


def _summed(packed, centroids: Centroids) -> Sums:
    """Sums over all blocks; partial ones are added in a tree, so no task or driver takes them all."""

    def block(held: Sums | None, row: Row) -> Sums:
        mine = centroids.sums(*_rows_of(bytes(row.x), row.large, centroids.dimension))
        return mine if held is None else held.plus(mine)

    def both(a: Sums | None, b: Sums | None) -> Sums | None:
        return a.plus(b) if a is not None and b is not None else b if a is None else a

    return packed.treeAggregate(None, block, both, depth=2)
