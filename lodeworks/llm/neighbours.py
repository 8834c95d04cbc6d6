"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing, candidates of all tables ranked by exact cosine.

Vectors are scaled to length 1 and hashed by floor((a.x + b) / width) for `projections` Gaussian a in each of `tables`
tables. A query visits `probes` buckets of each table in the order of their estimated success: perturbations of the
projections nearest to a bucket's edge come first. Parallel vectors (of one direction, equal ones among them) are one class
that keeps its k + 1 smallest ids (no more can be in any answer), so a very common vector is hashed once. Buckets of more than
`bucket_rows` rows are split, and so are their probes: each part of the rows meets each part of the queries in a cell of its own,
which holds one part of the queries while it streams the rows. Neither side of a bucket is held whole.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id; a row that is
repeated counts once. Vectors of different lengths aren't compared: those of each length are a search of their own. An id
with several vectors is one candidate, at its nearest, and one query, for which the nearest of any of its vectors count.
No vectors or no queries give no rows. Queries that find fewer classes than asked for meet all classes, in cells as above.
All scores are in double precision. Cosines that agree to 14 places are ties, as double sums can't tell them apart, and
ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.scratch import settled
from lodeworks.llm.textkit import tidy

PROJECTIONS, WIDTH, TABLES, PROBES = 12, 2.8, 12, 150
BUCKET_ROWS = 20_000
BLOCK = 4096
SPARE = 3  # more than asked for is kept until the scores of whole rows decide
PLACES = 14  # of cosines that are told apart


def perturbations(m: int, count: int) -> list[tuple[int, ...]]:
    """Sets of ranks into the 2m distances to bucket edges, sorted ascending, by expected squared distance."""

    def expected(j: int) -> float:
        if j < m:
            return (j + 1) * (j + 2) / (4 * (m + 1) * (m + 2))
        return 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m + 1 - j) / (4 * (m + 1) * (m + 2))

    cost = [expected(j) for j in range(2 * m)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < count:
        total, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - j in chosen for j in chosen):  # both edges of one projection can't be crossed
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


class Hashes:
    def __init__(self, dim: int, projections: int, width: float, tables: int, probes: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.m, self.width, self.tables = projections, width, tables
        self.a = rng.standard_normal((dim, tables * projections)) / width
        self.b = rng.random(tables * projections)
        self.code = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1
        self.sets = perturbations(projections, probes)

    def _cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (unit @ self.a + self.b).reshape(len(unit), self.tables, self.m)
        cell = np.floor(z)
        return cell.astype(np.int64), z - cell

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables."""
        return (self._cells(unit)[0] * self.code).sum(axis=2)

    def probed(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables x probes, in the order of estimated success."""
        cell, inside = self._cells(unit)
        own = (cell * self.code).sum(axis=2)
        edges = np.concatenate([inside, 1 - inside], axis=2)
        order = np.argsort(edges, axis=2)
        steps = np.concatenate([-self.code, self.code])[order]
        return np.stack([own + steps[:, :, list(s)].sum(axis=2) for s in self.sets], axis=2)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: v in double precision, over its largest component, so parallel vectors are equal."""
    v = F.col(vector_col).cast("array<double>")
    huge = F.lit(float("inf"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (x != huge) & (x != -huge), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("top", F.array_max(F.transform("v", F.abs)))
    return rows.select("id", F.transform("v", lambda x: x / F.col("top") + 0.0).alias("v")).distinct()  # + 0.0: no -0.0


class _Best:
    """The k + SPARE best candidates of each query of a task."""

    def __init__(self, keep: int):
        self.keep, self.rows = keep, {}

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: queries x ids."""
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], np.round(scores[:, order], PLACES)
        keep = min(self.keep, len(ids))
        least = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        for q, own, bound in zip(queries.tolist(), scores, least.tolist(), strict=True):
            above, ties = np.flatnonzero(own > bound), np.flatnonzero(own == bound)
            chosen = np.concatenate([above, ties[: keep - len(above)]])
            best = self.rows.setdefault(q, {})
            best.update(zip(ids[chosen].tolist(), own[chosen].tolist(), strict=True))
            if len(best) > 4 * self.keep:
                self.rows[q] = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.keep])

    def batches(self) -> Iterator[pa.RecordBatch]:
        rows = [(q, c, s) for q, best in self.rows.items() for c, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[: self.keep]]
        self.rows = {}
        columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["query", "cid", "near"])


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    projections: int = PROJECTIONS, width: float = WIDTH, tables: int = TABLES, probes: int = PROBES, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row that is_query marks."""
    lengths = [r[0] for r in usable(vectors, id_col, vector_col).select(F.size("v").alias("n")).distinct().collect()]
    if len(lengths) > 1:
        own = (vectors.filter(F.size(vector_col) == n) for n in sorted(lengths))
        made = (nearest(v, is_query, k, id_col, vector_col, projections, width, tables, probes, bucket_rows).withColumn("s", -F.col("score")) for v in own)
        every = reduce(DataFrame.unionByName, made).select(F.col("query_id").alias("id"), F.array(F.struct("s", "vec_id")).alias("near"))
        return _merged(every, k)
    rows = usable(vectors, id_col, vector_col)
    first = Window.partitionBy("v").orderBy("id")
    ranked = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    classes = ranked.groupBy("v").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = settled(classes, "classes")
    asked = usable(vectors.filter(is_query), id_col, vector_col)
    asked = settled(asked.join(classes.select("v", "cid"), "v").select("id", "cid"), "asked")
    queries = classes.select("cid", "v").join(asked.select("cid").distinct(), "cid", "left_semi")
    head = classes.select(F.size("v")).first()
    hashes = Hashes(head[0] if head else 1, projections, width, tables, probes)

    def keyed(probe: bool, vectors_too: bool = True):
        @tidy
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    unit = _unit(_matrix(part.column(1)))
                    keys = hashes.probed(unit) if probe else hashes.buckets(unit)[:, :, None]
                    n, t, p = keys.shape
                    if not vectors_too:
                        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.repeat(np.arange(t), p), n), pa.int32()), pa.array(keys.ravel())], ["t", "bucket"])
                        continue
                    packed = pa.array([x.tobytes() for x in unit], pa.binary())
                    own = np.repeat(np.arange(n), t * p)
                    table = pa.array(np.tile(np.repeat(np.arange(t), p), n), pa.int32())
                    yield pa.RecordBatch.from_arrays([table, pa.array(keys.ravel()), part.column(0).take(pa.array(own)), packed.take(pa.array(own))], ["t", "bucket", "cid", "x"])

        return work

    schema = "t int, bucket long, cid long, x binary"
    hashed = classes.select("cid", "v").mapInArrow(keyed(False), schema)
    parts_of = lambda n: F.ceil(F.col(n) / bucket_rows).cast("int")
    sizes = hashed.groupBy("t", "bucket").agg(F.count("*").alias("n"))
    visits = queries.mapInArrow(keyed(True, False), "t int, bucket long").groupBy("t", "bucket").agg(F.count("*").alias("asked"))
    sizes = settled(sizes.join(visits, ["t", "bucket"]).select("t", "bucket", parts_of("n").alias("parts"), parts_of("asked").alias("sides")), "buckets")
    data = _rows_in_cells(hashed.join(sizes, ["t", "bucket"]))
    asking = _queries_in_cells(queries.mapInArrow(keyed(True), schema).join(sizes, ["t", "bucket"]))
    keep = k + 1 + SPARE

    @tidy
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, here = _Best(keep), None
        q_ids, q_rows = [], []
        for batch in batches:
            key = np.stack([batch.column(j).to_numpy().astype(np.int64) for j in range(5)], axis=1)
            ids = batch.column(5).to_numpy()
            x = np.frombuffer(b"".join(batch.column(6).to_pylist())).reshape(batch.num_rows, -1) if batch.num_rows else None
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                group = tuple(key[a, :4].tolist())
                if group != here:
                    here, q_ids, q_rows = group, [], []
                if key[a, 4] == 0:
                    q_ids.append(ids[a:b]), q_rows.append(x[a:b])
                elif q_ids:
                    for mine, own in zip(q_ids, q_rows, strict=True):
                        for c in range(0, len(mine), BLOCK):
                            best.add(mine[c : c + BLOCK], ids[a:b], own[c : c + BLOCK] @ x[a:b].T)
                if len(best.rows) > 50_000:
                    yield from best.batches()
        yield from best.batches()

    def best_of(rows: DataFrame, asking: DataFrame) -> DataFrame:
        cell = ["t", "bucket", "part", "side"]
        both = rows.unionByName(asking).repartition(*cell).sortWithinPartitions(*cell, "kind")
        pairs = both.mapInArrow(meet, "query long, cid long, near double").groupBy("query", "cid").agg(F.max("near").alias("near"))
        return _first(pairs, keep)

    found = settled(best_of(data, asking), "found")
    counted = found.groupBy("query").count()
    n_classes = classes.count()
    short = queries.join(counted.filter(F.col("count") >= min(k + 1, n_classes)).select(F.col("query").alias("cid")), "cid", "left_anti")
    short = settled(short, "short")
    n_short = short.count()
    if n_short:  # as if all classes were one bucket that all these queries visit
        one = [F.lit(-1).alias("t"), F.lit(0).cast("long").alias("bucket"), F.lit(-(-n_classes // bucket_rows)).alias("parts"), F.lit(-(-n_short // bucket_rows)).alias("sides")]
        rows, asking = (df.mapInArrow(_packed, "cid long, x binary").select("*", *one) for df in (classes.select("cid", "v"), short.select("cid", "v")))
        found = found.unionByName(best_of(_rows_in_cells(rows), _queries_in_cells(asking)))
    return _ranked(found, classes, asked, k)


def _rows_in_cells(rows: DataFrame) -> DataFrame:
    """Each row belongs to one part and meets all sides of the queries."""
    side = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side")
    return rows.select("t", "bucket", F.pmod("cid", "parts").cast("int").alias("part"), side, F.lit(1).alias("kind"), "cid", "x")


def _queries_in_cells(rows: DataFrame) -> DataFrame:
    """Each query belongs to one side and meets all parts of the rows."""
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    return rows.select("t", "bucket", part, F.pmod(F.xxhash64("cid"), F.col("sides")).cast("int").alias("side"), F.lit(0).alias("kind"), "cid", "x")


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1 as bytes."""
    for batch in batches:
        if batch.num_rows:
            unit = _unit(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in unit], pa.binary())], ["cid", "x"])


def _first(pairs: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("near"), "cid")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep).select("query", "cid", "near")


def _ranked(found: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Cosines of whole rows decide; classes open into ids, the query's own id goes."""
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda a: a * a), F.lit(0.0), lambda s, x: s + x))
    of_query = classes.select(F.col("cid").alias("query"), F.col("v").alias("qv"))
    exact = found.dropDuplicates(["query", "cid"]).join(of_query, "query").join(classes, "cid")
    exact = exact.select("query", "cid", "ids", F.round(dot / (norm("qv") * norm("v")), PLACES).alias("score"))
    per_query = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")))
    answers = exact.groupBy("query").agg(per_query.alias("near"))  # at most k + 1 + SPARE classes of k + 1 ids
    opened = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct(c["s"].alias("s"), i.alias("vec_id")))))
    return _merged(asked.join(answers, asked["cid"] == answers["query"]).select("id", opened.alias("near")), k)


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of rows(id, near): all of an id's arrays together, each other id once, at its nearest."""
    rows = rows.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))  # a few dozen structs an id
    first = lambda x, i: (x["vec_id"] != F.col("id")) & ~F.exists(F.slice("near", F.lit(1), i), lambda y: y["vec_id"] == x["vec_id"])
    rows = rows.select("id", F.posexplode(F.slice(F.filter("near", first), 1, k)).alias("at", "x"))
    return rows.select(F.col("id").alias("query_id"), (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
