"""Buckets that many queries visit, and sums over many buckets of one source: small parts give what large ones give."""

import numpy as np
from pyspark.sql import functions as F

from lodeworks.llm import mixing, neighbours


def test_queries_of_a_bucket_are_split(spark):
    rng = np.random.default_rng(4)
    x = np.tile(rng.standard_normal(8), (240, 1)) + 1e-3 * rng.standard_normal((240, 8))  # all in one bucket
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    plain = lambda rows: sorted(map(tuple, rows.collect()))
    whole = plain(neighbours.nearest(table, F.col("vec_id") % 2 == 0))
    assert len(whole) == 600 and plain(neighbours.nearest(table, F.col("vec_id") % 2 == 0, bucket_rows=11)) == whole
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    score = np.round(unit @ unit.T, neighbours.PLACES)
    for q, rank, v, _ in whole:
        own = score[q].copy()
        own[q] = -9
        assert np.lexsort((np.arange(240), -own))[rank - 1] == v


def test_short_queries_meet_all_rows(spark):
    """More neighbours than any bucket has: every query meets every row, in small cells."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(table, F.col("vec_id") % 2 == 0, k=59, tables=2, probes=2, bucket_rows=7).collect()
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 60, 2))
    for q, found in got.items():
        own = np.round(unit @ unit[q], neighbours.PLACES)
        assert found == [v for v in np.lexsort((np.arange(60), -own)).tolist() if v != q]


def test_sums_in_two_levels(spark, monkeypatch):
    """One source over many buckets and groups of them: streams have no gaps and no overlaps."""
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 3)
    docs = spark.createDataFrame([(k, "w " * (k % 5), "big" if k % 40 else f"s{k}") for k in range(400)], "doc_id long, text string, source string").repartition(4)
    m = mixing.mix(docs, lambda i: (5.0, 2.0, 1.0)[i % 3], block=8)
    streams: dict = {}
    for r in m.rows.filter("size > 0").collect():
        streams.setdefault(r.source, []).append((r.start, r.size, r.source_size))
    for own in streams.values():
        at = 0
        for start, size, _ in sorted(own):
            assert start == at
            at += size
        assert at == own[0][2]
    by = {}
    for r in mixing.taken(m).collect():
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - b) < 1 for a, b in by.values())
