"""The block index against all Hamming distances; blocks of items bounded by bytes."""

import numpy as np
import pytest

from lodeworks.llm import decontamination as dc


@pytest.mark.parametrize(("items", "radius"), [(0, 63), (1, 63), (40, 63), (700, 63), (300, 31), (300, 15)])
def test_index_finds_all_within_the_radius(items, radius):
    rng = np.random.default_rng(items + radius)
    none = dc.Weights(max(items, 1), np.zeros(0, np.uint32))
    index = dc.Items([(k, " ".join(f"w{x}" for x in rng.integers(0, 60, 25))) for k in range(items)], none, radius)
    near = np.concatenate([index.prints[:150], rng.integers(0, 256, (60, 32)).astype(np.uint8)])
    for row in near[: min(items, 150)]:
        for bit in rng.choice(256, rng.integers(0, 90), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    want = {(int(r), int(k)) for r, k in np.argwhere(np.bitwise_count(near[:, None, :] ^ index.prints[None, :, :]).sum(axis=2) <= radius)} if items else set()
    got = list(index.candidates(near))
    assert len(got) == len(set(got)) and set(got) == want and (items < 40 or want)


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    items = spark.createDataFrame([(k, f"item {k} " + " ".join(f"w{k}x{j}" for j in range(10 + 30 * (k % 7 == 0)))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "before " + r.text + " after") if k % 2 else (k, "nothing here") for k, r in enumerate(items.collect())], "doc_id long, text string")
    whole = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in dc.find_leaks(docs, items).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 700)
    blocks = list(dc._blocks(items, 1000))
    assert len(blocks) > 2 and all(len(b) == 1 or sum(len(t.encode()) for _, t in b) <= 700 for b in blocks) and sum(map(len, blocks)) == 30
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in dc.find_leaks(docs, items).collect()} == whole and {d for d, _, _ in whole} == set(range(1, 30, 2))
    assert {r.doc_id for r in dc.clean(docs, items).collect()} == set(range(0, 30, 2))
