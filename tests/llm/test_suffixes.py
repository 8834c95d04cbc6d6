"""Substring dedup over bytes against every string of every text; hot anchors, split strings, odd texts."""

import random
from collections import Counter

import numpy as np
import pytest

from lodeworks.llm import suffixes

SCHEMA = "doc_id long, text string, n_bytes long, kept string, owner int"


def plain(rows, window):
    first: dict[bytes, tuple[int, int]] = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - window + 1):
                s = b[k : k + window]
                first[s] = min(first.get(s, (i, k)), (i, k))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - window + 1):
                if first[b[k : k + window]] != (i, k):
                    gone[k : k + window] = b"\1" * window
        spans = [(x, y) for x, y in zip([k for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])], [k + 1 for k in range(len(b)) if gone[k] and (k + 1 == len(b) or not gone[k + 1])])]
        out.append((i, len(b), sum(gone), len(spans), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


def answer(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], SCHEMA).repartition(3)
    got = suffixes.without_repeats(docs, **options).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(120), make(30)
    out = [(0, None), (1, ""), (2, "short"), (3, "a" * 99), (4, "a" * 100), (5, "a" * 350), (-7, "a" * 101), (6, "ab" * 200), (8, ("xyz " * 20 + "q") * 6)]
    out += [(10 + k, base) for k in range(6)] + [(10, base), (11, make(4) + base)]
    out += [(30 + k, make(rng.randint(0, 30)) + passage + make(rng.randint(0, 30))) for k in range(40)]
    for k in range(15):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = rng.choice("zé ")
        out.append((100 + k, "".join(own)))
    out += [(None, base), (None, base), (120, passage + passage), (121, make(2000) + passage + "é" * 150)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 5, "piece_bytes": 3000, "bucket_strings": 40}, {"hot": 2, "piece_bytes": 200, "bucket_strings": 4}, {"hot": 10**9, "bucket_strings": 7, "seed": 64}])
def test_matches_every_string(spark, rows, options):
    assert answer(spark, rows, **options) == plain(rows, 100)


@pytest.mark.parametrize("window", [9, 16, 33])
def test_other_windows(spark, rows, window):
    assert answer(spark, rows, window=window, seed=8, hot=3, piece_bytes=500, bucket_strings=50) == plain(rows, window)


def test_a_string_may_fill_several_buckets(spark):
    """One string in every piece, more often than a range is planned for: what its ranges find first is compared."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(5, 60))) + passage) for i in range(300)]
    rng.shuffle(rows)
    options = {"hot": 2, "piece_bytes": 250, "bucket_strings": 12}
    seen = []
    whole = suffixes._boundaries
    suffixes._boundaries = lambda replies: seen.append(whole(replies).count()) or whole(replies)
    try:
        assert answer(spark, rows, **options) == plain(rows, 100)
    finally:
        suffixes._boundaries = whole
    assert seen[0] > 0


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "x" * 500, 1, "k", 2)], SCHEMA)
    assert suffixes.without_repeats(docs.limit(0)).count() == 0
    assert answer(spark, [(None, "a" * 300)]) == plain([(None, "a" * 300)], 100)
    with pytest.raises(ValueError, match="multiple of 8"):
        suffixes.without_repeats(docs, seed=12)


def test_suffixes_are_sorted():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    raw = text.tobytes()
    for width in (5, 8, 20, 100):
        start = rng.permutation(2900)[:700]
        order, group = suffixes.sort_suffixes(text, start, width)
        names = [raw[k : k + width] for k in start[order].tolist()]
        assert names == sorted(names)
        assert [a == b for a, b in zip(names[1:], names)] == (group[1:] == group[:-1]).tolist()


def test_segments_change_nothing(rows):
    raw = "".join(t or "" for _, t in rows).encode()
    data, sizes, known = np.frombuffer(raw, np.uint8), np.array([len((t or "").encode()) for _, t in rows]), np.ones(len(rows), bool)
    whole = suffixes.anchors(data, sizes, known, 100, 32)
    cut = suffixes.anchors(data, sizes, known, 100, 32, segment=150)
    windows = lambda a: sorted((f + k, h) for f, c, h in zip(a.first.tolist(), a.count.tolist(), a.hash.tolist()) for k in range(c))
    assert windows(whole) == windows(cut) and set(whole.keys.tolist()) == set(cut.keys.tolist())
    often = dict(zip(cut.keys.tolist(), cut.times.tolist()))
    assert all(often[k] >= n for k, n in zip(whole.keys.tolist(), whole.times.tolist()))


def test_parts_of_windows_and_senders(spark, rows):
    """Hot windows of a piece in many parts, strings of few pieces sent at once."""
    options = {"hot": 2, "piece_bytes": 3000, "bucket_strings": 10, "sent_bytes": 2000, "hot_windows": 60}
    assert answer(spark, rows, **options) == plain(rows, 100)


def test_parts_sent_do_not_grow_with_pieces_times_ranges(spark, monkeypatch):
    """Many small pieces and many ranges: a range gets a part from each sender, not from each piece."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(40)]
    rows = [(k, texts[k % 40] + str(k)) for k in range(400)]
    counts, whole = {}, suffixes.settled
    monkeypatch.setattr(suffixes, "settled", lambda df, name: (made := whole(df, name), counts.update({name: made.count()}))[0])
    assert answer(spark, rows, piece_bytes=2000, bucket_strings=40) == plain(rows, 100)
    assert counts["pieces"] > 100 and counts["answers"] * 2 < counts["pieces"] * 20


def test_anchors_are_dealt_out_evenly():
    """The least hash of each window is small: ranges of the hashes themselves would bring most anchors to the first bucket."""
    data = np.random.default_rng(4).integers(97, 123, 400_000).astype(np.uint8)
    keys = suffixes.anchors(data, np.array([len(data)]), np.ones(1, bool), 100, 32).keys
    parts = dict(suffixes._by_bucket(keys, 20))
    places = np.arange(len(keys))
    sizes = [len(places[p]) for p in parts.values()]
    assert len(parts) == 20 and sum(sizes) == len(keys) and max(sizes) < 1.3 * min(sizes)
    assert np.array_equal(np.sort(np.concatenate([places[p] for p in parts.values()])), places)
