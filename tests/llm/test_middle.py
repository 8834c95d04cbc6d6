"""Fill-in-middle against a plain version over code points; odd texts, every length of unit, sentinels at lane edges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodeworks.llm import middle

SCHEMA = "doc_id long, text string, n long, form string, output string, h0 int"


def plain(doc_id, text, plain_from=90, spm_below=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or any(m in text for m in middle.MARKS) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < spm_below:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    pieces = ["a", "é", "漢", "😀", "<", ">", "P", "S", "M", "<P", "S>", "<<", "\n", " ", "\x00", "word "]
    out = [None, "", "<P>", "<", "<S", "x<M>y", "<P<S", "😀", "é" * 70, "<" * 200, "a" * 63 + "<P>", "a" * 64 + "<S" + ">" * 3, "<P" + "é>"]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 300))) for _ in range(250)]
    return [*out, "".join(rng.choice(pieces[:4]) for _ in range(300_000)), "é" * 100_000 + "<M>"]


def test_matches_plain_version(spark, texts):
    rows = [*enumerate(texts), (None, "a text without an id"), (7, "é"), (7, "é"), (-3, "negative")]
    docs = spark.createDataFrame([(i, t, 5, "form", "out", 1) for i, t in rows], SCHEMA).repartition(3)
    made = middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.select("*", middle.restored(made.form, made.output).alias("back")).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *plain(i, t), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_shares_and_nothing(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(400)], "doc_id long, text string")
    assert {r.form for r in middle.fill_in_middle(docs, plain_from=100, spm_below=100).collect()} == {"spm"}
    assert {r.form for r in middle.fill_in_middle(docs, plain_from=0).collect()} == {"plain"}
    other = middle.fill_in_middle(docs, seed=9, marks=("<|pre|>", "<|suf|>", "<|mid|>"))
    back = other.select("doc_id", middle.restored(other.form, other.output, ("<|pre|>", "<|suf|>", "<|mid|>")).alias("back")).collect()
    assert {(r.doc_id, r.back) for r in back} == {(i, f"text number {i}") for i in range(400)}
    assert middle.fill_in_middle(docs.limit(0)).count() == 0


def test_state_settles():
    """Whatever the state, `settle` symbols lead every state to the same one: lanes may start there."""
    go, _, settle = middle.tables()
    kinds = [0x41, 0x3C, 0x50, 0x53, 0x3E, 0x80, 0xBF, 0xC3, 0xE4, 0xF0, 0xFF, middle.END]
    for a in kinds:
        for b in kinds:
            for c in kinds:
                ends = {int(go[go[go[s, a], b], c]) for s in range(len(go))}
                assert settle == 3 and len(ends) == 1


def test_scan_is_the_same_in_any_number_of_lanes(monkeypatch):
    rng = np.random.default_rng(3)
    symbols = rng.choice(np.array([60, 80, 83, 77, 62, 65, 0x80, 0xC3, 0xE4, 0xF0, 256], np.uint16), 5000)
    go, out, _ = middle.tables()
    state, want = 0, []
    for x in symbols.tolist():
        want.append(out[state, x])
        state = go[state, x]
    for lanes in (1, 2, 7, 78):
        monkeypatch.setattr(middle, "LANES", lanes)
        assert middle.scan(symbols).tolist() == want


def test_stray_bytes_are_units():
    texts = pa.array([b"a\x80b", b"\xc3(", b"\xf0\x9f\x98", b"\xff\xfe"], pa.binary())
    raw, units, hits, begins = middle.units_of(texts)
    assert units.tolist() == [3, 2, 1, 2] and not hits.any() and begins.tolist() == [0, 1, 2, 0, 1, 0, 0, 1]
