"""Fill-in-middle: a text is cut in three at unit boundaries and written prefix-suffix-middle or suffix-prefix-middle.

A table-driven DFA over bytes (and an end symbol after each text) does all reading in one scan: its states know how many
continuation bytes of a UTF-8 unit are to come and which beginning of a sentinel stands last; each transition counts whether a
unit begins there and whether a sentinel ends there. Whatever it has read, the last few symbols settle its state, so a slice of
texts is scanned in many lanes at once. A second pass looks the cuts up among the counted beginnings.

Cuts come from the SHA-256 of a seed and the id. A text that is null, empty or holds a sentinel stays plain; null counts as
empty, a null id as an empty one. Repeated rows give repeated rows, an empty table none; texts of any length are read whole,
and a worker holds a slice of a few MB or one longer text. Units are code points; a stray byte that is no part of a code point
is a unit of its own. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.textkit import slices, tidy

# The sentinels of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
END = 256
UNIT, HIT = 1, 2
LANES = 4096


@functools.cache
def tables(marks: tuple[str, ...] = MARKS) -> tuple[np.ndarray, np.ndarray, int]:
    """next[state, symbol], what each transition counts, and the number of symbols after which the state is settled.

    States are the beginnings of sentinels (the empty one first), then one, two and three continuation bytes to come.
    """
    names = [m.encode() for m in marks]
    heads = sorted({n[:k] for n in names for k in range(len(n))}, key=lambda h: (len(h), h))
    longest = lambda seen: next(heads.index(seen[k:]) for k in range(len(seen) + 1) if seen[k:] in heads)
    go, out = np.zeros((len(heads) + 3, END + 1), np.uint8), np.zeros((len(heads) + 3, END + 1), np.uint8)
    for state in range(len(go)):
        needed = max(0, state - len(heads) + 1)
        for byte in range(END):
            if 0x80 <= byte < 0xC0 and needed:
                go[state, byte] = len(heads) + needed - 2 if needed > 1 else 0
                continue
            out[state, byte] = UNIT
            follow = 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0
            seen = (b"" if needed else heads[state]) + bytes([byte])
            if any(seen.endswith(n) for n in names):
                out[state, byte] |= HIT
            go[state, byte] = len(heads) + follow - 1 if follow else longest(seen)
    return go, out, max(3, *(len(n) - 1 for n in names))


def scan(symbols: np.ndarray, marks: tuple[str, ...] = MARKS) -> np.ndarray:
    """What the transition at each symbol counts; lanes of equal length start a few symbols early, which settles their state."""
    go, out, settle = tables(marks)
    flat_go, flat_out = go.ravel().astype(np.int32) * (END + 1), out.ravel()
    lanes = max(1, min(LANES, len(symbols) // 64))
    width = -(-len(symbols) // lanes)
    padded = np.full(settle + lanes * width, END, np.uint16)
    padded[settle : settle + len(symbols)] = symbols
    columns = np.lib.stride_tricks.as_strided(padded, (settle + width, lanes), (2, 2 * width))
    counted = np.empty((width, lanes), np.uint8)
    state = np.zeros(lanes, np.int32)
    for step in range(settle + width):
        at = state + columns[step]
        if step >= settle:
            counted[step - settle] = flat_out[at]
        state = flat_go[at]
    return counted.T.ravel()[: len(symbols)]


def units_of(column: pa.Array, marks: tuple[str, ...] = MARKS) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Texts as bytes, their units and sentinels, and a function's table: byte places of all units, texts one after another."""
    texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.full(first[-1], END, np.uint16)
    within = np.ones(first[-1], bool)
    within[first[1:] - 1] = False
    symbols[within] = np.frombuffer(b"".join(texts), np.uint8)
    counted = scan(symbols, marks)
    units = np.add.reduceat(counted & UNIT, first[:-1], dtype=np.int64)
    hits = np.add.reduceat(counted >> 1, first[:-1], dtype=np.int64)
    begins = np.flatnonzero(counted & UNIT)
    return texts, units, hits, begins - np.repeat(first[:-1], units)


def numbers(seed: int, key: Column) -> list[Column]:
    """Four numbers of 32 bits: the first digits of the SHA-256 of seed:key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of docs; form is plain, psm or spm.

    plain_from: of 100 texts, those from here on stay plain; spm_below: of 100 others, so many get their suffix first.
    """
    p, s, m = (x.encode() for x in marks)

    def written(text: bytes, n: int, hits: int, begins: np.ndarray, h: tuple[int, ...]) -> tuple:
        if not n or hits or h[2] % 100 >= plain_from:
            return "plain", None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        a, b = (int(begins[k]) if k < n else len(text) for k in (low, high))
        head, body, tail = text[:a], text[a:b], text[b:]
        if h[3] % 100 < spm_below:
            return "spm", low, high - low, s + tail + p + head + m + body
        return "psm", low, high - low, p + head + s + tail + m + body

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, units, hits, begins = units_of(part.column(1), marks)
                last = np.cumsum(units)
                own = np.split(begins, last[:-1])
                hashes = zip(*(part.column(k).to_pylist() for k in range(2, 6)), strict=True)
                forms, heads, bodies, outputs = zip(*map(written, texts, units.tolist(), hits.tolist(), own, hashes), strict=True)
                columns = [part.column(0), pa.array(units), pa.array(forms), pa.array(heads, pa.int64()), pa.array(bodies, pa.int64()), pa.array(outputs, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(numbers(seed, F.col(id_col)))))
    made = rows.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from its form and its sentinels alone."""
    from re import escape

    parts = F.split(output, "|".join(map(escape, marks)), 4)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
