"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Texts are lower-cased words of letters and digits; a shingle is five words (a shorter item is one shingle), named by a
64-bit hash. Every window of an item's length that shares a shingle with an item of that length (any other window has
similarity 0 with it) gets a 256-bit fingerprint: the signs of sums of its weighted shingle bits. Items are indexed by
the 16 blocks of their fingerprints: two fingerprints within the radius differ by at most radius // 16 bits in some
block, so all items within the radius are found by looking up each block with that many bits flipped. Candidates are
verified by the exact weighted Jaccard similarity of shingle sets. Weights are inverse document frequencies over the whole
benchmark, counted in SLOTS hashed counters (shingles that share a counter count together).

Null and empty texts and items are never contaminated. Repeated items match each; repeated rows give repeated rows. Of
windows that are equally similar the first is given. A benchmark of more than `block_items` items is taken in blocks of
items, one pass over the documents for each, so what is sent to the executors is bounded; results don't depend on blocks.
Without documents or items nothing is found. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.codes import Codes
from lodeworks.llm.textkit import Words, hash_grams, hash_words, mix, slices, tidy

SHINGLE = 5
BITS, BLOCKS = 256, 16
RADIUS = 63  # 3 flipped bits in a block
SIMILARITY = 0.8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20  # of items' texts that are sent at once; a longer item is sent alone
ROWS = 128  # fingerprints that are looked up at once
SLOTS = 1 << 20  # counters of document frequencies

_ODD = re.compile(r"[^\x00-\x7f\w]+")
_LANES = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_PART = np.zeros(256, bool)  # bytes of words, when other letters and digits are the only ones that aren't ASCII
_PART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Hashed:
    """Hashes of the words of texts, one text after another; first[i] is the place of text i's first word."""

    def __init__(self, texts: list[str | None]):
        raw = []
        for text in texts:
            text = text.lower() if text else ""
            raw.append((text if text.isascii() else _ODD.sub(" ", text)).encode("utf-8", "replace"))
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        part = np.concatenate([[False], _PART[data], [False]])
        start, end = np.flatnonzero(part[1:] & ~part[:-1]), np.flatnonzero(~part[1:] & part[:-1])
        bounds = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.words = hash_words(Words(data, start, end, start))
        self.first = np.searchsorted(start, bounds)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words; runs may cross texts."""
    return hash_grams(words, size) ^ np.uint64(size)


class Weights:
    """Inverse document frequencies of shingles among n items, from counters of at most SLOTS hashed places."""

    def __init__(self, n: int, counts: np.ndarray):
        self.n, self.counts = n, counts

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.full(len(hashes), math.log(1 + max(1, self.n)))
        return np.log1p(self.n / np.maximum(self.counts[(hashes % np.uint64(SLOTS)).astype(np.int64)], 1))


def own_shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingles of one item or window."""
    return np.unique(shingles(words, min(SHINGLE, len(words)))) if len(words) else np.zeros(0, np.uint64)


def weights_of(items: DataFrame) -> Weights:
    """Counted over all items; at most SLOTS numbers come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Hashed(batch.column(0).to_pylist())
            slots = [np.unique(own_shingles(found.words[a:b]) % np.uint64(SLOTS)).astype(np.int64) for a, b in zip(found.first[:-1], found.first[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(slots), -1), *slots]), pa.int64())], ["slot"])

    made = items.select("text").mapInArrow(work, "slot long").groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1 OR slot < 0").toArrow()
    counts = np.zeros(SLOTS, np.uint32)
    slot, n = made.column(0).to_numpy(), made.column(1).to_numpy()
    counts[slot[slot >= 0]] = np.minimum(n[slot >= 0], 2**32 - 1)
    return Weights(int(n[slot < 0].sum()), counts)


class Items:
    """The indexed items of one block of the benchmark."""

    def __init__(self, rows: list[tuple[int, str]], weights: Weights, radius: int = RADIUS, similarity: float = SIMILARITY):
        self.radius, self.similarity, self.weights = radius, similarity, weights
        found = Hashed([text for _, text in rows])
        self.ids, self.sizes, self.shingles = [], [], []
        for (item, _), a, b in zip(rows, found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if b > a:
                self.ids.append(item), self.sizes.append(b - a), self.shingles.append(own_shingles(found.words[a:b]))
        self.total = [float(weights.of(s).sum()) for s in self.shingles]
        every = np.concatenate([np.zeros(0, np.uint64), *self.shingles])
        known, code = np.unique(every, return_inverse=True)
        pairs = np.unique(code.astype(np.int64) << 32 | np.repeat(np.array(self.sizes, np.int64), [len(s) for s in self.shingles]))
        self.codes = Codes.of(known)
        self.sizes_at, self.sizes_of = np.searchsorted(pairs >> 32, np.arange(len(known) + 1)), pairs & (1 << 32) - 1  # of items with a shingle
        self.widths = sorted({min(n, SHINGLE) for n in self.sizes})
        self.prints = np.array([self._print(s) for s in self.shingles], np.uint8).reshape(-1, BITS // 8)
        masks = [m for m in range(1 << 16) if m.bit_count() <= radius // BLOCKS]
        self.near = np.array(masks, np.uint16)
        # Of each block: items in the order of their values, and where each value's items start.
        self.blocks = []
        for values in self.prints.view(np.uint16).T:
            order = np.argsort(values, kind="stable")
            self.blocks.append((order, np.searchsorted(values[order], np.arange((1 << 16) + 1))))

    @staticmethod
    def bits(hashes: np.ndarray) -> np.ndarray:
        """+1 or -1 for each bit of each shingle's hash."""
        lanes = mix(_LANES[None, :] ^ mix(hashes + np.uint64(1))[:, None])
        return np.unpackbits(lanes.view(np.uint8).reshape(len(hashes), BITS // 8), axis=1).astype(np.int8) * 2 - 1

    def _print(self, own: np.ndarray) -> np.ndarray:
        return np.packbits((self.weights.of(own)[:, None] * self.bits(own)).sum(axis=0) > 1e-9)

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) for all items whose fingerprints are within the radius of a row of prints.

        Two such fingerprints agree in some block but for radius // BLOCKS bits: every block is looked up with all these flips.
        """
        for first in range(0, len(prints), ROWS):
            own = np.ascontiguousarray(prints[first : first + ROWS])
            found = []
            for b, (order, start) in enumerate(self.blocks):
                value = own.view(np.uint16)[:, b, None] ^ self.near[None, :]
                n = np.diff(start)[value]
                row, flip = np.nonzero(n)
                times, at = n[row, flip], start[value[row, flip]]
                places = np.repeat(at, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                found.append(np.repeat(row, times) << 32 | order[places])
            pairs = np.unique(np.concatenate(found))
            row, item = pairs >> 32, pairs & (1 << 32) - 1
            near = np.bitwise_count(own[row] ^ self.prints[item]).sum(axis=1) <= self.radius
            yield from zip((row[near] + first).tolist(), item[near].tolist(), strict=True)

    def hits(self, found: Hashed) -> dict[int, dict[int, list[int]]]:
        """Per text and size of items: the words at which a shingle of such an item starts. All texts are looked up at once."""
        out: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for width in self.widths:
            code = self.codes.find(shingles(found.words, width))
            at = np.flatnonzero(code >= 0)
            text = np.searchsorted(found.first, at, "right") - 1
            whole = at + width <= found.first[text + 1]
            for i, d, c in zip(at[whole].tolist(), text[whole].tolist(), code[at[whole]].tolist(), strict=True):
                for n in self.sizes_of[self.sizes_at[c] : self.sizes_at[c + 1]].tolist():
                    out[d][n].append(i - int(found.first[d]))
        return out

    def leaks(self, words: np.ndarray, hits: dict[int, list[int]]) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the most similar window of each item that is found in a text."""
        best: dict[int, tuple[float, int, int]] = {}
        for n, places in hits.items():
            width = min(n, SHINGLE)
            # Starts of the windows that hold one of the places, as ranges.
            low = np.maximum(0, np.array(sorted(places)) - n + width)
            high = np.minimum(np.array(sorted(places)), max(0, len(words) - n))
            for start, stop in _joined(low.tolist(), high.tolist()):
                span = shingles(words[start : min(stop + n, len(words))], width)
                per = n - width + 1
                weight = self.weights.of(span)
                rows = weight[:, None] * self.bits(span)
                sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(rows, axis=0)])
                ends = np.minimum(np.arange(stop - start + 1) + per, len(span))
                totals = sums[ends] - sums[: len(ends)]
                _, code = np.unique(span, return_inverse=True)
                order = np.argsort(code, kind="stable")
                again = np.flatnonzero(code[order][1:] == code[order][:-1])
                for before, j in zip(order[again].tolist(), order[again + 1].tolist(), strict=True):  # a set counts a shingle once
                    totals[max(0, j - per + 1) : min(before, len(ends) - 1) + 1] -= rows[j]
                for a, k in self.candidates(np.packbits(totals > 1e-9, axis=1)):
                    found = self.similarity_of(k, np.unique(span[a : a + per]))
                    if found >= self.similarity and found > best.get(k, (0.0,))[0]:
                        best[k] = (found, start + a, min(n, len(words) - start - a))
        return sorted((self.ids[k], s, at, n) for k, (s, at, n) in best.items())

    def similarity_of(self, k: int, other: np.ndarray) -> float:
        both = float(self.weights.of(np.intersect1d(self.shingles[k], other, assume_unique=True)).sum())
        return both / ((self.total[k] + float(self.weights.of(other).sum()) - both) or 1.0)


def _joined(low: list[int], high: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges, by their starts, joined where they touch; empty ones go."""
    start = stop = None
    for a, b in zip(low, high, strict=True):
        if b < a:
            continue
        if start is None or a > stop + 1:
            if start is not None:
                yield start, stop
            start, stop = a, b
        stop = max(stop, b)
    if start is not None:
        yield start, stop


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    block: list = []
    held = 0
    for row in items.select("item_id", "text").filter("text IS NOT NULL").toLocalIterator():
        length = len(row[1].encode("utf-8", "replace"))
        if block and (len(block) == size or held + length > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += length
    if block:
        yield block


_built: dict[str, Items] = {}  # the last index that a worker built


def _index(block: Broadcast) -> Items:
    name, rows, weights, radius, similarity = block.value
    if name not in _built:
        _built.clear()
        _built[name] = Items(rows, weights, radius, similarity)
    return _built[name]


def _sent(items: DataFrame, radius: int, similarity: float, size: int) -> Iterator[Broadcast]:
    """Blocks of at most `size` items and BLOCK_BYTES, with the weights."""
    weights = weights_of(items)
    for block in _blocks(items, size):
        yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block, weights, radius, similarity))


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): a row for each item found in a document."""
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in _sent(items, radius, similarity, block_items):

        @tidy
        def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block)
            for batch in batches:
                for part in slices(batch):
                    ids, found = part.column(0), Hashed(part.column(1).to_pylist())
                    rows = [(ids[d].as_py(), *x) for d, own in sorted(index.hits(found).items()) for x in index.leaks(found.words[found.first[d] : found.first[d + 1]], own)]
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = rows.mapInArrow(work, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Rows of docs, all columns, in which no item is found."""
    text = docs.columns.index("text")
    for block in _sent(items, radius, similarity, block_items):

        @tidy
        def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = _index(block)
            for batch in batches:
                for part in slices(batch):
                    found = Hashed(part.column(text).to_pylist())
                    keep = np.ones(part.num_rows, bool)
                    for d, own in index.hits(found).items():
                        keep[d] = not index.leaks(found.words[found.first[d] : found.first[d + 1]], own)
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
