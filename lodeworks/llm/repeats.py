"""Exact substring dedup: runs of words that an earlier document has, found by super-k-mers.

A window is `window` consecutive words. Windows in a row that share their minimiser (the run of SEED words with the
least hash inside) form a super-k-mer. First only minimiser hashes travel: a window can be in two documents only if
its minimiser is. Super-k-mers whose minimiser more than one document has are then packed as strings and sent to the
minimiser's bucket, each distinct string once a task with its smallest and largest document. There windows are
sorted and compared word by word, and every string gets the smallest document of each of its windows. Places of
super-k-mers join these answers and say which words an earlier document has. A minimiser of more than HOT super-k-mers
(those at the edges of a very common passage differ by document) has no bucket: its windows meet by 128-bit BLAKE2 digests of
their words, as strings do when answers come back, which spreads them over all tasks.

Documents are ordered by doc_id. Null and empty texts have no words. Rows that share an id count as one document: neither
takes words from the other. Rows without an id neither give nor lose words. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.scratch import drop, settled
from lodeworks.llm.textkit import hash_grams, hash_words, mix, slices, tidy, words_of

WINDOW = 50
SEED = 8
BUCKET_KMERS = 40_000  # super-k-mers a bucket is planned for
HOT = 20_000  # super-k-mers of one minimiser that may share a bucket
SINGLES = 8192  # windows whose strings are held at once


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def super_kmers(column: pa.Array, window: int, seed: int) -> tuple:
    """Words, and per super-k-mer: text, first window (as a word place in all texts), windows, minimiser hash."""
    words = words_of(column)
    n = len(words.start) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return words, empty, empty, empty, np.zeros(0, np.uint64)
    seeds = hash_grams(hash_words(words), seed)
    least = _least(seeds, window - seed + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    whole = np.flatnonzero(text[:n] == text[window - 1 :])
    if not len(whole):
        return words, empty, empty, empty, np.zeros(0, np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(whole) > 1) | (least[whole[1:]] != least[whole[:-1]]) | (text[whole[1:]] != text[whole[:-1]])]))
    return words, text[whole[cut]], whole[cut], np.diff(cut, append=len(whole)), least[whole[cut]]


def _strings(words, first: np.ndarray, count: np.ndarray, window: int) -> list[bytes]:
    """The words of each super-k-mer, joined by one space."""
    raw = words.data.tobytes()
    starts, ends = words.start[first], words.end[first + count + window - 2]
    single = np.concatenate([[0], np.cumsum(words.start[1:] - words.end[:-1] != 1)])  # odd gaps before each word
    single += np.concatenate([[0], np.cumsum(words.data[words.end[:-1]] != 32)])
    plain = single[first + count + window - 2] == single[first]
    return [raw[a:b] if ok else b" ".join(raw[a:b].split()) for a, b, ok in zip(starts.tolist(), ends.tolist(), plain.tolist(), strict=True)]


def _places(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(h, doc_id, tk, at, windows): every super-k-mer of every row by its minimiser hash; tk tells texts of an id apart."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, text, first, count, least = super_kmers(part.column(2), window, seed)
                rows = pa.array(text)
                columns = [pa.array(least.view(np.int64)), part.column(0).take(rows), part.column(1).take(rows), pa.array((first - words.first[text]).astype(np.int32)), pa.array(count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "tk", "at", "windows"])

    return docs.mapInArrow(work, "h long, doc_id long, tk long, at int, windows int")


def _key(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=16).digest()


def smallest_documents(strings: list[bytes], least: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, the smallest document of each of its windows over all strings, by sorting windows."""
    numbers: dict[bytes, int] = {}
    parts = [[numbers.setdefault(w, len(numbers)) for w in s.split()] for s in strings]
    sizes = np.array([len(p) for p in parts], np.int64)
    coded = np.concatenate([np.array(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    counts = sizes - window + 1
    place = np.arange(counts.sum()) + np.repeat(starts[:-1] - (np.cumsum(counts) - counts), counts)
    document = np.repeat(least, counts)
    hashes = hash_grams(mix(coded.astype(np.uint64) + np.uint64(1)), window)[place]
    order = np.lexsort((document, hashes))
    same = hashes[order[1:]] == hashes[order[:-1]]
    for k in range(window):  # equal hashes are told apart by the words themselves
        at = np.flatnonzero(same)
        if not len(at):
            break
        same[at] = coded[place[order[at + 1]] + k] == coded[place[order[at]] + k]
    clash = np.flatnonzero(~same & (hashes[order[1:]] == hashes[order[:-1]]))
    if len(clash):  # different windows with one hash: compare all of that hash's windows exactly
        best: dict[bytes, int] = {}
        keys = [coded[p : p + window].tobytes() for p in place.tolist()]
        for key, d in zip(keys, document.tolist(), strict=True):
            best[key] = min(d, best.get(key, d))
        out = np.array([best[k] for k in keys], np.int64)
    else:
        group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else group
        out = np.empty(len(order), np.int64)
        out[order] = document[order][heads][group]
    return np.split(out, np.cumsum(counts)[:-1]) if parts else []


def _pack(strings: dict[bytes, list[int]]) -> bytes:
    names = list(strings)
    text = b"\n".join(names)
    bounds = np.array(list(strings.values()), "<i8").tobytes()
    return len(names).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(bounds + text)


def _unpack(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[8:])
    return raw[16 * n :].split(b"\n"), np.frombuffer(raw, "<i8", 2 * n).reshape(n, 2)


def covered(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, tk, starts): first words of the windows that an earlier document has; only rows that have one."""
    known = docs.filter("doc_id IS NOT NULL")
    places = settled(_places(known, window, seed), "places")
    shared = places.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high")
    shared = settled(shared, "shared")
    total, most = shared.agg(F.sum("n"), F.max("n")).first()
    buckets = max(1, int(total or 0) // BUCKET_KMERS)
    hit = places.join(shared.select("h", (F.col("n") > HOT).alias("hot")), "h")
    wanted = hit.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "at", "windows", "hot")).alias("own"))
    texts = docs.join(wanted, ["doc_id", "tk"])  # a repeated row has its places as often as it is repeated
    columns = texts.select("doc_id", "tk", "text", "own")

    def listed(part: pa.RecordBatch, wants_hot: bool) -> tuple:
        """Words of a slice of rows and, per super-k-mer of the wanted kind: its row, hash, first word and windows."""
        words, own = words_of(part.column(2)), part.column(3)
        at, flat = own.value_lengths().to_numpy(), own.flatten()
        h, first, count = (flat.field(k).to_numpy() for k in range(3))
        row = np.repeat(np.arange(part.num_rows), at)
        _, once = np.unique(row * (1 << 32) + first, return_index=True)  # rows that are repeated have theirs repeated
        once = once[flat.field(3).to_numpy(zero_copy_only=False)[once] == wants_hot]
        return words, row[once], h[once], first[once], count[once]

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Per slice of rows, an entry for each of their super-k-mers: doc_id, tk, hash, first word, string."""
        for part in slices(batch):
            words, row, h, first, count = listed(part, False)
            strings = _strings(words, first + words.first[row], count.astype(np.int64), window)
            yield part.column(0).to_numpy()[row], part.column(1).to_numpy()[row], h, first, strings

    @tidy
    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of super-k-mers of hot minimisers by itself, with a digest of its words."""
        for batch in batches:
            for part in slices(batch):
                words, row, _, first, count = listed(part, True)
                of, start = np.repeat(row, count), np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                for a in range(0, len(of), SINGLES):
                    rows, place = of[a : a + SINGLES], start[a : a + SINGLES]
                    keys = [_key(s) for s in _strings(words, place + words.first[rows], np.ones(len(rows), np.int64), window)]
                    columns = [pa.array(keys, pa.binary()), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(place.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "tk", "at"])

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list[int]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for bucket in sorted(held):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([_pack(held[bucket])], pa.binary())], ["bucket", "blob"])
            held.clear()

        for batch in batches:
            for docs_of, _, h, _, strings in cut(batch):
                for doc, bucket, string in zip(docs_of.tolist(), (h % buckets).tolist(), strings, strict=True):
                    mine = held.setdefault(bucket, {})
                    bounds = mine.get(string)
                    if bounds is None:
                        mine[string] = [doc, doc]
                        size += len(string) + 200
                    else:
                        bounds[0], bounds[1] = min(bounds[0], doc), max(bounds[1], doc)
                if size > 96 << 20:
                    yield from out()
                    size = 0
        yield from out()

    def answer(table: pa.Table) -> pa.Table:
        bounds: dict[bytes, list[int]] = {}
        for blob in table.column("blob"):
            names, own = _unpack(blob.as_py())
            for name, (low, high) in zip(names, own.tolist(), strict=True):
                mine = bounds.setdefault(name, [low, high])
                mine[0], mine[1] = min(mine[0], low), max(mine[1], high)
        names = list(bounds)
        limits = np.array(list(bounds.values()), np.int64).reshape(-1, 2)
        least = smallest_documents(names, limits[:, 0], window)
        keep = [k for k, x in enumerate(least) if (x < limits[k, 1]).any()]
        return pa.table([pa.array([_key(names[k]) for k in keep], pa.binary()), pa.array([least[k] for k in keep], pa.list_(pa.int64()))], ["key", "least"])

    @tidy
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_of, tks, _, first, strings in cut(batch):
                keys = pa.array([_key(s) for s in strings], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array(docs_of), pa.array(tks), pa.array(first, pa.int32())], ["key", "doc_id", "tk", "at"])

    answers = columns.mapInArrow(send, "bucket long, blob binary").groupBy("bucket").applyInArrow(answer, "key binary, least array<long>")
    found = columns.mapInArrow(keyed, "key binary, doc_id long, tk long, at int").join(answers, "key")
    # Of each place: the windows whose smallest document comes before this one.
    indexed = F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), i + F.col("at")))
    found = found.select("doc_id", "tk", F.array_compact(indexed).alias("starts")).filter(F.size("starts") > 0)
    if (most or 0) > HOT:
        windows = settled(columns.mapInArrow(single, "key binary, doc_id long, tk long, at int"), "windows")
        first = settled(windows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "firsts")
        later = windows.join(first, "key").filter("least < doc_id").groupBy("doc_id", "tk").agg(F.collect_list(F.col("at").cast("long")).alias("starts"))
        found = found.unionByName(settled(later, "later"))
        drop(windows, first)
    return found.groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs(doc_id, text); kept: words left, joined by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    hits = covered(rows, window, seed)

    def left(text: pa.Scalar, starts: pa.Scalar) -> tuple[int, int, bytes]:
        """Words, words removed and what is kept of one text."""
        words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
        if not starts.is_valid:
            return len(words), 0, b" ".join(words)
        change = np.zeros(len(words) + 1, np.int64)
        at = np.unique(starts.values.to_numpy())
        change[at] += 1
        change[at + window] -= 1
        stays = np.cumsum(change[:-1]) == 0
        return len(words), len(words) - int(stays.sum()), b" ".join([words[k] for k in np.flatnonzero(stays).tolist()])

    @tidy
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                total, removed, kept = zip(*map(left, part.column(1), part.column(2)), strict=True)
                columns = [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(hits, ["doc_id", "tk"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")
