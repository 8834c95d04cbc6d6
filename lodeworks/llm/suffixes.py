"""Exact substring dedup over bytes by a distributed sparse suffix array.

Every string of `window` bytes holds an anchor: the run of SEED bytes with the least hash inside. Only suffixes that begin at
anchors are sorted, one of some 36; windows in a row with one anchor travel with it as one string, so an anchor's suffix brings
what stands before it, too. (All suffixes with `window` bytes each would be a hundred times the input.)

1. Texts are packed in pieces of a few MB, written once. Anchor hashes of a piece travel by hash range; only anchors that occur
   twice go on.
2. Strings of those are cut, each once a piece with its earliest place. Sampled splitters of their leading bytes, those of the
   seed, deal them out by range, many pieces' strings at once: a piece alone would have a few strings for each of many ranges, and
   the parts to send would grow with the square of the input. A bucket sorts its suffixes by multikey quicksort, eight bytes a
   step, and gives every window its earliest place.
3. An anchor of more than `hot` places would bring its whole neighbourhood to one bucket: its windows go alone. Their own hashes
   are exchanged as in 1, those that occur twice are dealt out by all their bytes. A string that more than one splitter names
   fills several buckets, and what these found first is compared across their boundaries.
4. Pieces get a bit a window back, no text, and drop the bytes that are covered.

Strings are told apart by their bytes alone; hashes only choose anchors and say which can't occur twice. (Two seeds of one window
that share a 64-bit hash could hide a repeat.) Places are ordered by doc_id, then byte. Matches never cross texts. Null and
empty texts have no bytes. Rows that share an id count as one document whose texts begin at the same place, so equal rows don't
take from each other. Rows without an id neither give nor lose bytes. An empty table has no rows; texts of any length are read
whole, in segments. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.scratch import drop, settled
from lodeworks.llm.textkit import mix, tidy

WINDOW = 100
SEED = 32
PIECE_BYTES = 4 << 20
SEGMENT = 2 << 20  # windows of a long text that are hashed at once
BUCKET_KEYS = 1 << 20  # hashes an exchange bucket is planned for
BUCKET_STRINGS = 50_000  # strings a range is planned for
SENT_BYTES = 48 << 20  # of strings that are dealt out to ranges at once
HOT_WINDOWS = 1 << 20  # windows of hot anchors that are told apart at once
SPLITTERS = 1 << 20  # of 32 or `window` bytes each, sent to every worker; with more strings ranges grow
SAMPLES_EACH = 4  # samples taken for each splitter
HOT = 1024

_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _pack(*parts) -> bytes:
    """Arrays go as their kind and bytes: pickled, each takes a hundred bytes more."""
    flat = [(p.dtype.str, p.tobytes()) if isinstance(p, np.ndarray) else p for p in parts]
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(flat, 5))


def _unpack(blob: bytes) -> tuple:
    flat = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301  our own blobs of this run
    return tuple(np.frombuffer(p[1], p[0]) if isinstance(p, tuple) else p for p in flat)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Integers that are not negative in as few bytes as they need."""
    return values.astype(np.min_scalar_type(int(values.max()))) if len(values) and values.min() >= 0 else values


def _pack_strings(strings: list[bytes], *numbers: np.ndarray) -> bytes:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return _pack(b"".join(strings), *map(_narrow, (sizes, *numbers)))


def _unpack_strings(blob: bytes) -> tuple:
    raw, *numbers = _unpack(blob)
    sizes, *numbers = (n.astype(np.int64) for n in numbers)
    ends = np.cumsum(sizes)
    return [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], *numbers


def _runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for `count` values of each."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _extreme(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """Least or greatest of each run of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = of(out[: len(out) - step], out[step:])
        have += step
    return out


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each run of `seed` bytes, a multiple of eight."""
    n = len(data) - seed + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    out = np.zeros(n, np.uint64)
    for k in range(seed // 8):
        out += eight[8 * k : 8 * k + n] * (_FACTORS[k % 4] + np.uint64(2 * (k // 4)))
    return mix(out)


def window_hashes(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """64-bit hash of each window, from the hashes of seeds that cover it."""
    n = len(hashes) - (window - seed)
    out = np.zeros(max(n, 0), np.uint64)
    for k, at in enumerate([*range(0, window - seed, seed), window - seed]):
        out += hashes[at : at + len(out)] * (_FACTORS[k % 4] + np.uint64(2 * (k // 4)))
    return mix(out)


class Anchors(NamedTuple):
    """Strings of windows in a row with one anchor hash, and the distinct hashes with their places."""

    first: np.ndarray  # first window, a byte of the piece
    count: np.ndarray  # windows
    hash: np.ndarray
    lead: np.ndarray  # where in the string the anchor begins
    keys: np.ndarray  # distinct hashes, sorted
    times: np.ndarray  # anchors of each, 255 at most


def anchors(data: np.ndarray, sizes: np.ndarray, known: np.ndarray, window: int, seed: int, segment: int = SEGMENT) -> Anchors:
    """Of texts that stand in data one after another; known: rows that take part."""
    first, count, held, lead, places = [], [], [], [], []
    ends = np.cumsum(sizes)
    total, span = int(ends[-1]) if len(ends) else 0, window - seed + 1
    for a in range(0, total - window + 1, segment):
        part = data[a : min(total, a + segment + window - 1)]
        hashes = seed_hashes(part, seed)
        least = _extreme(hashes, span, np.minimum)
        row = np.searchsorted(ends, np.arange(a, a + len(part)), "right")
        ok = np.flatnonzero((row[: len(least)] == row[window - 1 :]) & known[row[: len(least)]])
        if not len(ok):
            continue
        new = (np.diff(ok) > 1) | (least[ok[1:]] != least[ok[:-1]]) | (row[ok[1:]] != row[ok[:-1]])
        cut = np.flatnonzero(np.concatenate([[True], new]))
        start = ok[cut]
        # A seed is an anchor if it is the least one of some window, so if the greatest of the least ones around it is its own.
        usable = np.zeros(len(least), np.uint64)
        usable[ok] = least[ok]
        around = _extreme(np.concatenate([np.zeros(span - 1, np.uint64), usable, np.zeros(span - 1, np.uint64)]), span, np.maximum)
        places.append(hashes[np.flatnonzero(around == hashes)])
        at = np.empty(len(start), np.int64)
        for k in range(0, len(start), 1 << 14):
            some = start[k : k + (1 << 14)]
            at[k : k + len(some)] = hashes[some[:, None] + np.arange(span)].argmin(axis=1)
        first.append(start + a), count.append(np.diff(cut, append=len(ok))), held.append(least[start]), lead.append(at)
    if not first:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    keys, times = np.unique(np.concatenate(places), return_counts=True)
    return Anchors(*(np.concatenate(x) for x in (first, count, held, lead)), keys, np.minimum(times, 255).astype(np.uint8))


def sort_suffixes(text: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first `width` bytes, and for each in that order the number of its group of equal ones.

    Multikey quicksort with eight bytes as a character: what is still together after some characters is sorted by the next.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))
    order, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    live = np.arange(len(start))
    for depth in range(0, width if len(live) else 0, 8):
        key = eight[start[order[live]] + depth].astype(np.uint64)
        if width - depth < 8:
            key >>= np.uint64(8 * (8 - width + depth))
        by = np.lexsort((key, group[live]))
        order[live], key, own = order[live][by], key[by], group[live]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
        # A group is numbered by the place of its first suffix, so the groups around it keep their numbers.
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        live = live[~(new & np.concatenate([new[1:], [True]]))]
        if not len(live):
            break
    return order, group


def first_places(strings: list[bytes], lead: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int, seed: int) -> list[np.ndarray]:
    """Distinct strings with their earliest places; for each, which of its windows stand nowhere earlier.

    Strings are sorted by their suffixes from the anchor on. Only those that share their seed with another one, or hold it twice,
    can share windows: their windows are sorted as suffixes of their own.
    """
    counts = np.array([len(s) for s in strings], np.int64) - window + 1
    out = [np.ones(n, bool) for n in counts.tolist()]
    text = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(counts + window - 1) - (counts + window - 1)
    order, group = sort_suffixes(text, begin + lead, seed)
    same = np.zeros(len(strings), bool)
    if len(order):
        equal = group[1:] == group[:-1]
        same[order[1:][equal]] = same[order[:-1][equal]] = True
    twice = [k for k, s in enumerate(strings) if not same[k] and counts[k] > 1 and s.find(s[lead[k] : lead[k] + seed], lead[k] + 1) >= 0]
    same[twice] = True
    mine = np.flatnonzero(same)
    if not len(mine):
        return out
    n = counts[mine]
    of, offset = np.repeat(mine, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, group = sort_suffixes(text, begin[of] + offset, window)
    docs, starts = doc[of][order], (start[of] + offset)[order]
    earliest = np.lexsort((starts, docs, group))
    heads = np.concatenate([[True], np.diff(group[earliest]) > 0])
    head = earliest[np.maximum.accumulate(np.where(heads, np.arange(len(heads)), 0))]
    first = np.empty(len(order), bool)
    first[order[earliest]] = (docs[earliest] == docs[head]) & (starts[earliest] == starts[head])
    for k, bits in zip(mine.tolist(), np.split(first, np.cumsum(n)[:-1]), strict=True):
        out[k] = bits
    return out


class Units(NamedTuple):
    """Distinct strings of a piece by their earliest places, and where they stand."""

    strings: list[bytes]
    lead: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    seen: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # of each place: first byte, windows, string, whether it is the earliest


def units_of(raw: bytes, at: np.ndarray, place: np.ndarray, count: np.ndarray, lead: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> Units:
    """at: where the strings stand in raw; place: in the piece."""
    order = np.lexsort((start, doc))
    strings = (raw[a:b] for a, b in zip(at[order].tolist(), (at + count + window - 1)[order].tolist(), strict=True))
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(s, len(numbers)) for s in strings], np.int64)
    _, head = np.unique(number, return_index=True)
    head = order[head]  # the earliest place of each string, in the order of their numbers
    of = np.empty(len(at), np.int64)
    of[order] = number
    own = (doc == doc[head][of]) & (start == start[head][of]) if len(at) else np.zeros(0, bool)
    return Units(list(numbers), lead[head], doc[head], start[head], (place, count, of, own))


PIECES = "piece long, ids array<long>, sizes array<long>, n_bytes long, text binary"


def pieces_of(docs: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """docs(doc_id, text) in rows of a few MB of text, compressed; a longer text is a row of its own."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            values = [[number], [ids], [[len(t) for t in texts]], [size], [text]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["piece", "ids", "sizes", "n_bytes", "text"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if ids and size + len(raw) > piece_bytes:
                    yield out()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i), texts.append(raw)
                size += len(raw)
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(pack, PIECES)


class Piece(NamedTuple):
    data: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, k: int) -> Piece:
        """Row k of a batch whose first columns are ids, sizes and text after the piece's number."""
        ids = batch.column(1)[k].values
        sizes = batch.column(2)[k].values.to_numpy().astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(batch.column(3)[k].as_buffer().to_pybytes(), max_output_size=max(1, int(sizes.sum())))
        known = ~ids.is_null().to_numpy(zero_copy_only=False)
        return cls(np.frombuffer(raw, np.uint8), ids.fill_null(0).to_numpy(), sizes, known)


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where each bucket's hashes stand. They are mixed anew: anchors are the least hashes around, most of them in the lowest ranges."""
    own = ((mix(keys.copy()) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order], prepend=-1, append=buckets)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(own[order[a]]), order[a:b]


EXCHANGE = "bucket long, owner long, blob binary"
#: An owner of strings is a piece and a number: 0, or from 1 on that of a part of its windows of hot anchors.
PART_BITS = 16
PARTS = (1 << PART_BITS) - 1


def _hash_rows(owner: int, keys: np.ndarray, times: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for bucket, part in _by_bucket(keys, buckets):
        yield bucket, owner, _pack(keys[part], times[part])


def exchange(hashes: DataFrame, hot: int) -> DataFrame:
    """(owner, bucket, n, codes): of each hash that an owner sent, whether it stands nowhere else (0), somewhere (1), in over `hot` places (2)."""

    def judge(table: pa.Table) -> pa.Table:
        owners, blobs = table.column("owner").to_pylist(), [_unpack(b.as_py()) for b in table.column("blob")]
        keys, times = (np.concatenate([b[k] for b in blobs]) for k in range(2))
        distinct, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, times, len(distinct))
        code = ((total > 1).astype(np.uint8) + (total > hot))[of]
        parts = np.split(code, np.cumsum([len(b[0]) for b in blobs])[:-1])
        bucket = table.column("bucket")[0].as_py()
        rows = [(o, bucket, int((c > 0).sum()), _pack(c)) for o, c in zip(owners, parts, strict=True) if c.any()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["owner", "bucket", "n", "codes"])

    return hashes.groupBy("bucket").applyInArrow(judge, "owner long, bucket long, n long, codes binary")


def _codes(keys: np.ndarray, buckets: int, replies: pa.Scalar) -> np.ndarray:
    """Codes of sorted hashes from the exchange's replies (bucket, codes)."""
    out = np.zeros(len(keys), np.uint8)
    held = {r["bucket"]: r["codes"] for r in replies.as_py()}
    for bucket, part in _by_bucket(keys, buckets):
        if bucket in held:
            out[part] = _unpack(held[bucket])[0]
    return out


CUTS = "kind string, owner long, bucket long, blob binary, sample array<binary>"


def _cut(kind: str, owner: int, blob: bytes, bucket: int = 0, sample: list[bytes] | None = None) -> pa.RecordBatch:
    values = [[kind], [owner], [bucket], [blob], [sample]]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["kind", "owner", "bucket", "blob", "sample"])


def _run(owner: int, units: Units, rate: float, width: int) -> Iterator[pa.RecordBatch]:
    """A piece's strings with samples of their keys, `width` bytes each, and the places of the strings."""
    if units.strings:
        lot = mix(np.arange(len(units.strings), dtype=np.uint64) + np.uint64(owner * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        chosen = np.flatnonzero(lot < np.uint64(min(rate, 1.0) * (2**64 - 2**12)))
        sample = [units.strings[k][a : a + width] for k, a in zip(chosen.tolist(), units.lead[chosen].tolist(), strict=True)]
        yield _cut("run", owner, _pack_strings(units.strings, units.lead, units.doc, units.start), sample=sample)
        yield _cut("seen", owner, _pack(*map(_narrow, units.seen[:3]), units.seen[3]))


def _place(piece: Piece, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and byte of places in a piece."""
    ends = np.cumsum(piece.sizes)
    row = np.searchsorted(ends, at, "right")
    return piece.ids[row], at - (ends - piece.sizes)[row]


def _spread(keys: list[bytes], owner: int, splitters: list[bytes]) -> np.ndarray:
    """Ranges of keys; a hot one that several splitters name is dealt out among the ranges that it fills."""
    high = [bisect_right(splitters, k) for k in keys]
    if not owner & PARTS:
        return np.array(high, np.int64)
    low = [bisect_left(splitters, k) for k in keys]
    return np.array([h if h - a < 2 else a + 1 + (owner >> PART_BITS) % (h - a) for a, h in zip(low, high, strict=True)], np.int64)


REPLY = "sender long, blob binary, claims array<struct<owner:long,unit:long,key:binary,doc:long,start:long>>"


def _dealt(runs: list[tuple[int, tuple]], splitters: list[bytes], window: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The strings of some owners by range; a part knows of each string whose it is, and its number there."""
    owners = np.array([r[0] for r in runs], np.int64)
    strings = [s for r in runs for s in r[1][0]]
    lead, doc, start = (np.concatenate([r[1][k] for r in runs]) for k in (1, 2, 3))
    of = np.repeat(np.arange(len(runs)), [len(r[1][0]) for r in runs])
    unit = np.concatenate([np.arange(len(r[1][0])) for r in runs])
    own = []
    for owner, (names, leads, *_) in runs:
        keys = [s[a : a + (window if owner & PARTS else seed)] for s, a in zip(names, leads.tolist(), strict=True)]
        own.append(_spread(keys, owner, splitters))
    own = np.concatenate(own)
    order = np.argsort(own, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
        near, mine = np.unique(of[part], return_inverse=True)
        packed = _pack_strings([strings[k] for k in part.tolist()], lead[part], doc[part], start[part], unit[part], mine, owners[near])
        yield pa.RecordBatch.from_arrays([pa.array([int(own[part[0]])], pa.int64()), pa.array([int(owners[0])], pa.int64()), pa.array([packed], pa.binary())], ["bucket", "owner", "blob"])


def _sorted_buckets(runs: DataFrame, splitters: list[bytes], window: int, seed: int, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Replies to those who sent the strings of runs(owner, blob): for each string a bit a window, set where nothing stands earlier."""
    heavy = {a for a, b in zip(splitters[:-1], splitters[1:], strict=True) if a == b}

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for owner, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((owner, _unpack_strings(blob.as_py())))
                size += sum(map(len, held[-1][1][0]))
                if size >= sent_bytes:
                    yield from _dealt(held, splitters, window, seed)
                    held, size = [], 0
        if held:
            yield from _dealt(held, splitters, window, seed)

    def answer(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        slices, lead, doc, start = [], [], [], []
        for sender, blob in zip(table.column("owner").to_pylist(), table.column("blob"), strict=True):
            strings, leads, docs, starts, units, whose, owners = _unpack_strings(blob.as_py())
            slices.append((sender, units, owners[whose], np.array([numbers.setdefault(s, len(numbers)) for s in strings], np.int64)))
            lead.append(leads), doc.append(docs), start.append(starts)
        names = list(numbers)
        of = np.concatenate([s[3] for s in slices])
        lead, doc, start = (np.concatenate(x) for x in (lead, doc, start))
        order = np.lexsort((start, doc, of))
        head = order[np.concatenate([[True], np.diff(of[order]) > 0])]  # the earliest place of each string
        own = (doc == doc[head][of]) & (start == start[head][of])
        first = first_places(names, lead[head], doc[head], start[head], window, seed)
        counts = np.fromiter(map(len, first), np.int64, len(first))
        rows, done = [], 0
        for sender, units, owners, mine in slices:
            wins = own[done : done + len(mine)]
            bits = [first[k] if w else np.zeros(len(first[k]), bool) for k, w in zip(mine.tolist(), wins.tolist(), strict=True)]
            claims = []
            if heavy:
                claims = [
                    {"owner": int(owners[k]), "unit": int(units[k]), "key": names[mine[k]], "doc": int(doc[done + k]), "start": int(start[done + k])}
                    for k in np.flatnonzero(wins & (owners & PARTS > 0)).tolist() if names[mine[k]] in heavy
                ]
            near, whose = np.unique(owners, return_inverse=True)
            rows.append((sender, _pack(np.packbits(np.concatenate(bits)), *map(_narrow, (near, whose, units, counts[mine]))), claims))
            done += len(mine)
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("owner", pa.int64()), ("unit", pa.int64()), ("key", pa.binary()), ("doc", pa.int64()), ("start", pa.int64())]))]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["sender", "blob", "claims"])

    return runs.mapInArrow(send, EXCHANGE).groupBy("bucket").applyInArrow(answer, REPLY)


def _by_owner(replies: DataFrame) -> DataFrame:
    """(owner, bits): of each owner's strings, by their numbers, the bits that all ranges gave its sender."""

    def work(table: pa.Table) -> pa.Table:
        bits, owner, unit, count = [], [], [], []
        for blob in table.column("blob"):
            packed, near, whose, units, counts = _unpack(blob.as_py())
            owner.append(near.astype(np.int64)[whose]), unit.append(units.astype(np.int64)), count.append(counts.astype(np.int64))
            bits.append(np.unpackbits(packed, count=int(count[-1].sum())).astype(bool))
        bits, owner, unit, count = map(np.concatenate, (bits, owner, unit, count))
        begin = np.cumsum(count) - count
        rows = []
        for o in np.unique(owner).tolist():
            mine = np.flatnonzero(owner == o)
            mine = mine[np.argsort(unit[mine])]
            rows.append((o, _pack(np.packbits(bits[_runs(begin[mine], count[mine])]))))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], ["owner", "bits"])

    return replies.select("sender", "blob").groupBy("sender").applyInArrow(work, "owner long, bits binary")


def _boundaries(replies: DataFrame) -> DataFrame:
    """(owner, lost): strings that fill several buckets are first in one of them only; lost: those that another bucket has earlier."""
    claims = replies.select(F.explode("claims").alias("c")).select("c.*")
    place = F.struct("doc", "start")
    first = claims.groupBy("key").agg(F.min(place).alias("first"))
    late = claims.join(first, "key").filter(place != F.col("first"))
    return late.groupBy("owner").agg(F.collect_set("unit").alias("lost"))


def _splitters(cuts: list[DataFrame], ranges: int) -> list[bytes]:
    """Keys that part all sampled keys in as many ranges."""
    if ranges < 2:
        return []
    keys = sorted(bytes(r.k) for c in cuts for r in c.filter("kind = 'run'").select(F.explode("sample").alias("k")).toLocalIterator())
    return [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []


def without_repeats(
    docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, piece_bytes: int = PIECE_BYTES, bucket_strings: int = BUCKET_STRINGS,
    sent_bytes: int = SENT_BYTES, hot_windows: int = HOT_WINDOWS,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, removed, kept) for each row of docs(doc_id, text); kept: the bytes that are left."""
    if seed % 8 or not 8 <= seed <= window:
        raise ValueError("seed has to be a multiple of 8, at most window")
    pieces = settled(pieces_of(docs, piece_bytes), "pieces")

    def ranges(strings: int) -> int:
        return min(SPLITTERS, -(-strings // bucket_strings))

    def rate(strings: int) -> float:
        return SAMPLES_EACH * ranges(strings) / max(1, strings)

    size = pieces.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, 2 * size // (window - seed + 2) // BUCKET_KEYS)

    @tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, owner in enumerate(batch.column(0).to_pylist()):
                p = Piece.of(batch, k)
                a = anchors(p.data, p.sizes, p.known, window, seed)
                for row in _hash_rows(owner, a.keys, a.times, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "owner", "blob"])

    texts = pieces.select("piece", "ids", "sizes", "text")
    found = settled(exchange(texts.mapInArrow(hashed, EXCHANGE), hot), "anchors")
    total = found.agg(F.sum("n")).first()[0] or 0
    share = rate(total)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, owner in enumerate(batch.column(0).to_pylist()):
                p = Piece.of(batch, k)
                a = anchors(p.data, p.sizes, p.known, window, seed)
                code = _codes(a.keys, buckets, batch.column(4)[k])[np.searchsorted(a.keys, a.hash)]
                doc, start = _place(p, a.first)
                mine, raw = np.flatnonzero(code == 1), p.data.tobytes()
                units = units_of(raw, a.first[mine], a.first[mine], a.count[mine], a.lead[mine], doc[mine], start[mine], window)
                yield from _run(owner << PART_BITS, units, share, seed)
                every = np.flatnonzero(code == 2)
                cuts = np.flatnonzero(np.diff((np.cumsum(a.count[every]) - 1) // hot_windows)) + 1
                for part, mine in enumerate(np.split(every, cuts) if len(every) else [], 1):
                    own = owner << PART_BITS | part
                    strings = [raw[x:y] for x, y in zip(a.first[mine].tolist(), (a.first + a.count + window - 1)[mine].tolist(), strict=True)]
                    keys, times = np.unique(np.concatenate(_hot_windows(strings, window, seed)), return_counts=True)
                    for bucket, _, blob in _hash_rows(own, keys, np.minimum(times, 255).astype(np.uint8), buckets):
                        yield _cut("window", own, blob, bucket)
                    yield _cut("hot", own, _pack_strings(strings, a.first[mine], doc[mine], start[mine]))

    replies = found.groupBy(F.col("owner").alias("piece")).agg(F.collect_list(F.struct("bucket", "codes")).alias("replies"))
    cuts = settled(texts.join(replies, "piece").select("piece", "ids", "sizes", "text", "replies").mapInArrow(cut, CUTS), "cuts")
    drop(found)
    tables = [cuts]
    if cuts.filter("kind = 'hot'").limit(1).count():
        alone = settled(exchange(cuts.filter("kind = 'window'").select("bucket", "owner", "blob"), hot), "windows")
        single = alone.agg(F.sum("n")).first()[0] or 0
        tables.append(settled(_hot_runs(cuts, alone, buckets, rate(single), window, seed), "hot"))
        total += single
        drop(alone)
    splitters = _splitters(tables, ranges(total))
    kinds = [t.select("kind", "owner", "blob") for t in tables]
    every = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    answered = settled(_sorted_buckets(every.filter("kind = 'run'").select("owner", "blob"), splitters, window, seed, sent_bytes), "answers")
    piece = F.shiftright("owner", PART_BITS).alias("piece")
    seen = every.filter("kind = 'seen'").groupBy(piece).agg(F.collect_list(F.struct("owner", "blob")).alias("seen"))
    bits = _by_owner(answered).groupBy(piece).agg(F.collect_list(F.struct("owner", "bits")).alias("bits"))
    lost = _boundaries(answered).groupBy(piece).agg(F.collect_list(F.struct("owner", "lost")).alias("lost"))
    marks = settled(seen.join(bits, "piece").join(lost, "piece", "left"), "marks")
    drop(*tables, answered)
    joined = texts.join(marks, "piece", "left").select("piece", "ids", "sizes", "text", "seen", "bits", "lost")
    return joined.mapInArrow(tidy(lambda batches: _applied(batches, window)), RESULT)


def _hot_windows(strings: list[bytes], window: int, seed: int) -> list[np.ndarray]:
    """Hashes of the windows of each string."""
    return [window_hashes(seed_hashes(np.frombuffer(s, np.uint8), seed), window, seed) for s in strings]


def _hot_runs(cuts: DataFrame, alone: DataFrame, buckets: int, rate: float, window: int, seed: int) -> DataFrame:
    """Sorted runs of single windows of hot anchors that occur twice."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, owner in enumerate(batch.column(0).to_pylist()):
                strings, first, doc, start = _unpack_strings(batch.column(1)[k].as_py())
                hashes = _hot_windows(strings, window, seed)
                n = np.array([len(h) for h in hashes], np.int64)
                every = np.concatenate(hashes)
                keys = np.unique(every)
                twice = np.flatnonzero(_codes(keys, buckets, batch.column(2)[k])[np.searchsorted(keys, every)])
                of, offset = np.repeat(np.arange(len(n)), n)[twice], _runs(np.zeros(len(n), np.int64), n)[twice]
                sizes = n + window - 1
                at = (np.cumsum(sizes) - sizes)[of] + offset
                ones, zeros = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
                units = units_of(b"".join(strings), at, first[of] + offset, ones, zeros, doc[of], start[of] + offset, window)
                yield from _run(owner, units, rate, window)

    replies = alone.groupBy("owner").agg(F.collect_list(F.struct("bucket", "codes")).alias("replies"))
    return cuts.filter("kind = 'hot'").select("owner", "blob").join(replies, "owner").select("owner", "blob", "replies").mapInArrow(work, CUTS)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<start:long,end:long>>, kept binary"


def _covered(batch: pa.RecordBatch, k: int, size: int, window: int) -> np.ndarray:
    """Bytes of a piece that a covered window holds."""
    hit = np.zeros(size, bool)
    bits = {r["owner"]: _unpack(r["bits"])[0] for r in batch.column(5)[k].as_py() or []}
    lost = {r["owner"]: r["lost"] for r in batch.column(6)[k].as_py() or []}
    for r in batch.column(4)[k].as_py() or []:
        *places, own = _unpack(r["blob"])
        first, count, unit = (x.astype(np.int64) for x in places)
        windows = np.zeros(unit.max() + 1, np.int64)
        windows[unit] = count
        begin = np.cumsum(windows) - windows
        earliest = np.unpackbits(bits[r["owner"]], count=int(windows.sum())).astype(bool)
        earliest[begin[lost.get(r["owner"], [])]] = False
        for a in range(0, len(first), 1 << 14):
            some = slice(a, a + (1 << 14))
            at = _runs(first[some], count[some])
            hit[at[~(np.repeat(own[some], count[some]) & earliest[_runs(begin[unit[some]], count[some])])]] = True
    at = np.arange(size)
    return at - np.maximum.accumulate(np.where(hit, at, -window)) < window


def _applied(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            p = Piece.of(batch, k)
            gone = _covered(batch, k, len(p.data), window)
            rows = []
            for a, b in zip((np.cumsum(p.sizes) - p.sizes).tolist(), np.cumsum(p.sizes).tolist(), strict=True):
                mine = gone[a:b]
                edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                rows.append((b - a, int(mine.sum()), len(edges), [{"start": x, "end": y} for x, y in edges], p.data[a:b][~mine].tobytes() if edges else p.data[a:b].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1)[k].values, *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])
