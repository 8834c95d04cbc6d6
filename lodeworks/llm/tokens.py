"""Token ids as binary shards: Elias-Fano document boundaries over one concatenated id array.

A shard is one self-contained byte string: header, Elias-Fano coded document ids, Elias-Fano coded ends of documents
with select samples, then all ids in 16 or 32 bits. Shards are rows of a Parquet table in the shared folder, so any store
that Spark reads can hold them, a task that is run again replaces its own shard, and the write is committed as a whole.

Null texts count as empty (the end id alone). Rows with a null id come first. Rows that share an id keep one entry each,
ordered by their ids' CRC-32 and bytes. An empty input gives no shard. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.codes import Codes
from lodeworks.llm.scratch import new_path
from lodeworks.llm.textkit import LOWER, Words, hash_words, slices, tidy, words_of

SHARD_TOKENS = 1 << 20
SAMPLE = 256  # every so many ones of the upper bits have their place stored
CACHED_PIECES = 1 << 19
SLICE_BYTES = 1 << 20
MAX_BASES = 1_000_000  # rows of 24 bytes that may be broadcast; with more shards their starts are joined by a shuffle

# The part of a pre-tokenizer's pattern that makes runs of letters and of punctuation tokens of their own.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_HEADER = struct.Struct("<4sBxxxQQQQQ")
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True
_LETTER = np.zeros(256, bool)  # ASCII letters, and bytes of any other character
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(universe / n) bits each, with select.

    Besides the bits only the place of every SAMPLE-th one is kept, in 32 bits: the upper bits are fewer than 3n + 1.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n >= 1 << 30:
            raise ValueError("too many values for 32-bit places")
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = []
        for at in range(0, n if bits else 0, 1 << 16):  # multiples of 8 values end on whole bytes
            part = values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            low.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.concatenate(low) if low else np.zeros(0, np.uint8), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of raw, and the bytes it takes."""
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        low, high = np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, bits, low, high, np.frombuffer(raw, "<u4", c, at + a + b)), at + a + b + 4 * c

    def run(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: only the upper bits between the samples around them and their own lower bits are read."""
        if not 0 <= a <= b <= self.n:
            raise IndexError(a, b)
        if a == b:
            return np.zeros(0, np.uint64)
        first, after = a // SAMPLE, -(-b // SAMPLE)
        place = int(self.samples[first])
        stop = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[place >> 3 : (stop + 7) >> 3], bitorder="little")[place & 7 :]
        ones = np.flatnonzero(bits)[a - first * SAMPLE : b - first * SAMPLE] + place
        out = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = a * self.low_bits
            own = np.unpackbits(self.low[at >> 3 : (b * self.low_bits + 7) >> 3], bitorder="little")[at & 7 :]
            own = own[: (b - a) * self.low_bits].reshape(b - a, self.low_bits)
            for k in range(self.low_bits):
                out |= own[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.run(i, i + 1)[0])

    def values(self) -> np.ndarray:
        """The whole sequence."""
        return self.run(0, self.n)


class Shard:
    """Reads one shard: ids of document i are tokens(i); start(i) comes from the boundaries' select."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        magic, width, self.n_null, self.first, n_docs, n_tokens, at = _HEADER.unpack_from(view)
        if magic != b"LWT1":
            raise ValueError("not a shard")
        self.keys, size = EliasFano.from_bytes(view[_HEADER.size :])
        self.ends, _ = EliasFano.from_bytes(view[_HEADER.size + size :])
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", n_tokens, at)
        self.n_docs, self.n_tokens = n_docs, n_tokens

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
        """doc_ids ascending, nulls first; ids: packed little-endian, `width` bytes each."""
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        n_null = len(doc_ids) - len(known)
        first = int(known[0]) if len(known) else 0
        keys = EliasFano.encode(known.astype(np.uint64) - np.int64(first).astype(np.uint64)).to_bytes()
        ends = EliasFano.encode(np.cumsum([len(x) // width for x in ids], dtype=np.uint64)).to_bytes()
        body = b"".join(ids)
        at = _HEADER.size + len(keys) + len(ends)
        at += (pad := -at % 4)
        head = _HEADER.pack(b"LWT1", width, n_null, first % (1 << 64), len(doc_ids), len(body) // width, at)
        return head + keys + ends + bytes(pad) + body

    def doc_ids(self) -> list[int | None]:
        known = (self.keys.values() + np.uint64(self.first)).astype(np.int64)
        return [None] * self.n_null + known.tolist()

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a to b - 1 start, and where the last one ends, by the boundaries' select."""
        ends = self.ends.run(max(a - 1, 0), b).astype(np.int64)
        return ends if a else np.concatenate([[0], ends])

    def tokens(self, i: int) -> np.ndarray:
        start, end = self.bounds(i, i + 1).tolist()
        return self.ids[start:end]


class WordEncoder:
    """Token ids of whole texts through the tokenizers library, each distinct piece encoded once while it is remembered.

    Where the tokenizer's own settings show that it drops white space and makes runs of letters tokens of their own, a
    piece is a word, or its letters and its closing punctuation apart, in lower case if the tokenizer lower-cases; pieces
    are told apart by 64-bit hashes (among CACHED_PIECES of them two agree with a chance of 1e-8). With other settings each
    whole text is one call.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        settings = json.loads(self.tokenizer.to_str())
        steps = (settings["normalizer"] or {}).get("normalizers", [settings["normalizer"]] if settings["normalizer"] else [])
        self.lowers = any(x["type"] == "Lowercase" for x in steps)
        tame = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
        split, *rest = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        apart = split.get("pattern") == {"Regex": LETTERS_APART} and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        within = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest)
        fixed = all(t["special"] and not any(t[k] for k in ("normalized", "single_word", "lstrip", "rstrip")) and not any(map(str.isspace, t["content"])) for t in settings["added_tokens"])
        self.by_words = tame and apart and within and fixed and settings["truncation"] is None
        marks = settings["added_tokens"]
        self.mark = (marks[0]["content"], marks[0]["id"]) if marks else None
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        """Empties the memory of pieces."""
        self.codes = Codes()
        self.count = 1  # piece 0 has no ids
        self.whole = np.zeros(1 << 12, bool)  # letters by their bytes, but the word has to be encoded as a whole
        self.flat, self.ptr = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids."""
        if self.mark and not any(self.mark[0] in t for t in texts):  # one call; a special token parts the pieces
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(texts)], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(ids == self.mark[1])
            if len(at) == len(texts) - 1:
                return np.diff(at, prepend=-1, append=len(ids)) - 1, np.delete(ids, at)
        made = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([len(x) for x in made], np.int64), np.array([i for x in made for i in x], np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: bool) -> None:
        """Encodes data[start:end] for keys that are new."""
        keys, first = np.unique(keys, return_index=True)
        at = [(a, b) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in at]
        total = int(self.ptr[self.count])
        for k in range(0, len(texts), 1_000):
            part = texts[k : k + 1_000]
            sizes, ids = self._encode(part)
            self.ptr = _room(self.ptr, self.count + len(part) + 1)
            self.ptr[self.count + 1 : self.count + len(part) + 1] = total + np.cumsum(sizes)
            self.flat = _room(self.flat, total + len(ids))
            self.flat[total : total + len(ids)] = ids
            self.whole = _room(self.whole, self.count + len(part))
            self.whole[self.count : self.count + len(part)] = [letters and not t.isascii() and not (t.isalpha() and t.lower().isalpha()) for t in part]
            self.codes.add(keys[k : k + 1_000], np.arange(self.count, self.count + len(part), dtype=np.int32))
            self.count, total = self.count + len(part), total + len(ids)

    def _pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: bool = False) -> np.ndarray:
        """Code of each piece data[start:end]."""
        keys = hash_words(Words(data, start, end, start))
        keys[keys == 0] = 1
        out = self.codes.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            self._learn(keys[new], data, start[new], end[new], letters)
            out[new] = self.codes.find(keys[new])
        return out

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Of an Arrow column of texts: number of ids of each, the end id included, and all ids."""
        kind = ("<u2", "<u4")[self.width == 4]
        if not self.by_words:
            made = [x.ids for x in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.array([len(x) + 1 for x in made], np.int64), np.array([i for x in made for i in (*x, end_id)], kind)
        if self.count > CACHED_PIECES:
            self.forget()
        words = words_of(column)
        data, start, end = words.data, words.start, words.end
        core = end.copy()
        live = np.arange(len(end))
        while len(live):
            live = live[(core[live] > start[live]) & _CLOSING[data[core[live] - 1]]]
            core[live] -= 1
        letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
        plain = np.flatnonzero((core > start) & (letters[core] - letters[start] == core - start))
        low = LOWER[data] if self.lowers else data
        code = np.zeros((len(start), 2), np.int32)
        code[plain, 0] = self._pieces(low, start[plain], core[plain], True)
        apart = np.zeros(len(start), bool)
        apart[plain] = ~self.whole[code[plain, 0]]
        tails = np.flatnonzero(apart & (core < end))
        code[tails, 1] = self._pieces(data, core[tails], end[tails])
        rest = np.flatnonzero(~apart)
        code[rest, 0] = self._pieces(data, start[rest], end[rest])
        piece = code.ravel()
        size = self.ptr[piece + 1] - self.ptr[piece]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ptr[piece] - (ends - size), size)]
        bound = np.concatenate([[0], ends])[words.first * 2]
        return np.diff(bound) + 1, np.insert(ids.astype(kind), bound[1:], end_id)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """array with at least `size` places."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bounds: np.ndarray | None = None) -> DataFrame:
    """(part, doc_id, n_tokens, ids): packed token ids of every whole text with the end id.

    part: the range of ids, between ascending bounds, that a row belongs to. An id that is a bound several times fills
    several ranges, dealt out by the CRC-32 of its rows' ids.
    """
    ascending = np.zeros(0, np.int64) if bounds is None else bounds

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                sizes, ids = encoder.encode(part.column(1), end_id)
                at = np.concatenate([[0], np.cumsum(sizes)]) * encoder.width
                packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids.tobytes())])
                packed = packed.cast(pa.binary())
                keys = part.column(0).fill_null(-(2**63)).to_numpy()
                low, high = np.searchsorted(ascending, keys, "left"), np.searchsorted(ascending, keys, "right")
                for k in np.flatnonzero(high > low).tolist():
                    low[k] += (zlib.crc32(packed[k].as_buffer()) * int(high[k] - low[k] + 1)) >> 32
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), part.column(0), pa.array(sizes), packed], ["part", "doc_id", "n_tokens", "ids"])
        encoder.forget()  # the worker outlives the task

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "part int, doc_id long, n_tokens long, ids binary")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> str:
    """Tokenizes docs(doc_id, text) and writes them as shards in ascending doc_id order; returns the table's path.

    As many id ranges as docs has input partitions, of about equal rows, so that packed ids are moved once.
    """
    spark = docs.sparkSession
    ranges = max(1, docs.rdd.getNumPartitions())
    shares = [k / ranges for k in range(1, ranges)]
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    bounds = (docs.select(F.percentile_approx(key, shares, 100 * ranges)).first()[0] or []) if shares else []
    made = tokenize(docs, tokenizer, end_id, bounds=np.array(sorted(bounds), np.int64))
    ranged = made.repartitionById(ranges, F.col("part"))
    ranged = ranged.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), F.crc32("ids"), "ids")
    width = WordEncoder.of(tokenizer).width

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        ids: list[bytes] = []
        number = held = 0
        now = None

        def shard() -> pa.RecordBatch:
            nonlocal number, held
            row = [now, number, len(keys), held, Shard.pack(keys, ids, width)]
            number, held = number + 1, 0
            keys.clear(), ids.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "number", "n_docs", "n_tokens", "shard"])

        for batch in batches:
            for part, key, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if keys and (held + n > shard_tokens or part != now):
                    yield shard()
                if part != now:
                    now, number = part, 0
                keys.append(key)
                ids.append(raw.as_py())
                held += n
        if keys:
            yield shard()

    path = new_path(spark, "shards")
    made = ranged.mapInArrow(pack, "part int, number long, n_docs long, n_tokens long, shard binary")
    made.write.option("compression", "uncompressed").parquet(path)
    return path


def read_shards(spark, path: str) -> DataFrame:
    """The table of shards with `base`, the number of ids in the shards before.

    Sums run inside each range of ids, and over one row a range: as many as the input had partitions.
    """
    shards = spark.read.parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select(F.col("part").alias("of_part"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("parts_before"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("part", F.col("number").alias("of_number"), F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    bases = bases.join(parts, F.col("part") == F.col("of_part")).select("of_part", "of_number", (F.col("parts_before") + F.col("inside")).alias("base"))
    if shards.select("part").count() <= MAX_BASES:
        bases = F.broadcast(bases)
    return shards.join(bases, (F.col("part") == F.col("of_part")) & (F.col("number") == F.col("of_number"))).drop("of_part", "of_number")


def read_documents(spark, path: str) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens and the ids as packed 32-bit integers."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(raw.as_py())
                packed = pa.py_buffer(shard.ids.astype("<u4"))
                keys = shard.doc_ids()
                for a in range(0, len(keys), 4096):
                    b = min(a + 4096, len(keys))
                    at = shard.bounds(a, b)
                    own = packed.slice(4 * int(at[0]), 4 * int(at[-1] - at[0]))
                    ids = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(4 * (at - at[0])), own]).cast(pa.binary())
                    columns = [pa.array(keys[a:b], pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), ids]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return read_shards(spark, path).select("base", "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(df: DataFrame) -> DataFrame:
    """Adds ids_crc32, the unsigned CRC-32 of the packed ids."""
    return df.withColumn("ids_crc32", F.crc32("ids"))


def check(encoder: WordEncoder, texts: list[str | None], end_id: int) -> bool:
    """Whether word-wise encoding gives what one call on each whole text gives."""
    plain = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, end_id] for t in texts]
    sizes, ids = encoder.encode(pa.array(texts, pa.string()), end_id)
    return sizes.tolist() == [len(x) for x in plain] and ids.tolist() == [i for x in plain for i in x]
