"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Each source's documents, in a hashed order, form one stream of words, cut into blocks of equal size. Slot t of the mix
belongs to the source in whose share of [0, 1) the t-th van der Corput point lies; how many earlier slots the same source
has is known in closed form from the binary digits of t, so slots are ranked without a shuffle. The r-th slot of a source
takes its r-th block (a later epoch starts at another place of the stream), the last one is cut so that each source
gives exactly the whole words of its target.

Sources may be null (a source of its own). Null and empty texts have size 0 and are never taken. Repeated rows are rows
of their own. A source of size 0 has target 0; an empty input gives an empty mix. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.scratch import settled
from lodeworks.llm.textkit import WORD

BLOCK_WORDS = 2048
MAX_SOURCES = 1_000_000  # what one table of sources on the driver may hold; more is an error
ROWS_A_BUCKET = 1024
_BITS = 48


def fill(sizes: Sequence[float], weights: Sequence[float], share: float, repeat: float) -> np.ndarray:
    """share x all sizes dealt out by weight; no target above repeat x its size, the excess dealt out again."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    cap, free = repeat * sizes, np.ones(len(sizes), bool)
    targets = np.zeros(len(sizes))
    left = min(share * sizes.sum(), cap.sum())
    while free.any():
        targets[free] = left * weights[free] / weights[free].sum()
        above = free & (targets > cap)
        if not above.any():
            break
        targets[above] = cap[above]
        left -= cap[above].sum()
        free &= ~above
    return targets


def points(t: np.ndarray) -> np.ndarray:
    """Van der Corput points in base 2 as integers below 2**48."""
    t, out = t.astype(np.int64), np.zeros(len(t), np.int64)
    for k in range(_BITS):
        out |= (t >> k & 1) << (_BITS - 1 - k)
    return out


def earlier(t: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of the points 0..t-1 lie in [low, high): each binary digit of t stands for an evenly spaced run."""
    t, out = t.astype(np.int64), np.zeros(len(t), np.int64)
    for k in range(int(t.max()).bit_length() if len(t) else 0):
        shift = points(t >> (k + 1) << (k + 1))
        step = np.int64(_BITS - k)
        count = -((shift - high) >> step) + ((shift - low) >> step)
        out += np.where(t >> k & 1, count, 0)
    return out


class Plan(NamedTuple):
    sources: list  # code-point order, null last
    sizes: np.ndarray
    targets: np.ndarray
    block: int
    blocks: np.ndarray  # of each source's stream
    turn: np.ndarray  # first block of every second epoch
    needed: np.ndarray  # slots of each source
    bounds: np.ndarray  # shares of [0, 2**48)
    slots: int


def plan(sources: list, sizes: np.ndarray, targets: np.ndarray, block: int) -> Plan:
    whole = np.floor(targets + 1e-9).astype(np.int64)
    blocks = -(-sizes // block)
    turn = np.where(blocks > 0, blocks // 2, 0)
    needed = np.zeros(len(sizes), np.int64)
    for i, (size, want) in enumerate(zip(sizes, whole, strict=True)):
        if want and size:
            epochs, rest = divmod(int(want), int(size))
            needed[i] = epochs * blocks[i] + -(-(rest + block) // block) * (rest > 0)
    total = max(1, int(needed.sum()))
    bounds = np.array([int(c) * (1 << _BITS) // total for c in np.concatenate([[0], np.cumsum(needed)])], np.int64)
    used = needed > 0
    low, high, want = bounds[:-1][used], bounds[1:][used], needed[used]
    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), 16 * total + 16, np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        enough = earlier(mid, low, high) >= want
        lo, hi = np.where(enough, lo, mid + 1), np.where(enough, mid, hi)
    return Plan(sources, sizes, whole, block, blocks, turn, needed, bounds, int(hi.max()) if len(hi) else 0)


def slot_table(spark, p: Plan) -> DataFrame:
    """(slot, sid, epoch, block, take): which block each slot of the mix reads, and how many of its words."""
    schema = "slot long, sid long, epoch long, block long, take long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column(0).to_numpy()
            sid = np.searchsorted(p.bounds, points(t), "right") - 1
            rank = earlier(t, p.bounds[sid], p.bounds[sid + 1])
            keep = rank < p.needed[sid]
            t, sid, rank = t[keep], sid[keep], rank[keep]
            n, size = p.blocks[sid], p.sizes[sid]
            epoch, place = rank // n, rank % n
            turn = np.where(epoch % 2, p.turn[sid], 0)
            block = (place + turn) % n
            short = n * p.block - size  # what the stream's last block lacks
            before = epoch * size + place * p.block - np.where(place > (n - 1 - turn) % n, short, 0)
            own = p.block - np.where(block == n - 1, short, 0)
            take = np.clip(p.targets[sid] - before, 0, own)
            columns = [t, sid, epoch, block, take]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["slot", "sid", "epoch", "block", "take"])

    tasks = max(1, min(10_000, p.slots >> 16))
    return spark.range(0, p.slots, 1, tasks).mapInArrow(work, schema).filter("take > 0")


def row_hash(docs: DataFrame) -> Column:
    """Tells rows of one id and source apart: a hash of all columns but those that can't be hashed."""
    return F.xxhash64(*(docs[c] for c, kind in sorted(docs.dtypes) if "map<" not in kind and kind != "variant"))


class Mix(NamedTuple):
    rows: DataFrame  # doc_id, source, row_hash, size, sid, start (null for size 0), source_size, target
    pieces: DataFrame  # slot, epoch, sid, start, doc_id, source, row_hash, word_from, word_to: the mix, in slot order


def mix(docs: DataFrame, weights: Callable[[int], float], share: float = 1.5, repeat: float = 2.0, block: int = BLOCK_WORDS) -> Mix:
    """weights: of the i-th source in code-point order, null last. share: words of the mix as a multiple of all words."""
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", "source", row_hash(docs).alias("row_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    rows = settled(rows.withColumn("place", F.xxhash64("doc_id", "row_hash", F.lit(20))), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = by_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = np.array([r["size"] for r in found], np.int64)
    targets = fill(sizes, [weights(i) for i in range(len(found))], share, repeat)
    p = plan([r["source"] for r in found], sizes, targets, block)

    table = [(r["source"], i, int(r["size"]), float(targets[i])) for i, r in enumerate(found)]
    sources = F.broadcast(spark.createDataFrame(table, "name string, sid long, source_size long, target double"))
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["name"])).drop("name")
    buckets = max(1, sum(r["n"] for r in found) // ROWS_A_BUCKET)
    rows = rows.withColumn("bucket", F.pmod("place", F.lit(buckets)))
    # Sums ahead in two levels: groups of buckets, then buckets inside their group, so no window sees all buckets of a source.
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket")).withColumn("group", F.floor(F.col("bucket") / ROWS_A_BUCKET))
    ahead = lambda *keys: Window.partitionBy(*keys).orderBy("group" if len(keys) == 1 else "bucket").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("sid", "group").agg(F.sum("in_bucket").alias("in_group"))
    groups = groups.select("sid", "group", F.coalesce(F.sum("in_group").over(ahead("sid")), F.lit(0)).alias("before"))
    bases = sums.withColumn("within", F.coalesce(F.sum("in_bucket").over(ahead("sid", "group")), F.lit(0))).join(groups, ["sid", "group"])
    bases = bases.select("sid", "bucket", (F.col("before") + F.col("within")).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(bases, ["sid", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("start", F.when(F.col("size") > 0, F.col("start")))
    rows = settled(rows.select("doc_id", "source", "row_hash", "size", "sid", "start", "source_size", "target"), "stream")

    in_blocks = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    cut = rows.filter("size > 0").select("sid", "start", "size", "doc_id", "source", "row_hash", in_blocks.alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    pieces = cut.join(slot_table(spark, p), ["sid", "block"]).filter(last > first)
    pieces = pieces.select(
        "slot", "epoch", "sid", "start", "doc_id", "source", "row_hash", (first - F.col("start")).alias("word_from"), (last - F.col("start")).alias("word_to")
    )
    return Mix(rows, pieces)


def taken(m: Mix) -> DataFrame:
    """Per row of the input: doc_id, source, size, source_size, target and the words that the mix takes of it."""
    by_row = m.pieces.groupBy("sid", "start").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    return m.rows.join(by_row, ["sid", "start"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed_texts(docs: DataFrame, m: Mix) -> DataFrame:
    """A row of docs for each document and epoch that the mix takes: its text where all words are taken, else those words.

    Rows that agree in all columns are one row here, given as often as the mix takes each of them.
    """
    parts = m.pieces.groupBy("doc_id", "source", "row_hash", "sid", "start", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("parts"), F.sum(F.col("word_to") - F.col("word_from")).alias("n")
    )
    # The row travels as one struct, so that its columns can have any names.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k1"), F.col("source").alias("k2"), row_hash(docs).alias("k3"))
    own = own.dropDuplicates(["k1", "k2", "k3"])
    same = F.col("k1").eqNullSafe(F.col("doc_id")) & F.col("k2").eqNullSafe(F.col("source")) & (F.col("k3") == F.col("row_hash"))
    words = F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    joined = own.join(parts, same).withColumn("words", words)
    span = lambda x: F.slice("words", (x["word_from"] + 1).cast("int"), (x["word_to"] - x["word_from"]).cast("int"))
    some = F.concat_ws(" ", F.transform("parts", lambda x: F.concat_ws(" ", span(x))))
    text = F.when(F.col("n") == F.size("words"), F.col("row.text")).otherwise(some)
    return joined.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
