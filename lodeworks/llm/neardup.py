"""Near duplicates by bottom-k sketches of one hash function.

A text's set holds the 64-bit hashes of its distinct shingles; its sketch is the k smallest. Texts with equal sets (size and
two independent 64-bit sums agree) are one class, which enters once. Inverted lists hold retained values; a class
enters only those of its rarest values that it can't be without in a pair of the similarity asked for (sketches of
such a pair share SHARED values or more but for a chance below 1e-8; sets smaller than a sketch are judged without chance).
Pairs that share enough lists and whose union sketch doesn't exclude them are verified on the full sets.

Large groups never give all their pairs: first each list links its members to a few heads, then only classes that share
lists with other components are looked at. Their full sets are ordered by how many of those classes hold a shingle; a
class enters the prefix lists of the rarest shingles that a similar pair can't do without, shingles of no other component
count as places taken, and a pair meets only if what follows in both sets can still make it similar (no pair of different
components is lost by that). What is equal or linked already needs no further link.

Null and empty texts have an empty set and are linked with nothing. Texts shorter than a shingle are one shingle. Rows that
share an id are one document. Rows with a null id are linked with nothing and have no component. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.bloom import bloom_of
from lodeworks.llm.components import components
from lodeworks.llm.scratch import drop, settled
from lodeworks.llm.textkit import Words, hash_grams, hash_words, mix, slices, tidy, words_of

SKETCH = 64
SHARED = 30  # P(Binomial(64, 0.8) < 30) < 1e-8
TOGETHER = 6  # lists that a pair must meet in
HEADS = 5  # members of a longer list that all others are compared with first
SEVERAL = 16  # components of a list that are told apart
_KEPT = ("cid", "n", "need", "home")


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes = hash_words(words)
    grams = hash_grams(hashes, n)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield mix(hash_grams(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield grams[:0]


def _sketches(docs: DataFrame, n: int, lower: bool, k: int) -> DataFrame:
    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, sums, others, kept = [], [], [], []
                for own in shingle_sets(words_of(part.column(1), lower), n):
                    sizes.append(len(own))
                    sums.append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                    others.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    kept.append(own[:k].view(np.int64))
                offsets = np.cumsum([0, *map(len, kept)])
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(kept)))
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (sizes, sums, others)), values]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n long, s1 long, s2 long, sketch array<long>")


def _lists(classes: DataFrame, threshold: float, k: int) -> DataFrame:
    """(value, band, home, cid, n, need, odd): each class in the lists of the rarest retained values that it needs.

    Lists are kept apart by bands of sizes, two rows of bands a half apart, so that sizes close enough share a band;
    home is the band in the first row; odd counts the retained values that no other class holds. Lists of one class go,
    and with them classes that are left in too few lists.
    """
    exact = math.floor(threshold * k)  # sets up to this size are seen whole, as are their partners
    values = classes.select("cid", "n", F.explode("sketch").alias("value"))
    # Written, so that a value that many classes hold is split like any skewed key of a join.
    common = settled(values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    held = F.least("n", F.lit(k))
    need = F.when(F.col("n") <= exact, F.ceil(F.lit(threshold) * F.col("n") - 1e-9)).otherwise(F.least(F.lit(SHARED), held))
    together = F.least(need, F.lit(TOGETHER))
    shared = values.join(common, "value").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
    odd = held - F.size("own")
    room = F.greatest(held - need + together - odd, F.lit(0)).cast("int")  # after those that no one shares
    rows = shared.select("cid", "n", together.cast("int").alias("need"), odd.cast("int").alias("odd"), F.explode(F.slice("own", F.lit(1), room)).alias("x"))
    at = F.log(F.col("n").cast("double")) / math.log(1 / threshold)
    even, across = (F.floor(at / 2) * 2).cast("int"), (F.floor((at + 1) / 2) * 2 + 1).cast("int")
    rows = rows.select(F.col("x.value").alias("value"), "cid", "n", "need", "odd", even.alias("home"), F.explode(F.array(even, across)).alias("band"))
    rows = settled(rows, "bands")
    drop(common)
    cells = settled(rows.groupBy("value", "band").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    met = settled(rows.join(cells, ["value", "band"]), "cells")
    drop(rows, cells)
    enough = met.groupBy("cid").agg(F.countDistinct("value").alias("lists"), F.max("need").alias("least"))
    enough = enough.filter(F.col("lists") >= F.col("least")).select("cid")
    out = settled(met.join(enough, "cid", "left_semi"), "lists")
    drop(met)
    return out


def _plausible(pairs: DataFrame, classes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch holds as many common values as the threshold needs, chance set aside."""
    of = lambda c: classes.select(F.col("cid").alias(c), F.col("sketch").alias(f"s{c}"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    # Values are unsigned hashes held in signed longs: with the top bit flipped they sort as when they were chosen.
    flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63))))
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", flip(F.col("sa")).alias("sa"), flip(F.col("sb")).alias("sb"))
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    full = F.size(union) < k
    return joined.filter(F.when(full, common >= threshold * F.size(union) - 1e-9).otherwise(common >= SHARED)).select("a", "b")


def _sets(docs: DataFrame, ids: DataFrame, n: int, lower: bool, repeated: bool) -> DataFrame:
    """(id, set): full sets of the wanted documents (and of a few more, which joins leave behind); repeated: ids may
    occur more than once, of which equal sets are kept once."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_of(ids))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            known = known.filter(pa.array(wanted.value.holds(known.column(0).to_numpy())))
            for part in slices(known):
                own = [x.view(np.int64) for x in shingle_sets(words_of(part.column(1), lower), n)]
                sets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["id", "set"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "id long, set array<long>")
    return made.groupBy("id", F.size("set").alias("n"), F.xxhash64("set").alias("h")).agg(F.first("set").alias("set")).select("id", "set") if repeated else made


def _similar(both: Column, n_a: Column, n_b: Column, threshold: float) -> Column:
    percent = round(threshold * 100)
    return (both > 0) & (100 * both >= percent * (n_a + n_b - both))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose full sets, of sets(id, set), are as similar as asked for."""
    of_a, of_b = (sets.select(F.col("id").alias(c), F.col("set").alias(f"s{c}")) for c in "ab")
    met = pairs.join(of_a, "a").join(of_b, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return settled(met.filter(_similar(F.col("both"), F.size("sa"), F.size("sb"), threshold)).select("a", "b").distinct(), "links")


def _close(threshold: float):
    """Sizes that allow the similarity; and a pair that shares its first band isn't met again in the second."""
    near = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    return near & ((F.col("band") == F.col("home_a")) | (F.col("home_a") != F.col("home_b")))


def _enough(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b) of pairs (cid_a, cid_b, need_a, need_b), a row per common list, that meet often enough."""
    a, b = F.least("cid_a", "cid_b"), F.greatest("cid_a", "cid_b")
    met = pairs.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("times"), F.min(F.least("need_a", "need_b")).alias("need"))
    return met.filter(F.col("times") >= F.least("need", F.lit(most))).select("a", "b")


def _to_heads(lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs of each list's members with its heads: its smallest id and, in longer lists, the one with the fewest values
    of its own (a group's middle) and those first by other orders.

    The orders are the same in all lists, so a group's lists agree on few heads, and one that isn't of a group doesn't
    keep the group apart.
    """
    order = lambda seed, first: F.struct(first.cast("long").alias("f"), F.xxhash64("cid", F.lit(seed)).alias("h"), "cid", "n", "need", "home")
    plain = F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("h"), "cid", "n", "need", "home")
    others = [F.min(order(k, F.col("odd") if k == 1 else F.lit(0))).alias(f"h{k}") for k in range(1, HEADS)]
    heads = lists.groupBy("value", "band").agg(F.max("size").alias("size"), F.min(plain).alias("h0"), *others)
    every = F.array(*(f"h{k}" for k in range(HEADS)))
    heads = heads.select("value", "band", F.explode(F.array_distinct(F.when(F.col("size") > HEADS, every).otherwise(F.slice(every, 1, 1)))).alias("x"))
    heads = heads.select("value", "band", *(F.col(f"x.{c}").alias(f"{c}_b") for c in _KEPT)).distinct()
    mine = lists.select("value", "band", *(F.col(c).alias(f"{c}_a") for c in _KEPT))
    pairs = mine.join(heads, ["value", "band"]).filter((F.col("cid_a") != F.col("cid_b")) & _close(threshold))
    pairs = pairs.withColumn("low", F.least("cid_a", "cid_b")).withColumn("high", F.greatest("cid_a", "cid_b"))
    once = pairs.groupBy("value", "low", "high").agg(F.first("need_a").alias("need_a"), F.first("need_b").alias("need_b"))  # both may be heads
    return _enough(once.withColumnsRenamed({"low": "cid_a", "high": "cid_b"}), 3)


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, comp): classes that may share enough lists with one other component.

    Common lists are counted by component, not by class. A list of more than SEVERAL components counts for any of them.
    """
    named = lists.join(labels, F.col("cid") == F.col("id"), "left")
    named = settled(named.select("value", "band", "cid", "need", F.coalesce("component", "cid").alias("comp")), "named")
    spread = settled(named.select("value", "band", "comp").distinct(), "spread")
    sizes = settled(spread.groupBy("value", "band").agg(F.count("*").alias("comps")).filter("comps > 1"), "sizes")
    few = spread.join(sizes.filter(F.col("comps") <= SEVERAL).select("value", "band"), ["value", "band"]).groupBy("value", "band").agg(F.collect_list("comp").alias("others"))
    several = settled(sizes.select("value", "band").join(few, ["value", "band"], "left"), "several")
    met = named.join(several, ["value", "band"]).groupBy("cid", "comp").agg(F.max("need").alias("need"), F.collect_list(F.struct("value", "others")).alias("lists"))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enough = [most_shared(own, lists) >= need for own, need, lists in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(enough, pa.bool_())).rename_columns(["id", "comp"])

    out = settled(met.filter(F.size("lists") >= F.col("need")).mapInArrow(work, "id long, comp long"), "mixed")
    drop(named, spread, sizes, several)
    return out


def most_shared(own: int, lists: list[dict]) -> int:
    """The most lists that a class of component `own` may share with one other component."""
    at: dict[int, set[int]] = {}
    anyone = set()
    for x in lists:
        if x["others"] is None:
            anyone.add(x["value"])
        else:
            for comp in x["others"]:
                at.setdefault(comp, set()).add(x["value"])
    at.pop(own, None)
    return max((len(v | anyone) for v in at.values()), default=len(anyone))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(value, id, comp, n, left) of sets(id, comp, set): lists of the rarest values that a pair of different components
    with the similarity can't do without; left: how many values of the set, this one included, a partner may still share.

    Values of one component alone can't be shared by such a pair: they come first and are never listed. The others are
    ordered by how many sets hold them. A set of n values shares at least threshold x n with a similar one, so of its s
    values that may be shared it needs the first s - threshold x n + 1 in lists.
    """
    percent = round(threshold * 100)
    values = sets.select("id", "comp", F.size("set").alias("n"), F.explode("set").alias("value"))
    spread = values.groupBy("value").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    spread = settled(spread.filter("low < high").select("value", "df"), "spread")
    own = values.join(spread, "value").groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"))
    least = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    own = own.withColumn("s", F.size("own")).filter(F.col("s") >= least)
    rows = own.select("id", "comp", "n", "s", F.posexplode(F.slice("own", F.lit(1), F.col("s") - least + 1)).alias("at", "x"))
    out = settled(rows.select(F.col("x.value").alias("value"), "id", "comp", "n", (F.col("s") - F.col("at")).alias("left")), "prefixes")
    drop(spread)
    return out


def meeting(lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that meet in prefix lists and, by what follows there, may be similar.

    A list's largest component is compared with the others only, never with itself.
    """
    percent = round(threshold * 100)
    sizes = lists.groupBy("value", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("value").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    main = settled(main.select("value", "main"), "main")
    several = settled(lists.join(main, "value"), "prefixes")
    columns = ("id", "comp", "n", "left")
    some = several.filter("comp <> main").select("value", *(F.col(c).alias(f"{c}_a") for c in columns))
    every = several.select("value", "main", *(F.col(c).alias(f"{c}_b") for c in columns))
    once = (F.col("comp_b") == F.col("main")) | (F.col("id_a") < F.col("id_b"))
    room = F.least("left_a", "left_b") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    met = some.join(every, ["value"]).filter((F.col("comp_a") != F.col("comp_b")) & room & once)
    out = settled(met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), "meeting")
    drop(main, several)
    return out


def _across(lists: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, n: int, lower: bool, threshold: float, k: int, repeated: bool) -> DataFrame:
    """Links (a, b) between components that are still apart."""
    mixed = _mixed(lists, labels)
    sets = settled(_sets(docs, mixed.select("id"), n, lower, repeated).join(mixed, "id"), "sets")
    listed = prefixes(sets, threshold)
    pairs = meeting(listed, threshold)
    links = _verified(_plausible(pairs, classes, threshold, k), sets, threshold)
    drop(mixed, sets, listed, pairs)
    return links


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, lower: bool = True, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for each row of docs(doc_id, text).

    class_id: the smallest id of those with an equal set. component_id: the smallest id reachable. kept: doc_id is it.
    """
    marked = settled(_sketches(docs, n, lower, k), "sketches")
    known = marked.filter("doc_id IS NOT NULL")
    repeated = not known.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").isEmpty()
    classes = known.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("cid"), F.first("sketch").alias("sketch"))
    classes = settled(classes, "classes")
    lists = _lists(classes, threshold, k)
    pairs = settled(_plausible(_to_heads(lists, threshold), classes, threshold, k), "pairs")
    sets = settled(_sets(docs, pairs.select("a").union(pairs.select("b")).distinct(), n, lower, repeated), "sets")
    first = _verified(pairs, sets, threshold)
    drop(pairs, sets)
    labels = components(first)
    second = _across(lists, labels, classes, docs, n, lower, threshold, k, repeated)
    drop(lists)

    sets = marked.join(classes.select("n", "s1", "s2", "cid"), ["n", "s1", "s2"], "left")
    sets = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id")).alias("class_id"))
    sets = settled(sets, "of_class")
    drop(marked, classes)
    final = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second).unionByName(_shared_ids(sets)))
    drop(first, second, labels)
    rows = sets.join(final, F.col("class_id") == F.col("id"), "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _shared_ids(sets: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    spread = sets.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("top")).filter("b < top")
    return sets.join(spread.select("doc_id", "b"), "doc_id").filter("class_id <> b").select(F.col("class_id").alias("a"), "b").distinct()


def first_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of docs, all columns, that are kept; rows without an id stay."""
    found = near_duplicates(docs, n, threshold)
    out = settled(found.filter("NOT kept").select("doc_id").distinct(), "copies")
    return docs.join(out, "doc_id", "left_anti")
