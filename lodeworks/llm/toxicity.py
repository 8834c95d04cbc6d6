"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs and full-width forms to Latin letters and, inside words and at their edges, digits and
signs to the letters that they stand for (a closing "!" stays a sign). Lexicon entries are whole words or beginnings of
words; their weights are smoothed log ratios of document frequencies in toxic and clean training rows. An entry must
follow several different words (counted by a 6-bit hash), which copies can't feign, and most rows that hold it must be
toxic; how many words and how large a part is chosen by F1 in a two-fold cross-validation of the training rows alone,
the strictest of equal choices. A word counts once, by its heaviest entry. Two-word phrases that hold an entry but
occur in clean rows only are exceptions: inside them no entry counts.

Null and empty texts score as texts without a hit. Training takes a bounded sample (`max_labels`) of labelled rows in the
order of a hash; rows without id or label are left out, an id labelled twice counts as toxic if one label says so. An entry
occurs in at least SUPPORT of the toxic rows, so there are at most 1 / SUPPORT times the mean number of a row's entries.
Without toxic or without clean training rows every score is the share of toxic rows (0 without any). Without documents
there are no scores. Repeated rows are scored each. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.scratch import drop, settled
from lodeworks.llm.textkit import tidy

MAX_LABELS = 200_000
SUPPORT = 0.003
STEMS = (4, 5, 6)
FLUSH = 200_000
THRESHOLD = 0.3  # from which a score counts as toxic in the cross-validation
#: What is chosen from, strictest last: least toxic share of the rows that hold an entry, most words asked for before it.
SETTINGS = [(p, n) for p in (0.6, 0.75, 0.9, 0.97) for n in (3, 16)]

# Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсхуіѕјкмтнвоαειορυνκτ", "aeopcxyisjkmthboaeiopuvkt", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_GLYPHS = str.maketrans(HOMOGLYPHS | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)})
_ODD = re.compile("[Ͱ-ӿ！-～]")
_SIGNS = re.compile(r"[013457@$!]+")
_WORD = re.compile(r"[^\W_]+")


def _letters(m: re.Match) -> str:
    """Signs as letters, if they stand beside a letter; a "!" only between letters."""
    text, a, b = m.string, *m.span()
    before, after = "a" <= text[a - 1 : a] <= "z", "a" <= text[b : b + 1] <= "z"
    if not before and not after:
        return m[0]
    own = m[0] if before and after else m[0].rstrip("!") if before else m[0].lstrip("!")
    made = "".join(SUBSTITUTES[c] for c in own)
    return made if len(own) == len(m[0]) else made + m[0][len(own) :] if before else m[0][: len(m[0]) - len(own)] + made


def fold(text: str | None) -> str:
    """The folded words of a text, each between single spaces."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_GLYPHS).lower()
    return f" {' '.join(_WORD.findall(_SIGNS.sub(_letters, text)))} "


def features(folded: str) -> set[str]:
    """Whole words (between spaces) and beginnings of words (after a space)."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


class Lexicon(NamedTuple):
    weights: dict[str, float]
    exceptions: frozenset[str]
    prior: float

    def automaton(self, masks: dict[str, int] | None = None):
        """Values: size, weight, whether it is an exception (or the given mask)."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for entry in self.weights.keys() | self.exceptions:
            made.add_word(entry, (len(entry), self.weights.get(entry, 0.0), masks[entry] if masks else entry in self.exceptions))
        if len(made):
            made.make_automaton()
        return made


def hits(folded: str, automaton) -> dict[int, float]:
    """Weight of the heaviest entry at each word (by the place of the space before it), outside of exceptions."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for last, (size, weight, exception) in automaton.iter(folded) if len(automaton) else ():
        at = last - size + 1
        if exception:
            spared.append((at, last))
        if weight > best.get(at, 0.0):
            best[at] = weight
    for a, b in spared:
        for at in [k for k in best if a <= k < b]:
            del best[at]
    return best


def graded(total: float, folded: str, prior: float) -> float:
    """A score from 0 to 1 of the sum of a text's weights, normalised by its words."""
    total /= 1 + 0.1 * math.log1p((folded.count(" ") - 1) / 100)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, prior + total))))


def score_of(folded: str, lexicon: Lexicon, automaton) -> float:
    return graded(sum(hits(folded, automaton).values()), folded, lexicon.prior)


def phrases(folded: str, automaton) -> set[str]:
    """Two-word phrases around each hit."""
    out = set()
    for at in hits(folded, automaton):
        end = folded.index(" ", at + 1)
        if at:
            out.add(folded[folded.rindex(" ", 0, at) : end + 1])
        if end + 1 < len(folded):
            out.add(folded[at : folded.index(" ", end + 1) + 1])
    return out


def _document_counts(train: DataFrame, of: Callable[[str], set[str]]) -> DataFrame:
    """(item, fold, toxic, clean): in how many training rows of each fold and kind an item occurs."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            items = list({(item, fold) for item, fold, _ in counts})
            columns = [pa.array([x[0] for x in items], pa.string()), pa.array([x[1] for x in items], pa.int32()), *(pa.array([counts[*x, k] for x in items], pa.int64()) for k in (1, 0))]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["item", "fold", "toxic", "clean"])

        for batch in batches:
            for text, label, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts.update((item, part, label) for item in of(fold(text.as_py())))
                if len(counts) > FLUSH:
                    yield rows()
        yield rows()

    made = train.select("text", "label", "fold").mapInArrow(work, "item string, fold int, toxic long, clean long")
    return made.groupBy("item", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(toxic: DataFrame) -> DataFrame:
    """(item, fold, toxic, seen): in how many toxic rows of each fold an item occurs, and, as bits, after which words (by hash).

    Copies and shared passages repeat a word in one place; a word that itself is toxic stands after many.
    """

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            items = list(rows)
            columns = [pa.array([x[0] for x in items], pa.string()), pa.array([x[1] for x in items], pa.int32()), *(pa.array([rows[x][k] for x in items], pa.int64()) for k in (0, 1))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["item", "fold", "toxic", "seen"])

        for batch in batches:
            for text, part in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for item, bits in contexts(fold(text.as_py())).items():
                    now = rows.setdefault((item, part), [0, 0])
                    now[0] += 1
                    now[1] |= bits - (1 << 64) if bits >> 63 else bits
                if len(rows) > FLUSH:
                    yield out()
        yield out()

    made = toxic.select("text", "fold").mapInArrow(work, "item string, fold int, toxic long, seen long").groupBy("item", "fold")
    return made.agg(F.sum("toxic").alias("toxic"), F.bit_or("seen").alias("seen"))


def contexts(folded: str) -> dict[str, int]:
    """Each feature with a bit set for each word before it, by hash."""
    own: dict[str, int] = {}
    before = ""
    for word in folded.split():
        bit = 1 << (zlib.crc32(before.encode()) & 63)
        for item in (f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)):
            own[item] = own.get(item, 0) | bit
        before = word
    return own


class Counted(NamedTuple):
    """What is known of an entry: toxic and clean rows that hold it, and the words before it as bits."""

    toxic: int
    clean: int
    seen: int

    def __add__(self, other: Counted) -> Counted:
        return Counted(self.toxic + other.toxic, self.clean + other.clean, self.seen | other.seen)


def weigh(counts: dict[str, Counted], toxic: int, clean: int) -> dict[str, tuple[float, float, int]]:
    """Weight, toxic share and number of words before each entry that is frequent and telling enough under any setting."""
    out = {}
    for item, x in counts.items():
        if x.toxic < max(3.0, SUPPORT * toxic):
            continue
        ratio = math.log((x.toxic + 0.5) / (toxic + 1)) - math.log((x.clean + 0.5) / (clean + 1))
        sure = ratio - math.sqrt(1 / (x.toxic + 0.5) + 1 / (x.clean + 0.5))
        if sure >= math.log(10):
            out[item] = sure, x.toxic / (x.toxic + x.clean), (x.seen & (1 << 64) - 1).bit_count()
    return out


def passes(setting: tuple[float, int], share: float, words: int, toxic: int) -> bool:
    return share >= setting[0] and words >= max(3.0, min(setting[1], 0.01 * toxic))


def _validated(train: DataFrame, entries: list[dict[str, tuple[float, int]]], priors: list[float]) -> list[float]:
    """F1 of each setting on the training rows; entries[fold]: weight of each entry and, as bits, the settings that take it,
    learnt from the other fold."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for own in entries:
            bare = Lexicon({k: w for k, (w, _) in own.items()}, frozenset(), 0.0)
            made.append((bare.automaton(masks={k: m for k, (_, m) in own.items()}), bare))
        tally = [[0, 0, 0] for _ in SETTINGS]  # found, flagged, toxic
        for batch in batches:
            for text, label, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                folded = fold(text.as_py())
                best: dict[int, dict[int, float]] = defaultdict(dict)
                if len(made[part][0]):
                    for last, (size, weight, mask) in made[part][0].iter(folded):
                        at = last - size + 1
                        for k in range(len(SETTINGS)):
                            if mask >> k & 1 and weight > best[k].get(at, 0.0):
                                best[k][at] = weight
                for k, own in enumerate(tally):
                    flag = graded(sum(best[k].values()) if k in best else 0.0, folded, priors[part]) >= THRESHOLD
                    own[0] += flag and label
                    own[1] += flag
                    own[2] += label
        yield pa.RecordBatch.from_arrays([pa.array(range(len(SETTINGS)), pa.int32()), *(pa.array([t[k] for t in tally], pa.int64()) for k in range(3))], ["setting", "found", "flagged", "toxic"])

    made = train.select("text", "label", "fold").mapInArrow(work, "setting int, found long, flagged long, toxic long")
    rows = made.groupBy("setting").agg(F.sum("found").alias("found"), F.sum("flagged").alias("flagged"), F.sum("toxic").alias("toxic")).collect()
    return [2 * r["found"] / max(1, r["flagged"] + r["toxic"]) for r in sorted(rows, key=lambda r: r["setting"])]


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Lexicon:
    """Learns weights and exceptions from docs(doc_id, text) joined with labels(doc_id, toxic)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).dropna()
    sample = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    sample = settled(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")), "labels")  # at most max_labels rows of three numbers: may be broadcast
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", "fold")
    sizes = {r["fold"]: (r["toxic"], r["clean"]) for r in train.groupBy("fold").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).collect()}
    of_fold = [sizes.get(f, (0, 0)) for f in (0, 1)]
    toxic, clean = (sum(x[k] for x in of_fold) for k in (0, 1))
    if not toxic or not clean:
        return Lexicon({}, frozenset(), 50.0 if toxic else -50.0)
    seen = settled(_contexts(train.filter("label = 1")), "contexts")
    whole = seen.groupBy("item").agg(F.sum("toxic").alias("toxic"), F.bit_or("seen").alias("seen"))
    enough = lambda n: (F.col("toxic") >= max(3.0, SUPPORT * n)) & (F.bit_count("seen") >= 3)
    common = whole.filter(enough(toxic)).select("item")
    for f in (0, 1):
        common = common.union(seen.filter((F.col("fold") == f) & enough(of_fold[f][0])).select("item"))
    candidates = {r["item"] for r in common.distinct().collect()}
    bits = {(r["item"], r["fold"]): r["seen"] for r in seen.join(common.distinct(), "item").collect()}
    drop(seen)
    counts: list[dict[str, Counted]] = [{}, {}]
    for r in _document_counts(train, lambda t: features(t) & candidates).collect():
        counts[r["fold"]][r["item"]] = Counted(r["toxic"], r["clean"], bits.get((r["item"], r["fold"]), 0))

    setting = SETTINGS[-1]
    if all(t and c for t, c in of_fold):
        entries = []
        for other in (1, 0):
            weighed = weigh(counts[other], *of_fold[other])
            masks = {i: sum(1 << k for k, x in enumerate(SETTINGS) if passes(x, share, words, of_fold[other][0])) for i, (_, share, words) in weighed.items()}
            entries.append({i: (weighed[i][0], m) for i, m in masks.items() if m})
        quality = _validated(train, entries, [math.log(of_fold[other][0] / of_fold[other][1]) for other in (1, 0)])
        setting = max(zip(quality, SETTINGS, strict=True))[1]
    none = Counted(0, 0, 0)
    weighed = weigh({i: counts[0].get(i, none) + counts[1].get(i, none) for i in counts[0].keys() | counts[1].keys()}, toxic, clean)
    bare = Lexicon({i: w for i, (w, share, words) in weighed.items() if passes(setting, share, words, toxic)}, frozenset(), math.log(toxic / clean))

    made: list = []

    def around(folded: str) -> set[str]:
        if not made:
            made.append(bare.automaton())
        return phrases(folded, made[0])

    spared = _document_counts(train, around).groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared = spared.filter("toxic = 0").filter(F.col("clean") >= max(3.0, 0.0005 * clean))
    return bare._replace(exceptions=frozenset(r["item"] for r in spared.collect()))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; columns of docs besides these two are kept."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [score_of(fold(t.as_py()), lexicon, automaton) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, score double").withColumnRenamed("id", id_col)


def passing(docs: DataFrame, lexicon: Lexicon, below: float) -> DataFrame:
    """Rows of docs, all columns, whose text scores below the bound: one pass, no join back."""
    columns = docs.columns

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            keep = [score_of(fold(t.as_py()), lexicon, automaton) < below for t in batch.column(columns.index("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
