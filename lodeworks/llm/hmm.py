"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward recursion for scores.

Tokens are a text's words (ASCII letters in lower case), then one end; words are told apart by 64-bit hashes. Rounds of
Baum-Welch train the moves between latent states on whole texts: the most frequent words (up to `classes`) have emissions
of their own there, all other words share one class per length and script. A last expectation step then gathers, for every
word of the corpus, its count in each state, summed by word in a distributed table, and every word gets its own emissions:

    b_k(w) = (c(w) * ((1 - FLAT) * p_k(w) / share_k + FLAT) + 0.5) / (N + 0.5 * (V + 1))

with p_k(w) the share of w's occurrences in state k (kept in 8 bits) and share_k that of all tokens by these shares, so that
the words and one unknown word sum to 1 in each state, and a mix of the states by their shares is the unigram model.
Scoring packs texts into bundles, sends each bundle the rows of its distinct words, and runs the forward recursion over
whole texts; nothing that grows with the corpus is broadcast or collected.

Long texts are computed in runs of `run` tokens whose transfer matrices carry the exact states from run to run: no
transition is lost. Rounds end when the likelihood of a token gains less than GAIN, or after `rounds`; Trained.history has
the likelihoods.

Null and empty texts are the end alone. Without training rows every word is unknown, with probability 1. Repeated rows
count each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.codes import Codes
from lodeworks.llm.scratch import drop, settled
from lodeworks.llm.textkit import hash_words, slices, tidy, words_of

STATES = 6
CLASSES = 20_000
ROUNDS = 3
GAIN = 0.002  # natural log units a token
RUN = 256
FLAT = 0.1  # of a word's count, the part that all states share alike
LENGTHS = 24  # lengths told apart in shared classes
END = np.uint64(1)  # the end's hash
FLUSH = 300_000  # distinct words that a task holds
BUNDLE_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
SCALED = 6  # steps between scalings
_ENTRY = 1e-3  # added to each expected count of a transition or emission
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True


class Tokens(NamedTuple):
    keys: np.ndarray  # hash of each token, ends included
    shape: np.ndarray  # shared class by length and script
    tail: np.ndarray  # the last two bytes before closing punctuation, where asked for
    bounds: np.ndarray  # per text: index of its first token; one more entry at the end


def tokens_of(column: pa.Array, tails: bool = False) -> Tokens:
    words = words_of(column, True)
    keys = hash_words(words)
    keys[keys <= END] = 2
    size = words.end - words.start
    wide = np.concatenate([[0], np.cumsum(words.data >= 128, dtype=np.int64)])
    shape = np.clip(size, 1, LENGTHS) - 1 + LENGTHS * (wide[words.end] > wide[words.start])
    tail = np.zeros(len(keys), np.int64)
    if tails:
        core = words.end.copy()
        live = np.arange(len(core))
        while len(live):
            live = live[(core[live] > words.start[live] + 1) & _CLOSING[words.data[core[live] - 1]]]
            core[live] -= 1
        data = np.concatenate([np.zeros(1, np.uint8), words.data])  # data[i] is the byte before place i
        tail = data[core].astype(np.int64) << 8 | np.where(core - words.start > 1, data[core - 1], 0)
    ends = words.first[1:]
    insert = lambda x, value: np.insert(x, ends, value)
    return Tokens(insert(keys, END), insert(shape, 0), insert(tail, 0), words.first + np.arange(len(words.first)))


class Model(NamedTuple):
    """Moves between states, and emissions of classes: frequent words by their hash, then the shared classes."""

    names: np.ndarray
    start: np.ndarray
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    def classes(self) -> Codes:
        return Codes.of(self.names)


def class_of(tokens: Tokens, names: Codes, n: int) -> np.ndarray:
    out = names.find(tokens.keys)
    return np.where(out < 0, n + tokens.shape, out)


class _Sums:
    """Sums of columns by hash, up to a bound of distinct hashes."""

    def __init__(self, width: int):
        self.codes, self.keys, self.sums = Codes(), [], np.zeros((0, width))

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        """columns: a number for each key, or None to count. Returns for each key its first place if it is new, else -1."""
        own = self.codes.find(keys)
        fresh = np.flatnonzero(own < 0)
        if len(fresh):
            new, first = np.unique(keys[fresh], return_index=True)
            self.codes.add(new, np.arange(len(self.sums), len(self.sums) + len(new), dtype=np.int32))
            self.keys.append(new)
            self.sums = np.concatenate([self.sums, np.zeros((len(new), self.sums.shape[1]))])
            own[fresh] = self.codes.find(keys[fresh])
            fresh = fresh[first]
        for k, values in enumerate(columns):
            self.sums[:, k] += np.bincount(own, values, len(self.sums))
        return fresh

    def full(self) -> bool:
        return len(self.sums) > FLUSH


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, c, shape, tail) over rows(text), ends included: summed per task first, then by word."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shapes, tails = _Sums(1), [], []

        def out() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, np.uint64), *sums.keys])
            kinds = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (shapes, tails)]
            columns = [keys.view(np.int64), sums.sums[:, 0].astype(np.int64), *kinds]
            shapes.clear(), tails.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["h", "c", "shape", "tail"])

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                own = tokens_of(part.column(0), True)
                fresh = sums.add(own.keys, None)
                shapes.append(own.shape[fresh]), tails.append(own.tail[fresh])
                if sums.full():
                    yield out()
                    sums = _Sums(1)
        yield out()

    made = rows.select("text").mapInArrow(work, "h long, c long, shape long, tail long")
    return made.groupBy("h").agg(F.sum("c").alias("c"), F.min("shape").alias("shape"), F.min("tail").alias("tail"))


def _frequent(counts: DataFrame, classes: int) -> DataFrame:
    """The words whose counts lie above a bound that at most `classes` words pass, found by a histogram of bounded size."""
    step = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2("c") * 64)).cast("long")
    many = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, bound = 0, None
    for at, n in many:
        total += n
        if total > classes:
            break
        bound = at
    return counts.filter(step >= bound) if bound is not None else counts.limit(0)


def first_model(names: np.ndarray, counts: np.ndarray, tails: np.ndarray, states: int) -> Model:
    """Staying states; emissions near the unigram shares, tilted alike for words that end alike.

    counts: of each name, then of each shared class. Endings tell languages and forms apart, so expectation steps
    start from states that differ.
    """
    tilt = np.ones((len(counts), states))
    known: dict[int, np.ndarray] = {}
    for k, tail in enumerate(tails.tolist()):
        if tail not in known:
            known[tail] = np.random.default_rng(tail).dirichlet(np.full(states, 0.3)) + 0.05
        tilt[k] = known[tail]
    emit = (counts[:, None] + 0.5) * tilt
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(names, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Runs(NamedTuple):
    """Runs of texts, a text's runs in a row."""

    first: np.ndarray  # place of each run's first token
    size: np.ndarray
    text: np.ndarray
    nth: np.ndarray  # place of the run in its text
    parts: np.ndarray  # runs of each text
    head: np.ndarray  # first run of each text


def runs_of(bounds: np.ndarray, run: int) -> Runs:
    sizes = np.diff(bounds)
    parts = -(-sizes // run)
    head = np.cumsum(parts) - parts
    text = np.repeat(np.arange(len(parts)), parts)
    nth = np.arange(len(text)) - head[text]
    first = bounds[:-1][text] + nth * run
    return Runs(first, np.minimum(bounds[1:][text] - first, run), text, nth, parts, head)


class Grid:
    """Some runs, longest first, and their tokens step by step: what a step touches lies together."""

    def __init__(self, runs: Runs, which: np.ndarray):
        self.order = which[np.argsort(-runs.size[which], kind="stable")]
        size = runs.size[self.order]
        steps = int(size[0]) if len(size) else 0
        self.alive = np.searchsorted(-size, -np.arange(steps), "left")  # runs that have a token at each step
        self.at = np.concatenate([[0], np.cumsum(self.alive)])  # where each step's tokens begin
        step = np.repeat(np.arange(steps), self.alive)
        row = np.arange(self.at[-1]) - self.at[step]
        self.tokens = runs.first[self.order][row] + step  # the token at each place
        self.last = self.at[np.maximum(size - 1, 0)] + np.arange(len(size))  # the place of each run's last token
        self.follows = self.at[np.minimum(step + 1, steps)] + row  # the place of the next token in the run
        self.inner = step + 1 < size[row]  # whether there is one

    def alphas(self, enter: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward values of all tokens (if they are kept), those of each run's last token, and the logarithms taken out."""
        out = np.empty_like(emit) if keep else emit[:0]
        last, logs, state = np.empty_like(enter), np.zeros(len(enter)), enter
        ones = np.ones(enter.shape[1], emit.dtype)
        for t, n in enumerate(self.alive.tolist()):
            a = self.at[t]
            state = (state[:n] @ move if t else state) * emit[a : a + n]
            if t % SCALED == SCALED - 1:
                scale = state @ ones
                logs[:n] += np.log(scale, dtype=np.float64)
                state /= scale[:, None]
            if keep:
                out[a : a + n] = state
            stop = self.alive[t + 1] if t + 1 < len(self.alive) else 0
            last[stop:n] = state[stop:]
        return out, last, logs

    def matrices(self, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transfer matrix of each run, its own first token included, and the logarithms taken out."""
        k, count = len(move), len(self.order)
        out, logs = np.empty((count, k, k), emit.dtype), np.zeros(count)
        own = np.zeros((count, k, k), emit.dtype)
        own[:, np.arange(k), np.arange(k)] = emit[:count]
        ones = np.ones(k * k, emit.dtype)
        for t, n in enumerate(self.alive.tolist()):
            own = own[:n]
            if t:
                own = (own.reshape(-1, k) @ move).reshape(n, k, k) * emit[self.at[t] : self.at[t] + n][:, None, :]
            if t % SCALED == SCALED - 1:
                scale = own.reshape(n, -1) @ ones
                logs[:n] += np.log(scale, dtype=np.float64)
                own /= scale[:, None, None]
            stop = self.alive[t + 1] if t + 1 < len(self.alive) else 0
            out[stop:n] = own[stop:]
        return out, logs

    def betas(self, leave: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
        """Backward values of all tokens, from those of each run's last token."""
        out = np.empty_like(emit)
        out[self.last] = leave
        back_move, ones = np.ascontiguousarray(move.T), np.ones(len(move), emit.dtype)
        for t in range(len(self.alive) - 2, -1, -1):
            m, after = int(self.alive[t + 1]), int(self.at[t + 1])
            mine = (out[after : after + m] * emit[after : after + m]) @ back_move
            if t % SCALED == 0:
                mine /= (mine @ ones)[:, None]
            out[self.at[t] : self.at[t] + m] = mine
        return out


class Passes(NamedTuple):
    """Forward passes over texts: first runs as vectors, later ones as matrices until the states that enter them are known."""

    total: np.ndarray  # log likelihood of each text
    runs: Runs
    heads: Grid
    later: Grid
    enter: np.ndarray  # states that enter each run, by run
    matrix: np.ndarray  # of later runs, by run
    alphas: np.ndarray  # of first runs' tokens, in their grid


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, classes: np.ndarray, bounds: np.ndarray, run: int, keep: bool = False) -> Passes:
    """emit: by class, the largest of each class about 1 (see `level`), so that scaling every SCALED steps suffices."""
    k, runs = len(start), runs_of(bounds, run)
    total = np.zeros(len(runs.parts))
    enter = np.tile(start.astype(emit.dtype), (len(runs.first), 1))
    matrix = np.zeros((len(runs.first), k, k), emit.dtype)
    heads, later = Grid(runs, np.flatnonzero(runs.nth == 0)), Grid(runs, np.flatnonzero(runs.nth > 0))
    alphas, last, logs = heads.alphas(enter[heads.order], move, emit[classes[heads.tokens]], keep)
    text = runs.text[heads.order]
    scale = last.sum(axis=1)
    total[text] += logs + np.log(scale, dtype=np.float64)
    more = runs.parts[text] > 1
    enter[heads.order[more] + 1] = (last[more] / scale[more, None]) @ move
    if len(later.order):
        by_run = np.zeros(len(runs.first))
        matrix[later.order], by_run[later.order] = later.matrices(move, emit[classes[later.tokens]])
        for nth in range(1, int(runs.parts.max())):
            at = runs.head[runs.parts > nth] + nth
            state = np.einsum("ri,rij->rj", enter[at], matrix[at])
            scale = state.sum(axis=1)
            total[runs.text[at]] += np.log(scale, dtype=np.float64) + by_run[at]
            on = runs.parts[runs.text[at]] > nth + 1
            enter[at[on] + 1] = (state[on] / scale[on, None]) @ move
    return Passes(total, runs, heads, later, enter, matrix, alphas)


def level(emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions over their largest in any state, and the logarithms of these."""
    top = emit.max(axis=1)
    return emit / top[:, None], np.log(top)


def posteriors(start: np.ndarray, move: np.ndarray, emit: np.ndarray, classes: np.ndarray, bounds: np.ndarray, run: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood of texts, tokens in some order, each one's states in that order, and expected moves: forward and backward."""
    made = forward(start, move, emit, classes, bounds, run, True)
    runs, k = made.runs, len(start)
    leave = np.ones((len(runs.first), k), emit.dtype)  # backward values of each run's last token
    for nth in range(int(runs.parts.max()) - 1 if len(runs.parts) else 0, 0, -1):
        at = runs.head[runs.parts > nth] + nth
        back = np.einsum("rij,rj->ri", made.matrix[at], leave[at]) @ move.T
        leave[at - 1] = back / back.sum(axis=1)[:, None]
    ones, moves = np.ones(k, emit.dtype), np.zeros((k, k))

    def moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        weight = ((before @ move) * after) @ ones
        return (before / weight[:, None]).T @ after * move

    tokens, gammas = [], []
    ends, begins = np.empty((len(runs.first), k), emit.dtype), np.empty((len(runs.first), k), emit.dtype)
    for grid, alpha in ((made.heads, made.alphas), (made.later, None)):
        own = emit[classes[grid.tokens]]
        if alpha is None:
            alpha, _, _ = grid.alphas(made.enter[grid.order], move, own, True)
        beta = grid.betas(leave[grid.order], move, own)
        gamma = alpha * beta
        gamma /= (gamma @ ones)[:, None]
        own *= beta
        moves += moved(alpha[grid.inner], own[grid.follows[grid.inner]])
        ends[grid.order], begins[grid.order] = alpha[grid.last], own[: len(grid.order)]
        tokens.append(grid.tokens), gammas.append(gamma)
    inner = np.flatnonzero(runs.nth > 0)  # from each run's last token to the next run's first
    moves += moved(ends[inner - 1], begins[inner])
    return float(made.total.sum()), np.concatenate(tokens), np.concatenate(gammas), moves


def _round(model: Model, rows: DataFrame, run: int) -> tuple[Model, float]:
    """One round: expected counts per task, summed by class. The new model, and the old one's log likelihood."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    states, n = len(model.start), len(model.emit)
    names = ["class", *(f"s{k}" for k in range(states))]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table, move = own.classes(), own.move.astype(np.float32)
        emit, tops = level(own.emit)
        emit = emit.astype(np.float32)
        sums, start, moves, likelihood = np.zeros((n, states)), np.zeros(states), np.zeros((states, states)), 0.0
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                tokens = tokens_of(part.column(0))
                at = class_of(tokens, table, len(own.names))
                more, places, gamma, pairs = posteriors(own.start.astype(np.float32), move, emit, at, tokens.bounds, run)
                there = at[places]
                for k in range(states):
                    sums[:, k] += np.bincount(there, gamma[:, k], n)
                start += gamma[: len(tokens.bounds) - 1].sum(axis=0)  # the first tokens of all texts come first
                moves += pairs
                likelihood += more + float(tops[at].sum())
        # Below the classes: the start, a row for each state's moves, and the likelihood.
        rest = np.concatenate([start[None], moves, np.full((1, states), likelihood)])
        some = np.flatnonzero(sums.any(axis=1))
        at = np.concatenate([some, -1 - np.arange(len(rest))])
        rows = np.concatenate([sums[some], rest])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(rows[:, k]) for k in range(states))], names)

    schema = "class long, " + ", ".join(f"{c} double" for c in names[1:])
    counts = rows.select("text").mapInArrow(work, schema).groupBy("class").agg(*(F.sum(c).alias(c) for c in names[1:]))
    found = np.zeros((n + states + 2, states))
    for r in counts.collect():  # classes x states numbers
        found[r["class"]] = r[1:]
    start, move, emit = found[-1] + _ENTRY, found[-1 - states : -1][::-1] + _ENTRY, found[:n] + _ENTRY
    better = model._replace(start=start / start.sum(), move=move / move.sum(axis=1, keepdims=True), emit=emit / emit.sum(axis=0))
    return better, float(found[-2 - states][0])


def _word_states(model: Model, rows: DataFrame, run: int) -> DataFrame:
    """(h, c, p): of every word its count and the 8-bit shares of its occurrences in each state, packed."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)
    names = ["h", "c", *(f"s{k}" for k in range(states))]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        table, emit, move = own.classes(), level(own.emit)[0].astype(np.float32), own.move.astype(np.float32)
        sums = _Sums(1 + states)

        def out() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, np.uint64), *sums.keys]).view(np.int64)
            columns = [pa.array(keys), pa.array(sums.sums[:, 0].astype(np.int64)), *(pa.array(sums.sums[:, 1 + k].astype(np.float32)) for k in range(states))]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                tokens = tokens_of(part.column(0))
                _, places, gamma, _ = posteriors(own.start.astype(np.float32), move, emit, class_of(tokens, table, len(own.names)), tokens.bounds, run)
                sums.add(tokens.keys[places], None, *gamma.T)
                if sums.full():
                    yield out()
                    sums = _Sums(1 + states)
        yield out()

    schema = "h long, c long, " + ", ".join(f"{c} float" for c in names[2:])
    made = rows.select("text").mapInArrow(work, schema).groupBy("h").agg(F.sum("c").alias("c"), *(F.sum(c).alias(c) for c in names[2:]))
    packed = F.lit(0).cast("long")
    for k, c in enumerate(names[2:]):
        packed = packed.bitwiseOR(F.shiftleft(F.round(F.col(c) / F.col("c") * 255).cast("long"), 8 * k))
    return made.select("h", "c", packed.alias("p"))


def unpacked(packed: np.ndarray, states: int) -> np.ndarray:
    """Shares of states, each row summing to 1."""
    out = (packed[:, None] >> (8 * np.arange(states)) & 255).astype(float)
    return out / np.maximum(out.sum(axis=1), 1)[:, None]


class Trained(NamedTuple):
    model: Model
    words: DataFrame  # (h, c, p) of all training words
    tokens: int  # N
    distinct: int  # V
    share: np.ndarray  # of each state among all training tokens
    history: list[float]  # log likelihood of a token by round


def train(rows: DataFrame, states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS, run: int = RUN) -> Trained:
    """rows(text): the training texts."""
    if states > 7:
        raise ValueError("at most 7 states: a word's shares are packed into one long")
    counts = settled(word_counts(rows), "counts")
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    top = sorted(_frequent(counts, classes).select("h", "c", "shape", "tail").collect(), key=lambda r: (-r["c"], r["h"]))
    known = np.array([r["c"] for r in top], float)
    shared = np.zeros(2 * LENGTHS)
    for r in counts.groupBy("shape").agg(F.sum("c").alias("c")).collect():
        shared[r["shape"]] = r["c"]
    for r in top:
        shared[r["shape"]] -= r["c"]
    drop(counts)
    names = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    model = first_model(names, np.concatenate([known, shared]), np.array([r["tail"] for r in top], np.int64), states)
    history: list[float] = []
    for _ in range(rounds if total else 0):
        better, likelihood = _round(model, rows, run)
        history.append(likelihood / total)
        model = better
        if len(history) > 1 and history[-1] - history[-2] < GAIN:
            break
    words = settled(_word_states(model, rows, run), "words")
    sums = [F.shiftright("p", 8 * k).bitwiseAND(F.lit(255)) for k in range(states)]
    parts = [F.sum(F.col("c") * x / F.greatest(sum(sums[1:], sums[0]), F.lit(1))) for x in sums]
    share = np.array([x or 0.0 for x in words.agg(*parts).first()])
    return Trained(model, words, int(total or 0), int(distinct or 0), share / max(1, int(total or 0)), history)


def emissions(counts: np.ndarray, packed: np.ndarray, trained_share: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """b_k(w) of words by count (0: unknown) and packed shares: words x states."""
    share = np.maximum(trained_share, 1e-12)
    tilt = np.where(counts[:, None] > 0, (1 - FLAT) * unpacked(packed, len(share)) / share + FLAT, 1)
    return (counts[:, None] * tilt + 0.5) / (total + 0.5 * (distinct + 1))


def _bundles(docs: DataFrame) -> DataFrame:
    """(bundle, keys, ids, blob): texts in bundles; keys: hashes of a bundle's distinct words; blob: its tokens by their
    place in keys, and how many each text has."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, ids, at, sizes, held = _Sums(0), [], [], [], 0
        pack = zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            keys = np.concatenate([np.zeros(0, np.uint64), *sums.keys]).view(np.int64)
            size, own = np.concatenate(sizes).astype("<i8"), np.concatenate(at).astype("<i4")
            blob = pack.compress(np.int64(len(size)).tobytes() + size.tobytes() + own.tobytes())
            columns = [pa.array([keys], pa.list_(pa.int64())), pa.array([[x for part in ids for x in part]], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["keys", "ids", "blob"])

        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                tokens = tokens_of(part.column(1))
                sums.add(tokens.keys)
                ids.append(part.column(0).to_pylist()), at.append(sums.codes.find(tokens.keys)), sizes.append(np.diff(tokens.bounds))
                held += part.column(1).nbytes
                if held > BUNDLE_BYTES:
                    yield out()
                    sums, ids, at, sizes, held = _Sums(0), [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "keys array<long>, ids array<long>, blob binary").withColumn("bundle", F.monotonically_increasing_id())


def score(docs: DataFrame, trained: Trained, run: int = 2 * RUN) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; base-10 logarithms."""
    bundles = settled(_bundles(docs), "bundles")
    words = bundles.select("bundle", F.explode("keys").alias("h")).join(trained.words, "h", "left")
    words = words.groupBy("bundle").agg(F.collect_list("h").alias("hs"), F.collect_list(F.coalesce("c", F.lit(0))).alias("cs"), F.collect_list(F.coalesce("p", F.lit(0))).alias("ps"))
    start, move, share, total, distinct = trained.model.start, trained.model.move, trained.share, trained.tokens, trained.distinct
    states = len(start)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                known, counts, packed, keys = (batch.column(j)[k].values.to_numpy() for j in range(4))
                order = np.argsort(known)
                place = order[np.searchsorted(known, keys, sorter=order)]
                yield from scored(batch.column(4)[k].values, batch.column(5)[k].as_py(), counts[place], packed[place])

    def scored(ids: pa.Array, blob: bytes, counts: np.ndarray, packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, tokens = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i4", -1, 8 + 8 * n)
        emit, tops = level(emissions(counts, packed, share, total, distinct))
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 250_000, "right")) - 1)
            own, inner = tokens[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
            log = forward(start, move, emit, own, inner, run).total
            text = np.repeat(np.arange(b - a), np.diff(inner))
            log += np.bincount(text, tops[own], b - a)
            n_known = np.bincount(text, counts[own] > 0, b - a).astype(np.int64)
            columns = [ids.slice(a, b - a), pa.array(np.diff(inner)), pa.array(n_known), pa.array(np.bincount(text, base[own], b - a)), pa.array(log / math.log(10))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])
            a = b

    both = words.join(bundles, "bundle").select("hs", "cs", "ps", "keys", "ids", "blob")
    made = both.mapInArrow(work, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return made.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
