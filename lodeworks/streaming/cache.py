"""A result cache as state: lookups that hit or miss, entries that expire, change or are evicted as least recently used.

Requests are either `put` (an analysis of a file's content is stored) or `get` (a lookup with the content that the file has now).
Entries live `ttl` seconds from their storage; a lookup with other content drops its entry; a shard that holds more than
`capacity` entries drops the one used longest ago, of several the smaller key. Requests of a shard count in the order of their
times, then their numbers, however late they come within the watermark: the stream keeps them until the watermark has passed, by
event-time timers, and so gives the rows of a batch replay. A shard is what one task folds; spread keys over enough of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

REQUEST = "shard string, request long, at long, kind string, key string, sha string"  # at: milliseconds
ANSWER = "shard string, request long, kind string, key string, outcome string, evicted string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entry(NamedTuple):
    sha: str
    stored: int
    used: int


class Request(NamedTuple):
    at: int
    request: int
    kind: str
    key: str
    sha: str | None


def answer(entries: dict[str, Entry], own: Request, ttl: int, capacity: int) -> tuple[str, str | None]:
    """Outcome and evicted key of one request; entries are brought up to date. ttl: milliseconds."""
    for key in [k for k, e in entries.items() if own.at - e.stored > ttl]:
        del entries[key]
    if own.kind == "put":
        entries[own.key] = Entry(own.sha, own.at, own.at)
        if len(entries) <= capacity:
            return "stored", None
        oldest = min((k for k in entries if k != own.key), key=lambda k: (entries[k].used, k), default=own.key)
        del entries[oldest]
        return "stored", oldest
    held = entries.get(own.key)
    if held is None:
        return "miss", None
    if held.sha != own.sha:
        del entries[own.key]
        return "changed", None
    entries[own.key] = held._replace(used=own.at)
    return "hit", None


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("string")


def replayed(requests: DataFrame, ttl: float, capacity: int) -> DataFrame:
    """Answers to all of a batch's requests."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        entries: dict[str, Entry] = {}
        frame = frame.sort_values(["at", "request"])
        rows = [answer(entries, Request(*x), int(ttl * 1000), capacity) for x in frame[list(Request._fields)].itertuples(index=False)]
        return frame[["shard", "request", "kind", "key"]].assign(outcome=[r[0] for r in rows], evicted=pd.Series([r[1] for r in rows], dtype=object, index=frame.index))

    return requests.select("shard", "request", "at", "kind", "key", "sha").groupBy("shard").applyInPandas(fold, ANSWER)


class CacheProcessor(StatefulProcessor):
    def __init__(self, ttl: float, capacity: int):
        self.ttl, self.capacity = int(ttl * 1000), capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, request long, kind string, key string, sha string")
        self.entries = handle.getMapState("entries", "key string", "sha string, stored long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for x in frame[list(Request._fields)].itertuples(index=False):
                own = Request(int(x.at), int(x.request), x.kind, x.key, x.sha)
                self.waiting.appendValue(tuple(own))
                self.handle.registerTimer(own.at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Answers everything up to the timer's time; one expiry answers all that wait for it."""
        until = expiredTimerInfo.getExpiryTimeInMs()
        held = [Request(*x) for x in self.waiting.get()] if self.waiting.exists() else []
        now = sorted(x for x in held if x.at <= until)
        if not now:
            return
        later = [tuple(x) for x in held if x.at > until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        before = {k[0]: Entry(*v) for k, v in self.entries.iterator()}
        entries, rows = dict(before), []
        for own in now:
            outcome, evicted = answer(entries, own, self.ttl, self.capacity)
            rows.append((key[0], own.request, own.kind, own.key, outcome, evicted))
        for k in before.keys() - entries.keys():
            self.entries.removeKey((k,))
        for k, e in entries.items():
            if before.get(k) != e:
                self.entries.updateValue((k,), tuple(e))
        yield pd.DataFrame(rows, columns=["shard", "request", "kind", "key", "outcome", "evicted"])

    def close(self) -> None:
        pass


def cached_stream(requests: DataFrame, ttl: float, capacity: int, late: str = "10 minutes") -> DataFrame:
    """Answers to a stream of requests (columns of REQUEST), as soon as the watermark has passed them.

    The session needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass = ROCKS.
    """
    rows = requests.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
    return rows.groupBy("shard").transformWithStateInPandas(CacheProcessor(ttl, capacity), ANSWER, outputMode="Append", timeMode="EventTime")
