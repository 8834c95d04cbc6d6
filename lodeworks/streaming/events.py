"""Event-driven operators: rate limits, expiry, webhook filters, windows. Batch replays share their rules with the streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PULL_ACTIONS = ["opened", "synchronize", "reopened", "open", "update"]
MAIN_BRANCHES = ["main", "master", "develop"]


def admitted(times: list[float], accepted: list[float], most: int, seconds: float) -> list[bool]:
    """Which requests of one id pass: at most `most` accepted ones in the window before; refused ones don't count.

    accepted holds the accepted times so far and is brought up to date.
    """
    out = []
    for t in times:
        while accepted and accepted[0] <= t - seconds:
            accepted.pop(0)
        ok = len(accepted) < most
        if ok:
            accepted.append(t)
        out.append(ok)
    return out


def rate_limited(requests: DataFrame, most: int = 100, seconds: float = 3600.0) -> DataFrame:
    """Adds `accepted` to requests(id, request, at): greedy state, so one id's requests are replayed in order."""

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "request"])
        return frame.assign(accepted=admitted(frame["at"].tolist(), [], most, seconds))

    rows = requests.select("id", "request", "at")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", accepted boolean"
    return rows.groupBy("id").applyInPandas(replay, schema)


def rate_limited_stream(requests: DataFrame, most: int = 100, seconds: float = 3600.0) -> DataFrame:
    """The same over a stream requests(id string, request long, at double), its accepted times held as state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "request"])
        ok = admitted(rows["at"].tolist(), kept, most, seconds)
        state.update((kept,))
        yield rows.assign(id=key[0], accepted=ok)[["id", "request", "at", "accepted"]]

    return requests.groupBy("id").applyInPandasWithState(step, "id string, request long, at double, accepted boolean", "kept array<double>", "append", "NoTimeout")


def triggering(events: DataFrame) -> DataFrame:
    """Webhook events that start an analysis: pull requests with certain actions, pushes to main branches."""
    pull = (F.col("event") == "pull_request") & F.col("action").isin(*PULL_ACTIONS)
    push = (F.col("event") == "push") & F.regexp_extract("ref", r"([^/]*)$", 1).isin(*MAIN_BRANCHES)
    return events.filter(pull | push)


def webhook_stream(spark, folder: str) -> DataFrame:
    """JSON files that appear in a folder, as webhook events that start an analysis."""
    return triggering(spark.readStream.schema("event string, action string, ref string, repository string, delivered timestamp").json(folder))


def expired(rows: DataFrame, at: str, as_of, hours: float) -> DataFrame:
    """Rows whose time is more than so many hours before as_of."""
    return rows.filter(F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) > int(hours * 3_600_000_000))


def changed_files(now: DataFrame, cached: DataFrame, as_of=None, hours: float | None = None, force: bool = False) -> DataFrame:
    """Files of now(path, sha) that cached(path, sha, analyzed_at) lacks with this content, or has only expired; all of them by force."""
    if force:
        return now
    if as_of is not None and hours is not None:
        cached = cached.join(expired(cached, "analyzed_at", as_of, hours).select("path", "sha"), ["path", "sha"], "left_anti")
    return now.join(cached.select("path", "sha"), ["path", "sha"], "left_anti")


def sessions(events: DataFrame, minutes: int, key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events with gaps below so many minutes; works on batches and watermarked streams."""
    window = F.session_window(F.col(at).cast("timestamp"), f"{minutes} minutes")
    rows = events.groupBy(F.col(key), window.alias("w")).agg(F.count("*").alias("n"), F.max(F.col(at).cast("timestamp")).alias("last"))
    return rows.select(key, F.col("w.start").alias("start"), "last", "n")


def tumbling(events: DataFrame, length: str, at: str = "ts", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window; with `late` a watermark, for streams."""
    rows = events.withColumn("at", F.col(at).cast("timestamp"))
    if late:
        rows = rows.withWatermark("at", late)
    grouped = rows.groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def running_mean(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds the mean of all values of a key so far."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mean_so_far", F.avg(value).over(so_far))


def hmac_sha256(body: Column, key: bytes) -> Column:
    """Lower-case hex of the keyed digest of a string column, by two nested digests of padded keys."""
    own = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in own)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))), 256)


def is_signed(body: Column, signature: Column, key: bytes) -> Column:
    """Whether a webhook's signature header fits its body."""
    return F.coalesce(signature == F.concat(F.lit("sha256="), hmac_sha256(body, key)), F.lit(False))
