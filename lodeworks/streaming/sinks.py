"""Sinks that write nothing twice, review and status payloads, batches of analyses, and progress as rows.

A ledger sink writes each micro-batch to a folder of its own and then notes its id. A batch that failed half-way is written again
from the start; one that is noted is left alone. Readers see noted batches only, so what a crash left behind never shows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class Ledger:
    """Folders `batches/<id>` and a note `ledger/<id>` for each that is whole, in any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def noted(self, batch: int) -> bool:
        system, place = self._place(f"ledger/{batch}")
        return system.exists(place)

    def note(self, batch: int) -> None:
        system, place = self._place(f"ledger/{batch}")
        system.create(place, True).close()

    def batches(self) -> list[int]:
        system, place = self._place("ledger")
        return sorted(int(s.getPath().getName()) for s in system.listStatus(place)) if system.exists(place) else []

    def read(self, schema: str) -> DataFrame:
        """Rows of all noted batches."""
        folders = [f"{self.path}/batches/{b}" for b in self.batches()]
        return self.spark.read.schema(schema).json(folders) if folders else self.spark.createDataFrame([], schema)


def ledger_sink(spark: SparkSession, path: str, made: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: rows that `made` makes of a batch are written once, however often the batch comes."""
    ledger = Ledger(spark, path)

    def write(batch: DataFrame, number: int) -> None:
        if not ledger.noted(number):
            made(batch).write.mode("overwrite").json(f"{ledger.path}/batches/{number}")
            ledger.note(number)

    return write


# Payloads for a code host.


def review_payload(event: Column, body: Column, comments: Column) -> Column:
    """JSON of a review. comments: array of (path, body, line, side, start_line, start_side); starts only where there is one."""
    start = lambda c: c["start_line"].isNotNull() & (c["start_line"] != 0)
    one = lambda c: F.struct(
        c["path"].alias("path"), c["body"].alias("body"), c["line"].alias("line"), c["side"].alias("side"), F.when(start(c), c["start_line"]).alias("start_line"),
        F.when(start(c), F.coalesce(F.nullif(c["start_side"], F.lit("")), c["side"])).alias("start_side"),
    )
    return F.to_json(F.struct(event.alias("event"), F.coalesce(body, F.lit("")).alias("body"), F.transform(comments, one).alias("comments")))


def status_payload(state: Column, description: Column, context: Column, target: Column) -> Column:
    """JSON of a commit's status; an empty target is left out."""
    return F.to_json(F.struct(state.alias("state"), description.alias("description"), context.alias("context"), F.nullif(target, F.lit("")).alias("target_url")))


MOST_COMMENTS = 20


def review_requests(issues: DataFrame, most: int = MOST_COMMENTS) -> DataFrame:
    """(owner, repo, number, path, payload): the review and the status that issues(owner, repo, number, sha, id, severity, priority,
    file_path, line_start, title) of each pull request ask for; its `most` first issues become comments."""
    critical, high = (F.count_if(F.col("severity") == s) for s in ("critical", "high"))
    comment = F.struct(
        (-F.col("priority")).alias("rank"), "id", F.struct(F.col("file_path").alias("path"), F.col("title").alias("body"), F.col("line_start").alias("line"),
        F.lit("RIGHT").alias("side"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("string").alias("start_side")).alias("comment"),
    )
    key = ["owner", "repo", "number"]
    place = F.row_number().over(Window.partitionBy(*key, "sha").orderBy(F.desc("priority"), "id"))
    ranked = issues.withColumn("comment", F.when(place <= most, comment)).groupBy(*key, "sha").agg(F.count("*").alias("n"), critical.alias("n_critical"), high.alias("n_high"), F.sort_array(F.collect_list("comment")).alias("first"))
    event = F.when(F.col("n_critical") > 0, "REQUEST_CHANGES").when(F.col("n_high") > 0, "COMMENT").otherwise("APPROVE")
    state = F.when(F.col("n_critical") > 0, "failure").when(F.col("n_high") > 0, "pending").otherwise("success")
    said = F.concat(F.col("n").cast("string"), F.lit(" issues, "), F.col("n_critical").cast("string"), F.lit(" critical, "), F.col("n_high").cast("string"), F.lit(" high"))
    place = F.concat(F.lit("/repos/"), "owner", F.lit("/"), "repo")
    review = F.struct(F.concat(place, F.lit("/pulls/"), F.col("number").cast("string"), F.lit("/reviews")).alias("path"), review_payload(event, said, F.transform("first", lambda c: c["comment"])).alias("payload"))
    status = F.struct(F.concat(place, F.lit("/statuses/"), "sha").alias("path"), status_payload(state, said, F.lit("code-quality"), F.lit("")).alias("payload"))
    return ranked.select(*key, F.explode(F.array(review, status)).alias("r")).select(*key, "r.path", "r.payload")


# Batches of analyses.

OUTCOME = "batch string, repository string, ok boolean, result string, error string"


def batch_outcomes(files: DataFrame, analyze: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """One row for each repository of files(batch, repository, ...): its analysis as JSON, or the error that ended it.

    An analysis that fails is a row, not a failed job; the others go on.
    """

    def guarded(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            row = (*key, True, json.dumps(analyze(frame), sort_keys=True), None)
        except Exception as error:  # whatever an analysis raises is its outcome
            row = (*key, False, None, f"{type(error).__name__}: {error}")
        return pd.DataFrame([row], columns=["batch", "repository", "ok", "result", "error"])

    return files.groupBy("batch", "repository").applyInPandas(guarded, OUTCOME)


def batch_status(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(batch, total, completed, failed, status) of requests(batch, repository): a repository without an outcome is pending yet."""
    rows = requests.select("batch", "repository").distinct().join(outcomes.select("batch", "repository", "ok"), ["batch", "repository"], "left")
    sums = rows.groupBy("batch").agg(F.count("*").alias("total"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"))
    done = F.col("completed") + F.col("failed")
    return sums.withColumn("status", F.when(done == F.col("total"), "completed").when(done > 0, "running").otherwise("pending"))


# Progress.

PROGRESS = "query string, batch long, at string, rows_in long, rows_total long, percent double, status string, error string"


class ProgressWriter(StreamingQueryListener):
    """Writes a row of JSON for the start, each progress and the end of every query that has a name of its own.

    total: rows that are expected in all, for the percentage; None if that isn't known.
    """

    def __init__(self, spark: SparkSession, path: str, total: int | None = None):
        self.spark, self.path, self.total = spark, path, total
        self.names: dict[str, str] = {}
        self.rows: dict[str, int] = {}

    def _write(self, name: str, batch: int | None, at: str, rows: int, status: str, error: str | None = None) -> None:
        done = self.rows[name] = self.rows.get(name, 0) + rows
        percent = min(100.0, 100.0 * done / self.total) if self.total else None
        row = (name, batch, at, rows, done, 100.0 if status == "completed" else percent, status, error)
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").json(self.path)

    def onQueryStarted(self, event) -> None:
        if event.name:
            self.names[str(event.runId)] = event.name
            self._write(event.name, None, event.timestamp, 0, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name and p.numInputRows:
            self._write(p.name, p.batchId, p.timestamp, p.numInputRows, "running")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), None)
        if name:
            self._write(name, None, "", 0, "failed" if event.exception else "completed", event.exception)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(path)
