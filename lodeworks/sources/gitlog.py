"""Exported git logs as a Spark data source: `spark.read.format("git_log").load(folder)`, or read_commits for whole commits.

A log is cut in byte ranges, each a partition. A range's lines know the header above them only if it stands in the same range;
what a range begins with belongs to the last header of a range before. So each range also tells its last header, and one row a
range, not one window a log, carries headers on. The pure DataFrame way (`lines_of`) cuts where Spark's text reader cuts.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# The forms of a log made with --numstat and --pretty=format:%H|%an|%ad|%s.
HEADER = r"^[0-9a-f]{6,40}\|"
STAT = r"^(\d+|-)\t(\d+|-)\t"
SPLIT_BYTES = 64 << 20
RAW = "log string, part long, head string, last string, file string, added long, deleted long"


class LogRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(start)
        self.path, self.start, self.end = path, start, end


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


class GitLogSource(DataSource):
    """Options: path, a file or folder; pattern, of the files' whole paths; splitBytes. With a schema of fewer columns of RAW only those are made."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: StructType) -> GitLogReader:
        return GitLogReader(self.options, schema)


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.columns = schema.names
        self.pattern = options.get("pattern", "*")

    def partitions(self) -> list[LogRange]:
        from pyarrow import fs

        system, place = _filesystem(self.path)
        found = system.get_file_info(place)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        files = [f for f in files if fnmatchcase(f.path, self.pattern)]
        return [LogRange(f.path, a, min(f.size, a + self.split)) for f in files for a in range(0, f.size, self.split)]

    def read(self, partition: LogRange) -> Iterator[tuple]:
        if not isinstance(partition, LogRange):  # no files
            return
        order = [RAW.split(", ").index(next(c for c in RAW.split(", ") if c.split()[0] == name)) for name in self.columns]
        for row in rows_of(partition.path, partition.start, _lines(self.path, partition)):
            yield tuple(row[k] for k in order)


def _lines(root: str, own: LogRange) -> Iterator[str]:
    """Lines that begin in the range; the one that reaches into it belongs to the range before."""
    system, _ = _filesystem(root)
    with io.BufferedReader(system.open_input_file(own.path), 1 << 20) as f:
        at = own.start
        if at:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        while at < own.end:
            line = f.readline()
            if not line:
                break
            at += len(line)
            yield line.decode("utf-8", "replace").rstrip("\r\n")


def rows_of(log: str, part: int, lines: Iterator[str]) -> Iterator[tuple]:
    """RAW rows: one for each changed file, and one with the last header at the end."""
    header, stat, head = re.compile(HEADER), re.compile(STAT), None
    for line in lines:
        if header.match(line):
            head = line
        elif stat.match(line):
            added, deleted, name = line.split("\t", 2)
            yield log, part, head, None, name, _count(added), _count(deleted)
    yield log, part, None, head, None, None, None


def _count(text: str) -> int:
    return 0 if text == "-" else int(text)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """RAW rows by Spark's text reader, for stores that only Spark reads: a window a split, which its file and first byte name."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")
    )
    so_far = Window.partitionBy("log", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = text.withColumn("head", F.last(F.when(F.col("line").rlike(HEADER), F.col("line")), ignorenulls=True).over(so_far))
    stat, count = F.split("line", "\t", 3), lambda k: F.coalesce(F.split("line", "\t", 3)[k].try_cast("long"), F.lit(0))
    files = rows.filter(F.col("line").rlike(STAT)).select("log", "part", "head", F.lit(None).cast("string").alias("last"), stat[2].alias("file"), count(0).alias("added"), count(1).alias("deleted"))
    ends = rows.groupBy("log", "part").agg(F.max_by("head", "n").alias("last"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    return files.unionByName(ends.select("log", "part", none("head", "string"), "last", none("file", "string"), none("added", "long"), none("deleted", "long")))


def carried(raw: DataFrame) -> DataFrame:
    """(log, head, file, added, deleted): ranges that begin inside a commit get its header from the ranges before."""
    before = Window.partitionBy("log").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = raw.filter("file IS NULL").select("log", "part", F.last("last", ignorenulls=True).over(before).alias("above"))
    rows = raw.filter("file IS NOT NULL").join(ends, ["log", "part"])
    return rows.select("log", F.coalesce("head", "above").alias("head"), "file", "added", "deleted").filter("head IS NOT NULL")


def commit_date(text: Column) -> Column:
    """Times as git's --date=iso and ISO 8601 write them; null for others."""
    return F.try_to_timestamp(F.regexp_replace(text, r"\s+([+-]\d)", "$1"))


def commit_rows(rows: DataFrame) -> DataFrame:
    """(hash, author, date, message, file, added, deleted) of rows(head, file, added, deleted); commits with odd dates are left out."""
    head = F.split("head", r"\|", 4)
    made = rows.select(head[0].alias("hash"), head[1].alias("author"), commit_date(head[2]).alias("date"), head[3].alias("message"), "file", "added", "deleted")
    return made.filter("date IS NOT NULL")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLogSource)


def read_commits(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, **options: Any) -> DataFrame:
    """Commits of all logs under a path, a row for each file of a commit."""
    register(spark)
    return commit_rows(carried(spark.read.format("git_log").option("splitBytes", split_bytes).options(**options).load(path)))


def write_log(commits: DataFrame, path: str, log: str = "log") -> None:
    """commits(log, hash, author, date, message, files array<struct<file,added,deleted>>) as one text file a log, in the order of their dates."""
    stats = F.array_join(F.transform("files", lambda f: F.concat_ws("\t", f["added"], f["deleted"], f["file"])), "\n")
    date = F.date_format(F.col("date").cast("timestamp"), "yyyy-MM-dd HH:mm:ss Z")
    text = F.concat(F.concat_ws("|", "hash", "author", date, "message"), F.lit("\n"), stats, F.lit("\n"))
    commits.repartition(log).sortWithinPartitions(log, "date", "hash").select(log, text.alias("value")).write.mode("overwrite").partitionBy(log).text(path)
