"""Sources and sinks: code trees, git logs, snapshots, known vulnerabilities, issue files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import language, matches_any
from lodeworks.sources.gitlog import HEADER, STAT, carried, commit_rows, lines_of

MAX_BYTES = 10 << 20
ISSUE_COLUMNS = ["id", "category", "severity", "title", "description", "file_path", "line_start", "line_end", "confidence", "suggestion"]


def read_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, most: int = MAX_BYTES) -> DataFrame:
    """(path, language, content, size_bytes, last_modified) of the text files of a tree.

    Excludes come first, then includes; too large files and files with NUL bytes are left out. Bytes that aren't UTF-8
    are read as ISO-8859-1.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = raw.filter(F.col("length") <= most)  # before content is read
    if exclude:
        rows = rows.filter(~matches_any(F.col("path"), exclude))
    if include:
        rows = rows.filter(matches_any(F.col("path"), include))
    rows = rows.filter(~F.contains("content", F.lit(bytearray(b"\x00"))))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return rows.select("path", language(F.col("path")).alias("language"), text.alias("content"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"))


def parse_git_log(lines: DataFrame) -> DataFrame:
    """commits from lines(log, line_no, line) of `git log --numstat` with hash|author|date|subject headers.

    The header is carried forward inside each log; '-' counts of binary files are 0.
    """
    order = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.last(F.when(F.col("line").rlike(HEADER), F.col("line")), ignorenulls=True).over(order))
    stat = F.split("line", "\t", 3)
    count = lambda k: F.coalesce(stat[k].try_cast("long"), F.lit(0)).alias("deleted" if k else "added")
    return commit_rows(rows.filter(F.col("line").rlike(STAT) & F.col("head").isNotNull()).select("head", stat[2].alias("file"), count(0), count(1)))


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Exported logs of any store that Spark reads; a log may be cut into many splits."""
    return commit_rows(carried(lines_of(spark, path)))


def read_vulnerabilities(spark: SparkSession, path: str, key: str = "vulnerabilities") -> DataFrame:
    """Entries of a JSON document's array."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(key).alias("v")).select("v.*")


def save_snapshot(issues: DataFrame, path: str, codebase: str, version: str) -> None:
    rows = issues.withColumn("codebase", F.lit(codebase)).withColumn("version", F.lit(version)).withColumn("taken_at", F.current_timestamp())
    rows.write.mode("append").partitionBy("codebase", "version").parquet(path)


def load_snapshot(spark: SparkSession, path: str, codebase: str, version: str | None = None) -> DataFrame:
    """The latest snapshot of a codebase, of a version where there is one."""
    rows = spark.read.parquet(path).filter(F.col("codebase") == codebase)
    best = rows.groupBy("version").agg(F.max("taken_at").alias("taken_at")).orderBy(F.desc(F.col("version").cast("string") == F.lit(version or "")), F.desc("taken_at")).limit(1)
    return rows.join(F.broadcast(best), ["version", "taken_at"], "left_semi")  # one row


def write_issues_csv(issues: DataFrame, path: str) -> None:
    issues.select(*ISSUE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def codebase_digest(files: DataFrame) -> DataFrame:
    """(digest): order-free digest of all paths and contents, summed from one hash a file."""
    each = F.conv(F.substring(F.sha2(F.concat_ws("\x00", "path", F.sha2("content", 256)), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return files.agg(F.sha2(F.concat_ws(":", F.count("*"), F.sum(each)), 256).alias("digest"))
