"""Change-history analytics over commits(hash, author, date, file, added, deleted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.sources.scratch import settled

DAY_MICROS = 86_400_000_000
BUCKETS = 1000


def file_churn(commits: DataFrame, least_commits: int = 1) -> DataFrame:
    """Per file: commits, authors, first and last date, commits a day (whole 24-hour spans, one at least), lines changed."""
    days = F.floor((F.unix_micros(F.max("date")) - F.unix_micros(F.min("date"))) / DAY_MICROS)
    rows = commits.groupBy("file").agg(
        F.count("*").alias("total_commits"), F.countDistinct("author").alias("unique_authors"),
        F.min("date").alias("first_commit"), F.max("date").alias("last_commit"), F.greatest(days, F.lit(1)).alias("days"),
        F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"),
    )
    rows = rows.filter(F.col("total_commits") >= least_commits)
    return rows.withColumn("change_frequency", F.col("total_commits") / F.col("days"))


def complexity_scores(functions: DataFrame, files: DataFrame) -> DataFrame:
    """(file, complexity): mean over functions(file, complexity), else lines / 100 of files(file, line_count)."""
    means = functions.groupBy("file").agg(F.avg("complexity").alias("mean"))
    return files.join(means, "file", "left").select("file", F.coalesce("mean", F.col("line_count") / 100).alias("complexity"))


def hotspot_scores(churn: DataFrame, complexity: DataFrame) -> DataFrame:
    """Full outer join; both sides scaled by their largest value, the score is their product's root mean."""
    top = churn.agg(F.max("change_frequency").alias("top_frequency"), F.max("total_commits").alias("top_commits"))
    most = complexity.agg(F.max("complexity").alias("top_complexity"))
    rows = churn.select("file", "total_commits", "change_frequency").join(complexity, "file", "full").crossJoin(top).crossJoin(most)  # one row each
    share = lambda x, m: F.coalesce(F.col(x) / F.nullif(F.col(m), F.lit(0)), F.lit(0.0))
    rows = rows.withColumn("churn_score", 0.5 * share("change_frequency", "top_frequency") + 0.5 * share("total_commits", "top_commits"))
    rows = rows.withColumn("complexity_score", share("complexity", "top_complexity"))
    return rows.select("file", "churn_score", "complexity_score", (0.5 * F.col("churn_score") + 0.5 * F.col("complexity_score")).alias("hotspot_score"))


def marked_hotspots(scores: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds threshold and is_hotspot: the value at place floor(n (1 - share)) of the scores in descending order.

    The place is found first among BUCKETS equal parts of the scores from 0 to 1, then inside the part that holds it: no window
    sees more than these or that part's distinct scores.
    """
    counts = scores.groupBy("hotspot_score").agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("hotspot_score") * BUCKETS))
    total = scores.agg(F.floor(F.count("*") * (F.lit(1.0) - F.lit(share))).alias("place"))
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("inside"))
    sums = sums.withColumn("upto", F.sum("inside").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)))
    part = sums.crossJoin(total).filter(F.col("upto") > F.col("place")).orderBy(F.desc("bucket")).limit(1).select("bucket", "place", (F.col("upto") - F.col("inside")).alias("before"))
    ahead = Window.partitionBy("bucket").orderBy(F.desc("hotspot_score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(part, "bucket").withColumn("upto", F.col("before") + F.sum("n").over(ahead)).filter(F.col("upto") > F.col("place"))
    threshold = ranked.agg(F.max("hotspot_score").alias("threshold"))
    return scores.crossJoin(threshold).withColumn("is_hotspot", F.col("hotspot_score") >= F.col("threshold"))


def share_threshold(rows: DataFrame, column: str, share: float = 0.8) -> DataFrame:
    """One row (column): the value at place floor(n (1 - share)) of all known ones in descending order, null without any.

    As marked_hotspots, over values of any size: they are scaled to the range that they have. Reads rows several times.
    """
    known = rows.filter(F.col(column).isNotNull())
    ends = known.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    scaled = F.coalesce((F.col(column) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)), F.lit(0.0))
    scores = known.crossJoin(ends).select(F.col(column).alias("value"), scaled.alias("hotspot_score"))  # one row
    return marked_hotspots(scores, share).filter("is_hotspot").agg(F.min("value").alias(column))


def hotspot_kinds(scores: DataFrame, churn: DataFrame, complexity: DataFrame, share: float = 0.8) -> DataFrame:
    """(file, is_hotspot, is_complex, is_busy): files in the top share by hotspot score, by complexity and by change frequency."""
    rows = scores.select("file", "hotspot_score").join(complexity.select("file", "complexity"), "file", "left").join(churn.select("file", "change_frequency"), "file", "left")
    rows = settled(rows, "hotspots")  # read for each threshold
    names = {"hotspot_score": "is_hotspot", "complexity": "is_complex", "change_frequency": "is_busy"}
    marked = rows
    for column in names:
        marked = marked.crossJoin(share_threshold(rows, column, share).withColumnRenamed(column, f"least_{column}"))  # one row
    return marked.select("file", *(F.coalesce(F.col(c) >= F.col(f"least_{c}"), F.lit(False)).alias(name) for c, name in names.items()))


def timeline(churn: DataFrame) -> DataFrame:
    return churn.select("file", "first_commit", "last_commit", "days", "total_commits").orderBy("first_commit", "file")


def advice(churn: DataFrame) -> DataFrame:
    """(file, advice): which advice holds for a file."""
    rules = [F.when(F.col("change_frequency") > 0.1, "stabilise"), F.when(F.col("unique_authors") > 5, "assign_owner"), F.when(F.col("total_commits") > 10, "review_design")]
    return churn.select("file", F.explode(F.array_compact(F.array(*rules))).alias("advice"))
