"""Metrics, priorities, summaries and gates over issues(id, category, severity, confidence, file_path, line_start, n_files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.weights import (
    CATEGORIES, DENSITY_WEIGHT, EFFORT_OF_CATEGORY, EFFORT_OF_SEVERITY, GRADE_BANDS, IMPACT_OF_CATEGORY, IMPACT_OF_SEVERITY, PRIORITY_BANDS,
    banded, lookup, severity_rank,
)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def selected(issues: DataFrame, categories: list[str] | None = None, least_severity: str | None = None, least_confidence: float | None = None) -> DataFrame:
    """Optional filters; none is applied unless asked for."""
    if categories is not None:
        issues = issues.filter(F.col("category").isin(*categories))
    if least_severity is not None:
        issues = issues.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(least_severity)))
    if least_confidence is not None:
        issues = issues.filter(F.col("confidence") >= least_confidence)
    return issues


def quality_metrics(issues: DataFrame, files: DataFrame) -> DataFrame:
    """One row from issues and files(line_count, n_elements): density, overall score, debt, maintainability, grade."""
    weight = lookup(DENSITY_WEIGHT, F.col("severity"), 0.0)
    found = issues.agg(F.count("*").alias("n_issues"), F.coalesce(F.sum(weight), F.lit(0.0)).alias("weighted"))
    corpus = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"), F.avg("n_elements").alias("elements"))
    rows = found.crossJoin(corpus)  # one row each
    density = F.coalesce(F.col("weighted") / F.nullif(F.col("n_lines"), F.lit(0)), F.lit(0.0))
    none = F.col("n_issues") == 0
    overall = F.when(none, 100.0).when(F.col("n_lines") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - 1000 * density))
    upkeep = F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), 100 - 2 * F.coalesce("elements", F.lit(0.0)) - F.col("weighted") / 10))
    return rows.select(
        "n_issues", "n_files", F.col("n_lines").cast("long").alias("n_lines"), F.when(none, 0.0).otherwise(density).alias("density"), overall.alias("overall"),
        F.when(none, 0.0).otherwise(1000 * density).alias("technical_debt"), upkeep.alias("maintainability"), banded(overall, GRADE_BANDS, "F").alias("grade"),
    )


def category_scores(issues: DataFrame) -> DataFrame:
    """(category, n, score) for all categories, those without issues too."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = issues.groupBy("category").agg(F.count("*").alias("n"))
    rows = every.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy())  # over the fixed categories
    return rows.select("category", "n", F.greatest(F.lit(0.0), 100 - F.coalesce(100 * F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0))).alias("score"))


def frequency_score(issues: DataFrame) -> DataFrame:
    """Adds frequency: how common an issue's category and severity are together, in steps."""
    counts = issues.groupBy("category", "severity").agg(F.count("*").alias("alike"))
    step = F.when(F.col("alike") <= 1, 1.0).when(F.col("alike") <= 3, 3.0).when(F.col("alike") <= 5, 5.0).when(F.col("alike") <= 10, 7.0).otherwise(10.0)
    return issues.join(counts, ["category", "severity"]).withColumn("frequency", step).drop("alike")  # Spark broadcasts counts if they are few


def prioritized(issues: DataFrame) -> DataFrame:
    """Adds impact, effort, frequency, priority and priority_level. Counts travel, issues don't."""
    severity, category = F.col("severity"), F.col("category")
    spread = F.least(1 + 0.1 * (F.col("n_files") - 1), F.lit(2.0))
    impact = F.least(lookup(IMPACT_OF_SEVERITY, severity, 1.0) * lookup(IMPACT_OF_CATEGORY, category, 1.0) * F.col("confidence") * spread, F.lit(10.0))
    effort = F.least(lookup(EFFORT_OF_CATEGORY, category, 5.0) * lookup(EFFORT_OF_SEVERITY, severity, 1.0), F.lit(10.0))
    rows = frequency_score(issues).withColumn("impact", impact).withColumn("effort", effort)
    rows = rows.withColumn("priority", F.least(F.col("impact") * F.col("frequency") / F.col("effort"), F.lit(10.0)))
    return rows.withColumn("priority_level", banded(F.col("priority"), PRIORITY_BANDS, "Info"))


def top_issues(ranked: DataFrame, k: int = 10) -> DataFrame:
    return ranked.orderBy(F.desc("priority"), "id").limit(k)


def top_files(issues: DataFrame, k: int = 10) -> DataFrame:
    return issues.groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(k)


def summary(ranked: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by category, severity, priority level and file in one pass over the issues."""
    keys = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("category", "severity", "priority_level", "file_path")))
    return ranked.select(F.explode(keys).alias("k")).groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row: n and a count per severity."""
    return issues.agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "medium", "low", "info")))


def quality_gate(issues: DataFrame, metrics: DataFrame, most_high: int = 5, least_score: float = 70.0) -> DataFrame:
    rows = severity_counts(issues).crossJoin(metrics.select("overall"))  # one row each
    gate = F.when(F.col("n_critical") > 0, "fail").when(F.col("n_high") > most_high, "fail").when(F.col("overall") < least_score, "warn").otherwise("pass")
    return rows.select("n_critical", "n_high", "overall", gate.alias("gate"))


def review(issues: DataFrame, changed: DataFrame) -> DataFrame:
    """Decision on a change from the issues in its files(file_path)."""
    rows = severity_counts(issues.join(changed, "file_path", "left_semi"))
    decision = F.when(F.col("n_critical") > 0, "REQUEST_CHANGES").when(F.col("n_high") > 0, "COMMENT").otherwise("APPROVE")
    status = F.when(F.col("n_critical") > 0, "failure").when(F.col("n_high") > 0, "pending").otherwise("success")
    return rows.select("n", "n_critical", "n_high", decision.alias("decision"), status.alias("status"))


def recommendations(issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """(rule): which general recommendations hold."""
    counts = issues.agg(*(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))
    top = issues.groupBy("file_path").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"))
    one = metrics.select("overall", "technical_debt").crossJoin(counts).crossJoin(top)  # one row each
    score = F.when(F.col("overall") < 50, "score_critical").when(F.col("overall") < 70, "score_low").when(F.col("overall") < 85, "score_fair")
    rules = [score, F.when(F.col("technical_debt") > 0.5, "reduce_debt"), F.when(F.col("most") > 10, "focus_top_file")]
    rules += [F.when(F.col(c) > 0, f"address_{c}") for c in CATEGORIES]
    return one.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"))
