"""Summaries that people read: codebase information, analysis summaries, fields of a summary prompt, advice on hotspots, exported scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import suffix

# Names of languages by suffix, orders, texts and their bounds.
LANGUAGE_NAMES = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript"}
SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
VERDICTS = {
    "urgent": "⚠️  Found {} high-priority issues that need immediate attention!",
    "calm": "✅ No critical issues found. Consider addressing medium and low priority items for improved code quality.",
    "none": "🎉 Excellent! No quality issues detected in your codebase.",
}
ALWAYS_SUGGESTED = [
    "Increase test coverage for this critical file", "Add comprehensive documentation", "Consider implementing design patterns to reduce coupling",
    "Monitor this file closely in code reviews",
]
HOTSPOT_TEXTS = {
    "hotspots": "Found {} hotspot files that combine high complexity with frequent changes. These files should be prioritized for refactoring and increased test coverage.",
    "complex": "Identified {} files with high complexity. Consider breaking down large functions and classes to improve maintainability.",
    "busy": "Found {} files with high change frequency. These files may benefit from additional documentation and code reviews.",
    "restless": "Files with very high change frequency ({} files) should be monitored closely and may indicate design issues or unstable requirements.",
    "shared": "Files modified by many developers ({} files) should have clear coding standards and comprehensive documentation.",
}


def filled(text: str, value: Column) -> Column:
    before, after = text.split("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def codebase_info(files: DataFrame) -> DataFrame:
    """(property, value) of files(path, size_bytes): how many there are, languages, size, and a rough estimate of an analysis's time."""
    names = F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair)), suffix(F.col("path")))
    sums = files.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(names)).alias("languages"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    languages = F.when(F.size("languages") > 0, F.array_join("languages", ", ")).otherwise("Unknown")
    size = F.concat(F.format_string("%.1f", F.col("bytes") / 1024.0), F.lit(" KB"))
    seconds = F.concat(F.lit("~"), F.format_string("%.0f", F.bround(F.greatest(F.lit(5.0), F.col("n") * 0.1))), F.lit(" seconds"))
    rows = {"Total Files": F.col("n").cast("string"), "Languages": languages, "Total Size": size, "Estimated Analysis Time": seconds}
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in rows.items()))).alias("r")).select("r.*")


def analysis_summary(issues: DataFrame, metrics: DataFrame) -> DataFrame:
    """(place, metric, value) of issues(category, severity) and one row metrics(n_files, overall, maintainability): the table that is shown,
    categories by name, severities by rank, a verdict last."""
    score = F.when(F.col("overall") <= 0, F.col("maintainability")).otherwise(F.col("overall"))
    urgent = F.count_if(F.col("severity").isin("critical", "high"))
    totals = issues.agg(F.count("*").alias("n"), urgent.alias("urgent")).crossJoin(metrics.select("n_files", score.alias("score")))  # one row each
    verdict = F.when(F.col("n") == 0, VERDICTS["none"]).when(F.col("urgent") > 0, filled(VERDICTS["urgent"], F.col("urgent"))).otherwise(VERDICTS["calm"])
    one = lambda place, metric, value: F.struct(F.lit(place).alias("place"), F.lit(metric).alias("metric"), value.alias("value"))
    rounded = F.concat(F.bround("score").cast("long").cast("string"), F.lit("/100"))
    head = totals.select(F.explode(F.array(
        one(0, "Files Analyzed", F.col("n_files").cast("string")), one(1, "Total Issues", F.col("n").cast("string")), one(2, "Overall Quality Score", rounded), one(200, "Recommendations", verdict),
    )).alias("r")).select("r.*")
    by = lambda c: issues.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").cast("string").alias("value"))
    order = F.row_number().over(Window.orderBy("category"))  # as many rows as there are categories
    categories = by("category").select((order + 2).cast("int").alias("place"), F.concat(F.initcap("category"), F.lit(" Issues")).alias("metric"), "value")
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITY_ORDER)), F.col("severity"))
    severities = by("severity").select((rank + 100).cast("int").alias("place"), F.concat(F.initcap("severity"), F.lit(" Severity")).alias("metric"), "value")
    return head.unionByName(categories).unionByName(severities)


def prompt_fields(issues: DataFrame, k: int = 5) -> DataFrame:
    """(total_issues, issues_by_category, issues_by_severity, top_issues) of issues(id, category, severity, title), as lines of a prompt.

    Kinds stand in the order in which issues by id first have them; the k issues of the highest severity follow, of one severity by id.
    """

    def counted(column: str) -> DataFrame:
        rows = issues.groupBy(column).agg(F.count("*").alias("n"), F.min("id").alias("first"))
        line = F.concat(F.lit("- "), F.col(column), F.lit(": "), F.col("n").cast("string"))
        return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", line.alias("line")))), lambda x: x["line"]), "\n").alias(f"issues_by_{column}"))

    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(s) for s in SEVERITY_ORDER)), F.col("severity")), F.lit(0)), F.lit(len(SEVERITY_ORDER) + 1))
    first = issues.select(rank.alias("rank"), "id", F.concat(F.lit("- "), "title", F.lit(" ("), "severity", F.lit(")")).alias("line")).orderBy("rank", "id").limit(k)
    top = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "line"))), lambda x: x["line"]), "\n").alias("top_issues"))
    return issues.agg(F.count("*").alias("total_issues")).crossJoin(counted("category")).crossJoin(counted("severity")).crossJoin(top)  # one row each


def hotspot_suggestion(frequency: Column, authors: Column, functions: Column, classes: Column, lines: Column) -> Column:
    """What to do about a hotspot; frequency and authors are null where its history isn't known."""
    own = [
        F.when(frequency > 0.1, "Consider stabilizing the API and requirements for this frequently changing file"),
        F.when(authors > 3, "Establish clear coding standards and review processes for this multi-author file"),
        F.when(functions > 10, "Break down large functions into smaller, more focused units"), F.when(classes > 5, "Consider splitting this file into multiple modules"),
        F.when(lines > 500, "This file is quite large; consider refactoring into smaller modules"),
    ]
    return F.array_join(F.array_compact(F.array(*own, *(F.lit(x) for x in ALWAYS_SUGGESTED))), " • ")


def hotspot_recommendations(marked: DataFrame, churn: DataFrame) -> DataFrame:
    """(place, text) of marked(is_hotspot, is_complex, is_busy) and churn(change_frequency, unique_authors): one for each kind that there is."""
    a = marked.agg(F.count_if("is_hotspot").alias("hotspots"), F.count_if("is_complex").alias("complex"), F.count_if("is_busy").alias("busy"))
    b = churn.agg(F.count_if(F.col("change_frequency") > 0.1).alias("restless"), F.count_if(F.col("unique_authors") > 5).alias("shared"))
    texts = [F.when(F.col(name) > 0, F.struct(F.lit(k).alias("place"), filled(text, F.col(name)).alias("text"))) for k, (name, text) in enumerate(HOTSPOT_TEXTS.items())]
    return a.crossJoin(b).select(F.explode(F.array_compact(F.array(*texts))).alias("r")).select("r.*")  # one row each


def export_scores(scored: DataFrame, statistics: DataFrame, configuration: dict[str, object], path: str) -> None:
    """Scores as JSON lines, one row of statistics and the configuration, in folders of their own."""
    scored.write.mode("overwrite").json(f"{path}/scores")
    statistics.write.mode("overwrite").json(f"{path}/statistics")
    settings = scored.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(configuration.items())], "key string, value string")
    settings.coalesce(1).write.mode("overwrite").json(f"{path}/configuration")
