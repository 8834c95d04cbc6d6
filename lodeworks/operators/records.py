"""Record checks: reasons why a row isn't valid, good rows and a quarantine from one pass, with metrics observed on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.weights import CATEGORIES

# What issues and files may be of.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
LANGUAGES = ["python", "javascript", "typescript", "jsx", "tsx"]
PROVIDERS = ["openai", "anthropic"]


def blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | ~text.rlike(r"\S")


def _reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in their order; a check that can't be told doesn't hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))


def location_checks(path: Column, start: Column, end: Column, column_start: Column | None = None, column_end: Column | None = None) -> dict[str, Column]:
    checks = {
        "File path cannot be empty": blank(path), "line_start must be at least 1": start.isNull() | (start < 1), "line_end must be >= line_start": end.isNull() | (end < start),
    }
    if column_start is not None:
        checks["column_start must be non-negative"] = column_start < 0
    if column_start is not None and column_end is not None:
        checks["column_end must be >= column_start"] = column_end < column_start
    return checks


def issue_reasons() -> Column:
    """Of issues(id, title, description, category, severity, confidence, file_path, line_start, line_end, affected_files)."""
    c = F.col
    return _reasons({
        "Issue ID cannot be empty": blank(c("id").cast("string")), "Issue title cannot be empty": blank(c("title")), "Issue description cannot be empty": blank(c("description")),
        "Invalid issue category": ~F.coalesce(c("category").isin(list(CATEGORIES)), F.lit(False)), "Invalid issue severity": ~F.coalesce(c("severity").isin(SEVERITIES), F.lit(False)),
        "Invalid confidence value": ~F.coalesce(c("confidence").between(0.0, 1.0), F.lit(False)) | F.isnan("confidence"),
        **location_checks(c("file_path"), c("line_start"), c("line_end")),
        "Issue must affect at least one file": F.coalesce(F.size("affected_files"), F.lit(0)) < 1, "Invalid affected file path": F.exists("affected_files", blank),
    })


def file_reasons() -> Column:
    """Of files(path, language, functions array<struct<name,line_start,line_end>>, classes alike)."""
    bad = lambda x: (x["line_start"] < 1) | (x["line_end"] < x["line_start"])
    return _reasons({
        "File path cannot be empty": blank(F.col("path")), "Language cannot be empty": blank(F.col("language")),
        "Unsupported language": ~blank(F.col("language")) & ~F.lower("language").isin(LANGUAGES),
        "Invalid function line numbers": F.exists("functions", bad), "Invalid class line numbers": F.exists("classes", bad),
    })


def option_reasons() -> Column:
    """Of options(include_patterns, exclude_patterns, max_workers, confidence_threshold, max_file_size_mb)."""
    c = F.col
    return _reasons({
        "Include patterns cannot be empty": F.coalesce(F.size("include_patterns"), F.lit(0)) < 1, "Invalid include pattern": F.exists("include_patterns", blank),
        "Invalid exclude pattern": F.exists("exclude_patterns", lambda x: x.isNull()), "max_workers must be at least 1": c("max_workers") < 1,
        "confidence_threshold must be between 0.0 and 1.0": ~c("confidence_threshold").between(0.0, 1.0), "max_file_size_mb must be positive": c("max_file_size_mb") <= 0,
    })


def configuration_reasons(document: Column) -> Column:
    """Of a VARIANT configuration: sections must be objects, values of the right kind and range."""
    get = lambda path, kind="variant": F.try_variant_get(document, path, kind)
    kind = lambda path: F.schema_of_variant(get(path))
    there = lambda path: get(path).isNotNull()
    is_object = kind("$").startswith("OBJECT")
    section = lambda name: is_object & there(f"$.{name}") & ~kind(f"$.{name}").startswith("OBJECT")
    number = lambda path: kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    temperature, workers = "$.llm.temperature", "$.analysis.max_workers"
    return _reasons({
        "Configuration must be a dictionary": ~F.coalesce(is_object, F.lit(False)), "LLM configuration must be a dictionary": section("llm"),
        "Invalid LLM provider": there("$.llm.provider") & ~F.coalesce(get("$.llm.provider", "string").isin(PROVIDERS), F.lit(False)),
        "Temperature must be between 0.0 and 2.0": there(temperature) & ~(number(temperature) & F.coalesce(get(temperature, "double").between(0.0, 2.0), F.lit(False))),
        "Analysis configuration must be a dictionary": section("analysis"),
        "max_workers must be a positive integer": there(workers) & ~(kind(workers).rlike("^(BIGINT|INT)") & F.coalesce(get(workers, "long") >= 1, F.lit(False))),
    })


def file_name(name: Column) -> Column:
    """A name that file systems take: odd characters are underscores, none at the ends, 255 characters at most."""
    made = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(made == "", "unnamed_file").otherwise(F.substring(made, 1, 255))


def checked(rows: DataFrame, reasons: Column) -> DataFrame:
    """Adds reasons and valid."""
    return rows.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def observed(rows: DataFrame, names: list[str], name: str = "checks") -> tuple[DataFrame, Observation]:
    """checked rows with an observation: n, n_valid, and for each reason's name how often it holds, counted as the rows pass by."""
    seen = Observation(name)
    counts = [F.count_if(F.array_contains("reasons", r)).alias(r) for r in names]
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), *counts), seen


def write_split(rows: DataFrame, reasons: Column, names: list[str], path: str) -> dict[str, int]:
    """Writes good rows to path/valid=true and the rest with their reasons to path/valid=false in one pass; the metrics of that pass."""
    watched, seen = observed(checked(rows, reasons), names)
    watched.write.mode("overwrite").partitionBy("valid").parquet(path)
    return seen.get


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """Both parts of what write_split wrote; a filter on valid reads one of them."""
    rows = spark.read.parquet(path)
    return rows.withColumn("valid", F.col("valid").cast("boolean"))


def reason_counts(rows: DataFrame) -> DataFrame:
    """(reason, n) of checked rows."""
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
