"""Saved analyses: one JSON document each, read as VARIANT, checked, upgraded and taken apart; broken ones are kept apart.

A document is what one analysis saved, so one row holds it. Versions are upgraded by expressions, one step at a time; a document
says its version or is of the oldest one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys that a saved analysis has, and versions in order.
REQUIRED = ["analysis_id", "timestamp", "codebase_path", "parsed_files", "issues", "metrics", "dependency_graph", "options"]
VERSIONS = ["0.1.0", "0.2.0"]
#: Key and value that a step to a version adds where the key is missing.
ADDED = {"0.2.0": {"new_field": "default_value"}}

ISSUE_KEYS = {
    "id": "string", "category": "string", "severity": "string", "title": "string", "description": "string", "location.file_path": "string", "location.line_start": "int",
    "location.line_end": "int", "suggestion": "string", "confidence": "double", "created_at": "string",
}


def documents_of(texts: DataFrame) -> DataFrame:
    """(path, document, version, missing, problem) of texts(path, text). document: VARIANT, null if it is no JSON object.

    missing: required keys that it lacks; problem: why it can't be used, null if it can.
    """
    rows = texts.select("path", F.try_parse_json("text").alias("document"))
    rows = rows.withColumn("document", F.when(F.schema_of_variant("document").startswith("OBJECT"), F.col("document")))
    rows = rows.withColumn("version", F.when(F.col("document").isNotNull(), F.coalesce(F.try_variant_get("document", "$.version", "string"), F.lit(VERSIONS[0]))))
    keys = F.map_keys(F.coalesce(F.try_variant_get("document", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    rows = rows.withColumn("missing", F.array_except(F.array(*(F.lit(k) for k in REQUIRED)), keys))
    problem = F.when(F.col("document").isNull(), "no JSON object").when(F.size("missing") > 0, "missing keys").when(~F.col("version").isin(VERSIONS), "unknown version")
    return rows.withColumn("problem", problem)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all JSON files under a path, one file each; Spark's readers skip files of no bytes."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return documents_of(text.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def usable(documents: DataFrame) -> DataFrame:
    return documents.filter("problem IS NULL").drop("problem", "missing")


def quarantined(documents: DataFrame) -> DataFrame:
    return documents.filter("problem IS NOT NULL").select("path", "problem", F.array_sort("missing").alias("missing"))


def migrated(documents: DataFrame, to: str = VERSIONS[-1]) -> DataFrame:
    """(path, document, version, added) brought up to a version; added: keys, with their values, that the steps on the way add.

    Documents of that version or a later one stay as they are.
    """
    target = VERSIONS.index(to)
    place = F.array_position(F.array(*(F.lit(v) for v in VERSIONS)), F.col("version")) - 1
    keys = F.map_keys(F.try_variant_get("document", "$", "map<string,variant>"))
    added = F.create_map().cast("map<string,string>")
    for k, version in enumerate(VERSIONS[: target + 1]):
        for key, value in ADDED.get(version, {}).items():
            step = (place < k) & ~F.array_contains(keys, key)
            added = F.map_concat(added, F.when(step, F.create_map(F.lit(key), F.lit(value))).otherwise(F.create_map().cast("map<string,string>")))
    rows = documents.withColumn("added", added)
    return rows.withColumn("version", F.when(place < target, F.lit(to)).otherwise(F.col("version")))


def field(key: str, kind: str = "string") -> Column:
    """A key's value in a document, or the value that migration added."""
    own = F.try_variant_get("document", f"$.{key}", kind)
    return F.coalesce(own, F.element_at("added", key).try_cast(kind)) if any(key in a for a in ADDED.values()) else own


def loaded(documents: DataFrame) -> DataFrame:
    """(path, version, analysis_id, timestamp, codebase_path, n_files, n_issues): each analysis in a row."""
    count = lambda key: F.size(F.try_variant_get("document", f"$.{key}", "array<variant>"))
    return documents.select(
        "path", "version", field("analysis_id").alias("analysis_id"), F.try_to_timestamp(field("timestamp")).alias("timestamp"), field("codebase_path").alias("codebase_path"),
        count("parsed_files").alias("n_files"), count("issues").alias("n_issues"),
    )


def issues_of(documents: DataFrame) -> DataFrame:
    """Issues of all analyses: analysis_id and a column for each of ISSUE_KEYS, affected_files and metadata (VARIANT)."""
    rows = documents.select(field("analysis_id").alias("analysis_id"), F.explode(F.try_variant_get("document", "$.issues", "array<variant>")).alias("i"))
    columns = [F.try_variant_get("i", f"$.{key}", kind).alias(key.rpartition(".")[2]) for key, kind in ISSUE_KEYS.items()]
    return rows.select("analysis_id", *columns, F.try_variant_get("i", "$.affected_files", "array<string>").alias("affected_files"), F.try_variant_get("i", "$.metadata", "variant").alias("metadata"))


def files_of(documents: DataFrame) -> DataFrame:
    """(analysis_id, path, language) of parsed files, without contents, which aren't saved."""
    rows = documents.select(field("analysis_id").alias("analysis_id"), F.explode(F.try_variant_get("document", "$.parsed_files", "array<variant>")).alias("f"))
    return rows.select("analysis_id", F.try_variant_get("f", "$.path", "string").alias("path"), F.try_variant_get("f", "$.language", "string").alias("language"))


def documents_from(analyses: DataFrame, issues: DataFrame, files: DataFrame, version: str = VERSIONS[-1]) -> DataFrame:
    """(analysis_id, text): JSON of analyses(analysis_id, timestamp, codebase_path) with their issues (columns as issues_of) and files."""
    location = F.struct("file_path", "line_start", "line_end")
    one = F.struct("id", "category", "severity", "title", "description", location.alias("location"), "affected_files", "suggestion", "confidence", "created_at")
    found = issues.groupBy("analysis_id").agg(F.sort_array(F.collect_list(one)).alias("issues"))
    parsed = files.groupBy("analysis_id").agg(F.sort_array(F.collect_list(F.struct("path", "language"))).alias("parsed_files"))
    rows = analyses.join(found, "analysis_id", "left").join(parsed, "analysis_id", "left")
    empty = F.create_map().cast("map<string,string>")
    listed = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    whole = F.struct(
        F.lit(version).alias("version"), "analysis_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "codebase_path",
        listed("parsed_files", parsed.schema["parsed_files"].dataType), listed("issues", found.schema["issues"].dataType), *(empty.alias(c) for c in ("metrics", "dependency_graph", "options")),
    )
    return rows.select("analysis_id", F.to_json(whole).alias("text"))
