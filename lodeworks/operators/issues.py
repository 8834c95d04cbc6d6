"""Issues made from findings: what every issue carries, what each category adds, known vulnerabilities, analyzers, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels and classes by type, in lower case.
SECURITY_IMPACT = {
    "sql_injection": "high", "xss": "high", "command_injection": "high", "path_traversal": "high", "hardcoded_secret": "medium", "weak_crypto": "medium", "insecure_random": "medium",
}
OWASP = {
    "sql_injection": "A03:2021 – Injection", "xss": "A03:2021 – Injection", "command_injection": "A03:2021 – Injection", "path_traversal": "A01:2021 – Broken Access Control",
    "hardcoded_secret": "A07:2021 – Identification and Authentication Failures", "weak_crypto": "A02:2021 – Cryptographic Failures", "insecure_random": "A02:2021 – Cryptographic Failures",
}
OPTIMIZATION = {"memory": "Memory Optimization", "cpu": "CPU Optimization", "io": "I/O Optimization", "network": "Network Optimization", "algorithm": "Algorithm Optimization"}
TEST_PRIORITY = {"untested_public_method": "high", "untested_critical_path": "high", "low_coverage": "medium", "missing_edge_cases": "medium"}
DOCUMENTATION_PRIORITY = {"missing_public_api_docs": "high", "outdated_critical_docs": "high", "missing_docstring": "medium", "incomplete_comments": "medium"}
CREATED = {"created_by": "IssueFactory", "analyzer_version": "1.0.0", "detection_method": "static_analysis"}
VULNERABILITIES = [  # type, weakness, words of the pattern, severity
    ("sql_injection", "CWE-89", "string formatting in SQL query", "high"), ("command_injection", "CWE-78", "shell=True with user input", "high"),
    ("unsafe_deserialization", "CWE-502", "pickle.loads with untrusted data", "critical"), ("hardcoded_credentials", "CWE-798", "hardcoded password or API key", "high"),
    ("xss_vulnerability", "CWE-79", "unescaped user input in HTML", "medium"), ("path_traversal", "CWE-22", "unvalidated file path", "medium"),
    ("weak_cryptography", "CWE-327", "weak hash function", "medium"), ("eval_injection", "CWE-95", "eval with user input", "critical"),
]
ANALYZERS = [  # name, category, priority, languages
    ("security", "security", "CRITICAL", ["python", "javascript", "typescript"]), ("performance", "performance", "HIGH", ["python", "javascript", "typescript"]),
    ("complexity", "complexity", "MEDIUM", ["python", "javascript", "typescript"]), ("duplication", "duplication", "MEDIUM", ["python", "javascript", "typescript"]),
    ("testing", "testing", "MEDIUM", ["python", "javascript", "typescript"]), ("documentation", "documentation", "LOW", ["python", "javascript", "typescript"]),
    ("hotspot", "hotspot", "LOW", ["python", "javascript", "typescript"]),
]
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def _named(table: dict[str, str], key: Column, rest: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.lower(key)), F.lit(rest))


def duplication_severity(similarity: Column, n_lines: Column) -> Column:
    return F.when((similarity >= 0.99) | ((similarity >= 0.95) & (n_lines > 100)), "high").when(similarity >= 0.95, "medium").when(similarity >= 0.85, "low").otherwise("info")


def created(findings: DataFrame, value: Column | None = None, threshold: Column | None = None) -> DataFrame:
    """Issues of findings(category, type, file_path, line_start, ...): an id, affected files and metadata by category.

    The id is a digest of what identifies a finding, so that runs agree. value, threshold: of a measure, for its ratio.
    """
    kind, none = F.col("type"), F.lit(None).cast("string")
    of = {
        "security": {"security_impact": _named(SECURITY_IMPACT, kind, "low"), "owasp_category": _named(OWASP, kind, "Other")}, "performance": {"optimization_category": _named(OPTIMIZATION, kind, "General Optimization")},
        "testing": {"test_priority": _named(TEST_PRIORITY, kind, "low")}, "documentation": {"documentation_priority": _named(DOCUMENTATION_PRIORITY, kind, "low")},
    }
    rows = findings.withColumns({n: F.when(F.col("category") == category, c).otherwise(none) for category, own in of.items() for n, c in own.items()})
    if value is not None:
        rows = rows.withColumn("ratio", F.when(threshold > 0, value / threshold).otherwise(0.0))
    rows = rows.withColumns({n: F.lit(x) for n, x in CREATED.items()})
    digest = F.sha2(F.concat_ws("\x1f", "category", "type", "file_path", F.col("line_start").cast("string")), 256)
    return rows.withColumn("issue_id", digest).withColumn("affected_files", F.array("file_path"))


def vulnerability_matches(issues: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, type, cwe, severity, confidence) of issues(id, category, type, description, severity): known vulnerabilities that one
    fits with more than `least`. A row for each issue and one of the eight rules, in one generator: nothing is joined."""
    kind, words = F.lower("type"), F.split(F.trim(F.lower("description")), r"\s+")
    rules = []
    for name, cwe, pattern, severity in VULNERABILITIES:
        keys = pattern.lower().split()
        shared = sum((F.array_contains(words, w).cast("int") for w in keys), F.lit(0)) / len(keys)
        typed = kind.contains(name) | F.lit(name).contains(kind)
        sure = F.when(typed, 0.4).otherwise(0.0) + F.when(F.lower("category") == "security", 0.2).otherwise(0.0) + F.coalesce(shared, F.lit(0.0)) * 0.3 + F.when(F.lower("severity") == severity, 0.1).otherwise(0.0)
        rules.append(F.struct(F.lit(name).alias("vulnerability"), F.lit(cwe).alias("cwe"), F.lit(severity).alias("known_severity"), F.least(F.round(sure, 9), F.lit(1.0)).alias("confidence")))
    return issues.select("id", F.explode(F.filter(F.array(*rules), lambda r: r["confidence"] > least)).alias("r")).select("id", "r.*")


def counted_by(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): how many rows have each value of each column."""
    long = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("x")
    return rows.select(long).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def analyzers(spark, enabled: dict[str, bool] | None = None) -> DataFrame:
    """(name, category, priority, rank, languages, enabled): the built-in registry; rank orders by priority."""
    rows = [(n, c, p, PRIORITIES.index(p) + 1, own, (enabled or {}).get(n, True)) for n, c, p, own in ANALYZERS]
    return spark.createDataFrame(rows, "name string, category string, priority string, rank int, languages array<string>, enabled boolean")


def registry_statistics(registry: DataFrame) -> DataFrame:
    """(dimension, value, n): all, enabled and disabled analyzers, and how many there are by category, language and priority."""
    totals = registry.select(F.explode(F.array(F.lit("all"), F.when(F.col("enabled"), "enabled").otherwise("disabled"))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    by = counted_by(registry.withColumn("language", F.explode("languages")).select("language"), ["language"])
    return totals.select(F.lit("total").alias("dimension"), "value", "n").unionByName(counted_by(registry, ["category", "priority"])).unionByName(by)


def hotspot_issues(hotspots: DataFrame, churn: DataFrame, files: DataFrame) -> DataFrame:
    """(file, severity) of hotspots(file) that matter: by churn(file, total_changes, complexity_score) if known, else by
    files(file, n_functions, n_classes, line_count). Files that aren't known are left out."""
    rows = hotspots.join(files, "file").join(churn.withColumn("known", F.lit(True)), "file", "left")
    busy = (F.col("total_changes") > 10) | (F.col("complexity_score") > 15)
    large = (F.col("n_functions") >= 5) | (F.col("n_classes") >= 3) | (F.col("line_count") >= 100)
    rows = rows.filter(F.when(F.col("known"), busy).otherwise(large))
    return rows.select("file", F.when(F.col("total_changes") > 20, "medium").otherwise("low").alias("severity"))


def heat_map(scores: DataFrame) -> DataFrame:
    """(file, metric, value): hotspot score, complexity, change frequency, and commits over the most of any file."""
    top = scores.agg(F.max("total_commits").alias("top"))
    values = {"hotspot_score": F.col("hotspot_score"), "complexity": F.col("complexity_score"), "change_frequency": F.col("change_frequency"), "total_commits": F.col("total_commits") / F.col("top")}
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()))).alias("x")
    return scores.crossJoin(top).select("file", cells).select("file", "x.metric", "x.value")  # one row


def structural_groups(signatures: DataFrame, least: int = 3) -> DataFrame:
    """(signature, n, first_file, n_files) of signatures(file_id, start_line, signature): patterns that occur at least so often."""
    rows = signatures.groupBy("signature").agg(F.count("*").alias("n"), F.min_by("file_id", F.struct("file_id", "start_line")).alias("first_file"), F.countDistinct("file_id").alias("n_files"))
    return rows.filter(F.col("n") >= least)


def cache_statistics(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of requests(hit) and entries(kind, size_bytes): hits, misses, rate in percent, entries by kind, megabytes."""
    asked = requests.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    rate = F.coalesce(100.0 * F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), F.lit(0.0))
    held = entries.agg(F.count_if(F.col("kind") == "file").alias("file_entries"), F.count_if(F.col("kind") == "analysis").alias("analysis_entries"), (F.coalesce(F.sum("size_bytes"), F.lit(0)) / 1048576).alias("megabytes"))
    return asked.withColumn("hit_rate_percent", rate).crossJoin(held)  # one row each


def question_statistics(questions: DataFrame) -> DataFrame:
    """One row of questions(conv_id, kind, confidence, focus_changes): conversations, questions, mean confidence, changes of focus."""
    return questions.agg(
        F.countDistinct("conv_id").alias("active_conversations"), F.count("*").alias("total_questions"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.sum("focus_changes"), F.lit(0)).alias("total_focus_changes"),
    )


def enhanced_query(question: Column, keywords: Column, function_name: Column, class_name: Column) -> Column:
    """The question, the first three keywords of its conversation, and the names in focus; nulls are left out."""
    return F.concat_ws(" ", question, F.concat_ws(" ", F.slice(keywords, 1, 3)) if keywords is not None else None, function_name, class_name)


def repository_of(url: Column) -> tuple[Column, Column]:
    """Owner and name of a GitHub repository address; null if it is none."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?(?i:github\.com)/([^?#]*)", 1), "/"), lambda x: x != "")
    owner, name = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    good = owner.rlike(r"^[a-zA-Z0-9._-]+$") & name.rlike(r"^[a-zA-Z0-9._-]+$")
    return F.when(good, owner), F.when(good, name)


def prioritized_in(ranked: DataFrame, category: str) -> DataFrame:
    return ranked.filter(F.col("category") == category).orderBy(F.desc("priority"), "id")


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * done / total).otherwise(0.0)
