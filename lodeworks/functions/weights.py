"""Fixed weights, levels and thresholds, and the columns that look them up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["info", "low", "medium", "high", "critical"]
CATEGORIES = ["security", "performance", "complexity", "duplication", "testing", "documentation", "hotspot"]
DENSITY_WEIGHT = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 1.0, "info": 0.5}
IMPACT_OF_SEVERITY = {"critical": 10.0, "high": 7.5, "medium": 5.0, "low": 2.5, "info": 1.0}
IMPACT_OF_CATEGORY = {"security": 1.2, "performance": 1.0, "complexity": 0.8, "testing": 0.9, "documentation": 0.6, "duplication": 0.7}
EFFORT_OF_CATEGORY = {"documentation": 2.0, "duplication": 4.0, "testing": 5.0, "complexity": 6.0, "performance": 7.0, "security": 8.0}
EFFORT_OF_SEVERITY = {"critical": 1.3, "high": 1.2, "medium": 1.0, "low": 0.8, "info": 0.6}
BASE_SCORE = {
    "security": 0.8, "performance": 0.6, "reliability": 0.7, "maintainability": 0.4, "complexity": 0.5,
    "duplication": 0.3, "documentation": 0.2, "style": 0.1, "testing": 0.4,
}
FEATURE_WEIGHT = {
    "involves_user_input": 0.8, "involves_network": 0.7, "involves_database": 0.7, "involves_file_system": 0.6, "in_loop": 0.6,
    "recursive_call": 0.5, "memory_allocation": 0.4, "function_complexity": 0.5, "complex_logic": 0.5, "is_main_module": 0.4,
    "is_test_file": -0.2, "file_size_lines": 0.2, "bug_history": 0.4,
}
KEYWORDS = {
    "involves_user_input": ["input", "request", "form", "parameter", "argument", "user data", "stdin", "argv", "query", "post", "get", "cookie", "header"],
    "involves_network": ["http", "https", "url", "request", "response", "api", "socket", "network", "connection", "fetch", "ajax", "curl", "download"],
    "involves_file_system": ["file", "path", "directory", "folder", "read", "write", "open", "save", "load", "upload", "download", "filesystem", "disk"],
    "involves_database": ["sql", "database", "query", "select", "insert", "update", "delete", "table", "schema", "orm", "mongodb", "postgres", "mysql", "sqlite"],
    "memory_allocation": ["memory", "allocation", "malloc", "new", "array", "list", "buffer", "cache", "heap", "stack", "leak"],
}


def lookup(table: dict[str, float], key: Column, default: float | None = None) -> Column:
    found = F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity) - 1


def banded(value: Column, bands: list[tuple[float, str]], last: str) -> Column:
    """The name of the first band (descending lower bounds) that value reaches."""
    out = None
    for bound, name in bands:
        test = value >= bound
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(last))


PRIORITY_BANDS = [(8.0, "Critical"), (6.0, "High"), (4.0, "Medium"), (2.0, "Low")]
SEVERITY_BANDS = [(0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low")]
GRADE_BANDS = [(90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D")]
MAINTAINABILITY_BANDS = [(85.0, "A"), (70.0, "B"), (50.0, "C"), (25.0, "D")]


def sql_case(table: dict[str, float], key: str, default: str = "NULL") -> str:
    """The same lookup as SQL text."""
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN CAST({v!r} AS DOUBLE)" for k, v in table.items()) + f" ELSE {default} END"
