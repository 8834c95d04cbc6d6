"""Column functions over source text: lines, stripping, indentation, tests of paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGE_OF_SUFFIX = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def split_lines(text: Column) -> Column:
    """Array of lines; \\r\\n and \\r end lines too, a closing line end opens no further line, null and '' have none."""
    parts = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def to_lines(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """One row per line: the file's other columns, line_no from 1, line, stripped, indent."""
    rest = [c for c in files.columns if c != text]
    rows = files.select(*rest, F.posexplode(split_lines(F.col(text))).alias("at", "line"))
    return rows.select(*rest, (F.col("at") + 1).alias("line_no"), "line", stripped(F.col("line")).alias("stripped"), indent(F.col("line")).alias("indent"))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF_SUFFIX.items() for x in pair))
    return F.element_at(table, suffix(path))


# Names of test files by language, in lower case.
TEST_PATHS = {
    "python": [r"/test_[^/]*\.py$", r".*_test\.py$", r"/tests?\.py$", r".*/tests?/.*\.py$"],
    "javascript": [r".*\.test\.js$", r".*\.spec\.js$", r".*/tests?/.*\.js$", r".*/__tests__/.*\.js$"],
    "typescript": [r".*\.test\.ts$", r".*\.spec\.ts$", r".*/tests?/.*\.ts$", r".*/__tests__/.*\.ts$"],
}


def is_test_path(path: Column, lang: Column) -> Column:
    """Whether a path names a test file by the habits of its language."""
    low = F.lower(path)
    out = F.when(F.lit(False), False)
    for name, patterns in TEST_PATHS.items():
        out = out.when(lang == name, low.rlike("|".join(patterns)))
    return out.otherwise(False)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; ** crosses folders, * and ? do too, as in fnmatch."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += "\\" + c if not (c.isalnum() or c in "_/") else c
        i += 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """fnmatch of the whole path, of its part after any folder, or of its base name."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = F.lit(False)
    for p in patterns:
        regex = glob_regex(p)
        inner = "(^|.*/)" + regex[1:]
        found = found | path.rlike(f"^{inner}") | name.rlike(regex)
    return found
