"""Parsers and analyzers that users add, as table functions in SQL and as DataFrame plans.

A parser is a function from a file's path and text to its elements; each is also a table function,
`SELECT * FROM <language>_elements(TABLE(files) PARTITION BY path)`, whose columns depend on the kind of element that is asked for.
An analyzer is a plan from files and elements to issues.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodeworks.functions.text import LANGUAGE_OF_SUFFIX
from lodeworks.operators import structure as st
from lodeworks.sources.corpus import read_tree

_TYPES = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType())}
ELEMENT = StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in st.ELEMENTS.split(", "))])
# What the table functions give for one kind of element.
KINDS = {
    "function": ["path", "name", "owner", "line_start", "line_end", "parameters", "complexity", "docstring", "is_async", "is_method", "returns"],
    "class": ["path", "name", "line_start", "line_end", "names", "bases", "docstring"],
    "import": ["path", "module", "names", "alias", "line_start"],
    "error": ["path", "error"],
}
LEAST_CONFIDENCE = 0.7


@dataclass(frozen=True)
class Parser:
    """languages, the suffixes of their files, and elements(path, text): a dict of ELEMENT's columns for each element.

    rows: the same one by one, or in runs, where a file's elements needn't be in memory at once; it may raise at any of them.
    """

    languages: tuple[str, ...]
    suffixes: tuple[str, ...]
    elements: Callable[[str, str], list[dict]]
    rows: Callable[[str, str], Iterable[dict | st.Run]] | None = None


@dataclass(frozen=True)
class Analyzer:
    """analyze(files, elements) gives issues(category, severity, title, file_path, line_start, confidence)."""

    name: str
    category: str
    languages: tuple[str, ...]
    analyze: Callable[[DataFrame, DataFrame], DataFrame]
    rank: int = 3
    config: dict[str, Any] = field(default_factory=dict)

    def enabled(self) -> bool:
        return self.config.get("enabled", True)

    def least_confidence(self) -> float:
        return self.config.get("confidence_threshold", LEAST_CONFIDENCE)


def table_function(parser: Parser):
    """The parser as a polymorphic table function over rows with path and content; a second argument names a kind of element."""
    elements = parser.elements

    class Elements:
        @staticmethod
        def analyze(files: AnalyzeArgument, kind: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not files.isTable or not {"path", "content"} <= set(files.dataType.names):
                raise ValueError("the first argument has to be a table with path and content")
            if kind is None:
                return AnalyzeResult(schema=ELEMENT)
            if not kind.isConstantExpression or kind.value not in KINDS:
                raise ValueError(f"the second argument has to be one of {', '.join(KINDS)}")
            return AnalyzeResult(schema=StructType([ELEMENT[c] for c in KINDS[kind.value]]))

        def eval(self, row, kind=None) -> Iterator[tuple]:
            names = KINDS[kind] if kind else ELEMENT.names
            for e in elements(row["path"], row["content"] or ""):
                if kind is None or e["kind"] == kind or kind == "function" and e["kind"] == "method":
                    yield tuple(e[c] for c in names)

    return udtf(Elements)


class Registry:
    """Parsers by language and analyzers by name; the built-in parsers are there from the start."""

    def __init__(self, builtin: bool = True):
        self.parsers: dict[str, Parser] = {}
        self.analyzers: dict[str, Analyzer] = {}
        self.suffixes: dict[str, str] = {}
        if builtin:
            of = lambda *languages: tuple(s for s, n in LANGUAGE_OF_SUFFIX.items() if n in languages)
            self.add_parser(Parser(("python",), of("python"), st.elements_of, st.element_runs))
            self.add_parser(Parser(("javascript", "typescript"), of("javascript", "typescript"), st.script_elements_of, st.script_rows))

    def add_parser(self, parser: Parser) -> None:
        """The latest parser of a language counts."""
        for k, language in enumerate(parser.languages):
            self.parsers[language] = parser
            for suffix in parser.suffixes:
                if k == 0 or LANGUAGE_OF_SUFFIX.get(suffix) == language:
                    self.suffixes[suffix] = LANGUAGE_OF_SUFFIX.get(suffix, language)

    def add_analyzer(self, analyzer: Analyzer) -> None:
        self.analyzers[analyzer.name] = analyzer

    def remove_analyzer(self, name: str) -> bool:
        return self.analyzers.pop(name, None) is not None

    def register(self, spark: SparkSession) -> list[str]:
        """Makes every parser a table function of the session: <language>_elements."""
        names = []
        for language, parser in self.parsers.items():
            spark.udtf.register(f"{language}_elements", table_function(parser))
            names.append(f"{language}_elements")
        return names

    def language(self, path) -> Any:
        """Language of a path column by the suffixes of all parsers."""
        pairs = F.create_map(*(F.lit(x) for pair in self.suffixes.items() for x in pair))
        return F.element_at(pairs, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))

    def parse(self, files: DataFrame) -> DataFrame:
        """Elements of files(path, content, language) by the parser of each file's language, and that language; one pass over the files."""
        parsers = {n: p.rows or p.elements for n, p in self.parsers.items()}
        schema = st.ARROW.append(pa.field("language", pa.string()))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = ((p.as_py(), c.as_py() or "", n.as_py()) for b in batches for p, c, n in zip(*(b.column(x) for x in ("path", "content", "language")), strict=True))
            return st.in_batches(((_deferred(parsers[n], p, c, n), _failed(p, n)) for p, c, n in texts), schema)

        known = files.filter(F.col("language").isin(list(parsers)))
        return known.select("path", "content", "language").mapInArrow(of, f"{st.ELEMENTS}, language string")

    def parse_directory(self, spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """Elements of all files under a folder that a parser knows."""
        files = read_tree(spark, root, include, exclude)
        return self.parse(files.withColumn("language", self.language(F.col("path"))).filter("language IS NOT NULL"))

    def chosen(self, categories: list[str] | None = None, languages: list[str] | None = None) -> list[Analyzer]:
        """Enabled analyzers, by rank, of these categories and languages."""
        own = [a for a in self.analyzers.values() if a.enabled()]
        own = [a for a in own if not categories or a.category in categories]
        own = [a for a in own if not languages or set(languages) & set(a.languages)]
        return sorted(own, key=lambda a: (a.rank, a.name))

    def run(self, files: DataFrame, elements: DataFrame, categories: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
        """(analyzer, category, severity, title, file_path, line_start, confidence): issues of all chosen analyzers that are sure enough."""
        columns = ["category", "severity", "title", "file_path", "line_start", "confidence"]
        made = []
        for a in self.chosen(categories, languages):
            own = F.col("language").isin(list(a.languages))
            issues = a.analyze(files.filter(own), elements.filter(own)).select(*columns).filter(F.col("confidence") >= a.least_confidence())
            made.append(issues.select(F.lit(a.name).alias("analyzer"), *columns))
        if not made:
            return files.sparkSession.createDataFrame([], "analyzer string, category string, severity string, title string, file_path string, line_start int, confidence double")
        return reduce(DataFrame.unionByName, made)

    def problems(self) -> dict[str, list[str]]:
        """Names of analyzers that can run, those that can't with the reason, and warnings."""
        out: dict[str, list[str]] = {"valid": [], "invalid": [], "warnings": []}
        for name, a in self.analyzers.items():
            if not callable(a.analyze):
                out["invalid"].append(f"{name}: Missing analyze method")
                continue
            if not a.languages:
                out["warnings"].append(f"{name}: No supported languages")
            if not 0.0 <= a.least_confidence() <= 1.0:
                out["warnings"].append(f"{name}: Invalid confidence threshold: {a.least_confidence()}")
            out["valid"].append(name)
        return out


def _deferred(rows: Callable[[str, str], Iterable[dict | st.Run]], path: str, content: str, language: str) -> Iterator[dict | st.Run]:
    own = {"language": language}
    for e in rows(path, content):
        yield e._replace(values=e.values | own) if isinstance(e, st.Run) else e | own


def _failed(path: str, language: str) -> Callable[[Exception], dict]:
    """An added parser may fail on a file: that is an error row."""
    return lambda error: dict.fromkeys(ELEMENT.names) | {"path": path, "kind": "error", "error": type(error).__name__, "language": language}
