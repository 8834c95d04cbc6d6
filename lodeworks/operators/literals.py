"""String literals of Python and JavaScript sources.

literal_spans lexes lines without reading a file in one go: blocks of lines become maps of the lexer's states, a scan of these maps
gives the state in which each block begins, and blocks lex their lines from there. A literal that crosses blocks is put together
from its pieces. string_values and pattern_strings read whole files, the first by Python's own parser.

The lexer knows quotes, triple quotes, templates, escapes (also of a line's end) and comments. Prefixes don't change how a literal
ends; expressions in templates belong to them; a slash opens no regular expression. A quote that its line doesn't close ends with it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.scans import prefix_composed, rounds_for
from lodeworks.operators.structure import in_batches, trees

BLOCK = 512
# States: outside, inside of one of these, inside a block comment.
QUOTES = {1: "'''", 2: '"""', 3: "`", 4: "*/", 5: "'", 6: '"'}
COMMENT = 4
STATES = len(QUOTES) + 1
_NUMBER = {q: k for k, q in QUOTES.items()}
_NEXT = {"python": re.compile("'''|\"\"\"|'|\"|#"), "javascript": re.compile(r"`|'|\"|//|/\*")}
_PLAIN = re.compile(r"['\"`#/*\\]")


def lex(line: str, state: int, language: str) -> tuple[int, list[tuple[int, int, int, int, bool]]]:
    """State after a line, and its pieces of literals: state, column of the opening quote (-1: an earlier line's), from, to, whether it closes."""
    pieces, at, opened, begin = [], 0, -1, 0
    while True:
        if state:
            quote, k, escaped = QUOTES[state], at, False
            while k < len(line) and not line.startswith(quote, k):
                escaped = line[k] == "\\" and state != COMMENT
                k += 2 if escaped else 1
            closes = k < len(line)
            end = min(k, len(line))
            goes_on = not closes and (state <= COMMENT or escaped and k > len(line))
            if state != COMMENT:
                pieces.append((state, opened, begin, end, closes))
            if not closes:
                return (state if goes_on else 0), pieces
            at, state = k + len(quote), 0
        found = _NEXT[language].search(line, at)
        if not found or found[0] in ("#", "//"):
            return 0, pieces
        state = COMMENT if found[0] == "/*" else _NUMBER[found[0]]
        opened, begin = found.start(), found.end()
        at = begin


def _follow(lines: Iterator[tuple[int, str]], state: int, opened: tuple[int, int], language: str) -> Iterator[tuple]:
    """Pieces of lines in a row, each with its literal's opening place; at last the state and opening place after them."""
    for number, line in lines:
        if not state and not _PLAIN.search(line):
            continue
        state, pieces = lex(line, state, language)
        for kind, column, a, b, closes in pieces:
            opened = opened if column < 0 else (number, column)
            yield opened, number, QUOTES[kind], line[a:b], closes
    yield state, opened


def _language(name: Column) -> Column:
    return F.when(name == "python", "python").otherwise("javascript")


def literal_spans(lines: DataFrame, key: str = "path", block: int = BLOCK) -> DataFrame:
    """(key, line_start, column, line_end, quote, text, closed) of lines(key, line_no, line, language); text: between the quotes, as it stands."""
    kind = lines.schema[key].dataType.simpleString()
    rows = lines.select(key, "line_no", F.coalesce("line", F.lit("")).alias("line"), _language(F.col("language")).alias("language"), F.floor((F.col("line_no") - 1) / block).alias("block"))
    keys = [key, "block"]

    def in_order(frame: pd.DataFrame) -> list[tuple[int, str]]:
        frame = frame.sort_values("line_no")
        return list(zip(frame["line_no"].tolist(), frame["line"].tolist(), strict=True))

    def mapped(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own, language, ends = in_order(frame), frame["language"].iloc[0], []
        for state in range(STATES):
            for last in _follow(iter(own), state, (-1, -1), language):
                pass
            ends.append({"state": last[0], "line": last[1][0], "col": last[1][1]})
        return pd.DataFrame([(*group, ends)], columns=[*keys, "f"])

    def composed(a: Column, b: Column) -> Column:
        def one(x: Column) -> Column:
            y = F.element_at(b, x["state"] + 1)
            carried = y["line"] < 0  # what is open was open before
            return F.struct(y["state"].alias("state"), F.when(carried, x["line"]).otherwise(y["line"]).alias("line"), F.when(carried, x["col"]).otherwise(y["col"]).alias("col"))

        return F.transform(a, one)

    maps = rows.groupBy(*keys).applyInPandas(mapped, f"{key} {kind}, block long, f array<struct<state:int,line:int,col:int>>")
    maps = prefix_composed(maps, [key], ["block"], "f", composed, rounds_for(rows.select(key, "block").distinct(), [key]))
    starts = maps.select(key, "block", F.lag(F.element_at("f", 1)).over(Window.partitionBy(key).orderBy("block")).alias("s"))
    starts = starts.select(key, "block", F.coalesce("s.state", F.lit(0)).alias("state"), F.coalesce("s.line", F.lit(-1)).alias("oline"), F.coalesce("s.col", F.lit(-1)).alias("ocol"))

    def pieces(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """A row for each literal of the block: its part of the text."""
        first = frame.iloc[0]
        parts: dict[tuple, list] = {}
        for opened, number, quote, text, closes in list(_follow(iter(in_order(frame)), int(first["state"]), (int(first["oline"]), int(first["ocol"])), first["language"]))[:-1]:
            held = parts.setdefault((*opened, quote), [[], 0, False])
            held[0].append(text)
            held[1], held[2] = number, closes
        made = [(group[0], group[1], a, b, q, "\n".join(t), e, c) for (a, b, q), (t, e, c) in parts.items()]
        return pd.DataFrame(made, columns=[key, "block", "line_start", "column", "quote", "text", "line_end", "closed"])

    found = rows.join(starts, keys).groupBy(*keys).applyInPandas(pieces, f"{key} {kind}, block long, line_start int, column int, quote string, text string, line_end int, closed boolean")
    whole = found.groupBy(key, "line_start", "column", "quote").agg(
        F.max("line_end").alias("line_end"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max("closed").alias("closed")
    )
    return whole.select(key, "line_start", "column", "line_end", "quote", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "closed")


# The patterns of strings in files that can't be parsed, in order.
PATTERNS = {
    "python": [r'"""(.*?)"""', r"'''(.*?)'''", r'"([^"\\]|\\.)*"', r"'([^'\\]|\\.)*'"],
    "javascript": [r"`([^`\\]|\\.)*`", r'"([^"\\]|\\.)*"', r"'([^'\\]|\\.)*'"],
}


def pattern_strings(content: str, language: str) -> list[str]:
    """What the patterns' groups hold, pattern by pattern: of a quoted string only its last unit."""
    return [x for p in PATTERNS[language] for x in re.findall(p, content, re.DOTALL)]


def values_of(content: str, language: str) -> list[str]:
    """String constants of a Python source, by its parser; by patterns where that fails, and in scripts. Other languages have none."""
    if language == "python":
        try:
            return [n.value for tree, _ in trees(content) for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)]
        except (SyntaxError, ValueError):
            return pattern_strings(content, "python")
    return pattern_strings(content, "javascript") if language in ("javascript", "typescript") else []


def _raised(error: Exception) -> dict:
    raise error


def string_values(files: DataFrame) -> DataFrame:
    """(path, value) for each string of files(path, language, content)."""
    kind = files.schema["path"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("path", batch.schema.field("path").type), ("value", pa.string())])
            texts = ((p.as_py(), c.as_py() or "", n.as_py()) for p, c, n in zip(*(batch.column(x) for x in ("path", "content", "language")), strict=True))
            yield from in_batches(((({"path": p, "value": v} for v in values_of(c, n)), _raised) for p, c, n in texts), schema)

    return files.select("path", "content", "language").mapInArrow(work, f"path {kind}, value string")
