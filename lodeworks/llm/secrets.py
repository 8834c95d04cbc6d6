"""Secret scan: an Aho-Corasick keyword prefilter, regular expressions anchored near its hits, embedded checksums.

Kinds, in order: assign, access and hex are judged by form alone; github and npm tokens are kept only if the CRC-32
that they carry in base 62 fits. Spans are code points, end exclusive; spans of one kind never overlap, those of
different kinds may, and of two that start together the kind listed first comes first. Null and empty texts have no spans;
an empty table has no rows; repeated rows give repeated rows; texts of any length are scanned whole. Other columns of the
input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.textkit import tidy

KINDS = ("assign", "access", "hex", "github", "npm")

# The keywords and forms that are looked for.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "AKIA"
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"h" * MIN_HEX
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word in ASSIGN_WORDS:
            made.add_word(word, (len(word), "assign"))
        made.add_word(ACCESS_WORD.lower(), (len(ACCESS_WORD), "access"))
        for prefix, kind in CHECKED_PREFIXES.items():
            made.add_word(prefix, (len(prefix), kind))
        made.make_automaton()
        _automaton = made
    return _automaton


def base62_crc(body: str) -> str:
    """The six base-62 digits of the CRC-32 of a token's random part."""
    value, out = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0")


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of every secret of a text, by start, then kind."""
    if not text:
        return []
    raw = text.encode()
    lowered = raw.lower().decode()
    found, over = [], {"assign": 0, "access": 0}
    for last, (size, kind) in _keywords().iter(lowered):
        at = last - size + 1
        if kind == "assign":
            if at >= over["assign"] and (m := ASSIGN.match(text, at)):
                over["assign"] = m.end()
                if len(m[2]) >= MIN_ASSIGN:
                    found.append((at, m.end(), 0))
        elif kind == "access":
            if at >= over["access"] and (m := ACCESS.match(text, at)):
                over["access"] = m.end()
                if m.end() - at >= MIN_ACCESS:
                    found.append((at, m.end(), 1))
        elif (m := CHECKED.match(text, at)) and base62_crc(m[1]) == m[2]:
            found.append((at, m.end(), KINDS.index(kind)))
    runs = raw.translate(_HEX_MAP)
    at = runs.find(_HEX_RUN)
    while at >= 0:
        end = runs.find(b" ", at)
        end = len(runs) if end < 0 else end
        start = at if len(raw) == len(text) else len(raw[:at].decode())
        found.append((start, start + end - at, 2))
        at = runs.find(_HEX_RUN, end)
    return sorted(found, key=lambda x: (x[0], x[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and `secrets`, its spans by start, then kind."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS_ARROW)], ["id", "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {kind}, secrets {SPANS}").withColumnRenamed("id", id_col)
