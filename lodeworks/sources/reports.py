"""Reports: summaries and the first issues, collected (both are small by construction) and written as text, Markdown or HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.operators.reporting import summary, top_issues

SHOWN = 20
TOP_FILES = 10


def report_of(ranked: DataFrame, metrics: DataFrame, shown: int = SHOWN) -> dict:
    """One document from prioritized issues and the one row of metrics: counts, most affected files, first issues."""
    counts = summary(ranked)
    small = counts.filter("dimension <> 'file_path'").orderBy("dimension", F.desc("n"), "value").collect()
    files = counts.filter("dimension = 'file_path'").orderBy(F.desc("n"), "value").limit(TOP_FILES).collect()
    first = top_issues(ranked, shown).select("id", "category", "severity", "file_path", "line_start", "priority", "priority_level").collect()
    document: dict = {"metrics": metrics.first().asDict(), "counts": {}, "files": {r["value"]: r["n"] for r in files}, "issues": [r.asDict() for r in first]}
    for r in small:
        document["counts"].setdefault(r["dimension"], {})[r["value"]] = r["n"]
    return document


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str, sort_keys=True)


def _tables(report: dict) -> list[tuple[str, list[str], list[list]]]:
    tables = [("Metrics", ["measure", "value"], [[k, round(v, 3) if isinstance(v, float) else v] for k, v in report["metrics"].items()])]
    tables += [(name.replace("_", " ").title(), ["value", "issues"], [[k, n] for k, n in own.items()]) for name, own in report["counts"].items()]
    tables.append(("Files", ["file", "issues"], [[k, n] for k, n in report["files"].items()]))
    columns = ["priority_level", "severity", "category", "file_path", "line_start"]
    tables.append(("Issues", columns, [[i[c] for c in columns] for i in report["issues"]]))
    return tables


def as_text(report: dict) -> str:
    parts = []
    for title, columns, rows in _tables(report):
        widths = [max(len(str(x)) for x in (c, *(r[k] for r in rows))) for k, c in enumerate(columns)]
        line = lambda r: "  ".join(str(x).ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
        parts.append("\n".join([title, "-" * len(title), line(columns), *map(line, rows)]))
    return "\n\n".join(parts) + "\n"


def as_markdown(report: dict) -> str:
    cell = lambda x: str(x).replace("|", "\\|")
    parts = []
    for title, columns, rows in _tables(report):
        body = "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in rows)
        parts.append(f"## {title}\n\n| {' | '.join(columns)} |\n|{'-|' * len(columns)}\n{body}")
    return "# Code quality\n\n" + "\n\n".join(parts) + "\n"


def as_html(report: dict) -> str:
    cell = lambda x, tag: f"<{tag}>{html.escape(str(x))}</{tag}>"
    parts = []
    for title, columns, rows in _tables(report):
        head = "".join(cell(c, "th") for c in columns)
        body = "".join("<tr>" + "".join(cell(x, "td") for x in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Code quality</title></head><body>{''.join(parts)}</body></html>"


FORMATS = {"json": as_json, "text": as_text, "markdown": as_markdown, "html": as_html}
