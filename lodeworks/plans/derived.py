"""Source-code shaped relations made from the test tables, once as DataFrames and once as SQL.

The test tables hold no code; these projections give lines, issues and snapshots that scale with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import indent, stripped

#: Line templates: hits and near misses of the rules, loops, blanks and comments. A prime number of them.
TEMPLATES = [
    "for x in rows:", 'cursor.execute("SELECT " + q)', "# TODO: fix this", "", "total += value", "while pending:", 'name += "x"', "data = open(path).read()",
    "# x = compute(1)", "# if ready:", "# return value = 1", "if a and b and c or d and e or f:", "call(a, b, c, d, e, f, g, h)", 'password = "hunter2hunter2"',
    "eval(user_input)", "return total", "pickle.loads(blob)", "key = random.random() + salt", "items = list(x for x in rows)", "except:",
    "session.commit()", "# updated in 2019 by hand", "// FIXME: old way", "innerHTML = a + b", "nodes(1)", "requests.get(url)",
    "def run(self):", "for i in range(len(rows)):", "for (let i = 0; i < rows.length; i++) {", "# legacy code path", 'print("secret: " + s)',
]
#: Files of users that leave 1, 2 or 3 over 5: runs of comments, of concatenations in a loop, of telling lines, as long as the
#: rules' own bounds ask for.
SPECIAL = {
    1: ["# x = compute(1)", "# if ready:", "# total(x)", "# for y in z", "return total", "# y = 2", "# import os"],
    2: ["while pending:", 'name += "x"', 'name += "yy"', 'name = name + "z"', "name += 'w'", 'name += "x"'],
    3: ['cursor.execute("SELECT " + q)', 'data = open(path).read().strip()', "answer = compute(first, 2)", 'send(message, "to all of them")'],
}
INDENT = "CASE WHEN user_id % 5 = 2 THEN CASE WHEN event_id % 6 = 0 THEN 0 ELSE 4 END WHEN user_id % 5 IN (1, 3) THEN 0 ELSE event_id % 9 * 4 END"
CATEGORY_OF_EVENT = {"view": "documentation", "signup": "testing", "click": "performance", "error": "security", "purchase": "complexity"}


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _choice(values: list[str]) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {k} THEN {_lit(t)}" for k, t in enumerate(values)) + " END"


#: The line of an event; the same text is SQL to Spark and to DuckDB.
LINE = "CASE " + " ".join(f"WHEN user_id % 5 = {k} THEN {_choice(v)}" for k, v in SPECIAL.items()) + f" ELSE {_choice(TEMPLATES)} END"


def code_lines(spark: SparkSession, events: DataFrame) -> DataFrame:
    """(file_id, line_no, line, stripped, indent, language): a file per user, a line per event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("t", F.expr(LINE)).select(
        F.col("user_id").alias("file_id"), F.row_number().over(order).alias("line_no"),
        F.when(F.col("t") == "", F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), F.expr(INDENT).cast("int")), "t")).alias("line"),
    )
    lang = F.when(F.col("file_id") % 3 == 0, "javascript").otherwise("python")
    return rows.select("file_id", "line_no", "line", stripped(F.col("line")).alias("stripped"), indent(F.col("line")).alias("indent"), lang.alias("language"))


CODE_LINES_SQL = (
    "code_lines AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS stripped, "
    "CAST(length(line) - length(regexp_replace(line, '^\\s+', '')) AS INTEGER) AS indent, "
    "CASE WHEN file_id % 3 = 0 THEN 'javascript' ELSE 'python' END AS language FROM ("
    "SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS line_no, "
    f"CASE WHEN t = '' THEN '' ELSE repeat(' ', CAST({INDENT} AS INTEGER)) || t END AS line FROM (SELECT *, {LINE} AS t FROM events)))"
)


def issues(events: DataFrame) -> DataFrame:
    """(id, category, severity, confidence, file_path, line_start, n_files): an issue per event."""
    value = F.col("value")
    table = F.create_map(*(F.lit(x) for pair in CATEGORY_OF_EVENT.items() for x in pair))
    severity = F.when(value > 200, "critical").when(value > 100, "high").when(value > 40, "medium").when(value > 10, "low").otherwise("info")
    return events.select(
        F.col("event_id").alias("id"), F.element_at(table, F.col("event_type")).alias("category"), severity.alias("severity"),
        (0.5 + (F.col("event_id") % 50) / 100.0).alias("confidence"), F.concat(F.lit("src/m"), F.col("user_id") % 40, F.lit(".py")).alias("file_path"),
        (F.col("event_id") % 200 + 1).cast("int").alias("line_start"), (F.col("event_id") % 3 + 1).cast("int").alias("n_files"),
    )


ISSUES_SQL = (
    "issues AS (SELECT event_id AS id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_OF_EVENT.items()) + " END AS category, "
    "CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'high' WHEN value > 40 THEN 'medium' WHEN value > 10 THEN 'low' ELSE 'info' END AS severity, "
    "CAST(0.5 AS DOUBLE) + CAST(event_id % 50 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS confidence, 'src/m' || (user_id % 40) || '.py' AS file_path, "
    "CAST(event_id % 200 + 1 AS INTEGER) AS line_start, CAST(event_id % 3 + 1 AS INTEGER) AS n_files FROM events)"
)


def commits(events: DataFrame) -> DataFrame:
    """(hash, author, date, file, added, deleted): a commit per event, a file per event type and user bucket."""
    return events.select(
        F.col("event_id").cast("string").alias("hash"), F.col("user_id").cast("string").alias("author"), F.col("ts").cast("timestamp").alias("date"),
        F.concat("event_type", F.lit("/f"), F.col("user_id") % 20).alias("file"), F.floor("value").cast("long").alias("added"), (F.col("event_id") % 7).alias("deleted"),
    )


COMMITS_SQL = (
    "commits AS (SELECT CAST(event_id AS VARCHAR) AS hash, CAST(user_id AS VARCHAR) AS author, ts AS date, event_type || '/f' || (user_id % 20) AS file, "
    "CAST(floor(value) AS BIGINT) AS added, event_id % 7 AS deleted FROM events)"
)
