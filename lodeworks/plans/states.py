"""Queries of caches, sinks, batches, conversation state, literals, saved analyses, record checks and the parser surface, with their
DuckDB statements. What streams share with batches runs here as a batch over all rows of the tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from lodeworks.functions.text import to_lines
from lodeworks.operators import focus as fo
from lodeworks.operators import literals as li
from lodeworks.operators import records as rc
from lodeworks.operators import registry as rg
from lodeworks.operators import reporting as rp
from lodeworks.plans import derived as dv
from lodeworks.plans import queries as own
from lodeworks.plans import structures as stq
from lodeworks.plans.queries import query, table
from lodeworks.sources import analyses as sa
from lodeworks.sources.scratch import scratch_dir, settled
from lodeworks.streaming import cache, sinks

# A cache a user: purchases and errors store an analysis, other events look one up.
_KIND = "CASE WHEN event_type IN ('purchase', 'error') THEN 'put' ELSE 'get' END"
_TTL, _CAPACITY = 3 * 86_400, 3
_ALIVE = f"list_filter(w.held, lambda x: e.ms - x.stored <= {_TTL * 1000})"
_NEW = "{'key': e.key, 'sha': e.sha, 'stored': e.ms, 'used': e.ms}"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, {_KIND} AS kind, 'f' || (event_id % 6) AS key, 'v' || (event_id // 6 % 2) AS sha,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events),
w AS (SELECT user_id, event_id, kind, key, k, CASE WHEN kind = 'put' THEN 'stored' ELSE 'miss' END AS outcome, CAST(NULL AS VARCHAR) AS evicted,
        CASE WHEN kind = 'put' THEN [{_NEW}] ELSE list_filter([{_NEW}], lambda x: false) END AS held FROM e WHERE k = 1
    UNION ALL SELECT user_id, event_id, kind, key, k, CASE WHEN kind = 'put' THEN 'stored' WHEN mine IS NULL THEN 'miss' WHEN mine.sha <> sha THEN 'changed' ELSE 'hit' END, out,
        CASE WHEN kind = 'put' THEN list_append(list_filter(others, lambda x: x.key IS DISTINCT FROM out), fresh) WHEN mine IS NULL THEN alive WHEN mine.sha <> sha THEN others
            ELSE list_append(others, {{'key': mine.key, 'sha': mine.sha, 'stored': mine.stored, 'used': ms}}) END
    FROM (SELECT *, list_filter(alive, lambda x: x.key <> key) AS others, list_filter(alive, lambda x: x.key = key)[1] AS mine,
            CASE WHEN kind = 'put' AND len(list_filter(alive, lambda x: x.key <> key)) >= {_CAPACITY}
                THEN list_sort(list_transform(list_filter(alive, lambda x: x.key <> key), lambda x: {{'used': x.used, 'key': x.key}}))[1].key END AS out
        FROM (SELECT e.*, {_ALIVE} AS alive, {_NEW} AS fresh FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS shard, event_id AS request, kind, key, outcome, evicted FROM w""")
def cache_lookups(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("shard"), k.alias("request"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.expr(_KIND).alias("kind"),
        F.concat(F.lit("f"), k % 6).alias("key"), F.concat(F.lit("v"), (F.floor(k / 6) % 2).cast("string")).alias("sha"),
    )
    return cache.replayed(rows, _TTL, _CAPACITY)


# Reviews: each file's issues are a pull request.
_MOST = 5


@query(f"""WITH {dv.ISSUES_SQL}, {own.RANKED}, n AS (SELECT *, CAST(regexp_extract(file_path, 'm(\\d+)', 1) AS INTEGER) AS number FROM ranked),
o AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY priority DESC, id) AS place FROM n),
g AS (SELECT number, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h,
    string_agg('{{"path":"' || file_path || '","body":"' || category || '","line":' || line_start || ',"side":"RIGHT"}}', ',' ORDER BY priority DESC, id) FILTER (WHERE place <= {_MOST}) AS first FROM o GROUP BY number),
s AS (SELECT *, n || ' issues, ' || c || ' critical, ' || h || ' high' AS said FROM g)
SELECT number, '/repos/org/repo' || (number % 3) || '/pulls/' || number || '/reviews' AS path,
    '{{"event":"' || CASE WHEN c > 0 THEN 'REQUEST_CHANGES' WHEN h > 0 THEN 'COMMENT' ELSE 'APPROVE' END || '","body":"' || said || '","comments":[' || first || ']}}' AS payload FROM s
UNION ALL SELECT number, '/repos/org/repo' || (number % 3) || '/statuses/' || md5(CAST(number AS VARCHAR)),
    '{{"state":"' || CASE WHEN c > 0 THEN 'failure' WHEN h > 0 THEN 'pending' ELSE 'success' END || '","description":"' || said || '","context":"code-quality"}}' FROM s""")
def review_requests(spark, d):
    number = F.regexp_extract("file_path", r"m(\d+)", 1).cast("int")
    issues = rp.prioritized(own._issues(spark, d)).withColumn("number", number).withColumns(
        {"owner": F.lit("org"), "repo": F.concat(F.lit("repo"), (F.col("number") % 3).cast("string")), "sha": F.md5(F.col("number").cast("string")), "title": F.col("category")})
    return sinks.review_requests(issues, _MOST).select("number", "path", "payload")


# Batches: a repository a user, an event a file of it; one that can't be read ends its analysis.
_JOBS = (
    "jobs AS (SELECT 'b' || (user_id % 10) AS batch, 'r' || user_id AS repository, bool_or(event_id % 397 = 0) AS bad, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total "
    "FROM events GROUP BY user_id)"
)


def _job(frame: pd.DataFrame) -> dict:
    if (frame["event_id"] % 397 == 0).any():
        raise ValueError("unreadable file")
    return {"files": len(frame), "total": int(frame["k"].sum())}


def _outcomes(spark, d):
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    return sinks.batch_outcomes(table(spark, d, "events").select(F.concat(F.lit("b"), (F.col("user_id") % 10).cast("string")).alias("batch"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repository"), "event_id", k), _job)


@query(f"""WITH {_JOBS} SELECT batch, repository, NOT bad AS ok, CASE WHEN NOT bad THEN '{{"files": ' || n || ', "total": ' || total || '}}' END AS result, CASE WHEN bad THEN 'ValueError: unreadable file' END AS error FROM jobs""")
def batch_jobs(spark, d):
    return _outcomes(spark, d)


@query(f"WITH {_JOBS} SELECT batch, count(*) AS total, count(*) FILTER (WHERE NOT bad) AS completed, count(*) FILTER (WHERE bad) AS failed, 'completed' AS status FROM jobs GROUP BY batch")
def batch_statuses(spark, d):
    out = _outcomes(spark, d)
    return sinks.batch_status(out.select("batch", "repository"), out)


# Conversations: a user's turn asks about a chunk, an assistant's may lead back.
_STEPS = (
    "said AS (SELECT conv_id, turn, role, text, lower(coalesce(text, '')) || CASE (conv_id + turn) % 4 WHEN 0 THEN ' in this function' WHEN 1 THEN ' the class' WHEN 2 THEN ' which file' ELSE '' END AS q, "
    "CASE WHEN (conv_id + turn) % 5 <> 0 THEN 'src/m' || (conv_id % 20) || '.py' END AS p, ['function', 'class', 'module'][1 + (conv_id + 2 * turn) % 3] AS kind, turn * 10 + 1 AS a, turn * 10 + 9 AS z FROM conversations), "
    "steps AS (SELECT conv_id, turn, CASE WHEN role = 'user' AND p IS NOT NULL THEN CASE WHEN contains(q, 'function') AND kind = 'function' THEN p || '::run()' WHEN contains(q, 'class') AND kind = 'class' THEN p || '::run' "
    "WHEN contains(q, 'file') OR contains(q, 'in this') THEN p ELSE p || ':' || a || '-' || z END END AS focus, coalesce(role = 'assistant' AND length(text) % 3 = 0, false) AS back FROM said), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM steps WHERE focus IS NOT NULL OR back), "
    "w AS (SELECT conv_id, turn, k, focus IS NOT NULL AS moved, CASE WHEN focus IS NULL THEN list_filter([''], lambda x: false) ELSE [focus] END AS st FROM s WHERE k = 1 "
    "UNION ALL SELECT s.conv_id, s.turn, s.k, s.focus IS NOT NULL OR len(st) > 1, CASE WHEN s.focus IS NOT NULL THEN list_append(st, s.focus)[-11:] WHEN len(st) > 1 THEN st[1:-2] ELSE st END "
    "FROM w JOIN s ON s.conv_id = w.conv_id AND s.k = w.k + 1)"
)


def _asked(spark, d):
    ends = F.expr("CASE (conv_id + turn) % 4 WHEN 0 THEN ' in this function' WHEN 1 THEN ' the class' WHEN 2 THEN ' which file' ELSE '' END")
    return table(spark, d, "conversations").withColumn("question", F.concat(F.coalesce("text", F.lit("")), ends))


def _states(spark, d):
    path = F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.concat(F.lit("src/m"), (F.col("conv_id") % 20).cast("string"), F.lit(".py")))
    kind = F.element_at(F.array(F.lit("function"), F.lit("class"), F.lit("module")), (1 + (F.col("conv_id") + 2 * F.col("turn")) % 3).cast("int"))
    made = fo.focus_of(F.col("question"), path, kind, F.lit("run"), F.col("turn") * 10 + 1, F.col("turn") * 10 + 9)
    steps = _asked(spark, d).select("conv_id", "turn", F.when(F.col("role") == "user", made).alias("focus"), ((F.col("role") == "assistant") & (F.length("text") % 3 == 0)).alias("back"))
    return fo.focus_states(steps)


@query(f"WITH RECURSIVE {_STEPS} SELECT conv_id, turn, moved, CAST(greatest(len(st) - 1, 0) AS INTEGER) AS depth, st[-1] AS current FROM w")
def focus_states(spark, d):
    return _states(spark, d).select("conv_id", "turn", "moved", "depth", "current")


_LAST = "last AS (SELECT conv_id, arg_max(st, k) AS st FROM w GROUP BY conv_id HAVING len(arg_max(st, k)) > 0)"


@query(f"WITH RECURSIVE {_STEPS}, {_LAST} SELECT conv_id, st[-1] AS current, array_to_string(st[1:-2], '>') AS history FROM last")
def focus_history(spark, d):
    return fo.focus_history(_states(spark, d)).select("conv_id", "current", F.array_join("history", ">").alias("history"))


@query(f"""WITH RECURSIVE {_STEPS}, {_LAST} SELECT conv_id, 'Current focus: ' || st[-1] || CASE WHEN len(st) > 1 THEN chr(10) || 'Recent focus history:' || chr(10) ||
    array_to_string(list_transform(st[1:-2][-3:], lambda x: '  - ' || x), chr(10)) ELSE '' END AS context FROM last""")
def focus_contexts(spark, d):
    return fo.focus_history(_states(spark, d)).select("conv_id", fo.context_text(F.col("current"), F.col("history")).alias("context"))


@query(f"""WITH RECURSIVE {_STEPS}, {_LAST}, u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, count(*) AS n, string_agg('  Q (general): ' || left(text, 40) || chr(10) || '  Confidence: 0.' || (50 + turn) || chr(10), chr(10) ORDER BY turn) FILTER (WHERE age <= 3) AS said FROM u GROUP BY conv_id)
SELECT q.conv_id, 'Conversation Context Summary' || chr(10) || repeat('=', 30) || chr(10) || 'Codebase: /src' || chr(10) || 'Session Duration: 0:10:00' || chr(10) || 'Questions Asked: ' || n || chr(10) || chr(10)
    || CASE WHEN st IS NULL THEN '' ELSE 'Current Focus:' || chr(10) || '  ' || st[-1] || chr(10) || chr(10) || CASE WHEN len(st) > 1 THEN 'Recent Focus History:' || chr(10)
        || array_to_string(list_transform(st[1:-2][-5:], lambda x, i: '  ' || i || '. ' || x), chr(10)) || chr(10) || chr(10) ELSE '' END END
    || 'Recent Questions:' || chr(10) || said AS summary FROM q LEFT JOIN last USING (conv_id)""")
def conversation_summaries(spark, d):
    asked = table(spark, d, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.substring("text", 1, 40).alias("question"), F.lit("general").alias("kind"), (0.5 + F.col("turn") / 100).alias("confidence"), F.array().cast("array<string>").alias("refs"))
    none = asked.select("conv_id", F.lit("").alias("word")).limit(0)
    return fo.conversation_summaries(asked, fo.focus_history(_states(spark, d)), none, "/src", F.lit("0:10:00"))


# Literals of the files of plans/structures.py: block, first line, last line, quote, text.
_PY_LITERALS = [
    (3, 2, 2, '"""', "Decides by many cases what to do."), (4, 2, 2, '"""', "Goes down step by step, :param a: what to look at."), (5, 2, 2, '"""', "Keeps things that matter."), (5, 4, 4, '"""', "todo"),
    (6, 3, 5, '"""', "Args:\n        url: where to look\n    "), (7, 2, 6, '"""', "Says what it does.\n\n    :param a: one\n    :param b: two\n    "), (10, 1, 1, '"""', "Module of derived code."), (14, 3, 3, "'", "one of many names"), (14, 3, 3, "'", "another one"),
]
_JS_LITERALS = [(0, 1, 1, "'", "pkg-a"), (0, 2, 2, '"', "./b"), (0, 3, 3, "'", "fs"), (0, 4, 4, "'", "side")]
_LITERAL = ["BIGINT", "INTEGER", "INTEGER", "VARCHAR", "VARCHAR"]


def _both(spark, d):
    made = [stq._files(spark, d, kind).withColumn("language", F.lit(kind)) for kind in ("python", "javascript")]
    return made[0].unionByName(made[1]).select("path", "content", "language")


@query(" UNION ALL ".join(
    f"SELECT * FROM (WITH {head}, l AS ({stq._rows(rows, _LITERAL)} v(k, a, z, quote, text)) SELECT path, above + a AS line_start, above + z AS line_end, quote, text FROM placed JOIN l USING (k))"
    for head, rows in ((stq.PY, _PY_LITERALS), (stq.JS, _JS_LITERALS))))
def string_literals(spark, d):
    return li.literal_spans(to_lines(_both(spark, d))).filter("closed").select("path", "line_start", "line_end", "quote", "text")


@query(" UNION ALL ".join(
    f"SELECT * FROM (WITH {head}, l AS ({stq._rows(rows, _LITERAL)} v(k, a, z, quote, text)) SELECT path, {value} AS value, count(*) AS n FROM placed JOIN l USING (k) GROUP BY ALL)"
    for head, rows, value in ((stq.PY, _PY_LITERALS, "text"), (stq.JS, _JS_LITERALS, "right(text, 1)"))))
def string_values(spark, d):
    """By Python's parser; of scripts, what the patterns' groups hold: each string's last character."""
    return li.string_values(_both(spark, d)).groupBy("path", "value").agg(F.count("*").alias("n"))


# Saved analyses: one a user, of two versions; some are cut off, lack keys or come from a later version.
_BROKEN = "CASE user_id % 10 WHEN 3 THEN 'no JSON object' WHEN 5 THEN 'missing keys' WHEN 7 THEN 'unknown version' END"


def _documents(spark, d):
    events = table(spark, d, "events")
    who = F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("analysis_id")
    rows = dv.issues(events).join(events.select(F.col("event_id").alias("id"), who), "id")
    issues = rows.select(
        "analysis_id", F.col("id").cast("string").alias("id"), "category", "severity", F.initcap("category").alias("title"), F.lit('a "quoted" text').alias("description"), "file_path", "line_start",
        (F.col("line_start") + 2).alias("line_end"), F.lit(None).cast("string").alias("suggestion"), "confidence", F.lit("2024-01-01T00:00:00").alias("created_at"), F.array("file_path").alias("affected_files"),
    )
    users = events.select("user_id", who).distinct()
    analyses = users.select("analysis_id", F.lit("2024-01-31 00:00:00").cast("timestamp").alias("timestamp"), F.lit("/src").alias("codebase_path"))
    files = issues.select("analysis_id", F.col("file_path").alias("path"), F.lit("python").alias("language")).distinct()
    saved = sa.documents_from(analyses, issues, files, "0.1.0").join(users, "analysis_id")
    k, t = F.col("user_id") % 10, F.col("text")
    text = F.when(k == 3, F.expr("substring(text, 1, length(text) - 7)")).when(k == 5, F.replace(t, F.lit(',"options":{}'), F.lit("")))
    text = text.when(k == 7, F.replace(t, F.lit('"version":"0.1.0"'), F.lit('"version":"9.9"'))).when(k == 8, F.replace(t, F.lit('"version":"0.1.0"'), F.lit('"new_field":"own","version":"0.2.0"')))
    return sa.documents_of(saved.select(F.col("analysis_id").alias("path"), text.otherwise(t).alias("text")))


@query(f"""WITH {dv.ISSUES_SQL} SELECT 'a' || user_id AS analysis_id, CAST(id AS VARCHAR) AS id, category, severity, file_path, line_start, line_start + 2 AS line_end, confidence, file_path AS affected
FROM issues JOIN events ON id = event_id WHERE {_BROKEN} IS NULL""", rounded=("confidence",))
def analysis_issues(spark, d):
    rows = sa.issues_of(sa.migrated(sa.usable(_documents(spark, d))))
    return rows.select("analysis_id", "id", "category", "severity", "file_path", "line_start", "line_end", "confidence", F.array_join("affected_files", ",").alias("affected"))


@query(f"""WITH u AS (SELECT DISTINCT user_id, {_BROKEN} AS problem FROM events) SELECT 'a' || user_id AS path, problem,
    CASE problem WHEN 'no JSON object' THEN '{",".join(sorted(sa.REQUIRED))}' WHEN 'missing keys' THEN 'options' ELSE '' END AS missing FROM u WHERE problem IS NOT NULL""")
def analysis_quarantine(spark, d):
    return sa.quarantined(_documents(spark, d)).withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {dv.ISSUES_SQL} SELECT 'a' || user_id AS analysis_id, '0.2.0' AS version, '/src' AS codebase_path, CAST(count(DISTINCT file_path) AS INTEGER) AS n_files, CAST(count(*) AS INTEGER) AS n_issues,
    CASE WHEN user_id % 10 = 8 THEN 'own' ELSE 'default_value' END AS new_field FROM issues JOIN events ON id = event_id WHERE {_BROKEN} IS NULL GROUP BY user_id""")
def analyses_loaded(spark, d):
    now = sa.migrated(sa.usable(_documents(spark, d)))
    return sa.loaded(now).join(now.select("path", sa.field("new_field").alias("new_field")), "path").select("analysis_id", "version", "codebase_path", "n_files", "n_issues", "new_field")


# Record checks: every issue, some with what isn't allowed.
_DEFECTS = [  # every so many-th id, column, its value, reason
    (11, "title", "' '", "Issue title cannot be empty"), (13, "severity", "'worst'", "Invalid issue severity"), (17, "confidence", "CAST(1.5 AS DOUBLE)", "Invalid confidence value"),
    (19, "line_start", "0", "line_start must be at least 1"), (23, "line_end", "-1", "line_end must be >= line_start"), (29, "file_path", "''", "File path cannot be empty"),
]
_CHECK_ORDER = ["Issue title cannot be empty", "Invalid issue severity", "Invalid confidence value", "File path cannot be empty", "line_start must be at least 1", "line_end must be >= line_start", "Invalid affected file path"]
_TESTS = {reason: f"id % {k} = 0" for k, _, _, reason in _DEFECTS} | {"Invalid affected file path": "id % 29 = 0"}
_FOUND = "concat_ws('; ', " + ", ".join(f"CASE WHEN {_TESTS[r]} THEN '{r}' END" for r in _CHECK_ORDER) + ")"


def _records(spark, d):
    rows = dv.issues(table(spark, d, "events")).withColumns({"title": F.initcap("category"), "description": F.lit("d"), "line_end": F.col("line_start") + 3})
    rows = rows.withColumns({column: F.expr(f"CASE WHEN id % {k} = 0 THEN {value} ELSE {column} END") for k, column, value, _ in _DEFECTS})
    return rows.withColumn("affected_files", F.array("file_path"))


@query(f"WITH {dv.ISSUES_SQL} SELECT id, {_FOUND} AS reasons, {_FOUND} = '' AS valid FROM issues")
def record_checks(spark, d):
    return rc.checked(_records(spark, d), rc.issue_reasons()).select("id", F.array_join("reasons", "; ").alias("reasons"), "valid")


@query(f"WITH {dv.ISSUES_SQL} SELECT 'n' AS name, count(*) AS n FROM issues UNION ALL SELECT 'n_valid', count(*) FROM issues WHERE {_FOUND} = '' "
       + " ".join(f"UNION ALL SELECT '{r}', count(*) FROM issues WHERE {_TESTS[r]}" for r in _CHECK_ORDER))
def record_metrics(spark, d):
    """Observed while good rows and the quarantine are written."""
    metrics = rc.write_split(_records(spark, d), rc.issue_reasons(), _CHECK_ORDER, f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}")
    return spark.createDataFrame(list(metrics.items()), "name string, n long")


# The surface of parsers and analyzers.


@query(f"WITH {stq.PY} SELECT path, name, owner, line_start, line_end, complexity FROM f")
def elements_in_sql(spark, d):
    """The parser as a table function, partitioned by file."""
    rg.Registry().register(spark)
    files = f"files_{uuid.uuid4().hex}"
    stq._files(spark, d, "python").select("path", "content").createOrReplaceTempView(files)
    return spark.sql(f"SELECT path, name, owner, line_start, line_end, complexity FROM python_elements(TABLE({files}) PARTITION BY (path), 'function')")


@query(f"""SELECT 'python' AS language, 'function' AS kind, (WITH {stq.PY} SELECT count(*) FROM f) AS n UNION ALL SELECT 'python', 'class', (WITH {stq.PY} SELECT count(*) FROM c)
UNION ALL SELECT 'python', 'import', (WITH {stq.PY} SELECT count(*) FROM i) UNION ALL SELECT 'python', 'file', (WITH {stq.PY} SELECT count(*) FROM files)
UNION ALL SELECT 'javascript', 'function', (WITH {stq.JS} SELECT count(*) FROM placed JOIN sf USING (k)) UNION ALL SELECT 'javascript', 'class', (WITH {stq.JS} SELECT count(*) FROM placed JOIN sc USING (k))
UNION ALL SELECT 'javascript', 'method', (WITH {stq.JS} SELECT CAST(sum(len(string_split(methods, ','))) AS BIGINT) FROM placed JOIN sc USING (k))
UNION ALL SELECT 'javascript', 'import', (WITH {stq.JS} SELECT count(*) FROM placed JOIN si USING (k))""")
def parsed_languages(spark, d):
    """Files of two languages in one pass, each by its language's parser."""
    return rg.Registry().parse(_both(spark, d)).groupBy("language", "kind").agg(F.count("*").alias("n"))


def _found(title: str, category: str, where: str, severity: str, confidence: float):
    def analyze(files, elements):
        rows = elements.filter(where)
        return rows.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.col("path").alias("file_path"), "line_start", F.lit(confidence).alias("confidence"))

    return analyze


@query(f"""SELECT * FROM (WITH {stq.PY} SELECT 'arguments' AS analyzer, 'complexity' AS category, 'low' AS severity, path AS file_path, line_start FROM f WHERE n_parameters > 5
UNION ALL SELECT 'branches', 'complexity', 'high', path, line_start FROM f WHERE complexity > 10
UNION ALL SELECT 'pickles', 'security', 'medium', path, line_start FROM i WHERE module = 'pickle')
UNION ALL SELECT * FROM (WITH {stq.JS} SELECT 'branches', 'complexity', 'high', path, above + a FROM placed JOIN sf USING (k) WHERE complexity > 10)""")
def registered_analyzers(spark, d):
    """Analyzers of two languages over what the parsers found; one is off, one isn't sure enough."""
    registry, both = rg.Registry(), ("python", "javascript")
    registry.add_analyzer(rg.Analyzer("arguments", "complexity", ("python",), _found("too many", "complexity", "size(parameters) > 5", "low", 0.85)))
    registry.add_analyzer(rg.Analyzer("branches", "complexity", both, _found("too branchy", "complexity", "kind = 'function' AND complexity > 10", "high", 0.9)))
    registry.add_analyzer(rg.Analyzer("pickles", "security", ("python",), _found("pickle", "security", "kind = 'import' AND module = 'pickle'", "medium", 0.7), 1))
    registry.add_analyzer(rg.Analyzer("guesses", "testing", both, _found("guess", "testing", "kind = 'function'", "low", 0.5)))
    registry.add_analyzer(rg.Analyzer("off", "testing", both, _found("off", "testing", "kind = 'function'", "low", 0.9), 2, {"enabled": False}))
    files = settled(_both(spark, d), "files")
    return registry.run(files, settled(registry.parse(files), "elements")).select("analyzer", "category", "severity", "file_path", "line_start")


@query(f"WITH {dv.ISSUES_SQL} SELECT '/src' AS path, 'Codebase: /src' || chr(10) || 'Files Analyzed: ' || count(DISTINCT file_path) || chr(10) || 'Code Quality Analysis: ' || count(*) || ' issues found' || chr(10) || "
       "'Languages: python' || chr(10) || 'Note: Focus on the specific issues and code details when answering questions.' AS context FROM issues")  # fmt: skip
def codebase_context(spark, d):
    sums = own._issues(spark, d).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("issues"), F.collect_set(F.lit("python")).alias("languages"))
    return sums.select(F.lit("/src").alias("path"), fo.codebase_text(F.lit("/src"), F.col("files"), F.col("issues"), F.col("languages")).alias("context"))


