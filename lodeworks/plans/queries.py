"""Queries over the test tables and their DuckDB statements: scans, line rules, islands, reports, churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions import text as tx
from lodeworks.functions.weights import (
    CATEGORIES, DENSITY_WEIGHT, EFFORT_OF_CATEGORY, EFFORT_OF_SEVERITY, IMPACT_OF_CATEGORY, IMPACT_OF_SEVERITY, sql_case,
)
from lodeworks.operators import churn as ch
from lodeworks.operators import duplicates as du
from lodeworks.operators import lines as ln
from lodeworks.operators import reporting as rp
from lodeworks.plans import catalogue as cat
from lodeworks.plans import derived as dv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None, rounded: tuple[str, ...] = ()):
    """Registers a function (spark, sf_dir) under its name, with its statement.

    rounded: doubles that both sides round to nine places, as sums of doubles depend on their order.
    """

    def keep(f):
        def made(spark, d):
            df = f(spark, d)
            return df.withColumns({c: F.round(c, 9) for c in rounded}) if rounded else df

        QUERIES[f.__name__] = made
        if oracle:
            columns = ", ".join(f"round({c}, 9) AS {c}" for c in rounded)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({columns}) FROM ({oracle})" if rounded else oracle
        return f

    return keep


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _code(spark, d) -> DataFrame:
    return dv.code_lines(spark, table(spark, d, "events"))


def _issues(spark, d) -> DataFrame:
    return dv.issues(table(spark, d, "events"))


# SQL pieces shared by several statements.
DOC_LINES = (
    "doc_lines AS (SELECT doc_id, lang, source, CAST(i AS INTEGER) AS line_no, ls[i] AS line, regexp_replace(ls[i], '^\\s+|\\s+$', '', 'g') AS stripped, "
    "CAST(length(ls[i]) - length(regexp_replace(ls[i], '^\\s+', '')) AS INTEGER) AS indent FROM (SELECT doc_id, lang, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM ("
    "SELECT doc_id, lang, source, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS ls FROM (SELECT doc_id, lang, source, "
    "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS p FROM documents))))"
)
FILES = "files AS (SELECT doc_id, lang, count(*) AS line_count FROM doc_lines GROUP BY doc_id, lang)"


def _doc_lines(spark, d) -> DataFrame:
    return tx.to_lines(_docs(spark, d).select("doc_id", "lang", "source", "text"), text="text")


@query(f"WITH {DOC_LINES}, n AS (SELECT doc_id, count(*) AS line_count FROM doc_lines GROUP BY doc_id) "
       "SELECT d.doc_id, lang, CAST(strlen(text) AS BIGINT) AS size_bytes, CAST(length(text) AS BIGINT) AS n_characters, coalesce(line_count, 0) AS line_count "
       "FROM documents d LEFT JOIN n USING (doc_id)")  # fmt: skip
def file_metadata(spark, d):
    lines = tx.split_lines(F.col("text"))
    return _docs(spark, d).select(
        "doc_id", "lang", F.octet_length("text").cast("long").alias("size_bytes"), F.length("text").cast("long").alias("n_characters"),
        F.greatest(F.size(lines), F.lit(0)).cast("long").alias("line_count"),
    )


@query("SELECT lang, count(*) AS n_files FROM documents GROUP BY lang")
def language_distribution(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("n_files"))


@query(f"WITH {DOC_LINES}, {FILES} SELECT coalesce(lang, 'all') AS lang, count(*) AS n_files, CAST(sum(line_count) AS BIGINT) AS n_lines, max(line_count) AS longest "
       "FROM files GROUP BY ROLLUP (lang)")  # fmt: skip
def parsing_statistics(spark, d):
    n = F.size(tx.split_lines(F.col("text"))).cast("long")
    rows = _docs(spark, d).select("lang", n.alias("n")).rollup("lang")
    rows = rows.agg(F.count("*").alias("n_files"), F.sum("n").alias("n_lines"), F.max("n").alias("longest"))
    return rows.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query(f"WITH {DOC_LINES}, {FILES} SELECT CAST(floor(line_count / 5) AS BIGINT) AS bucket, count(*) AS n_files FROM files GROUP BY 1")
def line_count_histogram(spark, d):
    n = F.size(tx.split_lines(F.col("text")))
    return _docs(spark, d).groupBy(F.floor(n / 5).alias("bucket")).agg(F.count("*").alias("n_files"))


@query("SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de')")
def language_filter(spark, d):
    return _docs(spark, d).filter(F.col("lang").isin("en", "de")).select("doc_id", "source")


SECRET_RULES = cat.chosen("security", ids={r.id for r in cat.RULES if r.id.startswith("secret_")})


@query(f"WITH {DOC_LINES} SELECT doc_id, line_no, rule_id, pattern_no FROM ({cat.sql_of(SECRET_RULES, 'doc_lines', 'lang', 'doc_id, line_no')})")
def secret_lines(spark, d):
    return cat.apply_rules(_doc_lines(spark, d), SECRET_RULES, F.col("lang")).select("doc_id", "line_no", "rule_id", "pattern_no")


@query(f"WITH {DOC_LINES} SELECT doc_id, line_no, regexp_extract(line, '(19|20)[0-9][0-9]') AS year FROM doc_lines WHERE regexp_matches(line, '(19|20)[0-9][0-9]')")
def years_in_lines(spark, d):
    pattern = "(19|20)[0-9][0-9]"
    return _doc_lines(spark, d).filter(F.col("line").rlike(pattern)).select("doc_id", "line_no", F.regexp_extract("line", pattern, 0).alias("year"))


ALL_RULES = list(cat.RULES)


@query(f"WITH {dv.CODE_LINES_SQL} SELECT file_id, line_no, rule_id, severity, confidence, pattern_no FROM ({cat.sql_of(ALL_RULES, 'code_lines', 'language', 'file_id, line_no')})")
def rule_findings_derived(spark, d):
    return cat.apply_rules(_code(spark, d), ALL_RULES, F.col("language")).select("file_id", "line_no", "rule_id", "severity", "confidence", "pattern_no")


@query(f"WITH {dv.CODE_LINES_SQL} SELECT category, severity, count(*) AS n FROM ({cat.sql_of(ALL_RULES, 'code_lines', 'language', 'file_id, line_no')}) GROUP BY category, severity")
def rule_hits_by_category_derived(spark, d):
    return cat.apply_rules(_code(spark, d), ALL_RULES, F.col("language")).groupBy("category", "severity").agg(F.count("*").alias("n"))


@query(f"WITH {dv.CODE_LINES_SQL} SELECT file_id, line_no, regexp_extract(line, '(\\w+)\\s*\\(', 1) AS function_name FROM code_lines "
       "WHERE regexp_matches(line, '\\beval\\s*\\(|\\bexec\\s*\\(|__import__\\s*\\(')")  # fmt: skip
def dangerous_calls_derived(spark, d):
    rule = cat.chosen(ids={"dangerous_function_py"})[0]
    found = _code(spark, d).filter(F.col("line").rlike("|".join(rule.patterns)))
    return found.select("file_id", "line_no", F.regexp_extract("line", r"(\w+)\s*\(", 1).alias("function_name"))


@query(f"WITH {dv.CODE_LINES_SQL}, c AS (SELECT file_id, line_no, len(regexp_extract_all(line, ' and ')) + len(regexp_extract_all(line, ' or ')) "
       "+ len(regexp_extract_all(line, '&&')) + len(regexp_extract_all(line, '\\|\\|')) AS n_operators, line FROM code_lines) "
       "SELECT file_id, line_no, CAST(n_operators AS BIGINT) AS n_operators FROM c WHERE n_operators > 3 AND regexp_matches(line, 'if |elif |while ')")  # fmt: skip
def complex_conditions_derived(spark, d):
    return ln.complex_conditions(_code(spark, d))


@query(f"WITH {dv.CODE_LINES_SQL}, c AS (SELECT file_id, line_no, CAST(len(regexp_extract_all(regexp_extract(line, '\\(([^)]*)\\)', 1), ',')) AS BIGINT) AS n_commas FROM code_lines) "
       "SELECT * FROM c WHERE n_commas > 6")  # fmt: skip
def call_arguments_derived(spark, d):
    return ln.many_arguments(_code(spark, d))


@query(f"WITH {dv.CODE_LINES_SQL} SELECT file_id, line_no, CAST(floor(indent / 4) AS BIGINT) AS level FROM code_lines WHERE stripped <> '' AND floor(indent / 4) > 6")
def deep_nesting_derived(spark, d):
    return ln.deep_nesting(_code(spark, d))


BLOCKS = (
    "{0}_runs AS (SELECT *, stripped = '' OR starts_with(stripped, '#') OR starts_with(stripped, '//') AS apart FROM {0}), "
    "{0}_seg AS (SELECT *, sum(CAST(apart AS INTEGER)) OVER (PARTITION BY {1} ORDER BY line_no) AS run FROM {0}_runs), "
    "{0}_base AS (SELECT *, min(indent) OVER (PARTITION BY {1}, run ORDER BY line_no) AS base FROM {0}_seg WHERE NOT apart), "
    "blocks AS (SELECT {1}, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS code "
    "FROM {0}_base GROUP BY {1}, run, base HAVING count(*) >= {2})"
)


@query(f"WITH {DOC_LINES}, {BLOCKS.format('doc_lines', 'doc_id', 5)} SELECT doc_id AS file_id, start_line, end_line, n_lines, md5(code) AS digest FROM blocks")
def code_blocks(spark, d):
    return ln.code_blocks(_doc_lines(spark, d).withColumnRenamed("doc_id", "file_id")).select("file_id", "start_line", "end_line", "n_lines", F.md5("code").alias("digest"))


NORMAL = ("lower(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(code, chr(10)), "
          "lambda x: regexp_replace(regexp_replace(x, '(#|//).*$', ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' '), '\\s+', ' ', 'g'), "
          "'\\s*([{}();,])\\s*', '\\1', 'g'))")  # fmt: skip


@query(f"WITH {DOC_LINES}, {BLOCKS.format('doc_lines', 'doc_id', 5)} SELECT md5({NORMAL}) AS digest, count(*) AS n, min(doc_id) AS first_id FROM blocks GROUP BY 1 HAVING count(*) > 1")
def duplicate_blocks(spark, d):
    blocks = ln.code_blocks(_doc_lines(spark, d).withColumnRenamed("doc_id", "file_id")).withColumn("normal", ln.normalized_code(F.col("code")))
    return du.exact_groups(blocks, "normal", "file_id")


@query(f"WITH {dv.CODE_LINES_SQL}, {BLOCKS.format('code_lines', 'file_id', 5)} SELECT file_id, start_line, end_line, n_lines, {NORMAL} AS normal FROM blocks")
def code_blocks_derived(spark, d):
    return ln.code_blocks(_code(spark, d)).select("file_id", "start_line", "end_line", "n_lines", ln.normalized_code(F.col("code")).alias("normal"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return du.exact_groups(_docs(spark, d), "text", "doc_id")


@query(f"WITH {dv.CODE_LINES_SQL}, c AS (SELECT file_id, line_no, regexp_matches(stripped, '^(#|//)') AND regexp_matches(stripped, {cat.sql_text(ln.CODE_COMMENT)}) AS is_code FROM code_lines), "
       "r AS (SELECT *, sum(CAST(NOT is_code AS INTEGER)) OVER (PARTITION BY file_id ORDER BY line_no) AS run, max(line_no) OVER (PARTITION BY file_id) AS last FROM c) "
       "SELECT file_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM r WHERE is_code GROUP BY file_id, run HAVING count(*) >= 3 AND max(line_no) < max(last)")  # fmt: skip
def commented_code_derived(spark, d):
    return ln.commented_code(_code(spark, d))


LOOPS = (
    "n AS (SELECT *, regexp_matches(stripped, '\\b(for|while)\\b') AND contains(stripped, ':') AS is_loop FROM code_lines WHERE stripped <> '' AND NOT starts_with(stripped, '#')), "
    "inside AS (SELECT l.file_id, l.line_no, l.line, max(p.line_no) AS loop_line FROM n l JOIN n p ON p.file_id = l.file_id AND p.line_no < l.line_no AND p.is_loop "
    "WHERE NOT l.is_loop AND p.indent < (SELECT min(x.indent) FROM n x WHERE x.file_id = l.file_id AND x.line_no > p.line_no AND x.line_no <= l.line_no) GROUP BY ALL)"
)


@query(f"WITH {dv.CODE_LINES_SQL}, {LOOPS} SELECT file_id, line_no, CAST(loop_line AS BIGINT) AS loop_line FROM inside WHERE regexp_matches(line, {cat.sql_text('(?i)' + ln.DB_CALL)})")
def db_calls_in_loops_derived(spark, d):
    return ln.calls_in_loops(ln.loop_context(_code(spark, d)), "(?i)" + ln.DB_CALL)


@query(f"WITH {dv.CODE_LINES_SQL}, {LOOPS} SELECT file_id, line_no, CAST(loop_line AS BIGINT) AS loop_line FROM inside WHERE regexp_matches(line, {cat.sql_text(ln.IO_CALL)})")
def io_in_loops_derived(spark, d):
    return ln.calls_in_loops(ln.loop_context(_code(spark, d)), ln.IO_CALL)


@query(f"WITH {dv.CODE_LINES_SQL}, {LOOPS}, c AS (SELECT file_id, line_no, CAST(loop_line AS BIGINT) AS loop_line, CAST(row_number() OVER (PARTITION BY file_id, loop_line ORDER BY line_no) AS INTEGER) AS nth "
       f"FROM inside WHERE regexp_matches(line, {cat.sql_text(ln.CONCAT)})) SELECT * FROM c WHERE nth > 2")  # fmt: skip
def concatenations_in_loops_derived(spark, d):
    return ln.concatenations(ln.loop_context(_code(spark, d)))


# A loop goes on a stack; other lines take off its end what stands no less deep, down to the first loop that does.
@query(f"""WITH RECURSIVE {dv.CODE_LINES_SQL}, n AS (SELECT *, regexp_matches(stripped, '\\b(for|while)\\b') AND contains(stripped, ':') AS is_loop,
    row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM code_lines WHERE stripped <> '' AND NOT starts_with(stripped, '#')),
w AS (SELECT file_id, line_no, k, is_loop, CASE WHEN is_loop THEN [indent] ELSE CAST([] AS INTEGER[]) END AS stack FROM n WHERE k = 1
    UNION ALL SELECT n.file_id, n.line_no, n.k, n.is_loop, CASE WHEN n.is_loop THEN list_append(stack, n.indent)
        ELSE stack[:coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda i: stack[i] < n.indent)), 0)] END FROM w JOIN n ON n.file_id = w.file_id AND n.k = w.k + 1)
SELECT file_id, line_no, len(stack) AS depth_ref, CASE WHEN len(stack) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM w WHERE is_loop AND len(stack) > 1""")
def nested_loops_derived(spark, d):
    return ln.nested_loops(ln.loop_context(_code(spark, d)))


_OPENS = " OR ".join(f"contains(stripped, '{w}')" for w in ln.NESTING_WORDS)
_WORDS = " + ".join(f"CAST(regexp_matches(stripped, '\\b{w}\\b') AS INTEGER)" for w in ln.COUNTED_WORDS)
_LOGIC = " + ".join(f"(length(stripped) - length(replace(stripped, '{o}', ''))) / {len(o)}" for o in ln.LOGICAL)


@query(f"WITH {dv.CODE_LINES_SQL}, c AS (SELECT *, sum(CAST(({_OPENS}) AND ends_with(stripped, ':') AS INTEGER)) OVER (PARTITION BY file_id ORDER BY line_no) AS depth FROM code_lines) "
       f"SELECT file_id, CAST(greatest(1, sum(({_WORDS}) * (depth + 1) + {_LOGIC})) AS BIGINT) AS cognitive FROM c GROUP BY file_id")  # fmt: skip
def cognitive_complexity_derived(spark, d):
    return ln.cognitive_complexity(_code(spark, d))


@query(f"""WITH RECURSIVE {dv.CODE_LINES_SQL}, c AS (SELECT file_id, line_no, CAST(({_OPENS} OR contains(stripped, 'with')) AND ends_with(stripped, ':') AS INTEGER) AS up,
    CAST(stripped IN ('pass', 'break', 'continue', 'return') OR starts_with(stripped, 'except') OR starts_with(stripped, 'finally') AS INTEGER) AS down FROM code_lines),
w AS (SELECT file_id, line_no, greatest(0, up - down) AS depth, up AS top FROM c WHERE line_no = 1
    UNION ALL SELECT c.file_id, c.line_no, greatest(0, w.depth + up - down), w.depth + up FROM w JOIN c ON c.file_id = w.file_id AND c.line_no = w.line_no + 1)
SELECT file_id, CAST(max(greatest(top, depth)) AS BIGINT) AS max_depth FROM w GROUP BY file_id""")
def nesting_depth_derived(spark, d):
    return ln.nesting_depth(_code(spark, d))


@query(f"""WITH {dv.CODE_LINES_SQL}, t AS (SELECT *, length(stripped) > 20 AND NOT regexp_matches(stripped, {cat.sql_text(ln.UNLIKELY)}) AS telling,
    regexp_replace(regexp_replace(regexp_replace(stripped, '["''][^"'']*["'']', '""', 'g'), '\\b\\d+\\b', '0', 'g'), '\\b[a-zA-Z_]\\w*\\b', 'VAR', 'g') AS shape FROM code_lines),
k AS (SELECT file_id, line_no, shape, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS r FROM t WHERE telling),
s AS (SELECT file_id, line_no AS start_line FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM t) WHERE line_no <= n - 10),
f AS (SELECT s.file_id, s.start_line, min(r) AS r FROM s JOIN k ON k.file_id = s.file_id AND k.line_no >= s.start_line GROUP BY ALL)
SELECT f.file_id, start_line, max(line_no) AS end_line, string_agg(shape, '|' ORDER BY line_no) AS signature FROM f JOIN k ON k.file_id = f.file_id AND k.r BETWEEN f.r AND f.r + 7
GROUP BY f.file_id, start_line HAVING count(*) = 8 AND max(line_no) <= start_line + 19""")
def structural_signatures_derived(spark, d):
    return ln.signatures(_code(spark, d))


QUALITY = (
    f"f AS (SELECT count(*) AS n_issues, sum({sql_case(DENSITY_WEIGHT, 'severity')}) AS weighted FROM issues), "
    "g AS (SELECT count(*) AS n_files, sum(line_count) AS n_lines, avg(line_count % 7) AS elements FROM files), "
    "quality AS (SELECT n_issues, n_files, CAST(n_lines AS BIGINT) AS n_lines, weighted / n_lines AS density, greatest(0, 100 - 1000 * (weighted / n_lines)) AS overall, "
    "1000 * (weighted / n_lines) AS technical_debt, greatest(0, 100 - 2 * elements - weighted / 10) AS maintainability FROM f, g)"
)


def _quality(spark, d):
    files = _docs(spark, d).select(F.size(tx.split_lines(F.col("text"))).alias("line_count"))
    return rp.quality_metrics(_issues(spark, d), files.withColumn("n_elements", F.col("line_count") % 7))


@query(f"WITH {dv.ISSUES_SQL}, {DOC_LINES}, {FILES}, {QUALITY} SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade FROM quality", rounded=("density", "overall", "technical_debt", "maintainability"))
def quality_metrics(spark, d):
    return _quality(spark, d)


@query(f"WITH {dv.ISSUES_SQL}, c AS (SELECT * FROM (VALUES {', '.join(f"('{c}')" for c in CATEGORIES)}) v(category)), n AS (SELECT category, count(*) AS n FROM issues GROUP BY 1), "
       "j AS (SELECT category, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (category)) SELECT category, n, greatest(0.0, 100 - 100 * n / (SELECT sum(n) FROM j)) AS score FROM j", rounded=("score",))  # fmt: skip
def category_scores(spark, d):
    return rp.category_scores(_issues(spark, d))


RANKED = (
    "counted AS (SELECT *, count(*) OVER (PARTITION BY category, severity) AS alike FROM issues), "
    "weighed AS (SELECT *, CAST(CASE WHEN alike <= 1 THEN 1 WHEN alike <= 3 THEN 3 WHEN alike <= 5 THEN 5 WHEN alike <= 10 THEN 7 ELSE 10 END AS DOUBLE) AS frequency, "
    f"least({sql_case(IMPACT_OF_SEVERITY, 'severity')} * {sql_case(IMPACT_OF_CATEGORY, 'category', '1.0')} * confidence * least(1 + CAST(0.1 AS DOUBLE) * (n_files - 1), 2.0), 10.0) AS impact, "
    f"least({sql_case(EFFORT_OF_CATEGORY, 'category', '5.0')} * {sql_case(EFFORT_OF_SEVERITY, 'severity')}, 10.0) AS effort FROM counted), "
    "pri AS (SELECT *, least(impact * frequency / effort, 10.0) AS priority FROM weighed), "
    "ranked AS (SELECT *, CASE WHEN priority >= 8 THEN 'Critical' WHEN priority >= 6 THEN 'High' WHEN priority >= 4 THEN 'Medium' WHEN priority >= 2 THEN 'Low' ELSE 'Info' END AS priority_level FROM pri)"
)


@query(f"WITH {dv.ISSUES_SQL}, {RANKED} SELECT id, round(impact, 6) AS impact, round(effort, 6) AS effort, frequency, round(priority, 6) AS priority, priority_level FROM ranked")
def prioritized_issues(spark, d):
    r = rp.prioritized(_issues(spark, d))
    return r.select("id", F.round("impact", 6).alias("impact"), F.round("effort", 6).alias("effort"), "frequency", F.round("priority", 6).alias("priority"), "priority_level")


@query(f"WITH {dv.ISSUES_SQL}, {RANKED} SELECT id, category, round(priority, 6) AS priority FROM ranked ORDER BY ranked.priority DESC, id LIMIT 10")
def top_issues(spark, d):
    return rp.top_issues(rp.prioritized(_issues(spark, d))).select("id", "category", F.round("priority", 6).alias("priority"))


@query(f"WITH {dv.ISSUES_SQL} SELECT file_path, count(*) AS n FROM issues GROUP BY 1 ORDER BY n DESC, file_path LIMIT 10")
def top_files(spark, d):
    return rp.top_files(_issues(spark, d))


@query(f"WITH {dv.ISSUES_SQL}, {RANKED} SELECT 'category' AS dimension, category AS value, count(*) AS n FROM ranked GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM ranked GROUP BY 2 "
       "UNION ALL SELECT 'priority_level', priority_level, count(*) FROM ranked GROUP BY 2 UNION ALL SELECT 'file_path', file_path, count(*) FROM ranked GROUP BY 2")  # fmt: skip
def report_summary(spark, d):
    return rp.summary(rp.prioritized(_issues(spark, d)))


@query(f"WITH {dv.ISSUES_SQL} SELECT id, category, severity FROM issues WHERE category IN ('security', 'testing') AND severity IN ('high', 'critical') AND confidence >= 0.7")
def selected_issues(spark, d):
    return rp.selected(_issues(spark, d), ["security", "testing"], "high", 0.7).select("id", "category", "severity")


@query(f"WITH {dv.ISSUES_SQL} SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS n_{s}" for s in ("critical", "high", "medium", "low", "info")) + " FROM issues")
def severity_counts(spark, d):
    return rp.severity_counts(_issues(spark, d))


@query(f"WITH {dv.ISSUES_SQL}, {DOC_LINES}, {FILES}, {QUALITY}, s AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'high') AS n_high FROM issues) "
       "SELECT n_critical, n_high, overall, CASE WHEN n_critical > 0 OR n_high > 5 THEN 'fail' WHEN overall < 70 THEN 'warn' ELSE 'pass' END AS gate FROM s, quality", rounded=("overall",))  # fmt: skip
def quality_gate(spark, d):
    return rp.quality_gate(_issues(spark, d), _quality(spark, d))


@query(f"WITH {dv.ISSUES_SQL}, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS n_critical, count(*) FILTER (WHERE severity = 'high') AS n_high FROM issues "
       "WHERE file_path IN ('src/m1.py', 'src/m2.py', 'src/m3.py')) SELECT *, CASE WHEN n_critical > 0 THEN 'REQUEST_CHANGES' WHEN n_high > 0 THEN 'COMMENT' ELSE 'APPROVE' END AS decision, "
       "CASE WHEN n_critical > 0 THEN 'failure' WHEN n_high > 0 THEN 'pending' ELSE 'success' END AS status FROM s")  # fmt: skip
def pull_request_review(spark, d):
    changed = spark.createDataFrame([("src/m1.py",), ("src/m2.py",), ("src/m3.py",)], "file_path string")
    return rp.review(_issues(spark, d), changed)


@query(f"WITH {dv.ISSUES_SQL}, {DOC_LINES}, {FILES}, {QUALITY}, t AS (SELECT max(n) AS most FROM (SELECT count(*) AS n FROM issues GROUP BY file_path)) "
       "SELECT CASE WHEN overall < 50 THEN 'score_critical' WHEN overall < 70 THEN 'score_low' ELSE 'score_fair' END AS rule FROM quality WHERE overall < 85 "
       "UNION ALL SELECT 'reduce_debt' FROM quality WHERE technical_debt > 0.5 UNION ALL SELECT 'focus_top_file' FROM t WHERE most > 10 "
       "UNION ALL SELECT DISTINCT 'address_' || category FROM issues")  # fmt: skip
def recommendations(spark, d):
    return rp.recommendations(_issues(spark, d), _quality(spark, d))


CHURN = (
    "churn AS (SELECT file, count(*) AS total_commits, count(DISTINCT author) AS unique_authors, min(date) AS first_commit, max(date) AS last_commit, "
    "greatest(CAST(floor((epoch_us(max(date)) - epoch_us(min(date))) / 86400000000.0) AS BIGINT), 1) AS days, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted "
    "FROM commits GROUP BY file HAVING count(*) >= 5)"
)


def _churn(spark, d):
    return ch.file_churn(dv.commits(table(spark, d, "events")), 5)


@query(f"WITH {dv.COMMITS_SQL}, {CHURN} SELECT file, total_commits, unique_authors, epoch_us(first_commit) AS first_us, epoch_us(last_commit) AS last_us, days, lines_added, lines_deleted, "
       "CAST(total_commits AS DOUBLE) / days AS change_frequency FROM churn", rounded=("change_frequency",))  # fmt: skip
def file_churn(spark, d):
    return _churn(spark, d).select(
        "file", "total_commits", "unique_authors", F.unix_micros("first_commit").alias("first_us"), F.unix_micros("last_commit").alias("last_us"), "days",
        "lines_added", "lines_deleted", "change_frequency",
    )


def _complexity(spark, d):
    functions = table(spark, d, "events").select(F.concat("event_type", F.lit("/f"), F.col("user_id") % 20).alias("file"), (F.col("event_id") % 13 + 1).alias("complexity"))
    return functions.groupBy("file").agg(F.avg("complexity").alias("complexity"))


SCORES = (
    "complexity AS (SELECT event_type || '/f' || (user_id % 20) AS file, avg(event_id % 13 + 1) AS complexity FROM events GROUP BY 1), "
    "freq AS (SELECT *, CAST(total_commits AS DOUBLE) / days AS change_frequency FROM churn), "
    "sc AS (SELECT coalesce(f.file, c.file) AS file, coalesce(CAST(0.5 AS DOUBLE) * (change_frequency / (SELECT max(change_frequency) FROM freq)), 0) "
    "+ coalesce(CAST(0.5 AS DOUBLE) * (CAST(total_commits AS DOUBLE) / (SELECT max(total_commits) FROM freq)), 0) AS churn_score, coalesce(complexity / (SELECT max(complexity) FROM complexity), 0) AS complexity_score "
    "FROM freq f FULL JOIN complexity c ON f.file = c.file), scores AS (SELECT *, CAST(0.5 AS DOUBLE) * churn_score + CAST(0.5 AS DOUBLE) * complexity_score AS hotspot_score FROM sc)"
)


def _scores(spark, d):
    return ch.hotspot_scores(_churn(spark, d), _complexity(spark, d))


@query(f"WITH {dv.COMMITS_SQL}, {CHURN}, {SCORES} SELECT file, round(churn_score, 6) AS churn_score, round(complexity_score, 6) AS complexity_score, round(hotspot_score, 6) AS hotspot_score FROM scores")
def hotspot_scores(spark, d):
    return _scores(spark, d).select("file", *(F.round(c, 6).alias(c) for c in ("churn_score", "complexity_score", "hotspot_score")))


@query(f"WITH {dv.COMMITS_SQL}, {CHURN}, {SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY hotspot_score DESC) - 1 AS place FROM scores), "
       "t AS (SELECT hotspot_score AS threshold FROM r WHERE place = (SELECT floor(count(*) * (CAST(1 AS DOUBLE) - CAST(0.8 AS DOUBLE))) FROM scores)) "
       "SELECT file, round(hotspot_score, 6) AS hotspot_score, hotspot_score >= threshold AS is_hotspot FROM scores, t")  # fmt: skip
def hotspot_threshold(spark, d):
    return ch.marked_hotspots(_scores(spark, d)).select("file", F.round("hotspot_score", 6).alias("hotspot_score"), "is_hotspot")


@query(f"WITH {dv.COMMITS_SQL}, {CHURN}, {SCORES} SELECT file, round(hotspot_score, 6) AS hotspot_score FROM scores ORDER BY scores.hotspot_score DESC, file LIMIT 10")
def churn_hotspots(spark, d):
    return _scores(spark, d).orderBy(F.desc("hotspot_score"), "file").limit(10).select("file", F.round("hotspot_score", 6).alias("hotspot_score"))


@query(f"WITH {dv.COMMITS_SQL}, {CHURN} SELECT file, epoch_us(first_commit) AS first_us, days, total_commits FROM churn")
def churn_timeline(spark, d):
    return ch.timeline(_churn(spark, d)).select("file", F.unix_micros("first_commit").alias("first_us"), "days", "total_commits")


@query(f"WITH {dv.COMMITS_SQL}, {CHURN} SELECT file, 'stabilise' AS advice FROM churn WHERE CAST(total_commits AS DOUBLE) / days > 0.1 UNION ALL SELECT file, 'assign_owner' FROM churn WHERE unique_authors > 5 "
       "UNION ALL SELECT file, 'review_design' FROM churn WHERE total_commits > 10")  # fmt: skip
def churn_advice(spark, d):
    return ch.advice(_churn(spark, d))
