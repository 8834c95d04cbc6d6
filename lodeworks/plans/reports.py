"""Queries of summaries, advice, snapshots' changes, matches and snippets, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeworks.operators import churn as ch
from lodeworks.operators import duplicates as du
from lodeworks.operators import lines as ln
from lodeworks.operators import retrieval as rt
from lodeworks.operators import structure as st
from lodeworks.operators import summaries as sm
from lodeworks.operators import validation as va
from lodeworks.plans import analytics as an
from lodeworks.plans import derived as dv
from lodeworks.plans import governance as gv
from lodeworks.plans import queries as own
from lodeworks.plans import structures as stq
from lodeworks.plans.queries import query, table
from lodeworks.sources.corpus import codebase_digest as digest_of

_PATHS = "CASE doc_id % 5 WHEN 0 THEN 'src/a' || doc_id || '.py' WHEN 1 THEN 'web/b' || doc_id || '.JSX' WHEN 2 THEN 'web/c' || doc_id || '.tsx' WHEN 3 THEN 'docs/d' || doc_id || '.md' ELSE 'bin/e' || doc_id END"


@query(f"""WITH f AS (SELECT {_PATHS} AS path, strlen(coalesce(text, '')) AS b FROM documents), s AS (SELECT count(*) AS n, sum(b) AS b FROM f),
l AS (SELECT DISTINCT CASE lower(regexp_extract(path, '\\.[^./]+$')) WHEN '.py' THEN 'Python' WHEN '.jsx' THEN 'JavaScript' WHEN '.tsx' THEN 'TypeScript' END AS language FROM f)
SELECT 'Total Files' AS property, CAST(n AS VARCHAR) AS value FROM s UNION ALL SELECT 'Languages', string_agg(language, ', ' ORDER BY language) FROM l WHERE language IS NOT NULL
UNION ALL SELECT 'Total Size', printf('%.1f KB', b / 1024e0) FROM s UNION ALL SELECT 'Estimated Analysis Time', printf('~%.0f seconds', round_even(greatest(5e0, n * 0.1e0), 0)) FROM s""")
def codebase_info(spark, d):
    rows = table(spark, d, "documents").select(F.expr(_PATHS).alias("path"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size_bytes"))
    return sm.codebase_info(rows)


@query(f"""WITH {dv.ISSUES_SQL}, m AS (SELECT count(*) AS n_files FROM documents),
c AS (SELECT category, count(*) AS n, row_number() OVER (ORDER BY category) AS place FROM issues GROUP BY category), s AS (SELECT severity, count(*) AS n FROM issues GROUP BY severity)
SELECT 0 AS place, 'Files Analyzed' AS metric, CAST(n_files AS VARCHAR) AS value FROM m UNION ALL SELECT 1, 'Total Issues', CAST(count(*) AS VARCHAR) FROM issues UNION ALL SELECT 2, 'Overall Quality Score', '72/100'
UNION ALL SELECT CAST(place + 2 AS INTEGER), upper(category[1]) || category[2:] || ' Issues', CAST(n AS VARCHAR) FROM c
UNION ALL SELECT 100 + list_position(['critical', 'high', 'medium', 'low', 'info'], severity), upper(severity[1]) || severity[2:] || ' Severity', CAST(n AS VARCHAR) FROM s
UNION ALL SELECT 200, 'Recommendations', '{sm.VERDICTS["urgent"].replace("{}", "' || count(*) || '")}' FROM issues WHERE severity IN ('critical', 'high')""")
def analysis_summary(spark, d):
    """With a score of 72.5, which rounds to the even number."""
    metrics = table(spark, d, "documents").agg(F.count("*").alias("n_files")).select("n_files", F.lit(0.0).alias("overall"), F.lit(72.5).alias("maintainability"))
    return sm.analysis_summary(own._issues(spark, d), metrics)


_LISTED = "(SELECT string_agg('- ' || {0} || ': ' || n, chr(10) ORDER BY first) FROM (SELECT {0}, count(*) AS n, min(id) AS first FROM issues GROUP BY {0})) AS issues_by_{0}"


@query(f"""WITH {dv.ISSUES_SQL}, t AS (SELECT list_position(['critical', 'high', 'medium', 'low', 'info'], severity) AS rank, id, '- ' || category || ' (' || severity || ')' AS line FROM issues ORDER BY rank, id LIMIT 5)
SELECT (SELECT count(*) FROM issues) AS total_issues, {_LISTED.format('category')}, {_LISTED.format('severity')}, (SELECT string_agg(line, chr(10) ORDER BY rank, id) FROM t) AS top_issues""")
def prompt_fields(spark, d):
    return sm.prompt_fields(own._issues(spark, d).withColumn("title", F.col("category")))


# Hotspots by three measures, and what is said about them.
_KINDS = (
    f"{dv.COMMITS_SQL}, {own.CHURN}, {own.SCORES}, k AS (SELECT s.file, hotspot_score, complexity, CAST(total_commits AS DOUBLE) / days AS change_frequency FROM scores s LEFT JOIN complexity c ON c.file = s.file LEFT JOIN churn h ON h.file = s.file), "
    + ", ".join(f"l{n} AS (SELECT v AS least{n} FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c} DESC) - 1 AS place, count(*) OVER () AS n FROM k WHERE {c} IS NOT NULL) WHERE place = CAST(floor(n * (1e0 - 0.8e0)) AS BIGINT))"
                for n, c in enumerate(("hotspot_score", "complexity", "change_frequency")))
    + ", kinds AS (SELECT file, hotspot_score >= least0 AS is_hotspot, coalesce(complexity >= least1, false) AS is_complex, coalesce(change_frequency >= least2, false) AS is_busy FROM k, l0, l1, l2)"
)


def _kinds(spark, d):
    return ch.hotspot_kinds(own._scores(spark, d), own._churn(spark, d), own._complexity(spark, d))


@query(f"WITH {_KINDS} SELECT * FROM kinds")
def hotspot_kinds(spark, d):
    return _kinds(spark, d)


_SAID = {"hotspots": "(SELECT count(*) FROM kinds WHERE is_hotspot)", "complex": "(SELECT count(*) FROM kinds WHERE is_complex)", "busy": "(SELECT count(*) FROM kinds WHERE is_busy)",
         "restless": "(SELECT count(*) FROM churn WHERE CAST(total_commits AS DOUBLE) / days > 0.1e0)", "shared": "(SELECT count(*) FROM churn WHERE unique_authors > 5)"}


@query(f"WITH {_KINDS}, n AS (" + " UNION ALL ".join(f"SELECT {k} AS place, {_SAID[name]} AS n, '{a}' AS a, '{b}' AS b" for k, (name, text) in enumerate(sm.HOTSPOT_TEXTS.items()) for a, b in [text.split("{}")])
       + ") SELECT place, a || n || b AS text FROM n WHERE n > 0")
def hotspot_recommendations(spark, d):
    return sm.hotspot_recommendations(_kinds(spark, d), own._churn(spark, d))


@query(f"""WITH {stq.PY}, h AS (SELECT *, CAST(regexp_extract(path, 'u(\\d+)', 1) AS BIGINT) AS u FROM m), x AS (SELECT path, n_functions, n_classes, line_count, CASE WHEN u % 2 = 0 THEN (u % 5) / 20e0 END AS freq, CASE WHEN u % 2 = 0 THEN u % 7 END AS authors FROM h)
SELECT path, concat_ws(' • ', CASE WHEN freq > 0.1e0 THEN 'Consider stabilizing the API and requirements for this frequently changing file' END, CASE WHEN authors > 3 THEN 'Establish clear coding standards and review processes for this multi-author file' END,
    CASE WHEN n_functions > 10 THEN 'Break down large functions into smaller, more focused units' END, CASE WHEN n_classes > 5 THEN 'Consider splitting this file into multiple modules' END,
    CASE WHEN line_count > 500 THEN 'This file is quite large; consider refactoring into smaller modules' END, '{" • ".join(sm.ALWAYS_SUGGESTED)}') AS suggestion FROM x""")
def hotspot_suggestions(spark, d):
    user = F.regexp_extract("path", r"u(\d+)", 1).cast("long")
    known = user % 2 == 0
    said = sm.hotspot_suggestion(F.when(known, user % 5 / 20.0), F.when(known, user % 7), F.col("n_functions"), F.col("n_classes"), F.col("line_count"))
    return stq._metrics(spark, d).select("path", said.alias("suggestion"))


@query(f"WITH {stq.PY} SELECT path, CASE WHEN line_count = 0 THEN 100e0 ELSE greatest(0e0, least(100e0, 171e0 - 0.23e0 * (total_complexity / CAST(greatest(n_functions, 1) AS DOUBLE)) - 16.2e0 * ln(line_count))) END AS index FROM m", rounded=("index",))
def parser_maintainability(spark, d):
    return stq._metrics(spark, d).select("path", st.parser_maintainability(F.col("total_complexity"), F.col("line_count"), F.col("n_functions")).alias("index"))


_RISKY = {n: "(?i)" + "|".join(f"(?:{p})" for p in ps).replace("'", "''") for n, ps in ln.SQL_RISKS.items()}


@query(f"WITH {dv.CODE_LINES_SQL} SELECT file_id, line_no, stripped AS context FROM code_lines WHERE CASE WHEN language = 'python' THEN regexp_matches(line, '{_RISKY['python']}') ELSE regexp_matches(line, '{_RISKY['javascript']}') END")
def sql_risks_derived(spark, d):
    return ln.sql_risks(own._code(spark, d))


@query(f"""WITH {dv.CODE_LINES_SQL}, w AS (SELECT file_id, line_no AS at_line FROM code_lines WHERE line_no % 10 = 1)
SELECT w.file_id, at_line, string_agg(CASE WHEN line_no = at_line THEN '>>> ' ELSE '    ' END || line, chr(10) ORDER BY line_no) AS snippet FROM w JOIN code_lines c ON c.file_id = w.file_id AND line_no BETWEEN at_line - 3 AND at_line + 3 GROUP BY 1, 2""")
def snippets_derived(spark, d):
    lines = own._code(spark, d)
    return ln.snippets(lines, lines.filter("line_no % 10 = 1").select("file_id", F.col("line_no").alias("at_line")))


@query(f"WITH {dv.ISSUES_SQL}, {an.DIFF} SELECT bl.signature, f AS field, CASE f WHEN 'severity' THEN bl.s ELSE bl.x END AS before, CASE f WHEN 'severity' THEN cl.s ELSE cl.x END AS after "
       "FROM bl JOIN cl USING (signature), (VALUES ('severity'), ('description')) v(f) WHERE CASE f WHEN 'severity' THEN bl.s <> cl.s ELSE bl.x <> cl.x END")  # fmt: skip
def changed_fields(spark, d):
    return va.changed_fields(*an._snapshots(spark, d))


@query(f"WITH {dv.ISSUES_SQL}, {gv.TYPED} SELECT id, category || '|' || type || '|' || file_path || '|' || line_start AS signature FROM typed")
def issue_signatures(spark, d):
    return gv._typed(spark, d).select("id", va.issue_signature(F.col("category"), F.col("type"), F.col("file_path"), F.col("line_start")).alias("signature"))


# How well each issue fits the next one of its file.
_WORDS = "list_distinct(regexp_split_to_array(lower({0}), '\\s+'))"


@query(f"""WITH {dv.ISSUES_SQL}, {gv.TYPED}, p AS (SELECT *, lead(id) OVER w AS bi, lead(category) OVER w AS bc, lead(severity) OVER w AS bs, lead(type) OVER w AS bt, lead(line_start) OVER w AS bl, lead(description) OVER w AS bd FROM typed WINDOW w AS (PARTITION BY file_path ORDER BY id)),
q AS (SELECT *, {_WORDS.format('description')} AS x, {_WORDS.format('bd')} AS y FROM p WHERE bi IS NOT NULL)
SELECT id, (CASE WHEN category = bc THEN 0.4e0 ELSE 0e0 END + CASE WHEN severity = bs THEN 0.2e0 ELSE 0e0 END + CASE WHEN type = bt THEN 0.2e0 ELSE 0e0 END + CASE WHEN line_start = bl THEN 0.1e0 WHEN abs(line_start - bl) <= 5 THEN 0.05e0 ELSE 0e0 END
    + 0.1e0 * len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE)) / 1e0 AS score FROM q""", rounded=("score",))
def match_scores(spark, d):
    rows = gv._typed(spark, d)
    names = {"category": "category", "severity": "severity", "type": "type", "line": "line_start", "description": "description"}
    nxt = Window.partitionBy("file_path").orderBy("id")
    rows = rows.withColumns({f"b_{k}": F.lead(c).over(nxt) for k, c in names.items()}).filter("b_category IS NOT NULL")
    return rows.select("id", va.match_score({k: F.col(c) for k, c in names.items()}, {k: F.col(f"b_{k}") for k in names}).alias("score"))


@query(f"WITH {an.QUESTIONS}, s AS (SELECT *, {an._SCORE} FROM asked), k AS (SELECT conv_id, turn, CASE WHEN s4 > 0 AND s5 > 0 AND ({an._METRIC}) THEN 'metrics' WHEN greatest(s0, s1, s2, s3, s4, s5) = 0 THEN 'general' {an._BEST} END AS kind, "
       "CASE WHEN turn % 5 <> 4 THEN (conv_id % 11) / 10e0 END AS near FROM s) SELECT conv_id, turn, CASE WHEN near IS NULL THEN 0.3e0 ELSE least(greatest(near * CASE kind "
       + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in rt.TYPE_FACTOR.items()) + " END, 0.1e0), 1e0) END AS confidence FROM k", rounded=("confidence",))
def answer_confidences(spark, d):
    near = F.when(F.col("turn") % 5 != 4, F.col("conv_id") % 11 / 10.0)
    return an._asked(spark, d).select("conv_id", "turn", rt.answer_confidence(near, rt.question_type(F.col("question"))).alias("confidence"))


@query("SELECT sha256(count(*) || ':' || sum(CAST('0x' || sha256(doc_id || chr(0) || sha256(coalesce(text, '')))[1:15] AS BIGINT))) AS digest FROM documents")
def codebase_digest(spark, d):
    return digest_of(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content")))


@query(f"""WITH {dv.ISSUES_SQL}, x AS (SELECT severity, id % 3 <> 0 AS expected, id % 5 <> 0 AS actual FROM issues),
s AS (SELECT severity, count(*) FILTER (WHERE expected AND actual) AS tp, count(*) FILTER (WHERE expected) AS n_expected, count(*) FILTER (WHERE actual) AS n_actual FROM x GROUP BY severity)
SELECT severity, tp, tp / CAST(n_actual AS DOUBLE) AS precision, tp / CAST(n_expected AS DOUBLE) AS recall, 2e0 * tp / (n_actual + n_expected) AS f1 FROM s""", rounded=("precision", "recall", "f1"))
def accuracy_by_severity(spark, d):
    rows = own._issues(spark, d).select("severity", (F.col("id") % 3 != 0).alias("expected"), (F.col("id") % 5 != 0).alias("actual"))
    return va.scores(rows, ["severity"]).select("severity", "tp", "precision", "recall", "f1")


@query()
def similar_functions(spark, d):
    """Functions of all files by bodies and numbers of parameters: pairs of different kinds, one parameter apart at most, whose bodies
    are much alike, with how many functions are of each kind."""
    files, elements, _ = stq._parsed(spark, d)
    functions = elements.filter("kind = 'function'").withColumn("n_parameters", F.size("parameters"))
    return du.similar_functions(st.function_bodies(files, functions, ("n_parameters",)), 0.8)
