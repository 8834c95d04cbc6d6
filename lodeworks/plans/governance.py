"""Queries of issue construction, known vulnerabilities, registries and statistics, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeworks.operators import duplicates as du
from lodeworks.operators import graph as gr
from lodeworks.operators import issues as iss
from lodeworks.operators import lines as ln
from lodeworks.operators import reporting as rp
from lodeworks.operators import retrieval as rt
from lodeworks.plans import analytics as an
from lodeworks.plans import derived as dv
from lodeworks.plans import queries as own
from lodeworks.plans.queries import query, table
from lodeworks.streaming import events as ev

TYPES = [
    "sql_injection", "XSS", "weak_crypto", "cpu", "Memory", "low_coverage", "untested_critical_path", "missing_docstring", "outdated_critical_docs", "path_traversal", "eval", "other",
    "hardcoded_secret",
]
SAID = [
    "string formatting in an sql query", "shell=true with user input", "pickle.loads with data", "a hardcoded password or api key", "unescaped user input in html", "an unvalidated file path",
    "weak hash function", "eval with user input", "nothing", "", "query",
]


def _pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


TYPED = f"typed AS (SELECT *, {_pick('id', TYPES)} AS type, {_pick('id', SAID)} AS description FROM issues)"


def _typed(spark, d):
    rows = dv.issues(table(spark, d, "events"))
    return rows.withColumns({"type": F.expr(_pick("id", TYPES)), "description": F.expr(_pick("id", SAID))})


def _map(values: dict, rest: str) -> str:
    return "CASE lower(type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{rest}' END"


@query(f"""WITH {dv.ISSUES_SQL}, {TYPED} SELECT id, sha256(category || chr(31) || type || chr(31) || file_path || chr(31) || line_start) AS issue_id,
    CASE WHEN category = 'security' THEN {_map(iss.SECURITY_IMPACT, 'low')} END AS security_impact, CASE WHEN category = 'security' THEN {_map(iss.OWASP, 'Other')} END AS owasp_category,
    CASE WHEN category = 'performance' THEN {_map(iss.OPTIMIZATION, 'General Optimization')} END AS optimization_category, CASE WHEN category = 'testing' THEN {_map(iss.TEST_PRIORITY, 'low')} END AS test_priority,
    CASE WHEN category = 'documentation' THEN {_map(iss.DOCUMENTATION_PRIORITY, 'low')} END AS documentation_priority, line_start / 50e0 AS ratio, 'IssueFactory' AS created_by, file_path AS affected
FROM typed""", rounded=("ratio",))
def created_issues(spark, d):
    rows = iss.created(_typed(spark, d), F.col("line_start"), F.lit(50))
    names = ("security_impact", "owasp_category", "optimization_category", "test_priority", "documentation_priority", "ratio", "created_by")
    return rows.select("id", "issue_id", *names, F.array_join("affected_files", ",").alias("affected"))


_SURE = " UNION ALL ".join(
    f"SELECT id, '{n}' AS vulnerability, '{cwe}' AS cwe, '{s}' AS known_severity, least(round(CASE WHEN contains(lower(type), '{n}') OR contains('{n}', lower(type)) THEN 0.4e0 ELSE 0e0 END "
    f"+ CASE WHEN category = 'security' THEN 0.2e0 ELSE 0e0 END + len(list_filter({p.lower().split()!r}, lambda w: list_contains(regexp_split_to_array(trim(description), '\\s+'), w))) / {len(p.split())}e0 * 0.3e0 "
    f"+ CASE WHEN severity = '{s}' THEN 0.1e0 ELSE 0e0 END, 9), 1e0) AS confidence FROM typed" for n, cwe, p, s in iss.VULNERABILITIES
)
MATCHED = f"{dv.ISSUES_SQL}, {TYPED}, matched AS (SELECT * FROM ({_SURE}) WHERE confidence > 0.5e0)"


@query(f"WITH {MATCHED} SELECT * FROM matched")
def vulnerability_matches(spark, d):
    return iss.vulnerability_matches(_typed(spark, d))


@query(f"WITH {MATCHED} SELECT 'vulnerability' AS dimension, vulnerability AS value, count(*) AS n FROM matched GROUP BY 2 UNION ALL SELECT 'known_severity', known_severity, count(*) FROM matched GROUP BY 2 "
       "UNION ALL SELECT 'cwe', cwe, count(*) FROM matched GROUP BY 2")  # fmt: skip
def vulnerability_statistics(spark, d):
    return iss.counted_by(iss.vulnerability_matches(_typed(spark, d)), ["vulnerability", "known_severity", "cwe"])


_VALUES = ", ".join(f"('{n}', '{c}', '{p}', {iss.PRIORITIES.index(p) + 1}, {langs!r}, {n != 'hotspot'})" for n, c, p, langs in iss.ANALYZERS)
_OWNED = (
    f"{dv.ISSUES_SQL}, registry AS (SELECT * FROM (VALUES {_VALUES}) v(name, category, priority, rank, languages, enabled)), "
    "owned AS (SELECT registry.*, id FROM registry JOIN issues USING (category))"
)


def _owned(spark, d):
    """Each issue with the analyzer of its category; one analyzer is off."""
    return iss.analyzers(spark, {"hotspot": False}).join(own._issues(spark, d).select("category", "id"), "category")


@query(f"""WITH {_OWNED} SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM owned UNION ALL SELECT 'total', CASE WHEN enabled THEN 'enabled' ELSE 'disabled' END, count(*) FROM owned GROUP BY enabled
UNION ALL SELECT 'category', category, count(*) FROM owned GROUP BY category UNION ALL SELECT 'priority', priority, count(*) FROM owned GROUP BY priority
UNION ALL SELECT 'language', language, count(*) FROM (SELECT unnest(languages) AS language FROM owned) GROUP BY language""")
def registry_statistics(spark, d):
    """How many issues fall to analyzers of each kind."""
    return iss.registry_statistics(_owned(spark, d))


@query(f"WITH {_OWNED} SELECT r.name, CAST(r.rank AS INTEGER) AS rank, count(id) AS n FROM registry r LEFT JOIN owned o ON o.name = r.name WHERE r.enabled GROUP BY r.name, r.rank")
def analyzer_order(spark, d):
    """Analyzers in the order in which they run, with the issues that fall to them."""
    found = _owned(spark, d).groupBy("name").agg(F.count("*").alias("n"))
    rows = iss.analyzers(spark, {"hotspot": False}).filter("enabled").join(found, "name", "left")
    return rows.orderBy("rank").select("name", "rank", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {dv.COMMITS_SQL}, {own.CHURN}, {own.SCORES}, t AS (SELECT max(total_commits) AS top FROM churn), a AS (SELECT s.file, hotspot_score, complexity_score, CAST(total_commits AS DOUBLE) / days AS change_frequency, total_commits FROM scores s JOIN churn c ON c.file = s.file)
SELECT file, 'hotspot_score' AS metric, hotspot_score AS value FROM a UNION ALL SELECT file, 'complexity', complexity_score FROM a UNION ALL SELECT file, 'change_frequency', change_frequency FROM a
UNION ALL SELECT file, 'total_commits', total_commits / CAST(top AS DOUBLE) FROM a, t""", rounded=("value",))
def hotspot_heat_map(spark, d):
    churn = own._churn(spark, d)
    return iss.heat_map(own._scores(spark, d).join(churn.select("file", "change_frequency", "total_commits"), "file"))


@query(f"""WITH {dv.COMMITS_SQL}, {own.CHURN}, {own.SCORES}, k AS (SELECT file, CASE WHEN unique_authors % 2 = 0 THEN total_commits END AS total_changes, unique_authors FROM churn)
SELECT file, CASE WHEN total_changes > 20 THEN 'medium' ELSE 'low' END AS severity FROM k WHERE CASE WHEN total_changes IS NOT NULL THEN total_changes > 10 OR false ELSE unique_authors % 7 >= 5 OR unique_authors % 4 >= 3 END""")
def hotspot_issues(spark, d):
    churn = own._churn(spark, d)
    known = churn.filter("unique_authors % 2 = 0").select("file", F.col("total_commits").alias("total_changes"), F.lit(0.0).alias("complexity_score"))
    files = churn.select("file", (F.col("unique_authors") % 7).alias("n_functions"), (F.col("unique_authors") % 4).alias("n_classes"), F.lit(1).alias("line_count"))
    return iss.hotspot_issues(churn.select("file"), known, files)


@query(f"""WITH {dv.CODE_LINES_SQL}, t AS (SELECT *, length(stripped) > 20 AND NOT regexp_matches(stripped, {own.cat.sql_text(ln.UNLIKELY)}) AS telling,
    regexp_replace(regexp_replace(regexp_replace(stripped, '["''][^"'']*["'']', '""', 'g'), '\\b\\d+\\b', '0', 'g'), '\\b[a-zA-Z_]\\w*\\b', 'VAR', 'g') AS shape FROM code_lines),
k AS (SELECT file_id, line_no, shape, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS r FROM t WHERE telling),
s AS (SELECT file_id, line_no AS start_line FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM t) WHERE line_no <= n - 10),
f AS (SELECT s.file_id, s.start_line, min(r) AS r FROM s JOIN k ON k.file_id = s.file_id AND k.line_no >= s.start_line GROUP BY ALL),
g AS (SELECT f.file_id, start_line, string_agg(shape, '|' ORDER BY line_no) AS signature FROM f JOIN k ON k.file_id = f.file_id AND k.r BETWEEN f.r AND f.r + 7
    GROUP BY f.file_id, start_line HAVING count(*) = 8 AND max(line_no) <= start_line + 19)
SELECT signature, count(*) AS n, min(file_id) AS first_file, count(DISTINCT file_id) AS n_files FROM g GROUP BY 1 HAVING count(*) >= 3""")
def structural_groups_derived(spark, d):
    return iss.structural_groups(ln.signatures(own._code(spark, d)))


@query("SELECT count(*) FILTER (WHERE value > 20) AS hits, count(*) FILTER (WHERE NOT value > 20) AS misses, 100e0 * count(*) FILTER (WHERE value > 20) / count(*) AS hit_rate_percent, "
       "(SELECT count(*) FROM documents WHERE doc_id % 3 = 0) AS file_entries, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS analysis_entries, (SELECT sum(strlen(text)) / 1048576e0 FROM documents) AS megabytes FROM events",
       rounded=("hit_rate_percent", "megabytes"))
def cache_statistics(spark, d):
    entries = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "file").otherwise("analysis").alias("kind"), F.octet_length("text").alias("size_bytes"))
    return iss.cache_statistics(table(spark, d, "events").select((F.col("value") > 20).alias("hit")), entries)


@query(f"WITH {an.QUESTIONS} SELECT count(DISTINCT conv_id) AS active_conversations, count(*) AS total_questions, avg((turn % 10) / 10e0) AS average_confidence, CAST(sum(turn % 2) AS BIGINT) AS total_focus_changes FROM asked",
       rounded=("average_confidence",))
def question_statistics(spark, d):
    rows = an._asked(spark, d).withColumn("confidence", F.col("turn") % 10 / 10.0).withColumn("focus_changes", F.col("turn") % 2)
    return iss.question_statistics(rows)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations),
w AS (SELECT DISTINCT conv_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM r WHERE age <= 10),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY word) AS n FROM w WHERE length(word) > 3 AND regexp_matches(word, '[\\p{L}\\p{N}]')
    AND word NOT IN ('what', 'how', 'where', 'when', 'why', 'this', 'that', 'with', 'from')),
l AS (SELECT conv_id, string_agg(word, ' ' ORDER BY word) AS words FROM k WHERE n <= 3 GROUP BY 1)
SELECT q.conv_id, 'where is it ' || words || CASE WHEN q.conv_id % 2 = 0 THEN ' run' ELSE '' END || ' Store' AS query FROM (SELECT DISTINCT conv_id FROM conversations) q JOIN l ON l.conv_id = q.conv_id""")
def enhanced_queries(spark, d):
    words = rt.keywords(table(spark, d, "conversations")).groupBy("conv_id").agg(F.sort_array(F.collect_list("word")).alias("words"))
    name = F.when(F.col("conv_id") % 2 == 0, "run")
    return words.select("conv_id", iss.enhanced_query(F.lit("where is it"), F.col("words"), name, F.lit("Store")).alias("query"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '^(https?://)[^/]*', CASE WHEN page_id % 5 = 0 THEN '\1code.example.org' ELSE '\1www.GitHub.com' END) AS url FROM pages),
p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?(?i:github\.com)/([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM u),
n AS (SELECT page_id, parts[1] AS owner, regexp_replace(parts[2], '\.git$', '') AS name FROM p)
SELECT page_id, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS name FROM (SELECT *, regexp_matches(owner, '^[a-zA-Z0-9._-]+$') AND regexp_matches(name, '^[a-zA-Z0-9._-]+$') AS ok FROM n)""")
def repositories(spark, d):
    """Addresses of all pages, four fifths of them moved to one host."""
    host = F.when(F.col("page_id") % 5 == 0, "code.example.org").otherwise("www.GitHub.com")
    url = F.concat(F.regexp_extract("url", "^(https?://)", 1), host, F.regexp_extract("url", "^https?://[^/]*(.*)$", 1))
    owner, name = iss.repository_of(url)
    return table(spark, d, "pages").select("page_id", owner.alias("owner"), name.alias("name"))


@query(f"WITH {dv.ISSUES_SQL}, {own.RANKED} SELECT id, round(priority, 6) AS priority FROM ranked WHERE category = 'security'")
def prioritized_in_category(spark, d):
    return iss.prioritized_in(rp.prioritized(own._issues(spark, d)), "security").select("id", F.round("priority", 6).alias("priority"))


@query(f"WITH {dv.ISSUES_SQL}, {own.RANKED} SELECT id, round(priority, 6) AS priority FROM ranked ORDER BY ranked.priority DESC, id LIMIT 50")
def issues_for_review(spark, d):
    return rp.top_issues(rp.prioritized(own._issues(spark, d)), 50).select("id", F.round("priority", 6).alias("priority"))


@query(f"WITH {an.EDGES} SELECT node, n_in, n_out, n_total FROM deg WHERE n_total > 0")
def dependency_hotspots(spark, d):
    return gr.degrees(an._edges(spark, d)).filter("n_total > 0")


@query(f"WITH {an.EDGES}, x AS (SELECT src AS node, list_sort(list(dst)) AS needs FROM edges GROUP BY 1), y AS (SELECT dst AS node, list_sort(list(src)) AS needed FROM edges GROUP BY 1) "
       "SELECT coalesce(x.node, y.node) AS node, coalesce(array_to_string(needs, ','), '') AS needs, coalesce(array_to_string(needed, ','), '') AS needed FROM x FULL JOIN y ON x.node = y.node")  # fmt: skip
def neighbours_of_nodes(spark, d):
    rows = gr.neighbours(an._edges(spark, d))
    return rows.select("node", F.array_join("needs", ",").alias("needs"), F.array_join("needed", ",").alias("needed"))


@query("SELECT user_id, event_id, 100e0 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) / count(*) OVER (PARTITION BY user_id) AS percent FROM events", rounded=("percent",))
def job_progress(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    done, total = F.row_number().over(order), F.count("*").over(Window.partitionBy("user_id"))
    return table(spark, d, "events").select("user_id", "event_id", iss.progress_percent(done, total).alias("percent"))


@query("SELECT page_id, similarity, CASE WHEN similarity >= 0.95 THEN 'exact_duplicate' WHEN similarity >= 0.8 THEN 'near_duplicate' WHEN similarity >= 0.6 THEN 'similar_code' ELSE 'potential_duplicate' END AS type, "
       "CASE WHEN similarity >= 0.99 OR similarity >= 0.95 AND page_id % 200 > 100 THEN 'high' WHEN similarity >= 0.95 THEN 'medium' WHEN similarity >= 0.85 THEN 'low' ELSE 'info' END AS severity FROM (SELECT page_id, (page_id % 51) / 50e0 AS similarity FROM pages)")  # fmt: skip
def duplication_classes(spark, d):
    rows = table(spark, d, "pages").select("page_id", (F.col("page_id") % 51 / 50.0).alias("similarity"))
    return rows.select("page_id", "similarity", du.duplicate_class(F.col("similarity")).alias("type"), iss.duplication_severity(F.col("similarity"), F.col("page_id") % 200).alias("severity"))


_KEY = b"a key of the hook"
_PADS = ["".join(f"{b ^ pad:02x}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"WITH s AS (SELECT event_id, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(props)))) AS mac FROM events) "
       "SELECT event_id, mac, event_id % 3 <> 0 AS signed FROM s")  # fmt: skip
def signed_hooks(spark, d):
    mac = ev.hmac_sha256(F.col("props"), _KEY)
    header = F.when(F.col("event_id") % 3 == 0, "sha256=00").otherwise(F.concat(F.lit("sha256="), mac))
    return table(spark, d, "events").select("event_id", mac.alias("mac"), ev.is_signed(F.col("props"), header, _KEY).alias("signed"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    return rt.upsert(rows.filter("vec_id % 6 <> 3"), rows.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100), "vec_id")


@query("SELECT count(*) AS n_chunks, count(embedding) AS n_vectors, min(len(embedding)) AS least_length, max(len(embedding)) AS most_length, count(DISTINCT label) AS n_kinds FROM embeddings")
def collection_info(spark, d):
    return rt.collection_info(table(spark, d, "embeddings"))


@query(f"WITH {an.SIMILAR} SELECT vec_id, similarity FROM sim WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY similarity DESC, vec_id LIMIT 7", rounded=("similarity",))
def related_chunks(spark, d):
    chunks = table(spark, d, "embeddings")
    return rt.related(chunks, chunks.filter("vec_id = 0"), 7, "vec_id", "label", an._vector(spark, d))
