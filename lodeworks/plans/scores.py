"""Queries of severity, context and business scores, with DuckDB statements.

Issues come from events, their descriptions from whole texts of all documents with a closing phrase, their contexts from
their ids. Keywords are looked for once per document, not once per issue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.weights import BASE_SCORE, FEATURE_WEIGHT, KEYWORDS
from lodeworks.operators import scoring as sc
from lodeworks.plans import derived as dv
from lodeworks.plans.queries import query, table

PHRASES = [
    " sql injection risk", " slow timeout", " crash with an exception", " duplicate and complex debt", " a recurring and widespread problem", " xss vulnerability", " memory leak, high latency",
    " refactor the docstring", " `x` example", " failure of auth", " all is well", " nothing to add",
]
PATHS = ["src/main.py", "tests/test_a.py", "src/auth/login.py", "config/settings.yaml", "web/public/app.js", "src/db/model.py", "pkg/__init__.py"]


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value!r}e0" if isinstance(value, float) else str(value)


def _pick(key: str, values: list, rest: str = "NULL") -> str:
    """One of values by a number; the same text is SQL to Spark and to DuckDB."""
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {_sql(v)}" for k, v in enumerate(values)) + f" ELSE {rest} END"


# Expressions over an issue's id that both engines read.
ISSUE = {
    "category": _pick("id % 13", ["Reliability", "maintainability", "unknown"], "category"), "file_path": _pick("id % 9", PATHS, "file_path"),
    "function_complexity": "CASE WHEN id % 6 <> 0 THEN id % 25 END", "bug_history": "id % 4", "in_loop": "id % 5 = 2", "recursive_call": "id % 17 = 0", "complex_logic": "id % 25 > 10",
    "file_size_lines": "id % 1500",
}
PROJECT = {
    "p_kind": _pick("id % 10", list(sc.PROJECT_TYPE), "'other'"), "p_domain": _pick("id % 8", list(sc.DOMAIN)), "p_security": "id % 3 = 0", "p_performance": "id % 5 = 0",
    "p_public": "id % 2 = 0", "p_compliance": "id % 4", "p_maturity": _pick("id % 4", list(sc.MATURITY), "'legacy'"),
}
FILE = {
    "f_role": _pick("id % 11", list(sc.FILE_ROLE), "'unknown'"), "f_entry": "id % 7 = 0", "f_api": "id % 6 = 0", "f_coverage": "CASE WHEN id % 5 <> 0 THEN (id % 20) / 20e0 END",
    "f_changes": "id % 15", "f_bugs": "id % 8", "f_dependents": "id % 14",
}
CODE = {
    "c_public": "id % 2 = 1", "c_constructor": "id % 9 = 0", "c_handler": "id % 10 = 0", "c_frequency": _pick("id % 5", list(sc.FREQUENCY), "'unknown'"), "c_user": "id % 4 = 1", "c_sensitive": "id % 6 = 1",
}
BUSINESS = {
    "b_industry": _pick("id % 9", list(sc.INDUSTRY), "'unknown'"), "b_size": _pick("id % 5", list(sc.COMPANY_SIZE), "'unknown'"), "b_model": _pick("id % 3", list(sc.REVENUE_MODEL), "'advertising'"),
    "b_customers": _pick("id % 4", [5_000, 50_000, 500_000, 5_000_000]), "b_uptime": _pick("id % 5", [None, 0.9, 0.95, 0.99, 0.999]), "b_brand": "(id % 11) / 10e0", "b_compliance": "(id + 1) % 3",
    "m_loss": _pick("id % 5", [None, 500.0, 5_000.0, 50_000.0, 500_000.0]), "m_users": _pick("id % 7", [None, 50, 500, 5_000], "50000"), "m_hours": "(id % 30) * 1e0", "m_velocity": "(id % 13 - 6) / 10e0",
    "m_arpu": _pick("id % 3", [None, 12.5, 0.0]), "m_fix": "(id % 4) * 100e0", "m_downtime": "(id % 3) * 50e0",
}


# Words that descriptions are searched for, by the family that needs them.
FAMILIES = {
    "features": KEYWORDS, "triggers": {f"t_{part}": own for part, (own, _) in sc.IMPACT_TRIGGERS.items()}, "fallback": {f"u_{part}": own for part, own, _, _ in sc.FALLBACK},
    "factors": {f"w_{w}": [w] for _, w in sc.WORD_FACTORS},
}


def _described(spark, d, families: tuple[str, ...] = ("features",)) -> DataFrame:
    """Issues with the flags of their descriptions, which are joined by document; `description` is the closing phrase."""
    documents = table(spark, d, "documents")
    n = max(1, documents.count())
    words = {name: own for f in families for name, own in FAMILIES[f].items()}
    issues = dv.issues(table(spark, d, "events")).withColumn("doc_id", F.col("id") % n)
    issues = issues.withColumn("description", F.expr(_pick("id % 12", PHRASES)))
    issues = sc.path_features(issues.withColumns({k: F.expr(v) for k, v in ISSUE.items()}))
    low = F.lower("description")
    flags = issues.withColumns({name: sc.contains_any(low, own) for name, own in words.items()})
    joined = flags.withColumnsRenamed({c: f"own_{c}" for c in words}).join(sc.text_flags(documents, words), "doc_id")
    return joined.withColumns({c: F.col(c) | F.col(f"own_{c}") for c in words}).drop(*(f"own_{c}" for c in words))


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _case(key: str, values: dict, rest: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {_sql(v)}" for k, v in values.items()) + f" ELSE {rest} END"


_WORDS = {name: own for f in FAMILIES.values() for name, own in f.items()}
#: Flags of each document and of each closing phrase; an issue has those of both.
DESCRIBED = (
    f"flagged AS MATERIALIZED (SELECT doc_id, {', '.join(f'{_any("low", words)} AS "d_{name}"' for name, words in _WORDS.items())} FROM (SELECT doc_id, lower(text) AS low FROM documents)), "
    f"phrased AS (SELECT k, {', '.join(f'{_any("low", words)} AS "p_{name}"' for name, words in _WORDS.items())} FROM (VALUES {', '.join(f'({k}, {_sql(p.lower())})' for k, p in enumerate(PHRASES))}) v(k, low)), "
    f"described AS (SELECT id, confidence, {', '.join(f'{v} AS {k}' for k, v in ISSUE.items())}, {', '.join(f'"d_{name}" OR "p_{name}" AS "{name}"' for name in _WORDS)} "
    "FROM issues JOIN flagged ON doc_id = id % (SELECT count(*) FROM documents) JOIN phrased ON k = id % 12)"
)
FEATURED = (
    "featured AS (SELECT *, contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') AS is_test_file"
    f", list_contains({sc.MAIN_MODULES!r}, lower(parse_filename(file_path))) AS is_main_module"
    f", list_contains({sc.CONFIG_SUFFIXES!r}, lower(regexp_extract(file_path, '\\.[^./]+$'))) OR {_any('lower(file_path)', sc.CONFIG_NAMES)} AS is_config_file"
    ", lower(regexp_extract(file_path, '\\.[^./]+$')) AS file_extension FROM described)"
)
_FLAT = ["involves_user_input", "involves_network", "involves_database", "involves_file_system", "in_loop", "recursive_call", "memory_allocation"]
_ADD = lambda names: " + ".join(f"CASE WHEN {n} THEN {_sql(FEATURE_WEIGHT[n])} ELSE 0e0 END" for n in names)
BASED = (
    f"based AS (SELECT *, round(least(greatest({_case('lower(category)', BASE_SCORE, '0.5e0')} + (0e0 + {_ADD(_FLAT)} "
    "+ CASE WHEN function_complexity > 10 THEN 0.5e0 * least(function_complexity / 20e0, 1e0) ELSE 0e0 END + CASE WHEN file_size_lines > 500 THEN 0.2e0 * least(file_size_lines / 1000e0, 1e0) ELSE 0e0 END "
    f"+ CASE WHEN bug_history > 0 THEN 0.4e0 * least(bug_history / 10e0, 1e0) ELSE 0e0 END + {_ADD(['complex_logic', 'is_main_module', 'is_test_file'])}), 0e0), 1e0), 9) AS base_score, "
    f"(CASE WHEN list_contains({list(BASE_SCORE)!r}, lower(category)) THEN 0.8e0 ELSE 0.4e0 END + ({' + '.join(f'coalesce(CAST({c} AS INTEGER), 0)' for c in sc.CONFIDENCE_FLAGS)}) / 10e0 "
    "+ CASE WHEN function_complexity IS NULL THEN 0.6e0 ELSE 0.9e0 END) / 3e0 AS sure FROM featured)"
)
_LEVEL = "CASE WHEN {0} >= 0.9e0 THEN 'critical' WHEN {0} >= 0.7e0 THEN 'high' WHEN {0} >= 0.5e0 THEN 'medium' WHEN {0} >= 0.3e0 THEN 'low' ELSE 'info' END"
_BASE = f"WITH {dv.ISSUES_SQL}, {DESCRIBED}, {FEATURED}, {BASED}"
_BLANK = lambda test, factor: f"CASE WHEN {test} THEN {factor!r}e0 ELSE 1e0 END"
_IN_CONTEXT = " * ".join([
    "base_score", _case("p_kind", sc.PROJECT_TYPE, "1e0"), _case("p_domain", sc.DOMAIN, "1e0"), _BLANK("p_security", 1.2), _BLANK("p_performance", 1.15), _BLANK("p_public", 1.1),
    "(1e0 + p_compliance * 0.1e0)", _case("p_maturity", sc.MATURITY, "1e0"), _case("f_role", sc.FILE_ROLE, "1e0"), _BLANK("f_entry", 1.2), _BLANK("f_api", 1.15),
    "CASE WHEN f_coverage < 0.5e0 THEN 1.2e0 WHEN f_coverage > 0.9e0 THEN 0.9e0 ELSE 1e0 END", _BLANK("f_changes > 10", 1.1), _BLANK("f_bugs > 5", 1.15), _BLANK("f_dependents > 10", 1.1),
    _BLANK("c_public", 1.1), _BLANK("c_constructor", 1.15), _BLANK("c_handler", 1.2), _case("c_frequency", sc.FREQUENCY, "1e0"), _BLANK("c_user", 1.15), _BLANK("c_sensitive", 1.2),
])
_SCORED = (
    f"{_BASE}, placed AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in (PROJECT | FILE | CODE | BUSINESS).items())} FROM based), "
    f"adjusted AS (SELECT *, round(least(greatest({_IN_CONTEXT}, 0e0), 1e0), 9) AS score, least(sure + 0.3e0, 1e0) AS final_confidence FROM placed), "
    f"scored AS MATERIALIZED (SELECT *, {_LEVEL.format('score')} AS level FROM adjusted)"
)


def _based(spark, d, *families: str) -> DataFrame:
    rows = _described(spark, d, ("features", *families))
    rows = rows.withColumn("base_score", F.round(sc.base_score(rows), 9))
    return rows.withColumn("sure", sc.confidence(rows))


def _scored(spark, d, *families: str) -> DataFrame:
    rows = _based(spark, d, *families).withColumns({k: F.expr(v) for k, v in (PROJECT | FILE | CODE | BUSINESS).items()})
    factors = sc.project_factors(*(F.col(c) for c in PROJECT)) + sc.file_factors(*(F.col(c) for c in FILE)) + sc.code_factors(*(F.col(c) for c in CODE))
    rows = rows.withColumn("score", F.round(sc.in_context(F.col("base_score"), factors), 9)).withColumn("final_confidence", sc.context_confidence(F.col("sure"), 3))
    return rows.withColumn("level", sc.level(F.col("score")))


def _impacts(spark, d) -> DataFrame:
    """Scored issues with impacts, impact and priority."""
    rows = _scored(spark, d, "triggers", "factors")
    named = sc.impact_categories(F.col("category"), None, F.col("level"), {part: F.col(f"t_{part}") for part in sc.IMPACT_TRIGGERS})
    rows = rows.withColumn("impacts", named)
    metrics = sc.metrics_factor(F.col("impacts"), F.col("m_loss"), F.col("m_users"), F.col("m_hours"), F.col("m_velocity"))
    business = sc.business_factor(*(F.col(c) for c in ("b_industry", "b_size", "b_model", "b_customers", "b_uptime", "b_brand", "b_compliance")))
    factors = [metrics, business, sc.issue_factor(F.col("file_path"), None, {w: F.col(f"`w_{w}`") for _, w in sc.WORD_FACTORS})]
    rows = rows.withColumn("impact", F.round(sc.business_impact(F.col("level"), F.col("impacts"), factors), 9))
    return rows.withColumn("priority", sc.priority(F.col("level"), F.col("impact"), F.col("final_confidence")))


def _trigger(part: str) -> str:
    _, impacts = sc.IMPACT_TRIGGERS[part]
    return f"CASE WHEN contains(lower(category), '{part}') OR t_{part} THEN {impacts!r} ELSE CAST([] AS VARCHAR[]) END"


_STEP = lambda c, *steps: "CASE " + " ".join(f"WHEN {c} > {a!r} THEN {b!r}e0" for a, b in steps) + " ELSE 1e0 END"
_HAVE = lambda impact, then: f"CASE WHEN list_contains(impacts, '{impact}') THEN {then} ELSE 1e0 END"
_FACTORS = " * ".join([
    _HAVE("revenue_loss", _STEP("m_loss", (100000, 1.5), (10000, 1.3), (1000, 1.1))), _HAVE("customer_experience", _STEP("m_users", (10000, 1.4), (1000, 1.2), (100, 1.1))),
    _HAVE("operational_disruption", _STEP("m_hours", (24, 1.3), (4, 1.2), (1, 1.1))), _HAVE("development_velocity", _STEP("abs(m_velocity)", (0.5, 1.3), (0.2, 1.2), (0.1, 1.1))),
    _case("b_industry", sc.INDUSTRY, "1e0"), _case("b_size", sc.COMPANY_SIZE, "1e0"), _case("b_model", sc.REVENUE_MODEL, "1e0"), _STEP("b_customers", (1000000, 1.3), (100000, 1.2), (10000, 1.1)),
    "CASE WHEN b_uptime >= 0.999e0 THEN 1.3e0 WHEN b_uptime >= 0.99e0 THEN 1.2e0 WHEN b_uptime >= 0.95e0 THEN 1.1e0 ELSE 1e0 END", "(1e0 + b_brand * 0.3e0)", "(1e0 + b_compliance * 0.1e0)",
    *(_BLANK(_any("lower(file_path)", words), f) for f, words in sc.PATH_FACTORS), *(_BLANK(f'"w_{w}"', f) for f, w in sc.WORD_FACTORS),
])
_IMPACTED = (
    f"{_SCORED}, named AS (SELECT *, {' || '.join(_trigger(p) for p in sc.IMPACT_TRIGGERS)} AS i0 FROM scored), "
    "more AS (SELECT *, CASE WHEN level IN ('critical', 'high') AND NOT list_contains(i0, 'revenue_loss') THEN list_append(i0, 'revenue_loss') ELSE i0 END AS i1 FROM named), "
    "most AS (SELECT *, CASE WHEN level IN ('critical', 'high') AND NOT list_contains(i1, 'customer_experience') THEN list_append(i1, 'customer_experience') ELSE i1 END AS i2 FROM more), "
    "held AS MATERIALIZED (SELECT *, CASE WHEN len(i2) = 0 THEN ['maintenance_cost'] ELSE i2 END AS impacts FROM most), "
    f"weighed AS MATERIALIZED (SELECT *, round(least(greatest({_case('level', sc.IMPACT_OF_LEVEL, '0.5e0')} * (list_sum(list_transform(impacts, lambda i: {_case('i', sc.IMPACT_WEIGHT, '0.5e0')})) / len(impacts)) * {_FACTORS}, 0e0), 1e0), 9) AS impact FROM held), "
    f"ranked AS MATERIALIZED (SELECT *, ({_case('level', sc.PRIORITY_OF_LEVEL, '0.6e0')} * 0.6e0 + impact * 0.4e0) * final_confidence AS priority FROM weighed)"
)


@query(f"{_BASE} SELECT id, {', '.join(KEYWORDS)}, is_test_file, is_main_module, is_config_file, file_extension FROM based")
def severity_features(spark, d):
    return _described(spark, d).select("id", *KEYWORDS, "is_test_file", "is_main_module", "is_config_file", "file_extension")


@query(f"{_BASE} SELECT doc_id, length(text) AS description_length, contains(text, '```') OR contains(lower(text), 'example') AS has_code_example, contains(lower(text), 'duplicate') AS code_duplication, "
       "contains(lower(text), 'docstring') OR lang = 'documentation' AS missing_documentation FROM documents")  # fmt: skip
def description_features(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("description"), F.col("lang").alias("category"))
    return sc.text_features(rows).select("doc_id", F.col("description_length").cast("long").alias("description_length"), "has_code_example", "code_duplication", "missing_documentation")


@query(f"{_BASE} SELECT id, base_score AS score, {_LEVEL.format('base_score')} AS level, sure AS confidence FROM based", rounded=("confidence",))
def severity_scores(spark, d):
    return _based(spark, d).select("id", F.col("base_score").alias("score"), sc.level(F.col("base_score")).alias("level"), F.col("sure").alias("confidence"))


@query(f"{_SCORED} SELECT id, score, level, final_confidence AS confidence FROM scored", rounded=("confidence",))
def contextual_scores(spark, d):
    return _scored(spark, d).select("id", "score", "level", F.col("final_confidence").alias("confidence"))


@query(f"{_IMPACTED} SELECT id, array_to_string(impacts, ',') AS impacts, impact, priority FROM ranked", rounded=("priority",))
def business_impacts(spark, d):
    return _impacts(spark, d).select("id", F.array_join("impacts", ",").alias("impacts"), "impact", "priority")


@query(f"{_IMPACTED} SELECT id, CASE WHEN m_arpu <> 0 THEN m_arpu * b_customers * impact * 0.01e0 END AS revenue_at_risk, CASE WHEN m_loss <> 0 THEN m_loss * impact END AS direct_revenue_loss, "
       "CASE WHEN m_fix <> 0 THEN m_fix END AS remediation_cost, CASE WHEN m_downtime <> 0 AND m_hours <> 0 THEN m_downtime * m_hours * impact END AS downtime_cost FROM ranked",
       rounded=("revenue_at_risk", "direct_revenue_loss", "downtime_cost"))
def financial_estimates(spark, d):
    own = sc.financial_estimates(*(F.col(c) for c in ("impact", "m_arpu", "b_customers", "m_loss", "m_fix", "m_downtime", "m_hours")))
    return _impacts(spark, d).select("id", *(c.alias(n) for n, c in own.items()))


_FALLBACK = "CASE " + " ".join(f"WHEN contains(lower(category), '{p}') OR \"u_{p}\" THEN {{{k}}}" for k, (p, _, _, _) in enumerate(sc.FALLBACK)) + " ELSE {4} END"


@query(f"{_BASE} SELECT id, {_FALLBACK.format(*(_sql(x[2]) for x in sc.FALLBACK), _sql('medium'))} AS level, {_FALLBACK.format(*(_sql(x[3]) for x in sc.FALLBACK), '0.5e0')} AS score FROM based")
def fallback_severities(spark, d):
    level, score = sc.fallback_severity(F.col("category"), None, {part: F.col(f"u_{part}") for part, _, _, _ in sc.FALLBACK})
    return _described(spark, d, ("fallback",)).select("id", level.alias("level"), score.alias("score"))


@query(f"{_IMPACTED} SELECT count(*) AS n, {', '.join(f"count(*) FILTER (WHERE level = '{x}') AS n_{x}" for x in sc.PRIORITY_OF_LEVEL)}, "
       + ", ".join(f"{f}({c}) AS {a}_{n}" for a, c in (("impact", "impact"), ("priority", "priority"), ("confidence", "final_confidence")) for f, n in (("avg", "mean"), ("max", "max"), ("min", "min")))
       + ", count(*) FILTER (WHERE round(priority, 9) > 0.7e0) AS n_high_priority, count(*) FILTER (WHERE round(final_confidence, 9) < 0.5e0) AS n_low_confidence FROM ranked",
       rounded=("impact_mean", "impact_max", "impact_min", "priority_mean", "priority_max", "priority_min", "confidence_mean", "confidence_max", "confidence_min"))
def score_statistics(spark, d):
    rows = _impacts(spark, d)
    return sc.statistics(rows.select("level", "impact", F.round("priority", 9).alias("priority"), F.round("final_confidence", 9).alias("confidence")))


def _advice(test: str, own: list[str]) -> str:
    return f"CASE WHEN {test} THEN [{', '.join(map(_sql, own))}] ELSE CAST([] AS VARCHAR[]) END"


_ADVICE = " || ".join([
    *(_advice(f"level = '{x}'", own) for x, own in sc.ADVICE_BY_LEVEL.items()), _advice("impact > 0.8e0", sc.ADVICE_HIGH_IMPACT), _advice("impact > 0.6e0 AND impact <= 0.8e0", sc.ADVICE_SOME_IMPACT),
    *(_advice(c, [sc.ADVICE_BY_PROJECT[n]]) for n, c in (("security_sensitive", "p_security"), ("public_facing", "p_public"), ("has_compliance", "p_compliance > 0"))),
    *(_advice(f"contains(lower(category), '{p}')", own) for p, own in sc.ADVICE_BY_CATEGORY.items()),
])


@query(f"{_IMPACTED} SELECT id, array_to_string({_ADVICE}, chr(10)) AS advice FROM ranked")
def scoring_recommendations(spark, d):
    project = {"security_sensitive": F.col("p_security"), "public_facing": F.col("p_public"), "has_compliance": F.col("p_compliance") > 0}
    rows = _impacts(spark, d)
    return rows.select("id", F.array_join(sc.recommendations(F.col("level"), F.col("impact"), F.col("category"), project), "\n").alias("advice"))


@query(f"{_SCORED} SELECT id, ((CAST(category IS NOT NULL AND category <> '' AS INTEGER) + CAST(level <> '' AS INTEGER) + CAST(f_role <> 'unknown' AS INTEGER) + CAST(coalesce(p_domain, '') <> '' AS INTEGER)) / 4e0 "
       "+ (CAST(id % 2 = 0 AS INTEGER) + CAST(id % 3 = 0 AS INTEGER) + CAST(id % 5 = 0 AS INTEGER) + CAST(id % 7 = 0 AS INTEGER)) / 4e0) / 2e0 AS completeness FROM scored", rounded=("completeness",))  # fmt: skip
def feature_completeness(spark, d):
    fields = [F.col("category"), F.col("level"), F.nullif(F.col("f_role"), F.lit("unknown")), F.col("p_domain")]
    return _scored(spark, d).select("id", sc.feature_completeness(fields, [F.col("id") % k == 0 for k in (2, 3, 5, 7)]).alias("completeness"))
