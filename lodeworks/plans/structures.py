"""Queries of structure, complexity and documentation over files that grow with `events`, with DuckDB statements.

A file per user holds a block of code per event. What is in each block (functions, classes, imports and their measures)
is written down by hand beside it; the statements only add line offsets and the rules' bounds, and parse nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.text import is_test_path, split_lines
from lodeworks.operators import graph as gr
from lodeworks.operators import structure as st
from lodeworks.plans.queries import query, table
from lodeworks.sources.scratch import settled

BRANCHY = "def branchy(x):\n    \"\"\"Decides by many cases what to do.\"\"\"\n" + "".join(f"    if x == {k}: return {k}\n" for k in range(12)) + "    return x\n"
#: Text; functions (name, owner, first, last line, complexity, cognitive, nesting, parameters, docstring length, rules of its docs);
#: classes (name, first, last line, methods, docstring length, rules); imports (module, names, line).
PYTHON = [
    ("import os\nimport pickle\nfrom collections import deque as dq, OrderedDict\n", [], [], [("os", "", 1), ("pickle", "", 2), ("collections", "deque,OrderedDict", 3)]),
    ("def wide(a, b, c, d, e, f, g=1):\n    return a\n", [("wide", None, 1, 2, 1, 1, 1, 7, 0, ["missing_function_docstring:high"])], [], []),
    ("class Big:\n" + "".join(f"    def m{k}(self): return {k}\n" for k in range(22)),
     [(f"m{k}", "Big", k + 2, k + 2, 1, 1, 0, 1, 0, ["missing_function_docstring:high"]) for k in range(22)],
     [("Big", 1, 23, 22, 0, ["missing_class_docstring:high", "low_method_coverage:medium"])], []),
    (BRANCHY, [("branchy", None, 1, 15, 13, 24, 1, 1, 34, [])], [], []),
    ("def deep(a):\n    \"\"\"Goes down step by step, :param a: what to look at.\"\"\"\n    for b in a:\n        while b:\n            if b > 1:\n                if b > 2:\n                    b = None\n    return a\n",
     [("deep", None, 1, 8, 5, 19, 5, 1, 50, [])], [], []),
    ("class Kept:\n    \"\"\"Keeps things that matter.\"\"\"\n    def one(self):\n        \"\"\"todo\"\"\"\n        return 1\n    def two(self, key):\n        return key\n    def _three(self):\n        return 3\n",
     [("one", "Kept", 3, 5, 1, 1, 1, 1, 4, ["short_function_docstring:low", "placeholder_function_docstring:medium"]), ("two", "Kept", 6, 7, 1, 1, 1, 2, 0, ["missing_function_docstring:high"]),
      ("_three", "Kept", 8, 9, 1, 1, 1, 1, 0, [])], [("Kept", 1, 9, 3, 25, ["low_method_coverage:medium"])], []),
    ("@cached\nasync def fetch(url, *rest, **more):\n    \"\"\"Args:\n        url: where to look\n    \"\"\"\n    return [r for r in rest if r and url or more]\n",
     [("fetch", None, 2, 6, 5, 9, 1, 3, 27, [])], [], []),
    ("def partly(a, b, c, d):\n    \"\"\"Says what it does.\n\n    :param a: one\n    :param b: two\n    \"\"\"\n    return a\n",
     [("partly", None, 1, 7, 1, 1, 1, 4, 48, ["undocumented_parameters:medium"])], [], []),
    ("def long():\n" + "    x = 1\n" * 51, [("long", None, 1, 52, 1, 1, 1, 0, 0, ["missing_function_docstring:high"])], [], []),
    ("def _hidden(a):\n    return a\n", [("_hidden", None, 1, 2, 1, 1, 1, 1, 0, [])], [], []),
    ("\"\"\"Module of derived code.\"\"\"\n", [], [], []),
    ("class Huge:\n" + "".join(f"    def m{k}(self): return {k}\n" for k in range(31)),
     [(f"m{k}", "Huge", k + 2, k + 2, 1, 1, 0, 1, 0, ["missing_function_docstring:high"]) for k in range(31)],
     [("Huge", 1, 32, 31, 0, ["missing_class_docstring:high", "low_method_coverage:medium"])], []),
    ("def tangled(x):\n" + "".join(f"    if x == {k}: return {k}\n" for k in range(21)) + "    return x\n",
     [("tangled", None, 1, 23, 22, 42, 1, 1, 0, ["missing_function_docstring:high"])], [], []),
    ("def typed(a: int) -> list[str]:\n    return []\n", [("typed", None, 1, 2, 1, 1, 1, 1, 0, ["missing_function_docstring:high"])], [], []),
    ("limit = 10\n# not a setting\nnames = ['one of many names', 'another one']\n\n", [], [], []),
]
#: Blocks that some users' files hold again and again: a class without much documentation, statements without any element.
ONLY = {"user_id % 13 = 5": 3, "user_id % 17 = 6": 14}
#: Deepest nesting of each block.
DEPTHS = [0, 1, 2, 2, 5, 2, 1, 1, 1, 1, 0, 2, 2, 1, 0]
#: Text; functions (name, first, last line, complexity, parameters, async, docstring: none, or one that needs a line above);
#: classes (name, base, first, last line, methods); imports.
SCRIPT = [
    ("import a from 'pkg-a';\nimport { b, c } from \"./b\";\nconst e = require('fs');\nimport 'side';\n", [], [], [("pkg-a", "a", 1), ("./b", "b,c", 2), ("fs", "e", 3), ("side", "", 4)]),
    ("/**\n * Adds two numbers.\n */\nfunction add(a, b = 1) {\n  if (a && b) {\n    return a ? b : a;\n  } else if (b) {\n    return b;\n  }\n  return a;\n}\n",
     [("add", 4, 11, 6, "a,b", False, None), ("if", 5, 9, 6, "a && b", False, None)], [], []),
    ("/** Loads it. */\nconst load = (url, n: number = 2) => {\n  for (const x of url) { go(x); }\n};\n", [("load", 2, 4, 2, "url,n", False, "Loads it."), ("for", 3, 3, 1, "const x of url", False, None)], [], []),
    ("class Store extends Base {\n  constructor(path, size) {\n    this.path = path;\n  }\n  async load() {\n    return await this.read();\n  }\n  find(key) {\n    while (key) { key = key.next; }\n    return key;\n  }\n}\n",
     [("constructor", 2, 4, 1, "path,size", False, None), ("find", 8, 11, 2, "key", False, None), ("while", 9, 9, 1, "key", False, None)], [("Store", "Base", 1, 12, "constructor,find,while")], []),
    ("async function go(x) {\n  return x || 1;\n}\n", [("go", 1, 3, 2, "x", True, None)], [], []),
    ("var g = y => {\n  return y;\n};\n", [("g", 1, 3, 1, "y", False, None)], [], []),
    ("const h = async (z) => {\n  return z;\n};\n", [], [], []),
]


_BLOCK = "CASE " + " ".join(f"WHEN {test} THEN {k}" for test, k in ONLY.items()) + f" ELSE event_id % {len(PYTHON)} END"


def _files(spark, d, kind: str) -> DataFrame:
    """(path, project, content, line_count): a file per user. Some users' Python files hold one block again and again."""
    blocks, script = (PYTHON, False) if kind == "python" else (SCRIPT, True)
    users = F.col("user_id") % 3 == 0 if script else F.col("user_id") % 3 != 0
    block = F.col("event_id") % len(blocks)
    if not script:
        block = F.expr(_BLOCK)
    texts = F.array(*(F.lit(b[0]) for b in blocks))
    # A numbered exchange stays as it is: AQE goes by bytes, and would parse all files in a few tasks, so small are their rows here.
    rows = table(spark, d, "events").filter(users).select("user_id", "ts", "event_id", (block + 1).cast("int").alias("block"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")
    rows = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "block"))).alias("own"))
    where = F.when(F.col("user_id") % 7 == 0, "tests/test_u").when(F.col("user_id") % 11 == 0, "src/api/u").otherwise("src/u")
    path = F.concat(where, "user_id", F.lit(".js" if script else ".py"))
    files = rows.select(path.alias("path"), (F.col("user_id") % 50).alias("project"), F.array_join(F.transform("own", lambda x: F.element_at(texts, x["block"])), "").alias("content"))
    return files.withColumn("line_count", F.size(split_lines(F.col("content"))))


def _sql(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _rows(rows: list[tuple], kinds: list[str]) -> str:
    """A table of values; one row of nulls stands for none."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"CAST({_sql(v)} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows) + ")"


def _placed(blocks: list[tuple], users: str, block: str, end: str) -> str:
    """Files, and where each of their blocks starts."""
    return (
        f"sizes AS (SELECT * FROM (VALUES {', '.join(f'({k}, {b[0].count(chr(10))})' for k, b in enumerate(blocks))}) v(k, n_lines)), "
        f"owned AS (SELECT user_id, ts, event_id, {block} AS k FROM events WHERE {users}), "
        "placed AS (SELECT user_id, k, n_lines, CAST(coalesce(sum(n_lines) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS above, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, "
        f"CASE WHEN user_id % 7 = 0 THEN 'tests/test_u' WHEN user_id % 11 = 0 THEN 'src/api/u' ELSE 'src/u' END || user_id || '{end}' AS path, user_id % 50 AS project FROM owned JOIN sizes USING (k)), "
        "files AS (SELECT path, project, CAST(sum(n_lines) AS INTEGER) AS line_count FROM placed GROUP BY path, project)"
    )


_PY_FUNCTIONS = [(k, *f[:9], ",".join(f[9])) for k, b in enumerate(PYTHON) for f in b[1]]
_PY_CLASSES = [(k, *c[:5], ",".join(c[5])) for k, b in enumerate(PYTHON) for c in b[2]]
PY = (
    _placed(PYTHON, "user_id % 3 <> 0", _BLOCK, ".py")
    + f", pf AS ({_rows(_PY_FUNCTIONS, ['BIGINT', 'VARCHAR', 'VARCHAR', *['INTEGER'] * 7, 'VARCHAR'])} v(k, name, owner, a, z, complexity, cognitive, nesting, n_parameters, doc, rules)), "
    f"pc AS ({_rows(_PY_CLASSES, ['BIGINT', 'VARCHAR', *['INTEGER'] * 4, 'VARCHAR'])} v(k, name, a, z, n_methods, doc, rules)), "
    f"pi AS ({_rows([(k, *i) for k, b in enumerate(PYTHON) for i in b[3]], ['BIGINT', 'VARCHAR', 'VARCHAR', 'INTEGER'])} v(k, module, names, a)), "
    "f AS (SELECT path, project, name, owner, above + a AS line_start, above + z AS line_end, complexity, cognitive, nesting, n_parameters, doc, rules FROM placed JOIN pf USING (k)), "
    "c AS (SELECT path, name, above + a AS line_start, above + z AS line_end, n_methods, doc, rules FROM placed JOIN pc USING (k)), "
    "i AS (SELECT path, module, names, above + a AS line_start FROM placed JOIN pi USING (k)), "
    "m AS (SELECT files.path, project, line_count, coalesce(nf, 0) AS n_functions, coalesce(nc, 0) AS n_classes, coalesce(ni, 0) AS n_imports, coalesce(total, 0) AS total_complexity, "
    "coalesce(most, 0) AS max_complexity, coalesce(total / CAST(nf AS DOUBLE), 0e0) AS avg_complexity FROM files "
    "LEFT JOIN (SELECT path, count(*) AS nf, CAST(sum(complexity) AS BIGINT) AS total, max(complexity) AS most FROM f GROUP BY 1) x ON x.path = files.path "
    "LEFT JOIN (SELECT path, count(*) AS nc FROM c GROUP BY 1) y ON y.path = files.path LEFT JOIN (SELECT path, count(*) AS ni FROM i GROUP BY 1) z ON z.path = files.path)"
)
_JS_FUNCTIONS = [(k, *f) for k, b in enumerate(SCRIPT) for f in b[1]]
JS = (
    _placed(SCRIPT, "user_id % 3 = 0", f"event_id % {len(SCRIPT)}", ".js")
    + f", sf AS ({_rows(_JS_FUNCTIONS, ['BIGINT', 'VARCHAR', 'INTEGER', 'INTEGER', 'INTEGER', 'VARCHAR', 'BOOLEAN', 'VARCHAR'])} v(k, name, a, z, complexity, parameters, is_async, doc)), "
    f"sc AS ({_rows([(k, *c) for k, b in enumerate(SCRIPT) for c in b[2]], ['BIGINT', 'VARCHAR', 'VARCHAR', 'INTEGER', 'INTEGER', 'VARCHAR'])} v(k, name, base, a, z, methods)), "
    f"si AS ({_rows([(k, *i) for k, b in enumerate(SCRIPT) for i in b[3]], ['BIGINT', 'VARCHAR', 'VARCHAR', 'INTEGER'])} v(k, module, names, a))"
)


#: The lines of all files.
_LINES = f"bl AS ({_rows([(k, j, x) for k, b in enumerate(PYTHON) for j, x in enumerate(b[0].splitlines(), 1)], ['BIGINT', 'INTEGER', 'VARCHAR'])} v(k, j, line)), src AS (SELECT path, above + j AS line_no, line FROM placed JOIN bl USING (k))"


def _python(spark, d) -> DataFrame:
    return st.python_elements(_files(spark, d, "python"))


def _parsed(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, their elements and their metrics, for queries that read them more than once: built and parsed once."""
    files = settled(_files(spark, d, "python"), "files")
    elements = settled(st.python_elements(files), "elements")
    return files, elements, st.file_metrics(files.select("path", "project", "line_count"), elements)


def _metrics(spark, d) -> DataFrame:
    return _parsed(spark, d)[2]


_FIELDS = "path, name, owner, line_start, line_end, complexity, cognitive, nesting, n_parameters"


@query(f"WITH {PY} SELECT {_FIELDS} FROM f")
def python_functions(spark, d):
    return _python(spark, d).filter("kind = 'function'").withColumn("n_parameters", F.size("parameters")).selectExpr(*_FIELDS.split(", "))


@query(f"WITH {PY} SELECT path, name, line_start, line_end, n_methods, doc > 0 AS has_docstring FROM c")
def python_classes(spark, d):
    return _python(spark, d).filter("kind = 'class'").select("path", "name", "line_start", "line_end", F.size("names").alias("n_methods"), F.col("docstring").isNotNull().alias("has_docstring"))


@query(f"WITH {PY} SELECT path, module, names, line_start, CASE WHEN module IN ('os', 'collections') THEN 'standard_library' ELSE 'third_party' END AS category FROM i")
def python_imports(spark, d):
    return _python(spark, d).filter("kind = 'import'").select("path", "module", F.array_join("names", ",").alias("names"), "line_start", st.import_category(F.col("module")).alias("category"))


@query(f"WITH {PY} SELECT path, module, line_start FROM i WHERE module = 'pickle'")
def dangerous_imports(spark, d):
    return st.dangerous_imports(_python(spark, d).filter("kind = 'import'"))


@query(f"WITH {PY} SELECT path, line_count, n_functions, n_classes, n_imports, total_complexity, max_complexity, avg_complexity FROM m", rounded=("avg_complexity",))
def file_metrics_derived(spark, d):
    return _metrics(spark, d).select("path", "line_count", "n_functions", "n_classes", "n_imports", "total_complexity", "max_complexity", "avg_complexity")


_RATIO = "CASE WHEN {0} >= {1} * 2 THEN 'high' WHEN {0} >= {1} * 1.5 THEN 'medium' ELSE 'low' END"
_LIMIT = "SELECT path, name, line_start, '{0}' AS metric, CAST({1} AS DOUBLE) AS value, {2} AS threshold, {3} AS severity, {4}e0 AS confidence FROM {5} WHERE {1} > {2}"
_FUNCTION_LIMITS = [
    ("cyclomatic_complexity", "complexity", 10, _RATIO.format("complexity", 10), 0.9), ("cognitive_complexity", "cognitive", 15, _RATIO.format("cognitive", 15), 0.85),
    ("nesting_depth", "nesting", 4, "'medium'", 0.9), ("function_length", "line_end - line_start", 50, "'medium'", 0.8), ("parameter_count", "n_parameters", 5, "'low'", 0.85),
    ("algorithmic_complexity", "complexity", 10, "'medium'", 0.6),
]


@query(f"WITH {PY} " + " UNION ALL ".join(_LIMIT.format(*x, "f") for x in _FUNCTION_LIMITS))
def function_findings(spark, d):
    return st.function_findings(_python(spark, d).filter("kind = 'function'"))


@query(f"WITH {PY} " + " UNION ALL ".join(_LIMIT.format(*x, "c") for x in (("class_size", "n_methods", 20, "'medium'", 0.8), ("class_cohesion", "n_methods", 10, "'low'", 0.6), ("god_class", "n_methods", 30, "'high'", 0.9))))
def class_findings(spark, d):
    return st.class_findings(_python(spark, d).filter("kind = 'class'"))


_INDEX = "CASE WHEN n_functions = 0 THEN 100e0 ELSE least(greatest(171e0 - 0.23e0 * avg_complexity - 16.2e0 * ln(line_count), 0e0), 100e0) END"


@query(f"""WITH {PY}, x AS (SELECT *, {_INDEX} AS index FROM m)
SELECT path, 'file_length' AS metric, CAST(line_count AS DOUBLE) AS value, 500 AS threshold, 'low' AS severity, 0.7e0 AS confidence FROM x WHERE line_count > 500
UNION ALL SELECT path, 'average_complexity', avg_complexity, 8, 'medium', 0.75e0 FROM x WHERE total_complexity > 50 AND avg_complexity > 8
UNION ALL SELECT path, 'low_maintainability', -index, -20, CASE WHEN index < 10 THEN 'high' ELSE 'medium' END, 0.8e0 FROM x WHERE index < 20""", rounded=("value",))
def file_findings(spark, d):
    return st.file_findings(_metrics(spark, d))


@query(f"WITH {PY}, x AS (SELECT path, {_INDEX} AS index FROM m) SELECT path, index, CASE WHEN index >= 85 THEN 'A' WHEN index >= 70 THEN 'B' WHEN index >= 50 THEN 'C' WHEN index >= 25 THEN 'D' ELSE 'F' END AS grade FROM x", rounded=("index",))
def maintainability_grades(spark, d):
    m = _metrics(spark, d)
    index = F.when(F.col("n_functions") == 0, 100.0).otherwise(st.maintainability_index(F.col("avg_complexity"), F.col("line_count")))
    return m.select("path", index.alias("index"), st.maintainability_grade(index).alias("grade"))


@query(f"WITH {PY} SELECT path, name, line_start, 'long_parameter_list' AS type, CAST(n_parameters AS BIGINT) AS value, 'medium' AS severity FROM f WHERE n_parameters > 5 "
       "UNION ALL SELECT path, name, line_start, 'large_class', n_methods, 'high' FROM c WHERE n_methods > 20 UNION ALL SELECT path, name, line_start, 'long_function', line_end - line_start, 'high' FROM f WHERE line_end - line_start > 50")  # fmt: skip
def code_smells(spark, d):
    return st.code_smells(_python(spark, d))


_RULES = "SELECT path, name, line_start, split_part(r, ':', 1) AS rule, split_part(r, ':', 2) AS severity FROM (SELECT *, unnest(string_split(rules, ',')) AS r FROM {0} WHERE rules <> '')"


@query(f"WITH {PY} {_RULES.format('f')}")
def documentation_findings(spark, d):
    return st.documentation_findings(_python(spark, d).filter("kind = 'function'"))


@query(f"WITH {PY} {_RULES.format('c')}")
def class_documentation(spark, d):
    _, e, _ = _parsed(spark, d)
    return st.class_documentation(e.filter("kind = 'class'"), e.filter("kind = 'function'"))


# A file's first block that is no import decides whether it has a docstring of its own.
@query(f"WITH {PY}, b AS (SELECT path, min(nth) AS nth FROM placed WHERE k <> 0 GROUP BY 1), o AS (SELECT placed.path FROM placed JOIN b ON b.path = placed.path AND b.nth = placed.nth WHERE k = 10 AND above < 20) "
       "SELECT path FROM m WHERE (n_functions > 3 OR n_classes > 1 OR n_imports > 5) AND path NOT IN (SELECT path FROM o)")  # fmt: skip
def module_documentation(spark, d):
    files, _, metrics = _parsed(spark, d)
    return st.module_documentation(files, metrics)


@query(f"""WITH {PY}, p AS (SELECT path, 'function' AS kind, name, doc FROM f WHERE NOT starts_with(name, '_') UNION ALL SELECT path, 'class', name, doc FROM c),
n AS (SELECT path, count(*) FILTER (WHERE kind = 'function') AS nf, count(*) FILTER (WHERE kind = 'class') AS nc, list_sort(list(kind || ' ' || name) FILTER (WHERE doc < 10)) AS poor FROM p GROUP BY 1)
SELECT path, array_to_string(poor, ',') AS undocumented FROM n WHERE (contains(path, 'api') OR nf > 5 OR nc > 2) AND len(poor) > 0""")
def api_documentation(spark, d):
    return st.api_documentation(_python(spark, d)).select("path", F.array_join("undocumented", ",").alias("undocumented"))


@query(f"WITH {PY}, s AS (SELECT path, list_sort(list(DISTINCT CASE name WHEN 'fetch' THEN 'Google' ELSE 'Sphinx' END)) AS styles FROM f WHERE name IN ('fetch', 'partly', 'deep') GROUP BY 1) "
       "SELECT path, array_to_string(styles, ',') AS styles FROM s WHERE len(styles) > 1")  # fmt: skip
def documentation_styles(spark, d):
    return st.documentation_styles(_python(spark, d)).select("path", F.array_join("styles", ",").alias("styles"))


@query(f"""WITH {PY}, t AS (SELECT project FROM files GROUP BY 1 HAVING NOT bool_or(starts_with(path, 'tests/')))
SELECT project, path FROM m WHERE (n_functions >= 3 OR n_classes >= 2 OR line_count >= 50) AND n_functions + n_classes > 0 AND project IN (SELECT project FROM t)""")
def missing_tests(spark, d):
    rows = _metrics(spark, d)
    return st.missing_tests(rows.withColumn("lang", F.lit("python")), is_test_path(F.concat(F.lit("/"), "path"), F.col("lang")), "project")


@query(f"WITH {JS} SELECT path, name, above + a AS line_start, above + z AS line_end, complexity, parameters, is_async, CASE WHEN above > 0 THEN doc END AS docstring FROM placed JOIN sf USING (k)")
def script_functions(spark, d):
    found = st.script_elements(_files(spark, d, "script")).filter("kind = 'function'")
    return found.select("path", "name", "line_start", "line_end", "complexity", F.array_join("parameters", ",").alias("parameters"), "is_async", "docstring")


@query(f"WITH {JS} SELECT path, name, base, above + a AS line_start, above + z AS line_end, methods FROM placed JOIN sc USING (k)")
def script_classes(spark, d):
    found = st.script_elements(_files(spark, d, "script")).filter("kind = 'class'")
    return found.select("path", "name", F.get("bases", F.lit(0)).alias("base"), "line_start", "line_end", F.array_join("names", ",").alias("methods"))


@query(f"WITH {JS} SELECT path, module, names, above + a AS line_start, CASE WHEN module = './b' THEN 'relative' ELSE 'third_party' END AS category FROM placed JOIN si USING (k)")
def script_imports(spark, d):
    found = st.script_elements(_files(spark, d, "script")).filter("kind = 'import'")
    return found.select("path", "module", F.array_join("names", ",").alias("names"), "line_start", st.import_category(F.col("module")).alias("category"))


# Chunks with their texts: functions with two lines around them, classes or their summaries, runs of module lines.
_TEXT = "string_agg(line, chr(10) ORDER BY line_no)"
_SUMMARIES = (
    "heads AS (SELECT c.path, c.name, c.line_start, string_agg(line, chr(10) ORDER BY line_no) AS head FROM c JOIN src ON src.path = c.path AND line_no BETWEEN line_start AND line_start + 9 GROUP BY 1, 2, 3), "
    "methods AS (SELECT c.path, c.name, c.line_start, string_agg('# ' || trim(line), chr(10) ORDER BY line_no) AS signatures FROM c JOIN f ON f.path = c.path AND f.owner = c.name AND f.line_start > c.line_start "
    "AND f.line_start <= c.line_end JOIN src ON src.path = c.path AND line_no = f.line_start GROUP BY 1, 2, 3), "
    "summaries AS (SELECT path, name, line_start, head || chr(10) || chr(10) || '# Method signatures:' || coalesce(chr(10) || signatures, '') AS summary FROM heads LEFT JOIN methods USING (path, name, line_start))"
)


@query(f"""WITH {PY}, {_LINES}, {_SUMMARIES}, n AS (SELECT path, 'function' AS kind, name, line_start, line_end FROM f UNION ALL SELECT path, 'class', name, line_start, line_end FROM c),
t AS (SELECT n.path, kind, name, line_start, line_end, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE line_no BETWEEN line_start AND line_end) AS content, {_TEXT} AS beside
    FROM n JOIN src ON src.path = n.path AND line_no BETWEEN line_start - 2 AND line_end + 2 GROUP BY 1, 2, 3, 4, 5),
free AS (SELECT path, line_no, line, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS run FROM src WHERE trim(line) <> '' AND NOT EXISTS (SELECT 1 FROM n WHERE n.path = src.path AND line_no BETWEEN line_start AND line_end)),
md AS (SELECT path, min(line_no) AS a, max(line_no) AS z, {_TEXT} AS content FROM free GROUP BY path, run)
SELECT t.path, kind, t.name, t.line_start, line_end, md5(CASE WHEN kind = 'class' AND length(content) > 1000 THEN summary ELSE content END) AS content, CASE WHEN kind = 'function' THEN md5(beside) END AS context
FROM t LEFT JOIN summaries s ON kind = 'class' AND s.path = t.path AND s.name = t.name AND s.line_start = t.line_start
UNION ALL SELECT path, 'module', NULL, a, z, md5(content), NULL FROM md WHERE length(content) > 50""")
def code_chunks(spark, d):
    files, elements, _ = _parsed(spark, d)
    return st.chunks(files, elements).select("path", "kind", "name", "line_start", "line_end", F.md5("content").alias("content"), F.md5("context").alias("context"))


@query(f"""WITH {PY}, n AS (SELECT path, lag(path) OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY path) AS before FROM files)
SELECT path AS src, before AS dst FROM n WHERE before IS NOT NULL""")
def import_edges(spark, d):
    """Every file imports something of the module before it in its folder."""
    files = _files(spark, d, "python").select("path", st.module_name(F.col("path")).alias("module"))
    order = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy("path")
    imports = files.withColumn("imported", F.concat(F.lag("module").over(order), F.lit(".part"))).filter("imported IS NOT NULL")
    return gr.import_edges(imports.select("path", F.col("imported").alias("module")), files)


@query(f"""WITH {PY} SELECT path, 'large_undocumented' AS rule, name, line_start FROM f WHERE doc = 0 AND line_end - line_start > 20 UNION ALL SELECT path, 'very_complex', name, line_start FROM f WHERE complexity > 20
UNION ALL SELECT path, 'no_elements', NULL, NULL FROM m WHERE line_count > 10 AND n_functions + n_classes + n_imports = 0""")
def parse_validation(spark, d):
    _, elements, metrics = _parsed(spark, d)
    return st.parse_validation(metrics, elements)


@query(f"WITH {PY} SELECT path, line_start, name || '(' || coalesce(array_to_string(list_transform(range(n_parameters), lambda k: 'param' || k), ','), '') || ')' AS signature FROM f")
def generic_signatures(spark, d):
    return _python(spark, d).filter("kind = 'function'").select("path", "line_start", st.generic_signature(F.col("name"), F.col("parameters")).alias("signature"))


@query(f"WITH {PY}, {_LINES} SELECT f.path, name, line_start, md5({_TEXT}) AS body FROM f JOIN src ON src.path = f.path AND line_no > line_start AND line_no <= line_end GROUP BY 1, 2, 3")
def function_bodies(spark, d):
    files, elements, _ = _parsed(spark, d)
    return st.function_bodies(files, elements.filter("kind = 'function'")).filter("body <> ''").select("path", "name", "line_start", F.md5("body").alias("body"))


@query(f"WITH {PY}, {_LINES}, {_SUMMARIES} SELECT path, name, line_start, md5(summary) AS summary FROM summaries")
def class_summaries(spark, d):
    files, e, _ = _parsed(spark, d)
    return st.class_summaries(files, e.filter("kind = 'class'"), e.filter("kind = 'function'")).select("path", "name", "line_start", F.md5("summary").alias("summary"))


@query(f"WITH {PY} SELECT path, name, line_start, owner IS NOT NULL AS is_method, CASE WHEN name = 'typed' THEN 'list[str]' END AS returns, name = 'fetch' AS is_async, CASE WHEN name = 'fetch' THEN 'cached' ELSE '' END AS decorators FROM f")
def function_details(spark, d):
    return _python(spark, d).filter("kind = 'function'").select("path", "name", "line_start", "is_method", "returns", "is_async", F.array_join("decorators", ",").alias("decorators"))


@query(f"WITH {PY}, x AS ({_rows([(k, DEPTHS[k], sum(bool(x.strip()) and not x.strip().startswith('#') for x in b[0].splitlines())) for k, b in enumerate(PYTHON)], ['BIGINT', 'INTEGER', 'INTEGER'])} v(k, depth, n)) "
       "SELECT path, max(depth) AS nesting, CAST(sum(n) AS INTEGER) AS n_code_lines FROM placed JOIN x USING (k) GROUP BY path")  # fmt: skip
def file_shapes(spark, d):
    return _python(spark, d).filter("kind = 'file'").select("path", "nesting", "n_code_lines")


@query(f"""WITH {JS}, n AS (SELECT path, lead(path) OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY path) AS nxt FROM files)
SELECT path AS src, nxt AS dst FROM n WHERE nxt IS NOT NULL""")
def script_edges(spark, d):
    """Every script imports the next one of its folder."""
    files = _files(spark, d, "script").select("path")
    order = Window.partitionBy(F.regexp_extract("path", "^(.*)/", 1)).orderBy("path")
    nxt = F.regexp_extract(F.lead("path").over(order), r"([^/]*)\.js$", 1)
    return st.script_edges(files.select("path", F.concat(F.lit("./x/../"), nxt).alias("module")).filter("module IS NOT NULL"), files)
