"""Saved analyses, record checks, and the surface of parsers and analyzers."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import records as rc
from lodeworks.operators import registry as rg
from lodeworks.operators import structure as st
from lodeworks.sources import analyses as an


def document(k, **more):
    issue = {"id": f"i{k}", "category": "security", "severity": "high", "title": "t", "description": "d", "location": {"file_path": f"f{k}.py", "line_start": k, "line_end": k + 1},
             "affected_files": ["a", "b"], "suggestion": "s", "confidence": 0.5, "metadata": {"k": [1, "x"]}, "created_at": "2024-01-01T00:00:00"}
    return {"analysis_id": f"a{k}", "timestamp": "2024-01-02T03:04:05.678", "codebase_path": "/src", "parsed_files": [{"path": "x.py", "language": "python"}], "issues": [issue] * k,
            "metrics": {}, "dependency_graph": {}, "options": {}} | more


def test_documents(spark, tmp_path):
    texts = {"old": json.dumps(document(1)), "new": json.dumps(document(2, version="0.2.0", new_field="own")), "later": json.dumps(document(1, version="9.0")), "cut": json.dumps(document(3))[:-9],
             "list": "[1, 2]", "empty": " ", "lacks": json.dumps({k: v for k, v in document(1).items() if k not in ("options", "issues")}), "odd": json.dumps(document(0, issues=[{"id": 7, "confidence": "high"}, 3]))}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    documents = an.read_documents(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"(\w+)\.json$", 1))
    assert {(r.path, r.problem, tuple(r.missing)) for r in an.quarantined(documents).collect()} == {
        ("later", "unknown version", ()), *((n, "no JSON object", tuple(sorted(an.REQUIRED))) for n in ("cut", "list", "empty")), ("lacks", "missing keys", ("issues", "options"))}
    now = an.migrated(an.usable(documents))
    assert {r.path: (r.version, r.x) for r in now.select("path", "version", an.field("new_field").alias("x")).collect()} == {"old": ("0.2.0", "default_value"), "new": ("0.2.0", "own"), "odd": ("0.2.0", "default_value")}
    assert {r.path: r.version for r in an.migrated(an.usable(documents), "0.1.0").collect()} == {"old": "0.1.0", "new": "0.2.0", "odd": "0.1.0"}
    rows = {r.path: (r.analysis_id, str(r.timestamp), r.n_files, r.n_issues) for r in an.loaded(now).collect()}
    assert rows["new"] == ("a2", "2024-01-02 03:04:05.678000", 1, 2)
    issues = an.issues_of(now)
    got = Counter((r.analysis_id, r.id, r.file_path, r.line_start, r.confidence, tuple(r.affected_files or ())) for r in issues.collect())
    assert got == Counter({("a1", "i1", "f1.py", 1, 0.5, ("a", "b")): 1, ("a2", "i2", "f2.py", 2, 0.5, ("a", "b")): 2, ("a0", "7", None, None, None, ()): 1, ("a0", None, None, None, None, ()): 1})
    assert {r.x for r in issues.select(F.try_variant_get("metadata", "$.k[1]", "string").alias("x")).collect()} == {"x", None}


def test_saved_analyses_come_back(spark):
    analyses = spark.createDataFrame([("a", "2024-05-06 07:08:09", "/x"), ("b", "2024-05-06 00:00:00", "/y")], "analysis_id string, timestamp string, codebase_path string").withColumn("timestamp", F.to_timestamp("timestamp"))
    rows = [("a", str(k), "security", "low", 'q"uote', "line\nend é", f"f{k}.py", k, k, None, 0.25, "2024-01-01", [f"f{k}.py"]) for k in range(3)]
    issues = spark.createDataFrame(rows, "analysis_id string, id string, category string, severity string, title string, description string, file_path string, line_start int, line_end int, suggestion string, confidence double, created_at string, affected_files array<string>")
    files = spark.createDataFrame([("b", "p.py", "python")], "analysis_id string, path string, language string")
    saved = an.documents_from(analyses, issues, files).select(F.col("analysis_id").alias("path"), "text")
    documents = an.documents_of(saved)
    assert an.quarantined(documents).count() == 0
    now = an.migrated(an.usable(documents))
    columns = [c for c in issues.columns if c != "affected_files"]
    assert Counter(tuple(r) for r in an.issues_of(now).select(*columns).collect()) == Counter(tuple(r[:-1]) for r in rows)
    assert [tuple(r) for r in an.files_of(now).collect()] == [("b", "p.py", "python")]
    assert {(r.analysis_id, str(r.timestamp), r.n_issues) for r in an.loaded(now).collect()} == {("a", "2024-05-06 07:08:09", 3), ("b", "2024-05-06 00:00:00", 0)}


# Record checks.

ISSUE = "id string, title string, description string, category string, severity string, confidence double, file_path string, line_start int, line_end int, affected_files array<string>"


def test_issue_checks(spark, tmp_path):
    good = ("1", "t", "d", "security", "low", 0.5, "f.py", 1, 2, ["f.py"])
    bad = {
        0: (" ", "Issue ID cannot be empty"), 1: (None, "Issue title cannot be empty"), 2: ("\t\n", "Issue description cannot be empty"), 3: ("art", "Invalid issue category"), 4: (None, "Invalid issue severity"),
        5: (float("nan"), "Invalid confidence value"), 6: ("", "File path cannot be empty"), 7: (0, "line_start must be at least 1"), 8: (0, "line_end must be >= line_start"), 9: (["x", " "], "Invalid affected file path"),
    }
    rows = [good, good] + [tuple(v if k == j else g for j, g in enumerate(good)) for k, (v, _) in bad.items()] + [(*good[:9], []), (*good[:9], None), (*good[:5], 1.01, *good[6:])]
    df = spark.createDataFrame(rows, ISSUE).repartition(3)
    names = [n for _, n in bad.values()] + ["Issue must affect at least one file"]
    metrics = rc.write_split(df, rc.issue_reasons(), names, str(tmp_path / "out"))
    back = rc.read_split(spark, str(tmp_path / "out"))
    assert metrics["n"] == len(rows) and metrics["n_valid"] == back.filter("valid").count() == 2
    counted = {r.reason: r.n for r in rc.reason_counts(back).collect()}
    assert counted == {n: metrics[n] for n in names} and counted["Invalid confidence value"] == 2 and counted["Issue must affect at least one file"] == 2
    assert Counter(counted.values()) == Counter({1: 9, 2: 2})


def test_other_checks(spark):
    files = spark.createDataFrame([("a.py", "Python", [("f", 1, 2)], []), ("", "cobol", [("f", 0, 2)], [("c", 3, 2)]), ("x", " ", None, None)],
                                  "path string, language string, functions array<struct<name:string,line_start:int,line_end:int>>, classes array<struct<name:string,line_start:int,line_end:int>>")
    assert [len(r.reasons) for r in rc.checked(files, rc.file_reasons()).collect()] == [0, 4, 1]
    options = spark.createDataFrame([(["*.py"], [], 1, 0.7, 10.0), ([], [None], 0, 1.5, 0.0), ([" "], None, 2, 0.0, 1.0)], "include_patterns array<string>, exclude_patterns array<string>, max_workers int, confidence_threshold double, max_file_size_mb double")
    assert [len(r.reasons) for r in rc.checked(options, rc.option_reasons()).collect()] == [0, 5, 1]
    texts = ['{"llm": {"provider": "openai", "temperature": 0.5}, "analysis": {"max_workers": 2}}', "[]", '{"llm": 3, "analysis": []}', '{"llm": {"provider": "x", "temperature": 3}, "analysis": {"max_workers": 0}}',
             '{"llm": {"temperature": "warm"}, "analysis": {"max_workers": 1.5}}', "{}", '{"llm": {"temperature": 2}}', "broken"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("r", rc.configuration_reasons(F.try_parse_json("t"))).orderBy("k").collect()
    assert [sorted(r.r) for r in got] == [
        [], ["Configuration must be a dictionary"], ["Analysis configuration must be a dictionary", "LLM configuration must be a dictionary"],
        ["Invalid LLM provider", "Temperature must be between 0.0 and 2.0", "max_workers must be a positive integer"], ["Temperature must be between 0.0 and 2.0", "max_workers must be a positive integer"],
        [], [], ["Configuration must be a dictionary"]]
    names = spark.createDataFrame([("a<b>:c",), (" .x. ",), ("...",), ("é" * 300,)], "n string").select(rc.file_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["a_b__c", "x", "unnamed_file", "é" * 255]


# Surface.


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.py", 'import os\nclass C:\n    def m(self): return 1\ndef f(x): return x\n', "python"), ("b.js", "import z from './z'\nfunction g(a) {\n  return a;\n}\n", "javascript"), ("bad.py", "def (", "python"), ("c.sql", "SELECT 1", "sql"), ("e.py", None, "python")]
    return spark.createDataFrame(rows, "path string, content string, language string")


def rows_of(df):
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


def test_table_functions(spark, files):
    assert rg.Registry().register(spark) == ["python_elements", "javascript_elements", "typescript_elements"]
    files.filter("language = 'python'").createOrReplaceTempView("files")
    whole = spark.sql("SELECT * FROM python_elements(TABLE(files) PARTITION BY path)")
    want = st.python_elements(spark.table("files"))
    assert whole.columns == want.columns and rows_of(whole) == rows_of(want)
    functions = spark.sql("SELECT * FROM python_elements(TABLE(SELECT * FROM files) PARTITION BY (path), 'function')")
    assert functions.columns == rg.KINDS["function"] and rows_of(functions) == rows_of(want.filter("kind = 'function'").select(*rg.KINDS["function"]))
    assert {r.error for r in spark.sql("SELECT * FROM python_elements(TABLE(files) PARTITION BY (path), 'error')").collect()} == {"SyntaxError"}
    files.filter("language = 'javascript'").createOrReplaceTempView("scripts")
    assert spark.sql("SELECT name FROM javascript_elements(TABLE(scripts) PARTITION BY (path), 'function')").collect()[0].name == "g"
    with pytest.raises(Exception, match="one of function"):
        spark.sql("SELECT * FROM python_elements(TABLE(files) PARTITION BY (path), 'poem')").collect()
    with pytest.raises(Exception, match="path and content"):
        spark.sql("SELECT * FROM python_elements(TABLE(SELECT 1 AS x) PARTITION BY x)").collect()


def test_added_parsers_and_analyzers(spark, files, tmp_path):
    registry = rg.Registry()

    def statements(path, text):
        if "DROP" in text:
            raise ValueError("no")
        return [dict.fromkeys(rg.ELEMENT.names) | {"path": path, "kind": "function", "name": s.split()[0], "line_start": 1} for s in text.split(";") if s.strip()]

    registry.add_parser(rg.Parser(("sql",), (".sql",), statements))
    elements = registry.parse(files.unionByName(spark.createDataFrame([("d.sql", "DROP x", "sql"), ("z.txt", "x", "text")], files.schema)))
    assert {(r.path, r.kind, r.name or r.error) for r in elements.filter("language = 'sql'").collect()} == {("c.sql", "function", "SELECT"), ("d.sql", "error", "ValueError")}
    assert rows_of(elements.filter("language = 'python'").drop("language")) == rows_of(st.python_elements(files.filter("language = 'python'")))

    def short_names(files, elements):
        sure = F.when(F.col("name") == "f", 0.9).otherwise(0.6)
        return elements.filter("kind = 'function' AND length(name) = 1").select(F.lit("documentation").alias("category"), F.lit("low").alias("severity"), F.lit("short name").alias("title"), F.col("path").alias("file_path"), "line_start", sure.alias("confidence"))

    registry.add_analyzer(rg.Analyzer("names", "documentation", ("python",), short_names))
    registry.add_analyzer(rg.Analyzer("all", "complexity", ("python", "javascript"), short_names, 1, {"confidence_threshold": 0.1}))
    registry.add_analyzer(rg.Analyzer("off", "security", ("python",), short_names, 2, {"enabled": False}))
    found = registry.run(files, registry.parse(files))
    assert {(r.analyzer, r.file_path, r.confidence) for r in found.collect()} == {("names", "a.py", 0.9), ("all", "a.py", 0.9), ("all", "a.py", 0.6), ("all", "b.js", 0.6)}
    assert [a.name for a in registry.chosen()] == ["all", "names"] and [a.name for a in registry.chosen(languages=["javascript"])] == ["all"] and registry.run(files, elements, ["security"]).count() == 0
    registry.add_analyzer(rg.Analyzer("odd", "x", (), None, 1, {"confidence_threshold": 2}))
    registry.add_analyzer(rg.Analyzer("wide", "x", (), short_names, 1, {"confidence_threshold": 2}))
    assert registry.problems() == {"valid": ["names", "all", "off", "wide"], "invalid": ["odd: Missing analyze method"], "warnings": ["wide: No supported languages", "wide: Invalid confidence threshold: 2"]}
    assert registry.remove_analyzer("odd") and not registry.remove_analyzer("odd")

    for name, text in {"src/a.py": "x = 1\n", "src/b.ts": "import a from 'a'\n", "src/q.sql": "SELECT 1;INSERT 2", "node/x.py": "y = 1", "r.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    parsed = registry.parse_directory(spark, str(tmp_path), exclude=["node/**"])
    assert {(r.path.rsplit("/", 1)[1], r.language, r.kind) for r in parsed.collect()} == {("a.py", "python", "file"), ("b.ts", "typescript", "import"), ("q.sql", "sql", "function")}
