"""Summaries, tuned models, settings, thresholds, similar functions, files of issues and vulnerabilities."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import churn as ch
from lodeworks.operators import duplicates as du
from lodeworks.operators import lines as ln
from lodeworks.operators import retrieval as rt
from lodeworks.operators import scoring as sc
from lodeworks.operators import structure as st
from lodeworks.operators import summaries as sm
from lodeworks.operators import validation as va
from lodeworks.sources import corpus, settings
from lodeworks.streaming import events as ev


def test_summaries_of_little(spark):
    files = spark.createDataFrame([("a.py", 2048), ("B.TSX", 100), ("x", None)], "path string, size_bytes long")
    assert {tuple(r) for r in sm.codebase_info(files).collect()} == {("Total Files", "3"), ("Languages", "Python, TypeScript"), ("Total Size", "2.1 KB"), ("Estimated Analysis Time", "~5 seconds")}
    assert dict(map(tuple, sm.codebase_info(files.limit(0)).collect()))["Languages"] == "Unknown"
    issues = spark.createDataFrame([(1, "security", "low", "t")], "id int, category string, severity string, title string")
    metrics = spark.createDataFrame([(3, 87.5, 10.0)], "n_files int, overall double, maintainability double")
    rows = {r.metric: r.value for r in sm.analysis_summary(issues, metrics).collect()}
    assert rows == {"Files Analyzed": "3", "Total Issues": "1", "Overall Quality Score": "88/100", "Security Issues": "1", "Low Severity": "1", "Recommendations": sm.VERDICTS["calm"]}
    assert {r.metric: r.value for r in sm.analysis_summary(issues.limit(0), metrics).collect()}["Recommendations"] == sm.VERDICTS["none"]
    assert sm.prompt_fields(issues).first().top_issues == "- t (low)"


def test_thresholds(spark):
    rng = random.Random(3)
    for values in ([rng.choice([1.0, 2.0, 5.0, 40.0, -3.0]) for _ in range(37)], [rng.uniform(-5, 900) for _ in range(101)], [7.0, 7.0], [4.0]):
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        want = sorted(values, reverse=True)[int(len(values) * (1 - 0.8))]
        assert ch.share_threshold(rows, "v").first().v == want


def test_tuned_models(spark, tmp_path):
    built, tuned = sc.Model(), sc.Model().updated(weights={"in_loop": 0.9}, domain={"space": 2.0}, bands={"critical": 0.95})
    assert built.weights["in_loop"] == 0.6 and tuned.weights["in_loop"] == 0.9 and tuned.weights["involves_network"] == 0.7
    with pytest.raises(ValueError, match="Unknown factor type: colour"):
        built.updated(colour={"red": 1.0})
    tuned.save(spark, str(tmp_path / "model"))
    assert sc.Model.load(spark, str(tmp_path / "model")) == tuned
    rows = spark.createDataFrame([("style", True), ("style", False)], "category string, in_loop boolean")
    assert [round(r.s, 9) for r in rows.select(sc.base_score(rows, tuned).alias("s")).collect()] == [1.0, 0.1]
    assert [round(r.s, 9) for r in rows.select(sc.base_score(rows).alias("s")).collect()] == [0.7, 0.1] == [round(r.s, 9) for r in rows.select(sc.base_score(rows, built).alias("s")).collect()]
    assert spark.range(1).select(sc.level(F.lit(0.92), tuned).alias("x")).first().x == "high"
    scored = spark.createDataFrame([("high", 0.5)], "level string, priority double")
    sm.export_scores(scored, scored.agg(F.count("*").alias("n")), {"model": "tuned"}, str(tmp_path / "scores"))
    assert spark.read.json(str(tmp_path / "scores" / "scores")).collect()[0].priority == 0.5 and spark.read.json(str(tmp_path / "scores" / "configuration")).collect()[0].value == "tuned"


def test_settings(tmp_path):
    first, second = tmp_path / "a.json", tmp_path / "b.json"
    second.write_text(json.dumps({"analysis": {"max_workers": 9}, "parser": {"include_patterns": ["*.sql"]}, "other": {}}))
    made = settings.load([first, second], {"LODEWORKS_PARALLEL_PROCESSING": "FALSE", "LODEWORKS_OUTPUT_FORMAT": "html", "LODEWORKS_MAX_WORKERS": ""})
    assert made.analysis.max_workers == 9 and made.parser.include_patterns == ("*.sql",) and made.parser.encoding == "utf-8" and not made.analysis.parallel_processing and made.report.default_format == "html"
    first.write_text("{}")
    assert settings.load([first, second], {}) == settings.Settings() == settings.from_file(tmp_path / "none.json")
    with pytest.raises(TypeError):
        settings.from_dict({"analysis": {"colour": 1}})


def test_similar_functions_match_each_with_each(spark):
    rng = random.Random(7)
    base = ["total = 0", "for x in rows:", "    total += x * weight", "return total / len(rows)", "raise ValueError(x)", "x = [a for a in b]"]
    rows = []
    for k in range(40):
        body = [rng.choice(base) for _ in range(rng.randint(0, 5))]
        rows.append((f"f{k % 5}.py", f"g{k}", k, rng.randrange(4), "\n".join(("  " * rng.randrange(3)) + x for x in body) + rng.choice(["", "\n\n"])))
    got = {(r.a, r.b): (round(r.ratio, 9), r.n_a, r.n_b) for r in du.similar_functions(spark.createDataFrame(rows, "path string, name string, line_start int, n_parameters int, body string"), 0.8).collect()}
    kinds = {}
    for _, _, _, n, body in rows:
        code = "\n".join(x.strip() for x in body.split("\n") if x.strip())
        if code:
            kinds[(code, n)] = kinds.get((code, n), 0) + 1
    ids = {(r.c, r.n): r.i for r in spark.createDataFrame(list(kinds), "c string, n int").select("c", "n", F.xxhash64("c", "n").alias("i")).collect()}
    want = {}
    for x in kinds:
        for y in kinds:
            a, b = ids[x], ids[y]
            if a < b and abs(x[1] - y[1]) <= 1 and (r := difflib.SequenceMatcher(None, x[0], y[0]).ratio()) >= 0.8:
                want[(a, b)] = (round(r, 9), kinds[x], kinds[y])
    assert got == want and want


def test_unused_imports(spark):
    files = spark.createDataFrame([("a.py", "use(OS); dq()"), ("b.py", "")], "path string, content string")
    imports = spark.createDataFrame([("a.py", "os", []), ("a.py", "x.deep", []), ("a.py", "collections", ["dq", "Chain"]), ("b.py", "os", None)], "path string, module string, names array<string>")
    assert {tuple(r) for r in st.unused_imports(files, imports).collect()} == {("a.py", "x.deep"), ("a.py", "collections.Chain"), ("b.py", "os")}


def test_sql_risks(spark):
    lines = ['cursor.execute(f"SELECT")', "EXECUTE(a + b)", "sql = x", "query = '%s'", "query(`a ${b}`)", "plain()"]
    rows = [(lang, k, x, x.strip(), lang) for lang in ("python", "javascript") for k, x in enumerate(lines)]
    got = ln.sql_risks(spark.createDataFrame(rows, "file_id string, line_no int, line string, stripped string, language string")).collect()
    assert {(r.file_id, r.line_no) for r in got} == {("python", 0), ("python", 1), ("python", 3), ("javascript", 4)}


def test_confidence_of_no_chunks(spark):
    rows = spark.createDataFrame([(None, "metrics"), (0.05, "general"), (0.99, "class_specific"), (0.5, "code_specific")], "s double, k string")
    assert [round(r.c, 9) for r in rows.select(rt.answer_confidence(F.col("s"), F.col("k")).alias("c")).collect()] == [0.3, 0.1, 1.0, 0.4]


def test_changes_and_files(spark, tmp_path):
    rows = lambda *own: spark.createDataFrame(own, "signature string, severity string, description string, id int")
    base, current = rows(("a", "low", "x", 1), ("a", "high", "x", 2), ("b", "low", None, 3), ("c", "low", "x", 4)), rows(("a", "high", "y", 1), ("b", "low", None, 2), ("d", "low", "x", 3), ("c", "info", None, 4))
    assert {tuple(r) for r in va.changed_fields(base, current).collect()} == {("a", "description", "x", "y"), ("c", "severity", "low", "info"), ("c", "description", "x", None)}
    one = spark.createDataFrame([("security", None, "f.py", None)], "c string, t string, p string, l int")
    assert one.select(va.issue_signature(F.col("c"), F.col("t"), F.col("p"), F.col("l")).alias("s")).first().s == "security||f.py|0"
    now = spark.createDataFrame([("f", "1"), ("g", "2")], "path string, sha string")
    assert ev.changed_files(now, now.withColumn("analyzed_at", F.lit("2024-01-01"))).count() == 0 and ev.changed_files(now, now, force=True).count() == 2
    issues = spark.createDataFrame([("1", "security", "low", 't, "q"', "d\nd", "f.py", 1, 2, 0.5, None)], ", ".join(f"{c} {'int' if c.startswith('line') else 'double' if c == 'confidence' else 'string'}" for c in corpus.ISSUE_COLUMNS))
    corpus.write_issues_csv(issues, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(str(tmp_path / "csv")).collect()
    assert [back[0][c] for c in ("id", "title", "description", "line_end", "confidence", "suggestion")] == ["1", 't, "q"', "d\nd", "2", "0.5", None]
    (tmp_path / "v.json").write_text(json.dumps({"vulnerabilities": [{"name": "a", "cwe": "CWE-1"}, {"name": "b", "cwe": None}]}))
    assert {(r.name, r.cwe) for r in corpus.read_vulnerabilities(spark, str(tmp_path / "v.json")).collect()} == {("a", "CWE-1"), ("b", None)}
    corpus.write_report(spark.createDataFrame([(1, "é")], "n int, t string"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().t == "é"
