import json

from lodeworks.operators import reporting as rp
from lodeworks.sources import reports


def test_formats(spark):
    issues = spark.createDataFrame(
        [(k, "security" if k % 2 else "testing", "high", 0.9, f"src/<{k % 3}>|.py", k, 1) for k in range(30)],
        "id long, category string, severity string, confidence double, file_path string, line_start int, n_files int",
    )
    metrics = rp.quality_metrics(issues, spark.createDataFrame([(100, 2)], "line_count int, n_elements int"))
    report = reports.report_of(rp.prioritized(issues), metrics)
    assert report["counts"]["category"] == {"security": 15, "testing": 15} and len(report["issues"]) == 20
    assert sum(report["files"].values()) == 30
    assert json.loads(reports.FORMATS["json"](report))["metrics"]["n_issues"] == 30
    assert "&lt;1&gt;" in reports.FORMATS["html"](report) and "src/<1>\\|.py" in reports.FORMATS["markdown"](report)
    assert reports.FORMATS["text"](report).startswith("Metrics\n-------\n")
