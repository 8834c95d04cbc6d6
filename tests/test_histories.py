"""Exported logs in ranges, substring joins, all simple cycles: against plain versions."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import cycles as cy
from lodeworks.operators import paths as pa
from lodeworks.sources import corpus, gitlog

LOG = """aaaaaaa1|Ann|2023-01-01 10:00:00 +0000|first | with bars
1\t2\tsrc/a.py
-\t-\timg.png

bbbbbbb2|Bob|2023-01-02T11:30:00+02:00|second

ccccccc3|Cyr|not a date|third
5\t5\tsrc/lost.py
ddddddd4|Ann|2023-01-03 12:00:00 -0330|é 漢
10\t0\tsrc/b c.py
"""


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "one.txt").write_text(LOG)
    rng = random.Random(1)
    text = ""
    for k in range(60):
        text += f"{k:08x}|A{k % 3}|2023-02-01 10:{k:02d}:00 +0000|step {k}\n" + "".join(f"{rng.randint(0, 9)}\t{rng.randint(0, 9)}\td/{rng.randint(0, 5)}.py\n" for _ in range(rng.choice([0, 1, 2, 30]))) + "\n"
    (folder / "deep").mkdir()
    (folder / "deep" / "two.txt").write_text(text.rstrip("\n"))
    (folder / "empty.txt").write_text("")
    (folder / "headless.txt").write_text("1\t1\tx.py\n\n2\t2\ty.py\n")
    return folder


def plain(rows):
    return Counter(tuple(r) for r in rows.select("hash", "author", F.unix_seconds("date"), "message", "file", "added", "deleted").collect())


def expected(logs):
    out = Counter()
    for path in logs.rglob("*.txt"):
        head = None
        for line in path.read_text().splitlines():
            if "\t" in line:
                if head:
                    a, d, f = line.split("\t")
                    out[(head[0], head[1], head[3], f, 0 if a == "-" else int(a), 0 if d == "-" else int(d))] += 1
            elif "|" in line:
                head = line.split("|", 3)
                head = None if head[2] == "not a date" else head
    return out


@pytest.mark.parametrize("size", [1, 17, 64])
def test_every_line_is_in_one_range(logs, size):
    for path in logs.rglob("*.txt"):
        n = path.stat().st_size
        ranges = [gitlog.LogRange(str(path), a, min(n, a + size)) for a in range(0, n, size)]
        assert [x for r in ranges for x in gitlog._lines(str(logs), r)] == path.read_text().splitlines()


@pytest.mark.parametrize("size", [700, 1 << 20])
def test_ranges_of_logs(spark, logs, size):
    rows = gitlog.read_commits(spark, str(logs), split_bytes=size)
    assert Counter({(h, a, m, f, x, y): n for (h, a, _, m, f, x, y), n in plain(rows).items()}) == expected(logs)
    dates = {r.hash: r.s for r in rows.select("hash", F.unix_seconds("date").alias("s")).collect()}
    assert dates["aaaaaaa1"] == 1672567200 and dates["ddddddd4"] == 1672759800


def test_text_reader_and_one_window_agree(spark, logs):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        assert gitlog.lines_of(spark, str(logs / "deep")).filter("file IS NULL").count() > 4
        got = plain(corpus.read_git_log(spark, str(logs / "deep")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = [("two", k, x) for k, x in enumerate((logs / "deep" / "two.txt").read_text().split("\n"))]
    assert got == plain(corpus.parse_git_log(spark.createDataFrame(lines, "log string, line_no int, line string")))
    assert got == plain(gitlog.read_commits(spark, str(logs / "deep" / "two.txt"), split_bytes=900))


def test_columns_and_pattern(spark, logs):
    gitlog.register(spark)
    rows = spark.read.format("git_log").schema("file string, added long").option("pattern", "*one*").load(str(logs)).filter("file IS NOT NULL")
    assert {tuple(r) for r in rows.collect()} == {("src/a.py", 1), ("img.png", 0), ("src/lost.py", 5), ("src/b c.py", 10)}
    assert spark.read.format("git_log").option("pattern", "nothing").load(str(logs)).count() == 0


def test_written_logs_come_back(spark, tmp_path):
    rows = [(k % 3, f"{k:07x}", f"a{k}", f"2024-01-{k + 1:02d} 00:00:00", "m | n", [(f"f{j}.py", str(k), "-") for j in range(k % 4)]) for k in range(20)]
    commits = spark.createDataFrame(rows, "log int, hash string, author string, date string, message string, files array<struct<file:string,added:string,deleted:string>>")
    gitlog.write_log(commits.withColumn("date", F.to_timestamp("date")), str(tmp_path / "out"))
    back = gitlog.read_commits(spark, str(tmp_path / "out"), split_bytes=500)
    assert Counter((r.hash, r.file, r.added, r.deleted) for r in back.collect()) == Counter((h, f, int(a), 0) for _, h, _, _, _, fs in rows for f, a, _ in fs)


# Substrings.


def test_holding_matches_each_with_each(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["", "é漢字x", "src/aaaa.py", None, "aaaa"]
    needles = ["".join(rng.choice("ab/.") for _ in range(rng.randint(0, 7))) for _ in range(80)] + ["", "漢字", "aaaa", "aaaaa", "zzzz", None, "b", "%", "src/aaaa.py"]
    got = pa.holding(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(n, t) for n in needles for t in texts if n is not None and t is not None and n in t}
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = pa.holding(spark.createDataFrame([], "needle string"), spark.createDataFrame([("a",)], "text string"))
    assert none.columns == ["needle", "text"] and none.count() == 0


def test_reference_edges(spark):
    files = spark.createDataFrame([("src/os_tools.py",), ("lib/app.js",), ("lib/app/main.py",)], "path string")
    imports = spark.createDataFrame([("src/os_tools.py", "os"), ("lib/app.js", "app/main"), ("lib/app.js", "app"), ("lib/app.js", "app"), ("x.py", None), ("x.py", "numpy")], "path string, module string")
    assert {tuple(r) for r in pa.reference_edges(imports, files).collect()} == {
        ("src/os_tools.py", "src/os_tools.py"), ("lib/app.js", "lib/app/main.py"), ("lib/app.js", "lib/app.js")}


# Cycles.


def brute(edges):
    """Every order of every subset of nodes, from its smallest one on."""
    nodes, own = sorted({n for e in edges for n in e}), set(edges)
    out = set()
    for n in range(1, len(nodes) + 1):
        for chosen in itertools.combinations(nodes, n):
            for rest in itertools.permutations(chosen[1:]):
                path = (chosen[0], *rest)
                if all((a, b) in own for a, b in zip(path, (*path[1:], path[0]))):
                    out.add(path)
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_cycles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = {(f"g{seed}n{rng.randrange(7)}", f"g{seed}n{rng.randrange(7)}") for _ in range([8, 14, 22, 35][seed])}
    edges |= {(f"h{a}", f"h{b}") for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 3)]}
    rows = [*edges, *list(edges)[:3], (None, "h1"), ("h1", None)]
    found = cy.all_cycles(spark.createDataFrame(rows, "src string, dst string"), starts=2).collect()
    assert Counter(tuple(r.cycle) for r in found) == Counter(brute([e for e in edges]))
    assert all(r.length == len(r.cycle) and r.severity == ("high" if r.length >= 5 else "medium" if r.length >= 3 else "low") for r in found)


def test_cycles_of_integers_and_none(spark):
    ring = [(k, (k + 1) % 40) for k in range(40)]
    found = cy.all_cycles(spark.createDataFrame([*ring, (3, 1)], "src long, dst long")).orderBy("length").collect()
    assert [(r.length, r.cycle[0]) for r in found] == [(3, 1), (40, 0)]
    assert found[0].description == "Circular dependency chain: 1 → 2 → 3 → 1"
    pair = cy.all_cycles(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")).collect()
    assert [r.description for r in pair] == ["Direct circular dependency between a and b"]
    none = cy.all_cycles(spark.createDataFrame([("a", "b")], "src string, dst string"))
    assert none.count() == 0 and {(r.value, r.n) for r in cy.cycle_summary(none).collect()} == {("high", 0), ("medium", 0), ("low", 0)}


def test_many_dead_ends_are_walked_once():
    """A ladder of diamonds that leads nowhere has 2^n paths: without blocking this would not end."""
    n = 40
    follow: dict = {0: [1, 2]}
    for k in range(n):
        a = 3 * k
        follow[a] = [a + 1, a + 2]
        follow[a + 1] = follow[a + 2] = [a + 3]
    last = 3 * n
    follow[last] = [last + 1]
    follow[last + 1] = [last]  # a small cycle at the end, and one way back to a node that is on every path
    follow[last].append(1)
    first = next(iter(cy.cycles_from(1, follow)))
    assert first[0] == 1
    assert sorted(map(tuple, cy.cycles_from(last, follow))) == [(last, last + 1)]


def test_reports(spark):
    cycles = cy.all_cycles(spark.createDataFrame([(a, b) for a in "abcdef" for b in "abcdef" if a != b], "src string, dst string"))
    counts = {(r.dimension, r.value): r.n for r in cy.cycle_summary(cycles).collect()}
    assert counts[("length", "2")] == 15 and counts[("length", "6")] == 120 and counts[("severity", "high")] == 144 + 120
    top = cy.top_cycles(cycles).collect()
    assert len(top) == 10 and {(r.severity, r.length) for r in top} == {("high", 6)} and top[0].shown == "a → b → c..."
    panels = {(r.panel, r.label): r.value for r in cy.dashboard(spark.createDataFrame([("x/a.py", "b"), ("b", "x/a.py"), ("b", "c")], "src string, dst string")).collect()}
    assert panels[("overview", "Total Files")] == 3 and panels[("hotspots", "a.py")] == 2 and panels[("components", "b")] == 2 and panels[("metrics", "Density")] == 0.5
