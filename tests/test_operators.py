import datetime as dt
import difflib
import json
import random

from pyspark.sql import functions as F

from lodeworks.functions import text as tx
from lodeworks.operators import churn as ch
from lodeworks.operators import duplicates as du
from lodeworks.operators import graph as gr
from lodeworks.operators import lines as ln
from lodeworks.operators import reporting as rp
from lodeworks.operators import structure as st
from lodeworks.operators import validation as va
from lodeworks.plans import catalogue as cat
from lodeworks.sources import corpus
from lodeworks.streaming import events as ev


def code(spark, text, name="f"):
    return tx.to_lines(spark.createDataFrame([(name, text)], "file_id string, content string"), "file_id")


def test_lines_of_odd_texts(spark):
    texts = [(1, ""), (2, "a\nb\n"), (3, "a\r\nb\rc"), (4, None), (5, "\n")]
    rows = spark.createDataFrame(texts, "k int, t string").select("k", F.size(tx.split_lines(F.col("t"))).alias("n"))
    assert {r.k: r.n for r in rows.collect() if (r.n or 0) > 0} == {2: 2, 3: 3, 5: 1}


def test_rules_first_pattern_and_guards(spark):
    text = 'password = "longenough1"\n# password = "longenough1"\nx = eval(input())\nnodes(1)\npassword = "test value 1"\n'
    found = cat.apply_rules(code(spark, text), list(cat.RULES), F.lit("python")).collect()
    by_line = {}
    for r in found:
        by_line.setdefault(r.line_no, set()).add(r.rule_id)
    assert by_line[1] == {"secret_password"} and 2 not in by_line
    assert {"command_injection_py", "dangerous_function_py"} <= by_line[3]
    assert by_line[4] == {"weak_crypto_py"} and "secret_password" not in by_line.get(5, set())


def test_loops(spark):
    text = "for a in b:\n    cursor.execute(q)\n    for c in d:\n        x.save(1)\nfor e in f:\n    pass\nopen(p)\n"
    context = ln.loop_context(code(spark, text))
    assert {(r.line_no, r.loop_line) for r in ln.calls_in_loops(context, ln.DB_CALL).collect()} == {(2, 1), (4, 3)}
    assert {r.line_no for r in ln.nested_loops(context).collect()} == {3, 5}
    assert ln.calls_in_loops(context, ln.IO_CALL).count() == 0
    beside = ln.nested_loops(ln.loop_context(code(spark, "for a in b: f(a)\nfor c in d: g(c)\n"))).collect()
    assert [(r.line_no, r.depth_ref) for r in beside] == [(2, 2)]  # neighbours count as nested


def test_commented_run_at_the_end_is_left_out(spark):
    run = "# x = f(1)\n# y = g(2)\n# if z:\n"
    assert ln.commented_code(code(spark, run)).count() == 0
    assert [tuple(r)[1:] for r in ln.commented_code(code(spark, run + "done()\n")).collect()] == [(1, 3, 3)]


def test_churn_constants(spark):
    days = [("a", "2023-01-01"), ("b", "2023-01-10"), ("a", "2023-01-20")]
    rows = [(str(k), a, dt.datetime.fromisoformat(d), "f", 1, 0) for k, (a, d) in enumerate(days)]
    r = ch.file_churn(spark.createDataFrame(rows, "hash string, author string, date timestamp, file string, added long, deleted long")).first()
    assert (r.total_commits, r.unique_authors, r.days) == (3, 2, 19) and abs(r.change_frequency - 3 / 19) < 1e-12


def test_complexity_scores(spark):
    f = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "file string, complexity int")
    files = spark.createDataFrame([("a", 10), ("b", 10), ("c", 250)], "file string, line_count int")
    assert {r.file: r.complexity for r in ch.complexity_scores(f, files).collect()} == {"a": 4.0, "b": 1.0, "c": 2.5}


def test_accuracy_constants(spark):
    rows = spark.createDataFrame([(True, True), (True, True)], "expected boolean, actual boolean")
    assert va.scores(rows).select("precision", "recall", "f1").first()[:] == (1.0, 1.0, 1.0)
    rows = spark.createDataFrame([(True, True), (True, False), (False, True)], "expected boolean, actual boolean")
    assert va.scores(rows).select("precision", "recall", "f1", "fp", "fn").first()[:] == (0.5, 0.5, 0.5, 1, 1)
    assert va.scores(rows.limit(0)).select("precision", "f1").first()[:] == (0.0, 0.0)


def test_no_issues(spark):
    empty = spark.createDataFrame([], "id long, category string, severity string, confidence double, file_path string, line_start int, n_files int")
    m = rp.quality_metrics(empty, spark.createDataFrame([(10, 1)], "line_count int, n_elements int")).first()
    assert (m.overall, m.density, m.maintainability) == (100.0, 0.0, 0.0)
    assert rp.category_scores(empty).filter("score = 100").count() == 7
    assert rp.prioritized(empty).count() == 0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert {(r.node, r.depth) for r in gr.bfs_depths(e, "a").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 4)}
    assert gr.bfs_depths(e, "none").count() == 1
    assert {(r.node, r.component) for r in gr.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
    assert [r.cycle for r in gr.simple_cycles(e).collect()] == [["a", "b", "c"]]
    assert gr.has_cycle(e).first()[0] and gr.longest_path(e).first()[0] == 0
    chain = e.filter("src <> 'c' OR dst <> 'a'")
    assert not gr.has_cycle(chain).first()[0] and gr.longest_path(chain).first()[0] == 4


def test_structure(spark):
    files = [
        ("src/a.py", 'import b\nfrom c import d as e\n@x\nclass A(B):\n    def m(self, p, *q, **r):\n        """Do."""\n        if p and q:\n            return [i for i in p if i]\n'),
        ("bad.py", "def (:\n"), ("empty.py", ""), ("null.py", None),
    ]
    rows = st.python_elements(spark.createDataFrame(files, "path string, content string")).collect()
    assert [r.error for r in rows if r.kind == "error"] == ["SyntaxError"]
    m = next(r for r in rows if r.kind == "function")
    assert (m.owner, m.parameters, m.complexity, m.is_method) == ("A", ["self", "p", "*q", "**r"], 5, True)
    assert {r.module for r in rows if r.kind == "import"} == {"b", "c"}
    e = next(r for r in rows if r.kind == "import" and r.module == "b")
    assert e.names == [] and e.alias is None and m.cognitive == 11 and m.nesting == 2
    js = [("a.ts", "function f(a: number, b) {\n  if (a) {\n    return 1;\n  }\n}\nx(function f() {\nconst g = (x) => x && y;\nimport z from './z'\nimport './side'\nfunction open(a) {\n"), ("n.js", None)]
    found = st.script_elements(spark.createDataFrame(js, "path string, content string")).collect()
    of = lambda kind: {(r.name or r.module, r.line_start, r.line_end, r.complexity) for r in found if r.kind == kind}
    assert of("function") == {("f", 1, 5, 2), ("if", 2, 4, 2), ("x", 6, 10, 2), ("open", 10, 10, 1)}
    assert of("import") == {("./z", 8, None, None), ("./side", 9, None, None)}
    assert [r.parameters for r in found if r.name == "f"] == [["a", "b"]]


def test_git_log(spark):
    log = "abcdef1|Ann|2024-01-02T03:04:05+00:00|fix | all\n\n3\t1\tsrc/a.py\n-\t-\tlogo.png\n"
    lines = spark.createDataFrame([("l", k, t) for k, t in enumerate(log.split("\n"))], "log string, line_no int, line string")
    rows = corpus.parse_git_log(lines).collect()
    assert {(r.author, r.file, r.added, r.deleted, r.message) for r in rows} == {("Ann", "src/a.py", 3, 1, "fix | all"), ("Ann", "logo.png", 0, 0, "fix | all")}


def test_tree(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "node_modules/b.js": b"y", "c.txt": b"z", "d.py": b"\xe9 = 1", "e.py": b"\x00"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = corpus.read_tree(spark, str(tmp_path), ["*.py", "*.js"], ["node_modules/**"]).collect()
    assert {(r.path.rsplit("/", 1)[1], r.language, r.content) for r in rows} == {("a.py", "python", "x = 1\n"), ("d.py", "python", "é = 1")}


def test_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("s", "high")], "signature string, severity string")
    for version in ("1", "2"):
        corpus.save_snapshot(rows, str(tmp_path / "s"), "app", version)
    assert corpus.load_snapshot(spark, str(tmp_path / "s"), "app", "1").first().version == 1
    assert corpus.load_snapshot(spark, str(tmp_path / "s"), "other").count() == 0


def test_rate_limit_counts_accepted_requests_only(spark):
    rows = spark.createDataFrame([("u", k, float(t)) for k, t in enumerate([0, 1, 2, 9, 10.5, 11.5])], "id string, request long, at double")
    assert [r.accepted for r in ev.rate_limited(rows, 2, 10.0).orderBy("request").collect()] == [True, True, False, False, True, True]


def test_streams(spark, tmp_path):
    (tmp_path / "hooks").mkdir()
    hooks = [{"event": "push", "ref": "refs/heads/main"}, {"event": "push", "ref": "refs/heads/x"}, {"event": "pull_request", "action": "opened"}, {"event": "pull_request", "action": "closed"}]
    (tmp_path / "hooks/a.json").write_text("\n".join(map(json.dumps, hooks)))
    q = ev.webhook_stream(spark, str(tmp_path / "hooks")).writeStream.format("memory").queryName("hooks").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM hooks").count() == 2

    (tmp_path / "requests").mkdir()
    (tmp_path / "requests/a.json").write_text("\n".join(json.dumps({"id": "u", "request": k, "at": float(k)}) for k in range(4)))
    stream = spark.readStream.schema("id string, request long, at double").json(str(tmp_path / "requests"))
    q = ev.rate_limited_stream(stream, 2, 10.0).writeStream.format("memory").queryName("limited").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.request, r.accepted) for r in spark.sql("SELECT * FROM limited").collect()) == [(0, True), (1, True), (2, False), (3, False)]


def test_similar_pairs_whole(spark, monkeypatch):
    """Against brute force: short, long and empty texts, lengths at the bound, repeated letters, small blocks."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    texts = ["", "", "abcdefgh", "abcdefgh1234", "ab" * 150, "ab" * 150, "a" * 199, "a" * 200]
    for n in (1, 3, 8, 20, 45, 60, 150):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.05, 0.12, 0.2):
                texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    rng.shuffle(texts)
    want = {(a, b): r for b, y in enumerate(texts) for a, x in enumerate(texts[:b]) if (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.8}
    blocks = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, file_id long, code string").repartition(3)
    for size in (4096, 5):
        monkeypatch.setattr(du, "BLOCK", size)
        rows = du.similar_pairs(blocks, 0.8).collect()
        assert len(rows) == len(want) and {(r.a, r.b): r.ratio for r in rows} == want


def test_similar_texts_of_all_lengths(spark, tmp_path):
    from lodeworks.plans import analytics  # noqa: F401  registers the query
    from lodeworks.plans import queries as own

    texts = ["short text", "short text!", "word " * 20 + "x", "word " * 20 + "y", "The quick brown fox jumps. " * 40, "The quick brown fox jumps! " * 40]
    spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(a, b) for b in range(6) for a in range(b) if difflib.SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.8}
    assert {(0, 1), (2, 3)} <= want and {(r.a, r.b) for r in own.QUERIES["similar_texts"](spark, str(tmp_path)).collect()} == want


def test_steps_of_all_events(spark, tmp_path):
    """Against brute force over all events; none of their ids is a multiple of 29."""
    from lodeworks.plans import analytics  # noqa: F401  registers the queries
    from lodeworks.plans import queries as own

    rng = random.Random(6)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), rng.randrange(12), rng.choice(["view", "click", "error"])) for i in range(1, 60) if i % 29]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    edges = set()
    for u in range(12):
        mine = [r for r in rows if r[2] == u]
        edges |= {(f"{x[3]}{u % 7}", f"{y[3]}{(u + y[0]) % 7}") for x, y in zip(mine, mine[1:], strict=False)}
    edges = {(a, b) for a, b in edges if a != b}
    after = lambda n: {b for a, b in edges if a == n}

    def depths(start):
        seen, front = {start: 0}, {start}
        while front:
            front = {b for n in front for b in after(n)} - seen.keys()
            seen |= dict.fromkeys(front, max(seen.values()) + 1)
        return seen

    nodes = {n for e in edges for n in e}
    reach = {n: set(depths(n)) for n in nodes}
    run = lambda name: own.QUERIES[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("reach_depths_derived")} == set(depths("view1").items())
    two = {f"{a}>{b}" for a, b in edges if a < b and (b, a) in edges}
    three = {f"{a}>{b}>{c}" for a, b in edges for c in after(b) if a < b and a < c and c != b and (c, a) in edges}
    assert {r.cycle for r in run("cycles_derived")} == two | three
    groups = {n: {m for m in reach[n] if n in reach[m]} for n in nodes}
    assert {tuple(r) for r in run("strong_components_derived")} == {(n, min(g)) for n, g in groups.items() if len(g) > 1}
    assert run("has_cycle_derived")[0][0] == any(len(g) > 1 for g in groups.values())
    longest = lambda n: max((1 + longest(b) for b in after(n) if n < b), default=0)
    assert run("longest_path_derived")[0][0] == max(map(longest, nodes))


def test_greedy_matches_of_all_events(spark, tmp_path):
    """Against brute force in which every even event meets every odd one of its user."""
    from lodeworks.plans import analytics  # noqa: F401  registers the query
    from lodeworks.plans import queries as own

    rng = random.Random(7)
    rows = [(i, rng.randrange(4), rng.choice(["view", "click"]), float(rng.randint(1, 9))) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want, used = set(), set()
    for i, u, t, v in rows[::2]:
        pairs = [((0.6 if t == t2 else 0.2) + 0.4 * min(v, w) / max(v, w), -j) for j, u2, t2, w in rows[1::2] if u2 == u and j not in used]
        if pairs and max(pairs)[0] >= 0.5:
            score, j = max(pairs)
            used.add(-j), want.add((u, i, -j, score))
    got = own.QUERIES["greedy_matches"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_scores_of_whole_texts(spark, tmp_path):
    """A keyword past the first 120 characters, in a document past the first 200."""
    from lodeworks.functions.weights import KEYWORDS
    from lodeworks.plans import scores  # noqa: F401  registers the queries
    from lodeworks.plans import queries as own

    word = KEYWORDS["involves_database"][0]
    docs = [(k, "x" * 130 + (f" {word}" if k in (5, 205) else "")) for k in range(210)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, dt.datetime(2024, 1, 1), 1, "error", 5.0) for i in range(420)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: own.QUERIES[name](spark, str(tmp_path)).collect()
    got = {r.id: r.involves_database for r in run("severity_features")}
    assert got == {i: i % 210 in (5, 205) or i % 12 == 0 for i in range(420)}  # every 12th has a phrase about SQL
    for name in ("severity_scores", "contextual_scores", "business_impacts"):
        assert {r.id for r in run(name)} == set(range(420))
    assert run("score_statistics")[0].n == 420
