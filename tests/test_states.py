"""Focus stacks and literals against sequential versions."""

import io
import random
import tokenize
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.text import to_lines
from lodeworks.operators import focus as fo
from lodeworks.operators import literals as li
from lodeworks.operators import scans


def stack(steps, kept):
    """Each step's (moved, depth, current), and the stack at the end."""
    current, history, out = None, [], []
    for focus, back in steps:
        moved = True
        if focus is not None:
            if current is not None:
                history.append(current)
            current, history = focus, history[-kept:]
            history = history[-kept:]
        elif history:
            current = history.pop()
        else:
            moved = False
        out.append((moved, len(history), current))
    return out, current, history


@pytest.mark.parametrize("kept", [10, 2])
def test_focus_stack(spark, kept):
    rng = random.Random(kept)
    rows, want, ends = [], {}, {}
    for conv in range(30):
        lean = rng.random()
        steps = [(f"c{conv}f{k}", False) if rng.random() < lean else (None, True) for k in range(rng.choice([1, 5, 40, 90]))]
        out, current, history = stack(steps, kept)
        rows += [(conv, 3 * k, f, b) for k, (f, b) in enumerate(steps)] + [(conv, 3 * k + 1, None, None) for k in range(3)]
        want |= {(conv, 3 * k): o for k, o in enumerate(out)}
        if current is not None:
            ends[conv] = (current, history)
    df = spark.createDataFrame(rows, "conv_id int, turn int, focus string, back boolean")
    states = fo.focus_states(df, kept=kept).cache()
    assert {(r.conv_id, r.turn): (r.moved, r.depth, r.current) for r in states.collect()} == want
    assert {r.conv_id: (r.current, list(r.history)) for r in fo.focus_history(states).collect()} == ends
    assert fo.focus_states(df.limit(0)).count() == 0


def test_focus_and_texts(spark):
    rows = spark.createDataFrame([
        ("The FUNCTION?", "a.py", "function", "run", 1, 2), ("the function", "a.py", "function", None, 1, 2), ("the class", "a.py", "class", "Box", 1, 2),
        ("the class", "a.py", "function", "run", 3, 4), ("in this one", "a.py", "module", "", 5, 6), ("what", "a.py", "module", "", 7, 8), ("what", None, None, None, None, None),
    ], "q string, p string, k string, n string, a int, b int")
    got = [r.f for r in rows.select(fo.focus_of(*(F.col(c) for c in "qpknab")).alias("f")).collect()]
    assert got == ["a.py::run()", "a.py", "a.py::Box", "a.py:3-4", "a.py", "a.py:7-8", None]
    shown = spark.createDataFrame([("x", ["a", "b", "c", "d"]), ("x", []), (None, [])], "c string, h array<string>").select(fo.context_text(F.col("c"), F.col("h")).alias("t"))
    assert [r.t for r in shown.collect()] == ["Current focus: x\nRecent focus history:\n  - b\n  - c\n  - d", "Current focus: x", "No current focus"]
    one = spark.range(1).select(fo.codebase_text(F.lit("/src"), F.lit(3), F.lit(0), F.array(F.lit("python"), F.lit("javascript"))).alias("t")).first().t
    assert one.split("\n")[:4] == ["Codebase: /src", "Files Analyzed: 3", "Code Quality Analysis: No issues found", "Languages: python, javascript"]


def test_summaries(spark):
    questions = spark.createDataFrame([(1, t, f"q{t}", "general", 0.5 + t / 100, [f"r{t}", "s", "t"] if t % 2 else [], "0:01:00") for t in range(5)] + [(2, 0, "only", "metrics", 1.0, [], "0:00:01")],
                                      "conv_id int, turn int, question string, kind string, confidence double, refs array<string>, spent string")
    focus = spark.createDataFrame([(1, "now", [f"h{k}" for k in range(7)])], "conv_id int, current string, history array<string>")
    words = spark.createDataFrame([(1, w) for w in "gfedcba"], "conv_id int, word string")
    got = {r.conv_id: r.summary for r in fo.conversation_summaries(questions, focus, words, "/src", F.col("spent")).collect()}
    assert got[1] == "\n".join([
        "Conversation Context Summary", "=" * 30, "Codebase: /src", "Session Duration: 0:01:00", "Questions Asked: 5", "", "Current Focus:", "  now", "", "Recent Focus History:",
        "  1. h2", "  2. h3", "  3. h4", "  4. h5", "  5. h6", "", "Recent Questions:", "  Q (general): q2", "  Confidence: 0.52", "", "  Q (general): q3", "  Confidence: 0.53", "  References: r3, s", "",
        "  Q (general): q4", "  Confidence: 0.54", "", "Active Keywords: a, b, c, d, e", ""])
    assert got[2].endswith("Questions Asked: 1\n\nRecent Questions:\n  Q (metrics): only\n  Confidence: 1.00\n")


def test_rounds(spark):
    rows = spark.createDataFrame([(k % 3, k, [k % 4, (k * 7) % 4, 1, 3]) for k in range(50)], "g int, n int, f array<int>")
    got = scans.prefix_composed(rows, ["g"], ["n"], "f", lambda a, b: F.transform(a, lambda x: F.element_at(b, x + 1)), scans.rounds_for(rows, ["g"]))
    for g in range(3):
        so_far, mine = [0, 1, 2, 3], sorted((r.n, r.f) for r in got.collect() if r.g == g)
        for n, f in mine:
            so_far = [[n % 4, (n * 7) % 4, 1, 3][x] for x in so_far]
            assert f == so_far


def whole(text, language):
    """Sequential: literals of a file from its whole text, character by character."""
    out, k, n = [], 0, len(text)
    place = lambda p: (text.count("\n", 0, p) + 1, p - (text.rfind("\n", 0, p) + 1))
    openers = ["'''", '"""', "'", '"'] if language == "python" else ["`", "'", '"']
    while k < n:
        if text.startswith("#", k) and language == "python" or text.startswith("//", k) and language != "python":
            k = text.find("\n", k)
            k = n if k < 0 else k
        elif text.startswith("/*", k) and language != "python":
            k = text.find("*/", k + 2)
            k = n if k < 0 else k + 2
        else:
            q = next((q for q in openers if text.startswith(q, k)), None)
            if not q:
                k += 1
                continue
            a = b = k + len(q)
            long, closed = len(q) == 3 or q == "`", False
            while b < n:
                if text.startswith(q, b):
                    closed = True
                    break
                if text[b] == "\\":
                    b += 2
                elif text[b] == "\n" and not long:
                    break
                else:
                    b += 1
            b = min(b, n)
            out.append((*place(k), place(b)[0], q, text[a:b], closed))
            k = b + len(q) if closed else b
    return out


SOURCES = [
    ("python", 'x = "a" + \'b\\\'c\' # "no"\ny = """one\ntwo \\""" three\n""" + r\'\\\\\'\nz = "open\nw = \'go\\\non\'\n'),
    ("javascript", "const a = `one ${b}\n two \\` three`; // 'no\n/* \"no\n 'no' */ let c = 'd' + \"e\\\"f\";\nlet g = 'open\nlet h = 'x'\n"),
    ("python", "# only\n\n"), ("python", ""), ("typescript", "`never\nclosed\n"), ("python", "'''a''''b'"), ("python", '"""x\n' * 7), ("python", "x = '\\\n\\\n\\\nend' 'q'\n'"),
]


@pytest.mark.parametrize("block", [1, 2, 512])
def test_literals_match_the_whole_text(spark, block):
    rng = random.Random(block)
    pieces = ["'", '"', "'''", '"""', "`", "\\", "\n", "a", " ", "#", "//", "/*", "*/", "x\n", "\\\n"]
    files = [(f"f{k}", lang, text) for k, (lang, text) in enumerate(SOURCES)]
    files += [(f"r{k}", rng.choice(["python", "javascript"]), "".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    lines = to_lines(spark.createDataFrame(files, "path string, language string, content string")).repartition(2)
    got = li.literal_spans(lines, block=block).collect()
    mine = Counter((r.path, r.line_start, r.column, r.quote, r.text.rstrip("\n"), r.closed) for r in got)
    want = Counter((p, a, c, q, t.rstrip("\n"), closed) for p, lang, text in files for a, c, _, q, t, closed in whole(text.rstrip("\n") if not text.endswith("\\\n") else text[:-1], lang))
    assert mine == want


def test_literals_match_the_tokenizer(spark):
    source = 'def f(a):\n    """Doc\n    more."""\n    return {"k": \'v\', 3: "it\'s", "e\\n": r"\\d"}  # "c"\n\nX = (\'a\'\n     "b")\nY = \'one \\\ntwo\'\n'
    tokens = [(t.start[0], t.start[1], t.end[0]) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.STRING]
    lines = to_lines(spark.createDataFrame([("f", "python", source)], "path string, language string, content string"))
    got = sorted((r.line_start, r.column, r.line_end) for r in li.literal_spans(lines, block=3).collect())
    assert got == sorted((a, b + (1 if source.split("\n")[a - 1][b] == "r" else 0), c) for a, b, c in tokens)


def test_values(spark):
    assert sorted(li.values_of('x = "a" "b"\n"""d"""\ny = b"no"\n', "python")) == ["ab", "d"]
    assert li.values_of('x = "abc" (\n"""doc"""\n', "python") == ["doc", "c", "", "c", ""]  # doesn't parse
    assert li.values_of("a('xyz', `t`, \"\")", "typescript") == ["t", "", "z"] and li.values_of("'a'", "java") == []
    files = spark.createDataFrame([("p", "python", "a = 'q'\n"), ("n", "python", None), ("j", "javascript", "'side'")], "path string, language string, content string")
    assert sorted(tuple(r) for r in li.string_values(files).collect()) == [("j", "e"), ("p", "q")]
