"""Operators over the lines of files where order matters: islands and running sums as windows, stacks as a fold per file.

All take lines(file_id, line_no, line, stripped, indent). A file's lines meet in one window partition or group; files are
bounded (10 MiB at the source), so no group grows with the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of commented code, loops, calls, concatenations and lines that hold no finding; the joined forms are searched in
# one pass.
CODE_COMMENTS = [
    r"#\s*(def|class|if|for|while|try|import|from)", r"//\s*(function|class|if|for|while|try|import|const|let|var)", r"#\s*[a-zA-Z_]\w*\s*[=\(]",
    r"//\s*[a-zA-Z_]\w*\s*[=\(]",
]
LOOP = r"\b(for|while)\b"
DB_CALLS = [
    r"\.(query|execute|find|save|update|delete)\s*\(", r"SELECT\s+.*FROM", r"INSERT\s+INTO", r"UPDATE\s+.*SET", r"DELETE\s+FROM", r"\.(objects|filter|all|first|last)\s*\(",
    r"cursor\.(execute|fetchone|fetchall)", r"session\.(query|add|commit|rollback)",
]
IO_CALLS = [
    r"open\s*\(", r"\.read\s*\(", r"\.write\s*\(", r"\.close\s*\(", r"requests\.(get|post|put|delete)", r"fetch\s*\(", r"axios\.(get|post|put|delete)",
]
CONCATS = [r"\+=\s*[\"']", r"=\s*\w+\s*\+\s*[\"']"]
UNLIKELY_FORMS = [r"^#", r"^//", r"^import ", r"^from ", r'^\"\"\"', r"^'''", r"^def\s+\w+\(", r"^class\s+\w+"]
CODE_COMMENT, DB_CALL, IO_CALL, CONCAT, UNLIKELY = map("|".join, (CODE_COMMENTS, DB_CALLS, IO_CALLS, CONCATS, UNLIKELY_FORMS))
# Words that nest or count, and logical operators.
NESTING_WORDS = ["if", "while", "for", "try", "def", "class"]
COUNTED_WORDS = ["if", "elif", "else", "while", "for", "try", "except", "finally"]
LOGICAL = ["&&", "||", "and", "or"]


def _file():
    return Window.partitionBy("file_id")


def _order():
    return _file().orderBy("line_no")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def code_blocks(lines: DataFrame, least: int = 5) -> DataFrame:
    """(file_id, start_line, end_line, n_lines, code): runs between blanks and comments, cut where the indent falls
    below the block's first; blocks are the strict running minima of indent inside a run."""
    apart = (F.col("stripped") == "") | F.col("stripped").startswith("#") | F.col("stripped").startswith("//")
    rows = lines.withColumn("apart", apart).withColumn("run", F.sum(apart.cast("int")).over(_so_far())).filter("NOT apart")
    inside = Window.partitionBy("file_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("base", F.min("indent").over(inside))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    blocks = rows.groupBy("file_id", "run", "base").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"), code.alias("code")
    )
    return blocks.filter(F.col("n_lines") >= least).select("file_id", "start_line", "end_line", "n_lines", "code")


def normalized_code(code: Column) -> Column:
    """Comments and blank lines gone, spaces collapsed and dropped around brackets and separators, lower case."""
    lines = F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "(#|//).*$", ""), r"^\s+|\s+$", ""))
    joined = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    return F.lower(F.regexp_replace(F.regexp_replace(joined, r"\s+", " "), r"\s*([{}();,])\s*", "$1"))


def commented_code(lines: DataFrame, least: int = 3) -> DataFrame:
    """(file_id, start_line, end_line, n_lines): runs of commented-out code; a run that reaches the file's end is left out."""
    rows = lines.withColumn("is_code", F.col("stripped").rlike("^(#|//)") & F.col("stripped").rlike(CODE_COMMENT))
    rows = rows.withColumn("run", F.sum((~F.col("is_code")).cast("int")).over(_so_far())).withColumn("last", F.max("line_no").over(_file()))
    runs = rows.filter("is_code").groupBy("file_id", "run").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"), F.max("last").alias("last")
    )
    return runs.filter((F.col("n_lines") >= least) & (F.col("end_line") < F.col("last"))).drop("run", "last")


def loop_context(lines: DataFrame) -> DataFrame:
    """Adds, to each line: loop_line (line_no of the innermost loop around it, null outside), is_loop and depth_ref (the
    depth at which a loop line stands if loops are left only at other lines, so neighbours at one indent count as nested).

    One linear pass over each file's lines with two stacks.
    """
    columns = lines.columns
    rows = lines.withColumn("is_loop", F.col("stripped").rlike(LOOP) & F.col("stripped").contains(":"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_no")
        around: list[int | None] = []
        depths: list[int | None] = []
        stack: list[tuple[int, int]] = []
        nested: list[int] = []
        for no, text, depth, loop in zip(frame["line_no"], frame["stripped"], frame["indent"], frame["is_loop"], strict=True):
            if text == "" or text.startswith("#"):
                around.append(None), depths.append(None)
                continue
            while stack and depth <= stack[-1][0]:
                stack.pop()
            around.append(stack[-1][1] if stack else None)
            if loop:
                stack.append((depth, no))
                nested.append(depth)
                depths.append(len(nested))
            else:
                while nested and depth <= nested[-1]:
                    nested.pop()
                depths.append(None)
        return frame.assign(loop_line=pd.array(around, "Int64"), depth_ref=pd.array(depths, "Int64"))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", loop_line long, depth_ref long"
    return rows.groupBy("file_id").applyInPandas(fold, schema).select(*columns, "is_loop", "loop_line", "depth_ref")


def calls_in_loops(context: DataFrame, pattern: str) -> DataFrame:
    """Lines inside a loop, not loops themselves, that match a pattern."""
    found = context.filter("loop_line IS NOT NULL AND NOT is_loop").filter(F.col("line").rlike(pattern))
    return found.select("file_id", "line_no", "loop_line")


def concatenations(context: DataFrame, more_than: int = 2) -> DataFrame:
    """From the third string concatenation on inside one innermost loop."""
    found = context.filter("loop_line IS NOT NULL AND NOT is_loop").filter(F.col("line").rlike(CONCAT))
    order = Window.partitionBy("file_id", "loop_line").orderBy("line_no")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") > more_than).select("file_id", "line_no", "loop_line", "nth")


def nested_loops(context: DataFrame) -> DataFrame:
    found = context.filter("is_loop AND depth_ref > 1")
    return found.select("file_id", "line_no", "depth_ref", F.when(F.col("depth_ref") >= 3, "high").otherwise("medium").alias("severity"))


def signatures(lines: DataFrame, size: int = 8, within: int = 20, shortest: int = 10) -> DataFrame:
    """(file_id, start_line, end_line, signature): for every start, the next `size` telling lines if `within` lines hold them,
    with strings, numbers and names blanked."""
    blank = F.regexp_replace(F.regexp_replace(F.regexp_replace("stripped", "[\"'][^\"']*[\"']", '""'), r"\b\d+\b", "0"), r"\b[a-zA-Z_]\w*\b", "VAR")
    telling = (F.length("stripped") > 20) & ~F.col("stripped").rlike(UNLIKELY)
    rows = lines.withColumn("n", F.count("*").over(_file())).withColumn("telling", telling).withColumn("shape", blank)
    ahead = _order().rowsBetween(0, Window.unboundedFollowing)
    starts = rows.withColumn("first", F.min(F.when(F.col("telling"), F.col("line_no"))).over(ahead)).filter(F.col("line_no") <= F.col("n") - shortest)
    next_ones = _order().rowsBetween(0, size - 1)
    kept = rows.filter("telling").select(
        "file_id", F.col("line_no").alias("first"), F.max("line_no").over(next_ones).alias("end_line"),
        F.count("*").over(next_ones).alias("have"), F.array_join(F.collect_list("shape").over(next_ones), "|").alias("signature"),
    )
    met = starts.select("file_id", F.col("line_no").alias("start_line"), "first").join(kept, ["file_id", "first"])
    return met.filter((F.col("have") == size) & (F.col("end_line") <= F.col("start_line") + within - 1)).select("file_id", "start_line", "end_line", "signature")


def cognitive_complexity(lines: DataFrame) -> DataFrame:
    """(file_id, cognitive): block lines deepen what follows, each keyword costs 1 and the depth, each logical operator 1."""
    opens = F.lit(False)
    for w in NESTING_WORDS:
        opens = opens | F.col("stripped").contains(w)
    words = sum((F.col("stripped").rlike(rf"\b{w}\b").cast("int") for w in COUNTED_WORDS), F.lit(0))
    logical = sum(((F.length("stripped") - F.length(F.replace("stripped", F.lit(o), F.lit("")))) / len(o) for o in LOGICAL), F.lit(0))
    rows = lines.withColumn("depth", F.sum((opens & F.col("stripped").endswith(":")).cast("int")).over(_so_far()))
    cost = words * (F.col("depth") + 1) + logical
    return rows.groupBy("file_id").agg(F.greatest(F.lit(1), F.sum(cost)).cast("long").alias("cognitive"))


def nesting_depth(lines: DataFrame) -> DataFrame:
    """(file_id, max_depth): up at block lines, down (not below 0) at leaving lines; the floor is a reflected running sum."""
    opens = F.lit(False)
    for w in [*NESTING_WORDS, "with"]:
        opens = opens | F.col("stripped").contains(w)
    up = (opens & F.col("stripped").endswith(":")).cast("int")
    down = (F.col("stripped").isin("pass", "break", "continue", "return") | F.col("stripped").rlike("^(except|finally)")).cast("int")
    rows = lines.withColumn("up", up).withColumn("down", down)
    # Two steps a line: up, then down. The depth after the first is what may be the greatest.
    steps = rows.select("file_id", "line_no", F.posexplode(F.array(F.col("up"), -F.col("down"))).alias("k", "step"))
    order = Window.partitionBy("file_id").orderBy("line_no", "k").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("s", F.sum("step").over(order)).withColumn("low", F.least(F.lit(0), F.min(F.col("s")).over(order)))
    return steps.groupBy("file_id").agg(F.max(F.col("s") - F.col("low")).cast("long").alias("max_depth"))


def deep_nesting(lines: DataFrame, more_than: int = 6) -> DataFrame:
    level = F.floor(F.col("indent") / 4)
    return lines.filter((F.col("stripped") != "") & (level > more_than)).select("file_id", "line_no", level.alias("level"))


def complex_conditions(lines: DataFrame, more_than: int = 3) -> DataFrame:
    n = sum((F.regexp_count("line", F.lit(p)) for p in (" and ", " or ", "&&", r"\|\|")), F.lit(0))
    found = lines.filter(F.col("line").rlike("if |elif |while ")).withColumn("n_operators", n)
    return found.filter(F.col("n_operators") > more_than).select("file_id", "line_no", F.col("n_operators").cast("long").alias("n_operators"))


def many_arguments(lines: DataFrame, more_than: int = 6) -> DataFrame:
    n = F.regexp_count(F.regexp_extract("line", r"\(([^)]*)\)", 1), F.lit(",")).cast("long")
    return lines.withColumn("n_commas", n).filter(F.col("n_commas") > more_than).select("file_id", "line_no", "n_commas")


# Lines that may build SQL from input, by language; the first that fits counts.
SQL_RISKS = {
    "python": [r"""execute\s*\(\s*["'].*%.*["']""", r"execute\s*\(\s*.*\+.*\)", r"""cursor\.execute\s*\(\s*f["']""", r"""query\s*=\s*["'].*%.*["']""", r"sql\s*=\s*.*\+.*"],
    "javascript": [r"""query\s*=\s*["`'].*\$\{.*\}.*["`']""", r"""execute\s*\(\s*["`'].*\+.*["`']""", r"sql\s*=\s*.*\+.*", r"""query\(\s*["`'].*\$\{.*\}.*["`']"""],
}


def sql_risks(lines: DataFrame) -> DataFrame:
    """(file_id, line_no, context) of lines(file_id, line_no, stripped, line, language) that one of the language's patterns fits."""
    of = {name: F.col("line").rlike("(?i)" + "|".join(f"(?:{p})" for p in own)) for name, own in SQL_RISKS.items()}
    fits = F.when(F.col("language") == "python", of["python"]).otherwise(of["javascript"])
    return lines.filter(fits).select("file_id", "line_no", F.col("stripped").alias("context"))


def snippets(lines: DataFrame, at: DataFrame, around: int = 3) -> DataFrame:
    """(file_id, at_line, snippet): lines around each wanted one(file_id, at_line), that one marked."""
    wanted = at.select("file_id", "at_line", F.explode(F.sequence(F.col("at_line") - around, F.col("at_line") + around)).alias("line_no"))
    mark = F.when(F.col("line_no") == F.col("at_line"), ">>> ").otherwise("    ")
    rows = wanted.join(lines.select("file_id", "line_no", "line"), ["file_id", "line_no"]).withColumn("text", F.concat(mark, "line"))
    return rows.groupBy("file_id", "at_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("snippet"))


