"""What a conversation looks at: focus made of questions, a bounded stack to go back on, and summaries.

The stack is never folded. Its depth is a scan of clamping functions; from that follows which steps back do something, so a running
sum gives every step's height without the bound; what is in focus at a height is what was put there last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.scans import prefix_composed, rounds_for

KEPT = 10  # focus locations behind the current one
# Words that ask about a file.
FILE_WORDS = ["file", "in this", "this file"]


def focus_of(question: Column, path: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
    """The focus (shown as text) that a question and its best chunk set; null without a chunk."""
    low = F.lower(question)
    about_file = F.lit(False)
    for w in FILE_WORDS:
        about_file = about_file | low.contains(w)
    function = F.when(F.length(name) > 0, F.concat(path, F.lit("::"), name, F.lit("()"))).otherwise(path)
    of_class = F.when(F.length(name) > 0, F.concat(path, F.lit("::"), name)).otherwise(path)
    lines = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    made = F.when(low.contains("function") & (kind == "function"), function).when(low.contains("class") & (kind == "class"), of_class)
    return made.when(about_file, path).otherwise(lines)


def _clamped(a: Column, b: Column) -> Column:
    """First a, then b, each x to min(max(x + add, low), high)."""
    inside = lambda x: F.least(F.greatest(x + b["add"], b["low"]), b["high"])
    return F.struct((a["add"] + b["add"]).alias("add"), inside(a["low"]).alias("low"), inside(a["high"]).alias("high"))


def focus_states(steps: DataFrame, key: str = "conv_id", order: str = "turn", kept: int = KEPT) -> DataFrame:
    """Adds moved, depth, height and current to steps(key, order, focus, back).

    A step with a focus sets it, one with `back` returns to the focus before; others do nothing and are left out. moved: whether the
    step changed the stack; depth: locations that one can go back to.
    """
    by = Window.partitionBy(key).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    push = F.col("focus").isNotNull()
    rows = steps.filter(push | F.coalesce("back", F.lit(False))).withColumn("_pushes", F.sum(push.cast("int")).over(so_far))
    begun = rows.filter("_pushes > 0")  # steps back before the first focus do nothing
    step = F.struct(F.when(push, 1).otherwise(-1).alias("add"), F.lit(1).alias("low"), F.lit(kept + 1).alias("high"))
    begun = prefix_composed(begun.withColumn("_f", step), [key], [order], "_f", _clamped, rounds_for(begun, [key]))
    size = F.least(F.greatest(F.col("_f.add"), F.col("_f.low")), F.col("_f.high"))
    begun = begun.withColumn("_size", size).withColumn("_was", F.lag("_size").over(by))
    begun = begun.withColumn("moved", push | (F.col("_was") > 1))
    height = F.sum(F.when(push, 1).when(F.col("moved"), -1).otherwise(0)).over(so_far)
    begun = begun.withColumn("height", height).withColumn("depth", F.col("_size") - 1)
    at_height = Window.partitionBy(key, "height").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begun = begun.withColumn("current", F.last("focus", ignorenulls=True).over(at_height))
    idle = rows.filter("_pushes = 0").withColumns({"moved": F.lit(False), "height": F.lit(0).cast("long"), "depth": F.lit(0), "current": F.lit(None).cast("string")})
    return begun.unionByName(idle, allowMissingColumns=True).drop("_pushes", "_f", "_size", "_was")


def focus_history(states: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, current, history): where each conversation is now, and what it can go back to, the latest last."""
    last = states.groupBy(key).agg(F.max_by(F.struct("height", "depth"), order).alias("now"))
    top = states.filter("focus IS NOT NULL").groupBy(key, "height").agg(F.max_by("focus", order).alias("focus"))
    held = top.join(last, key).filter("height <= now.height AND height >= now.height - now.depth")
    rows = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("height", "focus"))).alias("own"))  # kept + 1 at most
    focus = F.transform("own", lambda x: x["focus"])
    return rows.select(key, F.element_at(focus, -1).alias("current"), F.slice(focus, F.lit(1), F.size(focus) - 1).alias("history"))


def context_text(current: Column, history: Column) -> Column:
    """The current focus and the three before it, as lines."""
    recent = F.transform(F.slice(history, F.greatest(F.size(history) - 2, F.lit(1)), 3), lambda x: F.concat(F.lit("  - "), x))
    lines = F.concat(F.array(F.concat(F.lit("Current focus: "), current)), F.when(F.size(history) > 0, F.concat(F.array(F.lit("Recent focus history:")), recent)).otherwise(F.array().cast("array<string>")))
    return F.when(current.isNull(), "No current focus").otherwise(F.array_join(lines, "\n"))


def codebase_text(path: Column, files: Column, issues: Column, languages: Column) -> Column:
    """A codebase in a few lines."""
    found = F.when(issues > 0, F.concat(issues.cast("string"), F.lit(" issues found"))).otherwise("No issues found")
    return F.array_join(F.array(
        F.concat(F.lit("Codebase: "), path), F.concat(F.lit("Files Analyzed: "), files.cast("string")), F.concat(F.lit("Code Quality Analysis: "), found),
        F.concat(F.lit("Languages: "), F.array_join(languages, ", ")), F.lit("Note: Focus on the specific issues and code details when answering questions."),
    ), "\n")


def conversation_summaries(questions: DataFrame, focus: DataFrame, words: DataFrame, path: str, duration: Column, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, summary) of questions(key, order, question, kind, confidence, refs), focus(key, current, history) and words(key, word).

    The last three questions, five locations and five words are named; duration: a column of questions, the latest one counts.
    """
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    rows = questions.withColumn("_age", F.row_number().over(latest)).withColumn("_spent", duration)
    score = F.format_number("confidence", 2)
    refs = F.when(F.size("refs") > 0, F.concat(F.lit("  References: "), F.array_join(F.slice("refs", 1, 2), ", ")))
    said = F.array_compact(F.array(F.concat(F.lit("  Q ("), "kind", F.lit("): "), "question"), F.concat(F.lit("  Confidence: "), score), refs, F.lit("")))
    asked = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.max_by("_spent", order).alias("spent"), F.sort_array(F.collect_list(F.when(F.col("_age") <= 3, F.struct((-F.col("_age")).alias("a"), said.alias("said"))))).alias("last"),
    )
    named = words.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("word")), 1, 5).alias("words"))
    all_of = asked.join(focus, key, "left").join(named, key, "left")
    none = F.array().cast("array<string>")
    recent = F.slice("history", F.greatest(F.size("history") - 4, F.lit(1)), 5)
    places = F.transform(recent, lambda x, k: F.concat(F.lit("  "), (k + 1).cast("string"), F.lit(". "), x))
    lines = F.concat(
        F.array(F.lit("Conversation Context Summary"), F.lit("=" * 30), F.lit(f"Codebase: {path}"), F.concat(F.lit("Session Duration: "), "spent"), F.concat(F.lit("Questions Asked: "), F.col("n").cast("string")), F.lit("")),
        F.when(F.col("current").isNotNull(), F.array(F.lit("Current Focus:"), F.concat(F.lit("  "), "current"), F.lit(""))).otherwise(none),
        F.when(F.size("history") > 0, F.concat(F.array(F.lit("Recent Focus History:")), places, F.array(F.lit("")))).otherwise(none),
        F.array(F.lit("Recent Questions:")), F.flatten(F.transform("last", lambda x: x["said"])),
        F.when(F.size("words") > 0, F.array(F.concat(F.lit("Active Keywords: "), F.array_join("words", ", ")), F.lit(""))).otherwise(none),
    )
    return all_of.select(key, F.array_join(lines, "\n").alias("summary"))
