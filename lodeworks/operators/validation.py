"""Accuracy against expected results, and differences between snapshots."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds fp, fn, precision, recall and f1 to tp, n_expected and n_actual."""
    p, r = _share(F.col("tp"), F.col("n_actual")), _share(F.col("tp"), F.col("n_expected"))
    rows = counts.withColumn("fp", F.col("n_actual") - F.col("tp")).withColumn("fn", F.col("n_expected") - F.col("tp"))
    return rows.withColumn("precision", p).withColumn("recall", r).withColumn("f1", _share(2 * p * r, p + r))


def scores(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 from rows with booleans expected and actual, over all rows or by keys."""
    own = (F.count_if(F.col("expected") & F.col("actual")).alias("tp"), F.count_if("expected").alias("n_expected"), F.count_if("actual").alias("n_actual"))
    return with_scores(matched.groupBy(*by).agg(*own) if by else matched.agg(*own))


def greedy_matches(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(scope, expected_id, actual_id, score): inside each scope expected ones in order take their best actual one left.

    pairs(scope, expected_id, actual_id, score). Order matters, so each scope is one group: a file or a scenario.
    """

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame[frame["score"] >= least].sort_values(["expected_id", "score", "actual_id"], ascending=[True, False, True])
        used: set = set()
        rows = []
        for _, group in frame.groupby("expected_id", sort=True):
            free = group[~group["actual_id"].isin(used)]
            if len(free):
                rows.append(free.iloc[0])
                used.add(free.iloc[0]["actual_id"])
        return pd.DataFrame(rows, columns=frame.columns)

    return pairs.filter(F.col("score") >= least).groupBy("scope").applyInPandas(match, pairs.schema)


def greedy_matches_between(expected: DataFrame, actual: DataFrame, score: Callable[[pd.Series, pd.DataFrame], np.ndarray], least: float = 0.7) -> DataFrame:
    """greedy_matches of expected(scope, expected_id, ...) and actual(scope, actual_id, ...), with further columns alike, without a row for each pair.

    score: of one expected row with a frame of actual ones, NaN if there is none. A scope's rows are scored one expected
    row at a time, so what is held grows with the rows of a scope, not with its pairs.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((expected, "scope"), (expected, "expected_id"), (actual, "actual_id")))

    def match(e: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        e, a = e.sort_values("expected_id"), a.sort_values("actual_id").reset_index(drop=True)
        free, rows = np.ones(len(a), bool), []
        for _, own in e.iterrows() if len(a) else ():
            values = np.where(free, score(own, a), np.nan)
            values = np.where(values >= least, values, -np.inf)
            best = int(values.argmax())  # the first of equal ones: the smallest id
            if np.isfinite(values[best]):
                rows.append((own["scope"], own["expected_id"], a["actual_id"].iloc[best], float(values[best])))
                free[best] = False
        return pd.DataFrame(rows, columns=["scope", "expected_id", "actual_id", "score"])

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        e, a = (rows[rows["side"] == k].rename(columns={"id": name}) for k, name in enumerate(("expected_id", "actual_id")))
        return match(e, a)

    sides = [df.filter("scope IS NOT NULL").withColumnRenamed(name, "id").withColumn("side", F.lit(k)) for k, (df, name) in enumerate(((expected, "expected_id"), (actual, "actual_id")))]
    return sides[0].unionByName(sides[1]).groupBy("scope").applyInPandas(both, f"{kinds}, score double")


def match_score(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How well an actual issue fits an expected one: category, severity, type, line and words of the description."""
    same = lambda k, w: F.when(a[k] == b[k], w).otherwise(0.0)
    both = (a["line"] > 0) & (b["line"] > 0)
    gap = F.abs(a["line"] - b["line"])
    line = F.when(both & (gap == 0), 0.1).when(both & (gap <= 5), 0.05).otherwise(0.0)
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    x, y = words(a["description"]), words(b["description"])
    jaccard = _share(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))
    total = F.lit(0.9) + F.when(both, 0.1).otherwise(0.0)
    return (same("category", 0.4) + same("severity", 0.2) + same("type", 0.2) + line + 0.1 * jaccard) / total


def snapshot_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """(signature, change) of issues(signature, severity, description); of rows with one signature the last id counts."""
    last = lambda df, p: df.groupBy("signature").agg(F.max_by(F.struct("severity", "description"), "id").alias(p))
    rows = last(base, "b").join(last(current, "c"), "signature", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(F.col("b") != F.col("c"), "changed").otherwise("same")
    severity = F.coalesce("c.severity", "b.severity")
    return rows.select("signature", severity.alias("severity"), change.alias("change"))


def changed_fields(base: DataFrame, current: DataFrame, fields: tuple[str, ...] = ("severity", "description")) -> DataFrame:
    """(signature, field, before, after) of issues in both snapshots whose fields differ; of rows with one signature the last id counts."""
    last = lambda df, p: df.groupBy("signature").agg(F.max_by(F.struct(*fields), "id").alias(p))
    both = last(base, "b").join(last(current, "c"), "signature")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").cast("string").alias("before"), F.col(f"c.{f}").cast("string").alias("after")) for f in fields))
    return both.select("signature", F.explode(pairs).alias("x")).select("signature", "x.*").filter(~F.col("before").eqNullSafe(F.col("after")))


def issue_signature(category: Column, kind: Column, path: Column, line: Column) -> Column:
    """What tells an issue from others in all snapshots."""
    text = lambda c, rest: F.coalesce(c.cast("string"), F.lit(rest))
    return F.concat_ws("|", text(category, ""), text(kind, ""), text(path, ""), text(line, "0"))


def regression_flags(diff: DataFrame, base: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether a diff is a regression and whether it is an improvement; base, current: one row (n, score) each."""
    of = lambda change, severity: F.count_if((F.col("change") == change) & (F.col("severity") == severity))
    rows = diff.agg(
        of("added", "critical").alias("critical_added"), of("added", "high").alias("high_added"), of("removed", "critical").alias("critical_removed"),
        of("removed", "high").alias("high_removed"), F.count_if(F.col("change") == "added").alias("n_added"), F.count_if(F.col("change") == "removed").alias("n_removed"),
    )
    sides = base.select(F.col("n").alias("base_n"), F.col("score").alias("base_score")).crossJoin(current.select(F.col("n").alias("current_n"), F.col("score").alias("current_score")))
    rows, base_n = rows.crossJoin(sides), F.col("base_n")  # one row each
    score, count = F.col("current_score") - F.col("base_score"), F.col("current_n") - base_n
    worse = (score < -5) | (F.col("critical_added") > 0) | (F.col("high_added") > 2) | (count > F.greatest(F.lit(5.0), 0.2 * base_n))
    better = (score > 5) | (F.col("critical_removed") > 0) | (F.col("high_removed") > 1) | (-count > F.greatest(F.lit(3.0), 0.15 * base_n))
    return rows.withColumn("is_regression", worse).withColumn("is_improvement", better)
