"""Quality of explanations and suggestions of issues: scores, levels, strengths, weaknesses, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import contains_any
from lodeworks.functions.weights import banded

# What is looked for, in lower case, anywhere in a text.
TECHNICAL = ["vulnerability", "security risk", "performance impact", "memory leak", "algorithm complexity", "best practice", "code smell", "anti-pattern"]
CLARITY = ["because", "due to", "results in", "leads to", "causes", "means that", "for example", "specifically", "in other words"]
CONTEXT = ["in this code", "this function", "this method", "this variable", "line", "file", "module", "class"]
IMPACT = ["can lead to", "may cause", "could result in", "impact", "affect", "consequence", "risk", "problem"]
ACTIONABLE = ["use", "replace", "change", "modify", "add", "remove", "implement", "consider", "try", "instead", "alternatively"]
SPECIFIC = ["function", "method", "variable", "parameter", "library", "framework", "pattern", "approach", "technique"]
EXAMPLES = ["example", "for instance", "such as", "like", "e.g.", "i.e."]
CATEGORY_TERMS = {
    "security": ["vulnerability", "attack", "exploit", "malicious", "unauthorized"],
    "performance": ["slow", "inefficient", "memory", "cpu", "optimization", "bottleneck"],
}
CODE_LIKE = r"`[^`]+`|```[^`]+```|\b\w+\(\)"
# A pointing word that no other word follows, and words that name nothing.
VAGUE = r"(?i)\b(this|that|it)\b\s*($|[^\s\w])|\b(something|stuff|things)\b"
NO_CONTEXT = ["line", "function", "method", "variable", "class", "file"]
NO_IMPACT = ["can", "may", "could", "will", "might", "lead", "cause", "result"]
QUALITY_BANDS = [(0.8, "excellent"), (0.6, "good"), (0.4, "fair")]
MISSING_OF_CATEGORY = {"security": (["risk", "vulnerability"], "Security risk explanation"), "performance": (["performance", "efficiency"], "Performance impact")}


def _count(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def _capped(text: Column, words: list[str], each: float, most: float) -> Column:
    return F.least(_count(text, words) * each, F.lit(most))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def scores(explanation: Column, suggestion: Column, category: Column) -> dict[str, Column]:
    """Readability, completeness and actionability, each 0 to 1, and the total; null texts count as empty."""
    text, advice = (F.coalesce(c, F.lit("")) for c in (explanation, suggestion))
    low, low_advice, category = F.lower(text), F.lower(advice), F.lower(category)
    n = n_words(text)
    one = F.lit(1.0)
    length = F.when((n >= 15) & (n <= 100), 0.3).when((n >= 10) & (n <= 150), 0.2).when(n >= 5, 0.1).otherwise(0.0)
    readable = length + F.when(text.contains("."), 0.2).otherwise(0.0) + _capped(low, CLARITY, 0.1, 0.3) + _capped(low, TECHNICAL, 0.05, 0.2)
    terms = F.lit(False)
    for name, words in CATEGORY_TERMS.items():
        terms = terms | ((category == name) & contains_any(low, words))
    complete = _capped(low, CONTEXT, 0.1, 0.3) + _capped(low, IMPACT, 0.1, 0.3) + _capped(low, TECHNICAL, 0.05, 0.2) + F.when(terms, 0.2).otherwise(0.0)
    action = _capped(low_advice, ACTIONABLE, 0.1, 0.4) + _capped(low_advice, SPECIFIC, 0.1, 0.3) + _capped(low_advice, EXAMPLES, 0.1, 0.2) + F.when(advice.rlike(CODE_LIKE), 0.1).otherwise(0.0)
    given = lambda test, score: F.when(test != "", F.least(score, one)).otherwise(0.0)
    out = {"readability": given(text, readable), "completeness": given(text, complete), "actionability": given(advice, action)}
    return out | {"total": out["readability"] * 0.3 + out["completeness"] * 0.4 + out["actionability"] * 0.3}


def quality(total: Column) -> Column:
    return banded(total, QUALITY_BANDS, "poor")


def _named(tests: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests)))


def strengths(explanation: Column, suggestion: Column) -> Column:
    low, advice = (F.lower(F.coalesce(c, F.lit(""))) for c in (explanation, suggestion))
    return _named([
        (n_words(low) >= 20, "Detailed explanation"), (contains_any(low, CLARITY), "Clear reasoning"), (contains_any(low, CONTEXT), "Good context"), (contains_any(low, IMPACT), "Impact explained"),
        (contains_any(low, TECHNICAL), "Technical accuracy"), (contains_any(advice, ACTIONABLE), "Actionable suggestions"), (contains_any(advice, SPECIFIC), "Specific recommendations"),
        (contains_any(advice, EXAMPLES), "Examples provided"), (F.coalesce(suggestion, F.lit("")).rlike(CODE_LIKE), "Code examples"),
    ])


def weaknesses(explanation: Column, suggestion: Column) -> Column:
    text, advice = (F.coalesce(c, F.lit("")) for c in (explanation, suggestion))
    low, given = F.lower(text), text != ""
    return _named([
        (given & text.rlike(VAGUE), "Vague language"), (given & (n_words(text) < 10), "Too brief"), (given & ~contains_any(low, NO_CONTEXT), "Lacks context"),
        (given & ~contains_any(low, NO_IMPACT), "No impact explanation"), (~given, "No explanation provided"), (advice == "", "No suggestions provided"),
        ((advice != "") & (n_words(advice) < 5), "Suggestion too brief"),
    ])


def missing_elements(explanation: Column, suggestion: Column, category: Column) -> Column:
    text, advice = (F.coalesce(c, F.lit("")) for c in (explanation, suggestion))
    low, category = F.lower(text), F.lower(category)
    tests = [
        (~contains_any(low, CONTEXT), "Code context"), (~contains_any(low, IMPACT), "Impact description"), (~contains_any(low, TECHNICAL), "Technical details"),
        (advice == "", "Actionable suggestions"), ((advice != "") & ~contains_any(F.lower(advice), ACTIONABLE), "Specific actions"),
    ]
    tests += [((category == name) & ~contains_any(low, words), label) for name, (words, label) in MISSING_OF_CATEGORY.items()]
    nothing = F.array(*(F.lit(x) for x in ("Explanation", "Context", "Impact description", "Technical details")))
    return F.when(text == "", nothing).otherwise(_named(tests))


def report(assessed: DataFrame) -> DataFrame:
    """One row of assessed(readability, completeness, actionability, total): means, and how many are of each quality."""
    means = [F.avg(c).alias(f"{c}_mean") for c in ("readability", "completeness", "actionability", "total")]
    names = [*(n for _, n in QUALITY_BANDS), "poor"]
    return assessed.agg(F.count("*").alias("n"), *means, *(F.count_if(quality(F.col("total")) == n).alias(f"n_{n}") for n in names))
