"""Severity, context and business scores of issues(..., category, description, file_path, ...) as column arithmetic."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.functions.text import contains_any, suffix
from lodeworks.functions.weights import BASE_SCORE, FEATURE_WEIGHT, KEYWORDS, SEVERITY_BANDS, banded, lookup

# Factors of project, file, code and business context.
PROJECT_TYPE = {
    "fintech_app": 1.3, "healthcare_app": 1.3, "security_tool": 1.4, "web_app": 1.1, "microservice": 1.2, "library": 1.0, "cli_tool": 0.9, "prototype": 0.7, "internal_tool": 0.8,
}
DOMAIN = {"fintech": 1.3, "healthcare": 1.3, "government": 1.2, "ecommerce": 1.1, "education": 1.0, "gaming": 0.9, "internal": 0.8}
MATURITY = {"prototype": 0.8, "development": 1.0, "production": 1.3}
FILE_ROLE = {
    "authentication": 1.4, "authorization": 1.4, "payment": 1.5, "data_access": 1.3, "api_controller": 1.2, "security_config": 1.3, "main_entry": 1.2, "utility": 0.9, "test": 0.6,
    "documentation": 0.3,
}
FREQUENCY = {"critical_path": 1.3, "frequent": 1.2, "occasional": 1.0, "rare": 0.9}
INDUSTRY = {"fintech": 2.0, "healthcare": 1.8, "ecommerce": 1.5, "saas": 1.4, "gaming": 1.2, "media": 1.1, "internal": 0.8, "education": 0.9}
COMPANY_SIZE = {"startup": 0.8, "small": 1.0, "medium": 1.2, "enterprise": 1.5}
REVENUE_MODEL = {"transaction": 1.2, "subscription": 1.1}
IMPACT_WEIGHT = {
    "revenue_loss": 1.0, "security_breach": 0.9, "compliance_violation": 0.8, "customer_experience": 0.7, "operational_disruption": 0.6, "reputation_damage": 0.5,
    "development_velocity": 0.4, "maintenance_cost": 0.3,
}
IMPACT_TRIGGERS = {
    "security": (["vulnerability", "injection", "xss", "csrf", "auth"], ["security_breach", "compliance_violation", "reputation_damage"]),
    "performance": (["slow", "timeout", "memory", "cpu", "latency"], ["customer_experience", "revenue_loss"]),
    "reliability": (["crash", "error", "exception", "failure"], ["operational_disruption", "customer_experience"]),
    "maintainability": (["complex", "duplicate", "debt", "refactor"], ["development_velocity", "maintenance_cost"]),
}
IMPACT_OF_LEVEL = {"critical": 0.9, "high": 0.7, "medium": 0.5, "low": 0.3, "info": 0.1}
PRIORITY_OF_LEVEL = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4, "info": 0.2}
PATH_FACTORS = [
    (1.2, ["auth", "payment", "security", "api", "controller", "main", "index", "app", "server", "config"]),
    (1.15, ["public", "api", "web", "frontend"]),
    (1.1, ["db", "database", "model", "schema"]),
]
WORD_FACTORS = [(1.3, "recurring"), (1.2, "widespread")]
MAIN_MODULES = ["main.py", "app.py", "index.js", "server.js", "__init__.py"]
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf"]
CONFIG_NAMES = ["config", "settings", "setup", "requirements"]
FALLBACK = [
    ("security", ["vulnerability", "injection", "xss"], "high", 0.8), ("performance", ["slow", "timeout", "memory"], "medium", 0.6),
    ("reliability", ["crash", "error", "exception"], "medium", 0.6), ("maintainability", ["complex", "duplicate"], "low", 0.4),
]
CONFIDENCE_FLAGS = [
    "involves_user_input", "involves_network", "involves_database", "involves_file_system", "in_loop", "recursive_call", "memory_allocation", "complex_logic",
    "is_main_module", "is_test_file",
]
ADVICE_BY_LEVEL = {
    "critical": ["🚨 CRITICAL: Address immediately - halt deployment if necessary", "Assign senior developer and conduct code review", "Implement monitoring and alerting for this issue type"],
    "high": ["⚠️ HIGH: Prioritize in current sprint", "Conduct thorough testing after fix", "Consider adding automated tests to prevent regression"],
    "medium": ["📋 MEDIUM: Include in next sprint planning", "Document the issue and potential impact"],
    "low": ["📝 LOW: Add to technical debt backlog", "Consider addressing during refactoring"],
}
ADVICE_BY_CATEGORY = {
    "security": ["🔐 Security issue - conduct security review", "Update security documentation and training"],
    "performance": ["⚡ Performance issue - benchmark before and after fix", "Consider load testing in staging environment"],
    "maintainability": ["🔧 Maintainability issue - improve code documentation", "Consider refactoring surrounding code"],
}
ADVICE_HIGH_IMPACT = ["💰 High business impact - consider emergency fix", "Notify stakeholders and prepare communication plan"]
ADVICE_SOME_IMPACT = ["📊 Significant business impact - track resolution metrics"]
ADVICE_BY_PROJECT = {
    "security_sensitive": "🔒 Security-sensitive project - involve security team",
    "public_facing": "🌐 Public-facing application - consider user impact",
    "has_compliance": "📋 Compliance requirements - document remediation",
}


def keyword_features(rows: DataFrame) -> DataFrame:
    """Adds a boolean per keyword feature of the description. For texts that many issues share: once per text, then a join."""
    low = F.lower("description")
    return rows.withColumns({name: contains_any(low, words) for name, words in KEYWORDS.items()})


def text_flags(texts: DataFrame, words: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a boolean for each name): whether the lower-case text holds one of a name's words. For long texts: Arrow's own
    search is some ten times as fast as a column expression's. Null texts have null flags."""
    every = sorted({w for own in words.values() for w in own})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = pc.utf8_lower(batch.column(1))
            found = {w: pc.match_substring(low, w) for w in every}
            flags = [reduce(pc.or_, (found[w] for w in own)) for own in words.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *flags], [id_col, *words])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, " + ", ".join(f"{n} boolean" for n in words))


def path_features(issues: DataFrame) -> DataFrame:
    """Adds test, main and configuration flags and the extension, from the path."""
    low = F.lower("file_path")
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    return issues.withColumns({
        "is_test_file": contains_any(low, ["test", "spec"]), "is_main_module": name.isin(MAIN_MODULES),
        "is_config_file": suffix(F.col("file_path")).isin(CONFIG_SUFFIXES) | contains_any(low, CONFIG_NAMES), "file_extension": suffix(F.col("file_path")),
    })


def text_features(issues: DataFrame) -> DataFrame:
    """Adds what else of the description and category counts: length, examples, duplication, documentation."""
    low, category = F.lower("description"), F.lower("category")
    return issues.withColumns({
        "description_length": F.length("description"), "has_code_example": F.col("description").contains("```") | low.contains("example"),
        "code_duplication": category.contains("duplication") | low.contains("duplicate"), "missing_documentation": category.contains("documentation") | low.contains("docstring"),
    })


def features(issues: DataFrame) -> DataFrame:
    return text_features(path_features(keyword_features(issues)))


@dataclass(frozen=True)
class Model:
    """Weights and factors that may be tuned; what isn't given is as built in."""

    weights: dict[str, float] = field(default_factory=lambda: dict(FEATURE_WEIGHT))
    bases: dict[str, float] = field(default_factory=lambda: dict(BASE_SCORE))
    bands: dict[str, float] = field(default_factory=lambda: {name: bound for bound, name in SEVERITY_BANDS})
    project_type: dict[str, float] = field(default_factory=lambda: dict(PROJECT_TYPE))
    domain: dict[str, float] = field(default_factory=lambda: dict(DOMAIN))
    file_role: dict[str, float] = field(default_factory=lambda: dict(FILE_ROLE))

    def updated(self, **changes: dict[str, float]) -> Model:
        """A model with some values of some tables changed, as updated(weights={"in_loop": 0.9})."""
        unknown = changes.keys() - self.__dataclass_fields__.keys()
        if unknown:
            raise ValueError(f"Unknown factor type: {', '.join(sorted(unknown))}")
        return replace(self, **{name: getattr(self, name) | own for name, own in changes.items()})

    def rows(self) -> list[tuple[str, str, float]]:
        return [(name, key, float(v)) for name in self.__dataclass_fields__ for key, v in getattr(self, name).items()]

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.rows(), "part string, key string, value double").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        """A saved model; parts that it doesn't name are as built in."""
        parts: dict[str, dict[str, float]] = {}
        for r in spark.read.schema("part string, key string, value double").json(path).collect():  # some dozens of values
            parts.setdefault(r["part"], {})[r["key"]] = r["value"]
        return cls(**parts)


def base_score(rows: DataFrame, model: Model | None = None) -> Column:
    """Category base and weights of the features that hold, between 0 and 1; columns that rows lack count as absent."""
    weights, bases = (model.weights, model.bases) if model else (FEATURE_WEIGHT, BASE_SCORE)
    total = F.lit(0.0)
    for name in ("involves_user_input", "involves_network", "involves_database", "involves_file_system", "in_loop", "recursive_call", "memory_allocation"):
        if name in rows.columns:
            total = total + F.when(F.col(name), weights[name]).otherwise(0.0)
    scaled = {"function_complexity": (10, 20.0), "file_size_lines": (500, 1000.0), "bug_history": (0, 10.0)}
    for name, (above, full) in scaled.items():
        if name in rows.columns:
            total = total + F.when(F.col(name) > above, weights[name] * F.least(F.col(name) / full, F.lit(1.0))).otherwise(0.0)
    for name in ("complex_logic", "is_main_module", "is_test_file"):
        if name in rows.columns:
            total = total + F.when(F.col(name), weights[name]).otherwise(0.0)
    return _unit(lookup(bases, F.lower("category"), 0.5) + total)


def _unit(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def level(score: Column, model: Model | None = None) -> Column:
    bands = sorted(((bound, name) for name, bound in model.bands.items()), reverse=True) if model else SEVERITY_BANDS
    return banded(score, bands, "info")


def confidence(rows: DataFrame) -> Column:
    """Mean of three: whether the category is known, the share of flags that hold, whether the function's complexity is known."""
    known = F.when(F.lower("category").isin(list(BASE_SCORE)), 0.8).otherwise(0.4)
    flags = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in CONFIDENCE_FLAGS if c in rows.columns), F.lit(0)) / len(CONFIDENCE_FLAGS)
    complexity = F.when(F.col("function_complexity").isNotNull(), 0.9).otherwise(0.6) if "function_complexity" in rows.columns else F.lit(0.6)
    return (known + flags + complexity) / 3


def _held(description: Column | None, words: list[str], flags: dict[str, Column] | None, name: str) -> Column:
    """Whether a description holds one of the words; a flag of that name says so where the words were looked for before."""
    return flags[name] if flags else contains_any(F.lower(description), words)


def fallback_severity(category: Column, description: Column | None, flags: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """Level and score by simple rules; their confidence is 0.6. flags: by the names of FALLBACK, in place of a description."""
    category = F.lower(category)
    name, score = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for part, words, own, value in FALLBACK:
        test = category.contains(part) | _held(description, words, flags, part)
        name, score = name.when(test, own), score.when(test, value)
    return name.otherwise("medium"), score.otherwise(0.5)


def in_context(score: Column, factors: list[Column]) -> Column:
    """The score times all factors that are known, between 0 and 1."""
    for f in factors:
        score = score * F.coalesce(f, F.lit(1.0))
    return _unit(score)


def _if(test: Column, factor: float) -> Column:
    return F.when(test, factor).otherwise(1.0)


def project_factors(kind: Column, domain: Column, security: Column, performance: Column, public: Column, n_compliance: Column, maturity: Column, model: Model | None = None) -> list[Column]:
    types, domains = (model.project_type, model.domain) if model else (PROJECT_TYPE, DOMAIN)
    return [
        lookup(types, kind, 1.0), lookup(domains, domain, 1.0), _if(security, 1.2), _if(performance, 1.15), _if(public, 1.1), 1.0 + n_compliance * 0.1,
        lookup(MATURITY, maturity, 1.0),
    ]


def file_factors(role: Column, entry: Column, public_api: Column, coverage: Column, changes: Column, bugs: Column, dependents: Column, model: Model | None = None) -> list[Column]:
    """changes: a month; bugs: per thousand lines."""
    return [
        lookup(model.file_role if model else FILE_ROLE, role, 1.0), _if(entry, 1.2), _if(public_api, 1.15), F.when(coverage < 0.5, 1.2).when(coverage > 0.9, 0.9).otherwise(1.0), _if(changes > 10, 1.1), _if(bugs > 5, 1.15),
        _if(dependents > 10, 1.1),
    ]


def code_factors(public: Column, constructor: Column, handler: Column, frequency: Column, user_facing: Column, sensitive: Column) -> list[Column]:
    return [_if(public, 1.1), _if(constructor, 1.15), _if(handler, 1.2), lookup(FREQUENCY, frequency, 1.0), _if(user_facing, 1.15), _if(sensitive, 1.2)]


def context_confidence(own: Column, contexts: int) -> Column:
    """A tenth more for each kind of context that is there."""
    return F.least(own + contexts * 0.1, F.lit(1.0))


def impact_categories(category: Column, description: Column | None, severity: Column, flags: dict[str, Column] | None = None) -> Column:
    """Business impacts of an issue; severe ones add revenue and customers where they aren't named yet.

    flags: by the names of IMPACT_TRIGGERS, in place of a description.
    """
    category, none = F.lower(category), F.array().cast("array<string>")
    own = none
    for part, (words, impacts) in IMPACT_TRIGGERS.items():
        here = F.array(*(F.lit(i) for i in impacts))
        own = F.concat(own, F.when(category.contains(part) | _held(description, words, flags, part), here).otherwise(none))
    severe = severity.isin("critical", "high")
    for impact in ("revenue_loss", "customer_experience"):
        own = F.when(severe & ~F.array_contains(own, impact), F.array_append(own, F.lit(impact))).otherwise(own)
    return F.when(F.size(own) == 0, F.array(F.lit("maintenance_cost"))).otherwise(own)


def _steps(value: Column, *steps: tuple[float, float]) -> Column:
    """The factor of the first bound that value is above; 1 without one."""
    out = F.when(F.lit(False), 1.0)
    for bound, factor in steps:
        out = out.when(value > bound, factor)
    return out.otherwise(1.0)


def metrics_factor(impacts: Column, revenue_loss: Column, users: Column, hours_to_resolve: Column, velocity: Column) -> Column:
    """What measured losses add to the impacts that an issue has."""
    own = [
        ("revenue_loss", _steps(revenue_loss, (100_000, 1.5), (10_000, 1.3), (1_000, 1.1))), ("customer_experience", _steps(users, (10_000, 1.4), (1_000, 1.2), (100, 1.1))),
        ("operational_disruption", _steps(hours_to_resolve, (24, 1.3), (4, 1.2), (1, 1.1))), ("development_velocity", _steps(F.abs(velocity), (0.5, 1.3), (0.2, 1.2), (0.1, 1.1))),
    ]
    return reduce(lambda a, b: a * b, (F.when(F.array_contains(impacts, name), f).otherwise(1.0) for name, f in own))


def business_factor(industry: Column, size: Column, model: Column, customers: Column, uptime: Column, brand: Column, n_compliance: Column) -> Column:
    sla = F.when(uptime >= 0.999, 1.3).when(uptime >= 0.99, 1.2).when(uptime >= 0.95, 1.1).otherwise(1.0)
    base = _steps(customers, (1_000_000, 1.3), (100_000, 1.2), (10_000, 1.1))
    return lookup(INDUSTRY, industry, 1.0) * lookup(COMPANY_SIZE, size, 1.0) * lookup(REVENUE_MODEL, model, 1.0) * base * sla * (1.0 + brand * 0.3) * (1.0 + n_compliance * 0.1)


def issue_factor(path: Column, description: Column | None, flags: dict[str, Column] | None = None) -> Column:
    """What an issue's path and description add; flags: by the words of WORD_FACTORS, in place of a description."""
    path = F.lower(path)
    tests = [(f, contains_any(path, words)) for f, words in PATH_FACTORS] + [(f, _held(description, [w], flags, w)) for f, w in WORD_FACTORS]
    return reduce(lambda a, b: a * b, (_if(test, f) for f, test in tests))


def business_impact(severity: Column, impacts: Column, factors: list[Column]) -> Column:
    """The level's impact times the mean weight of its impacts times further factors, between 0 and 1."""
    weights = F.transform(impacts, lambda i: lookup(IMPACT_WEIGHT, i, 0.5))
    mean = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w) / F.size(impacts)
    return in_context(lookup(IMPACT_OF_LEVEL, severity, 0.5) * mean, factors)


def financial_estimates(impact: Column, arpu: Column, customers: Column, revenue_loss: Column, cost_to_fix: Column, downtime_cost: Column, hours_to_resolve: Column) -> dict[str, Column]:
    """Money at stake; null where what it is made of is missing or 0."""
    given = lambda *cs: reduce(lambda a, b: a & b, (F.coalesce(c != 0, F.lit(False)) for c in cs))
    return {
        "revenue_at_risk": F.when(given(arpu), arpu * customers * impact * 0.01), "direct_revenue_loss": F.when(given(revenue_loss), revenue_loss * impact),
        "remediation_cost": F.when(given(cost_to_fix), cost_to_fix), "downtime_cost": F.when(given(downtime_cost, hours_to_resolve), downtime_cost * hours_to_resolve * impact),
    }


def priority(severity: Column, impact: Column, confidence: Column) -> Column:
    return (lookup(PRIORITY_OF_LEVEL, severity, 0.6) * 0.6 + impact * 0.4) * confidence


def recommendations(severity: Column, impact: Column, category: Column, project: dict[str, Column]) -> Column:
    """Array of advice: by level, business impact, project flags (names as in ADVICE_BY_PROJECT), category."""
    none = F.array().cast("array<string>")
    texts = lambda own: F.array(*(F.lit(x) for x in own))
    parts = [F.when(severity == name, texts(own)).otherwise(none) for name, own in ADVICE_BY_LEVEL.items()]
    parts.append(F.when(impact > 0.8, texts(ADVICE_HIGH_IMPACT)).when(impact > 0.6, texts(ADVICE_SOME_IMPACT)).otherwise(none))
    parts += [F.when(test, texts([ADVICE_BY_PROJECT[name]])).otherwise(none) for name, test in project.items()]
    by_category = F.when(F.lit(False), none)
    for part, own in ADVICE_BY_CATEGORY.items():
        by_category = by_category.when(F.lower(category).contains(part), texts(own))
    return F.concat(*parts, by_category.otherwise(none))


def feature_completeness(fields: list[Column], contexts: list[Column]) -> Column:
    """Mean of the share of issue fields that are filled and the share of contexts that are there."""
    share = lambda tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) / len(tests)
    return (share([f.isNotNull() & (f.cast("string") != "") for f in fields]) + share(contexts)) / 2


def statistics(scored: DataFrame) -> DataFrame:
    """One row of scored(level, impact, priority, confidence): counts, spreads, how many are urgent or unsure."""
    spreads = [f(c).alias(f"{c}_{n}") for c in ("impact", "priority", "confidence") for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    levels = [F.count_if(F.col("level") == name).alias(f"n_{name}") for name in PRIORITY_OF_LEVEL]
    return scored.agg(F.count("*").alias("n"), *levels, *spreads, F.count_if(F.col("priority") > 0.7).alias("n_high_priority"), F.count_if(F.col("confidence") < 0.5).alias("n_low_confidence"))
