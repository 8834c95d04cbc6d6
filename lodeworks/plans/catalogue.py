"""Rules over single lines as data, and their compilation into one projection (or its SQL)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import contains_any


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    confidence: float
    languages: tuple[str, ...]
    patterns: tuple[str, ...]  # the first that matches names the finding; one finding a line and rule
    ignore_case: bool = False
    also: str | None = None  # a pattern that the lower-case line must match, too
    unless: str | None = None  # a pattern that the stripped lower-case line must not match


PY, JS, ALL = ("python",), ("javascript", "typescript"), ("python", "javascript", "typescript")
NOT_A_SECRET = r"^#|^//|example|test|dummy|placeholder"
NOT_CODE = r"^$|^#"

# Rule patterns, severities and confidences.
RULES = (
    Rule("sql_injection_py", "security", "high", 0.8, PY, (
        r"""execute\s*\(\s*["'].*%.*["']""", r"execute\s*\(\s*.*\+.*\)", r"""cursor\.execute\s*\(\s*f["']""", r"""query\s*=\s*["'].*%.*["']""", r"sql\s*=\s*.*\+.*"), True),
    Rule("sql_injection_js", "security", "high", 0.8, JS, (
        r"""query\s*=\s*["`'].*\$\{.*\}.*["`']""", r"""execute\s*\(\s*["`'].*\+.*["`']""", r"sql\s*=\s*.*\+.*", r"""query\(\s*["`'].*\$\{.*\}.*["`']"""), True),
    Rule("command_injection_py", "security", "high", 0.85, PY, (
        r"os\.system\s*\(\s*.*\+", r"subprocess\.(call|run|Popen)\s*\(\s*.*\+", r"eval\s*\(\s*.*input", r"exec\s*\(\s*.*input"), True),
    Rule("command_injection_js", "security", "high", 0.85, JS, (
        r"exec\s*\(\s*.*\+", r"eval\s*\(\s*.*\+", r"Function\s*\(\s*.*\+", r"child_process\.exec\s*\(\s*.*\+"), True),
    Rule("path_traversal", "security", "medium", 0.75, PY, (
        r"""open\s*\(\s*.*\+.*["']\.\./""", r"""file\s*=\s*.*\+.*["']\.\./""", r"""path\s*=\s*.*\+.*["']\.\./"""), True),
    Rule("weak_crypto_py", "security", "medium", 0.9, PY, (
        r"hashlib\.md5\s*\(", r"hashlib\.sha1\s*\(", r"random\.random\s*\(", r"DES\s*\(", r"RC4\s*\("), True),
    Rule("weak_crypto_js", "security", "medium", 0.9, JS, (
        r"Math\.random\s*\(", r"""crypto\.createHash\s*\(\s*["']md5["']""", r"""crypto\.createHash\s*\(\s*["']sha1["']"""), True),
    Rule("secret_api_key", "security", "high", 0.85, ALL, (
        r"""api[_-]?key\s*[=:]\s*["']([a-zA-Z0-9_-]{20,})["']""",), True, None, NOT_A_SECRET),
    Rule("secret_password", "security", "high", 0.85, ALL, (
        r"""password\s*[=:]\s*["']([^"']{8,})["']""", r"""passwd\s*[=:]\s*["']([^"']{8,})["']""", r"""pwd\s*[=:]\s*["']([^"']{8,})["']"""), True, None, NOT_A_SECRET),
    Rule("secret_token", "security", "high", 0.85, ALL, (r"""token\s*[=:]\s*["']([a-zA-Z0-9_-]{20,})["']""",), True, None, NOT_A_SECRET),
    Rule("secret_secret", "security", "high", 0.85, ALL, (r"""secret\s*[=:]\s*["']([a-zA-Z0-9_-]{16,})["']""",), True, None, NOT_A_SECRET),
    Rule("secret_private_key", "security", "high", 0.85, ALL, (
        r"-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----", r"""private[_-]?key\s*[=:]\s*["']([a-zA-Z0-9+/=]{100,})["']"""), True, None, NOT_A_SECRET),
    Rule("xss", "security", "high", 0.8, JS, (
        r"innerHTML\s*=\s*.*\+", r"document\.write\s*\(\s*.*\+", r"\.html\s*\(\s*.*\+", r"dangerouslySetInnerHTML"), True),
    Rule("unsafe_deserialization", "security", "high", 0.8, PY, (r"pickle\.loads?\s*\(", r"cPickle\.loads?\s*\(", r"marshal\.loads?\s*\(")),
    Rule("dangerous_function_py", "security", "high", 0.85, PY, (r"\beval\s*\(", r"\bexec\s*\(", r"__import__\s*\(")),
    Rule("dangerous_function_js", "security", "high", 0.8, JS, (
        r"\beval\s*\(", r"Function\s*\(", r"""setTimeout\s*\(\s*["']""", r"""setInterval\s*\(\s*["']""")),
    Rule("insecure_random_py", "security", "medium", 0.9, PY, (r"random\.random\s*\(", r"random\.randint\s*\("), False, r"password|token|key|salt|nonce"),
    Rule("insecure_random_js", "security", "medium", 0.9, JS, (r"Math\.random\s*\(",), False, r"password|token|key|salt|nonce"),
    Rule("information_leak", "security", "low", 0.6, ALL, (
        r"print\s*\(\s*.*password", r"console\.log\s*\(\s*.*password", r"console\.log\s*\(\s*.*token", r"print\s*\(\s*.*secret",
        r"console\.error\s*\(\s*.*error\)", r"traceback\.print_exc\s*\("), True),
    Rule("inefficient_loop_py", "performance", "medium", 0.7, PY, (r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(", r"while\s+.*len\s*\("), False, None, NOT_CODE),
    Rule("inefficient_loop_js", "performance", "medium", 0.7, JS, (
        r"for\s*\(\s*var\s+\w+\s*=\s*0\s*;\s*\w+\s*<\s*\w+\.length", r"for\s*\(\s*let\s+\w+\s*=\s*0\s*;\s*\w+\s*<\s*\w+\.length"), False, None, NOT_CODE),
    Rule("list_building", "performance", "low", 0.7, PY, (r"\.append\s*\(.*\).*for\s+.*in",)),
    Rule("needless_list", "performance", "low", 0.6, PY, (r"list\s*\(\s*.*\s*for\s+.*in.*\)",)),
    Rule("memory_growth", "performance", "medium", 0.5, ALL, (
        r"global\s+\w+.*=.*\[\]", r"global\s+\w+.*=.*\{\}", r"\.append\s*\(.*\).*while\s+True", r".*=.*\*.*\d{4,}")),
    Rule("python_habit", "performance", "low", 0.7, PY, (
        r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(", r"in\s+\w+\.keys\s*\(\s*\)", r"list\s*\(\s*\w+\.keys\s*\(\s*\)\s*\)", r"\.has_key\s*\(", r"except\s*:\s*$")),
    Rule("javascript_habit", "performance", "medium", 0.7, JS, (
        r"document\.getElementById.*for\s*\(", r"document\.querySelector.*for\s*\(", r"\.innerHTML\s*\+=",
        r"for\s*\(\s*var\s+\w+\s*=\s*0\s*;\s*\w+\s*<\s*\w+\.length", r"new\s+RegExp\s*\(.*\).*for\s*\(", r"JSON\.parse\s*\(.*JSON\.stringify")),
    Rule("todo_py", "documentation", "info", 0.9, PY, (r"#\s*TODO:?\s*(.+)",), True),
    Rule("todo_js", "documentation", "info", 0.9, JS, (r"//\s*TODO:?\s*(.+)",), True),
    Rule("fixme_py", "documentation", "low", 0.9, PY, (r"#\s*FIXME:?\s*(.+)",), True),
    Rule("fixme_js", "documentation", "low", 0.9, JS, (r"//\s*FIXME:?\s*(.+)",), True),
    Rule("outdated_comment", "documentation", "info", 0.6, ALL, (
        r"(19|20)\d{2}", r"version\s+[0-9.]+", r"deprecated", r"obsolete", r"old\s+way", r"legacy"), True, r"^\s*(#|//|/\*|\*)"),
)


#: Texts of which a lower-case line holds one if a rule of that id matches it: cheap tests before any pattern.
NEEDLES = {
    "sql_injection_py": ["execute", "query", "sql"],
    "sql_injection_js": ["execute", "query", "sql"],
    "command_injection_py": ["os.system", "subprocess.", "eval", "exec"],
    "command_injection_js": ["exec", "eval", "function"],
    "path_traversal": ["../"],
    "weak_crypto_py": ["hashlib.", "random.random", "des", "rc4"],
    "weak_crypto_js": ["math.random", "createhash"],
    "secret_api_key": ["api"],
    "secret_password": ["password", "passwd", "pwd"],
    "secret_token": ["token"],
    "secret_secret": ["secret"],
    "secret_private_key": ["private"],
    "xss": ["innerhtml", "document.write", ".html"],
    "unsafe_deserialization": ["pickle.load", "marshal.load"],
    "dangerous_function_py": ["eval", "exec", "__import__"],
    "dangerous_function_js": ["eval", "function", "settimeout", "setinterval"],
    "insecure_random_py": ["random."],
    "insecure_random_js": ["math.random"],
    "information_leak": ["print", "console.", "traceback."],
    "inefficient_loop_py": ["len"],
    "inefficient_loop_js": ["length"],
    "list_building": [".append"],
    "needless_list": ["list"],
    "memory_growth": ["global", ".append", "*"],
    "python_habit": ["range", "keys", "has_key", "except"],
    "javascript_habit": ["document.", ".innerhtml", "for", "regexp", "json.parse"],
    "todo_py": ["todo"],
    "todo_js": ["todo"],
    "fixme_py": ["fixme"],
    "fixme_js": ["fixme"],
    "outdated_comment": ["19", "20", "version", "deprecated", "obsolete", "old", "legacy"],
}


def chosen(category: str | None = None, language: str | None = None, ids: set[str] | None = None) -> list[Rule]:
    """Rules of a category and language: what isn't asked for never enters the plan."""
    return [
        r for r in RULES
        if (category is None or r.category == category) and (language is None or language in r.languages) and (ids is None or r.id in ids)
    ]


def _first_match(rule: Rule, line: Column, low: Column) -> Column:
    flag = "(?i)" if rule.ignore_case else ""
    found = None
    for k, p in enumerate(rule.patterns):
        test = line.rlike(flag + p)
        found = F.when(test, F.lit(k + 1)) if found is None else found.when(test, F.lit(k + 1))
    if rule.also:
        found = F.when(low.rlike(rule.also), found)
    if rule.unless:
        found = F.when(~F.regexp_replace(low, r"^\s+|\s+$", "").rlike(rule.unless), found)
    return found


def apply_rules(lines: DataFrame, rules: list[Rule], lang: Column) -> DataFrame:
    """Findings of all rules over lines(..., line) in one pass: the lines' columns and the rule's.

    pattern_no is the first pattern of the rule that matches. No shuffle: a filter, one projection and one generator.
    """
    low = F.col("_low")
    kept = lines.withColumn("_low", F.lower("line")).filter(contains_any(low, sorted({n for r in rules for n in NEEDLES[r.id]})))
    matches = []
    for r in rules:
        match = F.when(contains_any(low, NEEDLES[r.id]), _first_match(r, F.col("line"), low))
        matches.append(match if set(r.languages) == set(ALL) else F.when(lang.isin(*r.languages), match))
    numbered = F.transform(F.array(*matches), lambda m, k: F.struct((k + 1).alias("k"), m.alias("pattern_no")))
    found = kept.withColumn("hit", F.explode(F.filter(numbered, lambda h: h["pattern_no"].isNotNull())))
    # What a rule says is looked up for its findings only.
    of = lambda name: F.element_at(F.array(*(F.lit(getattr(r, name)) for r in rules)), F.col("hit.k")).alias("rule_id" if name == "id" else name)
    return found.select(*lines.columns, *map(of, ("id", "category", "severity", "confidence")), "hit.pattern_no")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_of(rules: list[Rule], lines: str, lang: str, columns: str) -> str:
    """The same findings as SQL over a relation `lines` with a column `line`."""
    parts = []
    for r in rules:
        flag = "(?i)" if r.ignore_case else ""
        case = "CASE " + " ".join(f"WHEN regexp_matches(line, {sql_text(flag + p)}) THEN {k + 1}" for k, p in enumerate(r.patterns)) + " END"
        tests = []
        if set(r.languages) != set(ALL):
            tests.append(f"{lang} IN ({', '.join(map(sql_text, r.languages))})")
        if r.also:
            tests.append(f"regexp_matches(lower(line), {sql_text(r.also)})")
        if r.unless:
            tests.append(f"NOT regexp_matches(regexp_replace(lower(line), '^\\s+|\\s+$', '', 'g'), {sql_text(r.unless)})")
        where = " AND ".join(tests) or "true"
        parts.append(
            f"SELECT {columns}, '{r.id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, "
            f"CAST({r.confidence} AS DOUBLE) AS confidence, {case} AS pattern_no FROM {lines} WHERE {where}"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE pattern_no IS NOT NULL"
