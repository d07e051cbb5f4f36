"""Column functions over text: tokenisers, token estimates, snippets, lines, paths, redaction and question routing.

All are built-in expressions, so they run inside generated code and take part in column pruning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"

#: Words a question may contain without meaning.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "does", "do", "for", "from", "how", "in", "is", "it", "of", "on", "or",
    "should", "the", "to", "when", "what", "which", "why", "with",
)

#: Words of a question that name no symbol.
SYMBOL_STOP_WORDS = (
    "what", "does", "which", "where", "when", "why", "how", "impact", "call", "calls", "caller", "callers", "chain", "tests", "test",
    "change", "changing", "affect", "affected", "will", "the",
)

#: What counts as a term, and as a token of an estimate.
TOKEN = r"[㐀-鿿]+|[A-Za-z]+|[0-9]+"
TOKEN_ESTIMATE = r"(?U)[一-鿿]|[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|[^\s]"
LINE_BREAK = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\x85\\u2028\\u2029]"

#: Intents in order of precedence, with the words that signal them.
INTENTS = (
    ("security_review", ("安全", "认证", "密钥", "注入", "权限", "漏洞", "secret", "token", "password", "security")),
    ("dependency_impact", ("影响", "依赖", "调用链", "谁调用", "受影响", "改动", "回归", "impact", "dependency", "call chain")),
    ("test_runtime", ("测试", "用例", "失败", "运行", "启动", "报错", "构建", "test", "pytest", "vitest")),
    ("repository_navigation", ("概览", "架构", "从哪里开始", "怎么读", "主要模块", "入口", "overview", "architecture", "reading guide")),
    ("language_structure", ("继承", "接口", "符号", "类结构", "函数结构", "方法列表", "typescript", "python", "class hierarchy", "symbol")),
)


def fold(text: Column) -> Column:
    """Lower case without accents, as the index tokeniser sees it."""
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def index_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def query_terms(text: Column) -> Column:
    """Distinct terms in order of appearance: CJK runs and their characters, words and their camel-case parts, numbers."""
    raw = F.regexp_extract_all(F.replace(text, F.lit("\\"), F.lit("/")), F.lit(f"({TOKEN})"))
    camel = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

    def expand(t: Column) -> Column:
        parts = F.filter(F.split(t, camel), lambda p: p != "")
        characters = F.filter(F.split(t, ""), lambda c: c != "")
        cjk = F.rlike(t, F.lit("^[㐀-鿿]"))
        more = F.when(cjk & (F.char_length(t) > 1), characters).when(~cjk & (F.size(parts) > 1), F.transform(parts, lambda p: F.lower(p)))
        return F.concat(F.array(F.when(cjk, t).otherwise(F.lower(t))), F.coalesce(more, F.array().cast("array<string>")))

    return F.array_distinct(F.flatten(F.transform(raw, expand)))


def meaningful_terms(terms: Column) -> Column:
    return F.filter(terms, lambda t: (F.char_length(t) >= 3) & ~t.isin(*STOP_WORDS))


def wants_cooccurrence(query: Column, terms: Column) -> Column:
    """Plain English with at least four meaningful terms; identifiers, paths and other scripts match any term."""
    identifier = F.rlike(query, F.lit(r"[_/\\.]|\b[a-z]+[A-Z][A-Za-z0-9]*\b"))
    return ~identifier & (F.octet_length(query) == F.char_length(query)) & (F.size(meaningful_terms(terms)) >= 4)


def estimate_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN_ESTIMATE})")))


def truncate_tokens(text: Column, most: Column) -> Column:
    """The text cut to ``most`` estimated tokens: whole lines, then words of the next line, else characters; a cut ends in a mark."""
    lines = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\n]*\n|[^\n]+)"))
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def words(line: Column, used: Column) -> Column:
        start = F.struct(F.expr("cast(array() as array<string>)").alias("words"), used.alias("used"), F.lit(False).alias("full"))
        fits = lambda a, w: ~a["full"] & (a["used"] + estimate_tokens(w) <= most)
        step = lambda a, w: F.struct(
            F.when(fits(a, w), F.concat(a["words"], F.array(w))).otherwise(a["words"]).alias("words"),
            F.when(fits(a, w), a["used"] + estimate_tokens(w)).otherwise(a["used"]).alias("used"),
            (~fits(a, w)).alias("full"),
        )
        return F.aggregate(F.filter(F.split(line, r"\s+"), lambda w: w != ""), start, step, lambda a: F.array_join(a["words"], " "))

    def step(a: Column, line: Column) -> Column:
        n = estimate_tokens(line)
        fits = ~a["full"] & (a["used"] + n <= most)
        more = F.when(a["full"], "").when(fits, line).otherwise(words(line, a["used"]))
        return F.struct(F.concat(a["text"], more).alias("text"), F.when(fits, a["used"] + n).otherwise(a["used"]).alias("used"), (~fits).alias("full"))

    kept = F.aggregate(lines, state, step, lambda a: F.regexp_replace(a["text"], r"\s+$", ""))
    kept = F.when(kept == "", F.left(text, F.greatest(most, F.lit(1)).cast("int"))).otherwise(kept)
    return F.when(estimate_tokens(text) <= most, text).when(kept == text, kept).otherwise(F.concat(kept, F.lit("\n…")))


def symbol_term(question: Column) -> Column:
    """The name a question is about: its longest dotted, underscored or inner-capital word, else its longest word, else its last."""
    tokens = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"([A-Za-z_][A-Za-z0-9_.]*|[一-鿿]+)"))
    named = F.filter(tokens, lambda t: ~F.lower(t).isin(*SYMBOL_STOP_WORDS))
    longest = lambda found: F.try_element_at(F.array_sort(found, lambda a, b: F.char_length(b) - F.char_length(a)), F.lit(1))
    long_ = lambda t: F.char_length(t) >= 3
    marked = longest(F.filter(named, lambda t: long_(t) & F.rlike(t, F.lit("[._]|^.+[A-Z]"))))
    plain = longest(F.filter(named, lambda t: long_(t) & F.rlike(t, F.lit("^[A-Za-z_][A-Za-z0-9_]*$"))))
    last = F.try_element_at(F.filter(named, lambda t: F.char_length(t) >= 2), F.lit(-1))
    word = F.try_element_at(F.filter(F.split(F.trim(question), r"\s+"), lambda w: F.char_length(w) >= 2), F.lit(-1))
    return F.coalesce(marked, plain, last, word, F.left(question, F.lit(80)))


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the end of the text adds none."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAK)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def snippet(text: Column, width: int = 280) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > width, F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit("..."))).otherwise(flat)


def mask_secret(value: Column) -> Column:
    """Four dots and the last four characters; of a value of four or fewer only dots; null for none."""
    n = F.char_length(value)
    return F.when(n == 0, F.lit(None)).when(n <= 4, F.repeat(F.lit("•"), n)).otherwise(F.concat(F.lit("••••"), F.right(value, F.lit(4))))


def route_intent(question: Column) -> Column:
    low, found = F.lower(question), None
    for intent, words in INTENTS:
        met = F.lit(False)
        for w in words:
            met = met | F.contains(low, F.lit(w))
        found = F.when(met, intent) if found is None else found.when(met, intent)
    return found.otherwise("direct_qa")


def has_precise_symbol(question: Column) -> Column:
    """A dotted, underscored or inner-capital word of three characters or more."""
    words = F.regexp_extract_all(question, F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)"))
    return F.exists(words, lambda w: (F.char_length(w) >= 3) & F.rlike(w, F.lit(r"[._]|^.+[A-Z]")))


#: What redaction looks for, in its order, as (pattern, replacement).
_BEFORE_QUERY = (
    (r"(?i)(https?://hooks\.slack\.com/services/)[^\s/\"'`<>]+/[^\s/\"'`<>]+/[^\s?#\"'`<>]+", "$1[redacted]"),
    (r"(?i)(https?://(?:canary\.|ptb\.)?discord(?:app)?\.com/api(?:/v[0-9]+)?/webhooks/)[^\s/\"'`<>]+/[^\s?#\"'`<>]+", "$1[redacted]"),
    (r"(?i)(authorization\s*[:=]\s*)(?:(bearer|basic)\s+)?[^\r\n,;\"'`<>]+", "$1$2 [redacted]"),
    (r"(?i)(https?:)//[^\s/\"'`<>@]+@", "$1//[redacted]@"),
)
_AFTER_QUERY = (
    (r"(?i)(https?://[^\s\"'`<>#]+)#[^\s\"'`<>]*", "$1"),
    (r"(?i)((?:api[_-]?key|access[_-]?token|refresh[_-]?token|token|password|passwd|secret|credential)\s*[:=]\s*)[^\s,;\"'`<>]+", "$1[redacted]"),
    (r"(?i)([\"'`])(?:[A-Za-z]:[\\/]|\\\\|/(?!/))[^\r\n\"'`<>]*\1", "$1[local path]$1"),
    (r"(?im)(^|[\s(\"'`=:])(?:[A-Za-z]:[\\/][^\r\n,;\"'`<>]*|\\\\[^\r\n,;\"'`<>]+|/(?!/)[^\r\n,;\"'`<>]+)", "$1[local path]"),
)
_PARAMETER = r"(?i)(?:api[_-]?key|access[_-]?token|refresh[_-]?token|token|auth(?:orization)?|password|passwd|secret|credential|signature|sig)"


def redact(text: Column) -> Column:
    """Secrets, credentials in URLs, headers and query parameters, fragments, and absolute paths, replaced in a fixed order."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in _BEFORE_QUERY:
        out = F.regexp_replace(out, pattern, to)
    out = F.regexp_replace(F.replace(out, F.lit("  [redacted]"), F.lit(" [redacted]")), r"(?i)(authorization\s*[:=])\s*\[redacted\]", "$1 [redacted]")
    # sensitive parameters of a URL go with their separator; a question mark that has nothing left after it goes, too
    key = _PARAMETER + r"=[^&#\s\"'`<>]*"
    out = F.regexp_replace(out, r"(?<=[?&])" + key + r"(?:&|(?=[#\s\"'`<>]|$))", "")
    out = F.regexp_replace(out, r"(?i)(https?://[^\s\"'`<>?#]+)\?(?=[#\s\"'`<>]|$)", "$1")
    out = F.regexp_replace(out, r"(?i)(https?://[^\s\"'`<>#]+)&(?=[#\s\"'`<>]|$)", "$1")
    for pattern, to in _AFTER_QUERY:
        out = F.regexp_replace(out, pattern, to)
    return out


SENSITIVE_QUERY_KEY = r"(?i)(api[_-]?key|access[_-]?token|refresh[_-]?token|token|auth(orization)?|password|passwd|secret|credential|signature|sig)"


def redact_url(url: Column, sensitive: str = SENSITIVE_QUERY_KEY) -> Column:
    """User info masked, sensitive query parameters and the fragment removed."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"(?i)^(https?:)//[^/?#@]+@", "$1//[redacted]@")
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_extract(bare, r"\?(.*)$", 1)).otherwise("")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(F.element_at(F.split(p, "="), 1), F.lit(sensitive))), "&")
    base = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)


def normalize_url(url: Column) -> Column:
    """A source's identity: scheme and host lower case, no trailing slash or .git, path lower case, no query or fragment."""
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r"\.git$", ""))


# --- paths -----------------------------------------------------------------------------------------------------------

#: Fixed values.
IGNORED_SEGMENTS = (".git", "node_modules", "dist", "build", "coverage", "e2e-artifacts", ".claude", ".codex", "__pycache__", ".next", ".venv", "venv")
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".json": "json",
    ".md": "markdown", ".toml": "toml", ".yml": "yaml", ".yaml": "yaml", ".txt": "text",
}
TEXT_NAMES = ("dockerfile", "makefile", "readme", "license", ".gitignore", ".dockerignore")
TEST_SEGMENTS = ("test", "tests", "spec", "specs", "__tests__")


def _literals(values) -> Column:
    return F.array(*map(F.lit, values))


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_ignored(path: Column) -> Column:
    return F.arrays_overlap(folders(path), _literals(IGNORED_SEGMENTS))


def detect_language(path: Column) -> Column:
    name = F.lower(file_name(path))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.coalesce(F.try_element_at(known, suffix), F.when(name.isin(*TEXT_NAMES), "text"))


def is_test_path(path: Column) -> Column:
    low = F.lower(path)
    stem = F.regexp_replace(file_name(low), r"(?<=.)\.[^.]+$", "")
    return F.arrays_overlap(folders(low), _literals(TEST_SEGMENTS)) | F.rlike(stem, F.lit(r"^test_|^test$|(_test|\.test|\.spec)$"))


def safe_path(path: Column) -> Column:
    """The path with forward slashes and without leading ``./``; null where it is absolute, has a drive or climbs."""
    flat = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    bad = F.rlike(flat, F.lit("^/|^[A-Za-z]:")) | F.array_contains(F.split(flat, "/"), "..") | (F.trim(flat) == "")
    return F.when(~bad, flat)
