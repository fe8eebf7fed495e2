"""Text column expressions: log levels, line flags, word sets, topic tags.

All are built-in Catalyst expressions (regex, contains, higher-order array
functions) so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's rules) ---------------------
# line flags, case-insensitive
ERROR_LINE = "error|exception|fatal|panic|fail"
OOM_LINE = "oomkilled|out of memory|heap space|memory limit"
CONNECTION_LINE = "connection refused|econnrefused|connection reset|timeout"

# topic label -> keywords looked up as substrings of the lower-cased title;
# a title can carry several topics; order of topics is the output order
TOPIC_KEYWORDS = [
    ("rust", ["rust", "rustlang", "cargo"]),
    ("python", ["python", "django", "fastapi", "flask", "pandas", "numpy"]),
    ("ai", ["ai", "llm", "gpt", "machine learning", "neural", "transformer",
            "diffusion", "openai", "anthropic", "gemini", "claude"]),
    ("web", ["react", "vue", "svelte", "angular", "javascript", "typescript",
             "css", "html", "nextjs", "remix", "htmx", "wasm"]),
    ("go", [" go ", "golang"]),
    ("systems", ["kernel", "syscall", "memory", "allocator", "compiler", "llvm",
                 "zig", "c++", "assembly"]),
    ("security", ["security", "exploit", "vulnerability", "cve", "breach",
                  "ransomware", "phishing", "zero-day"]),
    ("cloud", ["aws", "gcp", "azure", "kubernetes", "k8s", "docker",
               "terraform", "serverless", "lambda"]),
    ("database", ["postgres", "mysql", "sqlite", "redis", "mongodb", "clickhouse",
                  "duckdb", "sql", "nosql"]),
    ("open-source", ["open source", "open-source", "github", "oss", "foss"]),
    ("startup", ["startup", "ycombinator", "yc ", "series a", "seed round",
                 "funding", "acquisition"]),
    ("devtools", ["ide", "vscode", "neovim", "vim", "terminal", "shell",
                  "cli", "debugging", "profiling"]),
]
# --------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_level(message) -> Column:
    """Ordered substring rules on the lower-cased message."""
    m = F.lower(_c(message))
    return (F.when(m.contains("error") | m.contains("exception") | m.contains("fatal"), "error")
            .when(m.contains("warn"), "warn")
            .when(m.contains("debug") | m.contains("trace"), "debug")
            .otherwise("info"))


def is_error_line(message) -> Column:
    """E2."""
    return F.coalesce(F.lower(_c(message)).rlike(ERROR_LINE), F.lit(False))


def is_oom_line(message) -> Column:
    """E3."""
    return F.coalesce(F.lower(_c(message)).rlike(OOM_LINE), F.lit(False))


def is_connection_error_line(message) -> Column:
    """E3."""
    return F.coalesce(F.lower(_c(message)).rlike(CONNECTION_LINE), F.lit(False))


def word_set(*parts) -> Column:
    """lower(join(parts, ' ')), split on whitespace, words longer than 3
    characters, distinct.  Array parts (tags) are joined with spaces."""
    cols = [F.array_join(_c(p), " ") if isinstance(p, tuple) else _c(p) for p in parts]
    text = F.lower(F.concat_ws(" ", *cols))
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 3))


def truncate(c, n: int) -> Column:
    """First n characters."""
    return F.substring(_c(c), 1, n)


def short_sha(c) -> Column:
    """7-character commit id."""
    return F.substring(_c(c), 1, 7)


def topic_tags(title, whole_word: bool = False) -> Column:
    """Topics whose keyword occurs in the lower-cased title (substring
    match, as in the reference; ``whole_word`` requires word borders)."""
    low = F.lower(_c(title))
    topics = F.array(*[
        F.struct(F.lit(t).alias("topic"), F.array(*[F.lit(k) for k in kws]).alias("kws"))
        for t, kws in TOPIC_KEYWORDS
    ])
    if whole_word:
        matched = F.filter(topics, lambda t: F.exists(t["kws"], lambda k: F.regexp_like(
            low, F.concat(F.lit("(^|[^a-z0-9])"), k, F.lit("([^a-z0-9]|$)")))))
    else:
        matched = F.filter(topics, lambda t: F.exists(t["kws"], lambda k: F.instr(low, k) > 0))
    return F.transform(matched, lambda t: t["topic"])
