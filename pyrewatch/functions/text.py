"""Text columns: normalization, clipping and guard patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pyrewatch.schemas import LEVELS

# Patterns whose hits must match the published results.
LABEL_LEAK = (
    r"(?i)DB_CONNECTION_POOL_EXHAUSTION|MEMORY_LEAK|DOWNSTREAM_SERVICE_TIMEOUT|"
    r"root[ _-]?cause|memory leak|pool exhaust"
)
QUERY_LEAK = (
    r"(?i)DB_CONNECTION_POOL_EXHAUSTION|MEMORY_LEAK|DOWNSTREAM_SERVICE_TIMEOUT|"
    r"\btrue_root_cause\b|\bfault_start_time\b|\bexpected_symptoms\b|"
    r"\broot_cause_variant\b|\broot_cause_service\b|\broot_cause_detail\b|\bscenario\b"
)
CAUSAL_PHRASES = (
    " caused ", " causing ", " because ", " due to ", " led to ", " root cause", " responsible for ",
    " triggered ", " resulting from ",
)
TIMEOUT_WORDS = r"(?i)timed out|timeout|deadline exceeded"
# Keyword families counted in log lines.
KEYWORDS = {
    "timeout / timed out / deadline": TIMEOUT_WORDS,
    "'Database connection timeout'": r"Database connection timeout",
    "pool": r"(?i)\bpool\b|QueuePool|HikariPool",
    "heap / GC": r"(?i)\bheap\b|\bGC\b|\bgc\b|Mark-Compact|garbage",
    "OOM / out of memory": r"(?i)OOM|out of memory|OutOfMemory|MemoryError",
    "HTTP 503 / 502 / 504": r"\b50[234]\b",
    "circuit breaker / ejecting": r"(?i)circuit|ejecting",
    "retry": r"(?i)retry|retrying",
}
# Words looked for in titles and descriptions.
DESCRIPTION_WORDS = (
    "pool", "connection", "memory", "leak", "heap", "oom", "garbage", "downstream", "provider", "network",
    "dependency", "timing out", "timeout",
)
# Fixed value: the time of a postmortem step.
RELATIVE_TIME = r"^[-+]?\d{2}[mh]"
# A run of five or more hex characters holding a digit, written without lookahead.
HEX_RUN = (
    r"[0-9][0-9a-f]{4,}|[a-f][0-9][0-9a-f]{3,}|[a-f]{2}[0-9][0-9a-f]{2,}|"
    r"[a-f]{3}[0-9][0-9a-f]+|[a-f]{4,}[0-9][0-9a-f]*"
)
NUMBER_RUN = r"[0-9]+(\.[0-9]+)?"
# Unicode white space and the ASCII separators.
WHITESPACE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{WHITESPACE}|{WHITESPACE}$", "")


def normalize_level(raw: Column) -> Column:
    """INFO, WARN or ERROR in any case and padding; null for every other level."""
    upper = F.upper(stripped(raw))
    level = F.when(upper == "WARNING", "WARN").otherwise(upper)
    return F.when(level.isin(*LEVELS), level)


def template_of(message: Column) -> Column:
    """The message with ids and numbers replaced, so equal lines can be counted."""
    return F.regexp_replace(F.regexp_replace(message, HEX_RUN, "#"), NUMBER_RUN, "#")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def clip(text: Column, limit: int) -> Column:
    """Whitespace collapsed; longer texts end in ``...`` and have ``limit`` characters."""
    flat = squeeze(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def sentence(text: Column) -> Column:
    """Collapsed text closed with a full stop; null when nothing is left."""
    flat = squeeze(text)
    closed = F.when(flat.endswith("."), flat).otherwise(F.concat(flat, F.lit(".")))
    return F.when(flat != "", closed)


def has_causal_phrase(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return reduce(lambda a, b: a | b, [padded.contains(phrase) for phrase in CAUSAL_PHRASES])


def non_blank(text: Column) -> Column:
    """Trimmed text, or null when it is blank."""
    trimmed = stripped(text)
    return F.when(trimmed != "", trimmed)


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def fixed(number: Column, digits: int) -> Column:
    """Fixed-point text, rounded half to even on the exact binary value, without group separators."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", number, F.lit(pattern))
