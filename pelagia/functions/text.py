"""Text rules shared by traces and conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: credential patterns and the texts that replace them -------------------
BEARER = r"\bbearer\s+[^\s,;]+"
URL_LOGIN = r"([a-z][a-z0-9+.-]*://)([^\s/:@]+):([^\s/@]+)@"
ASSIGNMENT = (r"\b(api[-_ ]?key|authorization|client[-_ ]?secret|password|passwd|"
              r"access[-_ ]?token|refresh[-_ ]?token|secret)\b(\s*[:=]\s*)([^\s,;&]+)")
BEARER_TO = "Bearer [REDACTED]"
URL_LOGIN_TO = "$1[REDACTED]@"
ASSIGNMENT_TO = "$1$2[REDACTED]"
TEXT_LIMIT = 4_000
TITLE_LIMIT = 80
# --- end of fixed values ------------------------------------------------------------------

# Case-insensitive, with Unicode word and blank classes, as Python's ``re.I`` on text.
JVM_FLAGS = "(?iU)"


def redact(text: Column) -> Column:
    """Bearer values, URL logins and ``key=value`` secrets are replaced, in this order."""
    text = F.regexp_replace(text, JVM_FLAGS + BEARER, BEARER_TO)
    text = F.regexp_replace(text, JVM_FLAGS + URL_LOGIN, URL_LOGIN_TO)
    return F.regexp_replace(text, JVM_FLAGS + ASSIGNMENT, ASSIGNMENT_TO)


def bounded(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """Cut text past ``limit`` characters and say how many were left out."""
    size = F.char_length(text)
    note = F.concat(F.lit("\n[TRUNCATED "), (size - limit).cast("string"), F.lit(" CHARACTERS]"))
    return F.when(size > limit, F.concat(F.substring(text, 1, limit), note)).otherwise(text)


def safe_text(text: Column, limit: int = TEXT_LIMIT) -> Column:
    return bounded(redact(text), limit)


def title(text: Column, limit: int = TITLE_LIMIT) -> Column:
    """One line of at most ``limit`` characters."""
    line = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.when(F.char_length(line) <= limit, line).otherwise(
        F.concat(F.substring(line, 1, limit - 1), F.lit("…")))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds, half to even, never negative."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(F.lit(0).cast("long"),
                      F.bround(micros / F.lit(1000.0), 0).cast("long"))
