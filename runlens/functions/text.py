"""Column functions over text: redaction, shortening, secret names, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The secret-name test and the four value patterns, in the order they are applied.
SECRET_NAME = (
    r"(?i)(pass(word|wd)?|pwd|secret|token|api[_-]?key|apikey|auth|credential|private[_-]?key|dsn"
    r"|conn(ection)?[_-]?str)"
)
SECRET_VALUES = [
    (r"(?U)(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 ***"),
    (r"(?U)(://[^/\s:@]+:)[^@\s/]+@", "$1***@"),
    (r"(?U)\b(sk|pk|rk|ghp|gho|ghs|xox[abpr]|AKIA|ASIA|AIza)[-_A-Za-z0-9]{12,}", "***"),
    (
        r"(?U)(?i)([?&](?:key|token|apikey|api_key|access_token|secret|password|sig|signature)=)[^&\s]+",
        "$1***",
    ),
]
# Fixed value: the access-log line (address, method, path, status, size).
LOG_LINE = r'(?U)(\S+) .* "(\w+) (\S+) [^"]*" (\d{3}) (\d+)'
MASK = "***"
ELLIPSIS = "…"


def redact(text: Column) -> Column:
    for pattern, replacement in SECRET_VALUES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def is_secret_name(name: Column) -> Column:
    return F.regexp_like(name, F.lit(SECRET_NAME))


def short(text: Column, n: int = 120) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit(ELLIPSIS))).otherwise(text)


def cell(value: Column, n: int = 24) -> Column:
    """How a value is shown in a table: text, redacted, at most ``n`` characters; a missing one as None."""
    return F.coalesce(short(redact(value.cast("string")), n), F.lit("None"))


def masked(name: str | Column, value: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(is_secret_name(name), F.lit(MASK)).otherwise(redact(value))


def log_fields(line: Column) -> dict[str, Column]:
    """Fields of an access-log line, by name; the size stays text."""
    names = ["ip", "method", "path", "status", "bytes"]
    fields = {n: F.regexp_extract(line, LOG_LINE, i + 1) for i, n in enumerate(names)}
    fields["status"] = fields["status"].cast("int")
    return fields


def is_log_line(line: Column) -> Column:
    return F.regexp_like(line, F.lit(LOG_LINE))


def endpoint(path: Column) -> Column:
    """Cut the query string, then every ``/<digits>`` becomes ``/:id`` (also as a prefix: /12ab -> /:idab)."""
    return F.regexp_replace(F.split_part(path, F.lit("?"), F.lit(1)), "/[0-9]+", "/:id")


def percent(rate: Column) -> Column:
    return F.format_string("%.1f%%", rate * 100)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w.-]", "_")


def first_line(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"\r\n|\n|\r")[0]


def line_slice(text: Column, first: Column, last: Column) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, first.cast("int"), (last - first + 1).cast("int")), "\n")


def database_label(dsn: Column) -> Column:
    return redact(F.substring(F.split_part(dsn, F.lit(" "), F.lit(1)), 1, 60))
