"""Column expressions for the combined access-log format.

Everything here is a native Catalyst expression (regex, string and cast
functions) so parsing runs inside whole-stage codegen on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the reference's behaviour)
#
# Combined log format, nine capture groups in this order:
#   ip, datetime, method, path, protocol, status, size, referrer, user_agent
# The match is anchored at the start of the line only (trailing text is
# ignored); referrer and user agent need at least one character.
LOG_PATTERN = r'(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" (\d+) (\S+) "([^"]+)" "([^"]+)"'
RAW_FIELDS = ("ip", "datetime", "method", "path", "protocol", "status", "size", "referrer", "user_agent")
# Apache time stamp, e.g. 25/Nov/2025:06:31:10 +1100; one-digit days, hours,
# minutes and seconds and offsets written +11:00 or Z are accepted too. The
# pattern asks for exactly one offset, which the format alone cannot.
TIMESTAMP_FORMAT = "d/MMM/yyyy:H:m:s [XXX][XX]"
TIMESTAMP_PATTERN = r"^[0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}:[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2} ([+-][0-9]{2}:?[0-9]{2}|Z)$"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Strings a CSV round trip of the parsed log turns into missing values
# (the default missing-value tokens of the CSV reader the reference uses).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# ---------------------------------------------------------------------------

# Java regex: (?U) makes \S and \d Unicode-aware like Python's str patterns.
ANCHORED_PATTERN = "(?U)^" + LOG_PATTERN
_SEP = "\u0001"
_REPLACEMENT = _SEP.join(f"${i}" for i in range(1, len(RAW_FIELDS) + 1))

STRING_COLUMNS = ("ip", "method", "path", "protocol", "referrer", "user_agent")


def line_matches(value: Column) -> Column:
    """True when the line is a combined-format record."""
    return value.rlike(ANCHORED_PATTERN)


def raw_field_array(value: Column) -> Column:
    """array<string> of the nine groups, or an array of another size when the
    line does not match.

    One regex pass per line: the whole line is rewritten to the groups joined
    by U+0001 and split. Lines that already contain U+0001 (never seen in
    real logs) take the exact nine-``regexp_extract`` path instead.
    """
    fast = F.split(F.regexp_replace(value, ANCHORED_PATTERN + "(?s:.*)", _REPLACEMENT), _SEP, -1)
    slow = F.when(line_matches(value),
                  F.array(*[F.regexp_extract(value, ANCHORED_PATTERN, i)
                            for i in range(1, len(RAW_FIELDS) + 1)]))
    return F.when(F.instr(value, _SEP) == 0, fast).otherwise(slow)


def field_array_rows(value: Column) -> Column:
    """Generator input: a one-element array holding :func:`raw_field_array`.

    Exploding it and then keeping arrays of nine fields filters and extracts
    with a single regex evaluation: the size filter references the generated
    column, so Catalyst cannot push a second copy of the regex below the
    generator (it would if the fields were a plain projection)."""
    return F.array(raw_field_array(value))


def parse_timestamp(text: Column) -> Column:
    """Apache time stamp -> instant (TimestampType); bad text -> null."""
    return F.when(text.rlike(TIMESTAMP_PATTERN), F.try_to_timestamp(text, F.lit(TIMESTAMP_FORMAT)))


def tz_offset(text: Column) -> Column:
    """The offset of a parseable time stamp as ``+hhmm``, else null."""
    off = F.regexp_replace(F.substring_index(text, " ", -1), ":", "")
    return F.when(parse_timestamp(text).isNotNull(), F.when(off == "Z", "+0000").otherwise(off))


def coerce_status(text: Column) -> Column:
    """Status text -> bigint, null when not a number."""
    return text.try_cast("bigint")


def coerce_bytes(text: Column) -> Column:
    """Size text -> bigint: a decimal number truncated toward zero, anything
    else (``-``, junk, hexadecimal or typed literals, overflow) -> 0."""
    as_long = text.try_cast("double").try_cast("bigint")
    return F.coalesce(F.when(text.rlike(NUMBER_PATTERN), as_long), F.lit(0).cast("bigint"))


def null_token(col: Column) -> Column:
    """A string after a CSV round trip: missing-value tokens become null."""
    return F.when(col.isin(*NULL_TOKENS), F.lit(None).cast("string")).otherwise(col)


def drop_invalid_utf8(value: Column) -> Column:
    """Invalid UTF-8 byte sequences are dropped (decode with errors ignored)."""
    return F.translate(F.make_valid_utf8(value), "�", "")
