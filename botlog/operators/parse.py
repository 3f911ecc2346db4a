"""Raw log text -> typed request table (a map-only job: no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botlog.functions import logformat as lf

REQUEST_COLUMNS = ("ip", "timestamp", "method", "path", "protocol", "status",
                   "bytes_sent", "referrer", "user_agent", "tz_offset")


def parse_raw_fields(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Matching lines -> the nine captured groups as strings; other lines
    are dropped (count them with :func:`rejected_lines`)."""
    v = F.col(value_col)
    fields = (lines.select(F.explode(lf.field_array_rows(v)).alias("_f"))
              .filter(F.size(F.col("_f")) == len(lf.RAW_FIELDS)))
    return fields.select(*[F.col("_f")[i].alias(name) for i, name in enumerate(lf.RAW_FIELDS)])


def type_raw_fields(raw: DataFrame) -> DataFrame:
    """Rename and coerce: ``datetime`` -> ``timestamp`` (instant, plus its
    ``tz_offset``), ``size`` -> ``bytes_sent``, ``status`` numeric."""
    dt = F.col("datetime")
    return raw.select(
        "ip",
        lf.parse_timestamp(dt).alias("timestamp"),
        "method",
        "path",
        "protocol",
        lf.coerce_status(F.col("status")).alias("status"),
        lf.coerce_bytes(F.col("size")).alias("bytes_sent"),
        "referrer",
        "user_agent",
        lf.tz_offset(dt).alias("tz_offset"),
    )


def parse_log_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Combined-format lines -> request table (see ``REQUEST_COLUMNS``)."""
    return type_raw_fields(parse_raw_fields(lines, value_col))


def rejected_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Lines that are not combined-format records."""
    return lines.filter(~lf.line_matches(F.col(value_col)))


def with_null_tokens(requests: DataFrame, columns=lf.STRING_COLUMNS) -> DataFrame:
    """The request table as a CSV round trip leaves it: missing-value tokens
    in string columns become null. Features and marts consume this form."""
    present = set(requests.columns)
    return requests.withColumns({c: lf.null_token(F.col(c)) for c in columns if c in present})
