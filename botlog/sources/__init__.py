"""Scans and sinks."""

from botlog.sources.events_log import access_log_lines, read_events
from botlog.sources.files import (
    REQUEST_SCHEMA,
    read_log_text,
    read_parsed_log,
    read_parsed_log_csv,
    read_scores,
    write_clustered_log,
    write_parsed_log,
    write_parsed_log_csv,
    write_scores,
)

__all__ = [
    "access_log_lines",
    "read_events",
    "REQUEST_SCHEMA",
    "read_log_text",
    "read_parsed_log",
    "read_parsed_log_csv",
    "read_scores",
    "write_clustered_log",
    "write_parsed_log",
    "write_parsed_log_csv",
    "write_scores",
]
