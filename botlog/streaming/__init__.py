"""Structured Streaming jobs."""

from botlog.streaming.ingest import start_flag_stream, start_ingest_stream, start_session_stream
from botlog.streaming.traffic import log_stream, start_traffic_stream, traffic_counts

__all__ = ["log_stream", "start_flag_stream", "start_ingest_stream", "start_session_stream", "start_traffic_stream", "traffic_counts"]
